"""Break plans: content segments and reels put in playing order.

Every entry gets a sort key computed from its own position, so a plan is a union of rows and never
a list built in one place. Tables, one row per entry:
  bases  block_id, path, offset, duration, clip_duration, strategy, start_bump, start_bump_seconds,
         end_bump, end_bump_seconds
  reels  block_id, reel_no (0-based), entry_no, path, duration, content_type
  cuts   block_id, seg_no (0-based), chapter_start, chapter_end   (optional break points)
  clips  block_id, clip_no (0-based), path, duration, content_type
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_OUT = ["block_id", "major", "minor", "path", "skip", "duration", "content_type"]
_START, _END = -2, 2**40


def _entry(df: DataFrame, major: Column, minor: Column, path: str, skip: Column, duration: Column, kind: Column) -> DataFrame:
    return df.select(
        "block_id", major.cast("bigint").alias("major"), minor.cast("bigint").alias("minor"), F.col(path).alias("path"),
        skip.cast("double").alias("skip"), duration.cast("double").alias("duration"), kind.alias("content_type"))


def _bumps(bases: DataFrame) -> DataFrame:
    zero, kind = F.lit(0), F.lit("bump")
    start = _entry(bases.filter("start_bump IS NOT NULL"), F.lit(_START), zero, "start_bump", zero,
                   F.col("start_bump_seconds"), kind)
    end = _entry(bases.filter("end_bump IS NOT NULL"), F.lit(_END), zero, "end_bump", zero, F.col("end_bump_seconds"), kind)
    return start.unionByName(end)


def _reel_counts(bases: DataFrame, reels: DataFrame) -> DataFrame:
    counts = reels.groupBy("block_id").agg((F.max("reel_no") + 1).alias("breaks"))
    return bases.join(counts, "block_id", "left").withColumn("breaks", F.coalesce("breaks", F.lit(0)))


def assemble_plan(bases: DataFrame, reels: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Plan rows of each block in (major, minor) order.

    With fewer than two reels, or the strategies end and center, the content plays whole or in two
    halves; otherwise reels alternate with the break-point segments, or with equal parts of the
    content where there are none.
    """
    sized = _reel_counts(bases, reels)
    if cuts is not None:
        sized = sized.join(cuts.select("block_id").distinct().withColumn("has_cuts", F.lit(True)), "block_id", "left")
    else:
        sized = sized.withColumn("has_cuts", F.lit(None).cast("boolean"))
    center = F.col("strategy") == "center"
    whole = (F.col("breaks") <= 1) | F.col("strategy").isin("end", "center")
    sized = sized.withColumn("mode", F.when(center, "center").when(whole, "whole")
                             .when(F.col("has_cuts"), "cuts").otherwise("even"))
    feature, zero = F.lit("feature"), F.lit(0)
    half = F.col("duration") / 2
    uncut = _entry(sized.filter("mode = 'whole'"), zero, zero, "path", F.col("offset"), F.col("duration"), feature)
    first = _entry(sized.filter("mode = 'center'"), zero, zero, "path", F.col("offset"), half, feature)
    second = _entry(sized.filter("mode = 'center'"), F.lit(_END - 1), zero, "path", F.col("offset") + half, half, feature)
    piece = F.col("clip_duration") / F.col("breaks")
    even = sized.filter("mode = 'even'").withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("breaks") - 1).cast("int"))))
    parts = _entry(even, F.col("i") * 2, zero, "path", F.col("offset") + piece * F.col("i"), piece, feature)
    content = uncut.unionByName(first).unionByName(second).unionByName(parts)
    if cuts is not None:
        at_cuts = sized.filter("mode = 'cuts'").select("block_id", "path").join(cuts, "block_id")
        content = content.unionByName(_entry(
            at_cuts, F.col("seg_no") * 2, zero, "path", F.col("chapter_start"),
            F.col("chapter_end") - F.col("chapter_start"), feature))
    filler = reels.join(sized.select("block_id", "mode"), "block_id")
    spread = F.when(F.col("mode").isin("cuts", "even"), F.col("reel_no") * 2 + 1).otherwise(F.col("reel_no") + 1)
    filled = _entry(filler, spread, F.col("entry_no"), "path", zero, F.col("duration"), F.col("content_type"))
    return content.unionByName(filled).unionByName(_bumps(bases)).select(*_OUT)


def assemble_clip_plan(bases: DataFrame, clips: DataFrame, reels: DataFrame) -> DataFrame:
    """Plan rows of clip blocks: reels after the clips, between two halves, or spread over the clips."""
    sized = _reel_counts(bases.select("block_id", "strategy"), reels).join(
        clips.groupBy("block_id").agg((F.max("clip_no") + 1).alias("clips")), "block_id", "left")
    k, b, r = F.coalesce("clips", F.lit(0)), F.col("breaks"), F.col("reel_no")
    after_all = k * 2 + 1
    every = F.bround(k / F.nullif(b, F.lit(0)).cast("double"))
    apart = (r + 1) * every
    each = F.floor(b / (k + 1))
    extra = b % (k + 1)
    dense = extra * (each + 1)
    slot = F.when(r < dense, F.floor(r / (each + 1))).otherwise(
        extra + F.floor((r - dense) / F.nullif(each, F.lit(0))))
    after = (
        F.when((b <= 1) | (F.col("strategy") == "end"), F.lit(None).cast("bigint"))
        .when(F.col("strategy") == "center", F.floor(k / 2) - 1)
        .when(k > b, F.when(apart < k, apart))
        .otherwise(F.when(slot < k, slot))
    )
    placed = reels.join(sized, "block_id")
    major = F.coalesce(after * 2 + 1, after_all)
    zero = F.lit(0)
    filled = _entry(placed, major, F.col("reel_no") * 1000000 + F.col("entry_no"), "path", zero, F.col("duration"),
                    F.col("content_type"))
    content = _entry(clips, F.col("clip_no") * 2, zero, "path", zero, F.col("duration"), F.col("content_type"))
    return content.unionByName(filled).unionByName(_bumps(bases)).select(*_OUT)


def plan_end(plan: DataFrame) -> DataFrame:
    """Entries and total seconds of each assembled plan."""
    return plan.groupBy("block_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("duration").alias("seconds"))
