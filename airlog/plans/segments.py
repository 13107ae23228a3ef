"""Content segments between breaks: from marks, from detected black frames, merged and thinned.

Segment tables have path, chapter_start and chapter_end in seconds, one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airlog.operators.scan import OrderedScan, Running, spread
from airlog.session import durable

# Fixed value: breaks closer than this to either end, and shorter segments, are not used.
MIN_SECONDS = 60

#: Seconds of a file, and positions, that are scanned together.
WIDTH, POSITIONS = 600, 1000


def _next(df: DataFrame, value: str, name: str, order: list[str], width: float) -> DataFrame:
    """Value of the following row of the same path, by scanning the order backwards."""
    back = df.withColumns({f"_back_{c}": -F.col(c) for c in order})
    seen = OrderedScan(back, ["path"], [f"_back_{c}" for c in order], width).running(
        Running(name, "last", F.col(value), inclusive=False))
    return seen.result().drop(*[f"_back_{c}" for c in order])


#: The buckets of rows without a start, behind all others or before them.
_LAST, _FIRST = (1 << 63) - 1, -(1 << 63)


def _bucketed(df: DataFrame, width: float, unplaced: int) -> DataFrame:
    """Rows with the number of the stretch of `width` seconds that they start in."""
    return df.withColumn("_bucket", F.coalesce(F.floor(F.col("chapter_start") / F.lit(float(width))), F.lit(unplaced)))


def segments(points: DataFrame, files: DataFrame, width: float = WIDTH) -> DataFrame:
    """Break marks as segments covering a file from 0 to its duration.

    points: path, seq (a unique number per mark of a file), chapter_start, optional chapter_end.

    Marks are shuffled once, into buckets of `width` seconds. What a bucket needs from the rest of its file, the next start and the
    duration, is found from one row of each bucket.
    """
    marks = _bucketed(points.select("path", F.col("seq").cast("bigint").alias("seq"), "chapter_start", "chapter_end"), width, _LAST)
    place = ["path", "_bucket"]
    totals = spread(marks.groupBy(*place).agg(F.min("chapter_start").alias("_first")), "path")
    # buckets of a file from its last one: what begins behind each, and whether it is the first of the file
    back = Window.partitionBy("path").orderBy(F.desc("_bucket"))
    known = totals.withColumns({
        "_after": F.last("_first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
        "_opens": F.lead("_bucket").over(back).isNull()})
    carry = known.join(spread(files.select("path", "duration"), "path"), "path")
    behind = Window.partitionBy(*place).orderBy(F.desc("chapter_start"), F.desc_nulls_first("seq"))
    followed = spread(marks, *place).withColumn("_next", F.lag("chapter_start").over(behind))
    until = F.coalesce("_next", "_after", "duration")
    cut = followed.join(spread(carry.select(*place, "_after", "duration"), *place), place).select(
        "path", "seq", "chapter_start", F.coalesce(F.col("chapter_end"), until).alias("chapter_end"),
        (until - F.col("chapter_start")).alias("segment_duration"))
    lead_in = carry.filter("_opens AND _first > 0").select(
        "path", F.lit(-1).cast("bigint").alias("seq"), F.lit(0.0).alias("chapter_start"), F.col("_first").alias("chapter_end"),
        F.col("_first").alias("segment_duration"))
    return cut.unionByName(lead_in)


def black_marks(log: DataFrame) -> DataFrame:
    """Midpoints of the black frames reported in detector log lines (path, line_no, line)."""
    named = log.filter(F.contains("line", F.lit("blackdetect")) & F.contains("line", F.lit("black_duration:")))
    tokens = named.select("path", "line_no", F.split(F.regexp_extract("line", r"\]\s*([^\]]*)", 1), " ").alias("_tokens"))

    def value(name: str) -> Column:
        # the last of several tokens of one name counts
        found = F.filter("_tokens", lambda x: F.startswith(x, F.lit(name + ":")))
        return F.substr(F.get(found, F.size(found) - 1), F.lit(len(name) + 2)).try_cast("double").alias(name)

    found = tokens.select("path", "line_no", value("black_start"), value("black_end"), value("black_duration"))
    whole = found.filter("black_start IS NOT NULL AND black_end IS NOT NULL AND black_duration IS NOT NULL")
    return whole.select("path", "line_no", ((F.col("black_start") + F.col("black_end")) / 2).alias("midpoint"))


def black_segments(log: DataFrame, files: DataFrame, width: float = WIDTH) -> DataFrame:
    """Segments cut at the midpoints of black frames that are well inside the file.

    Every mark closes the segment before it and opens the next. The first segment of a file starts at
    0 and the last one ends with the file, so the lead-in of segments() is never needed here.
    """
    marks = black_marks(log).join(files.select("path", "duration"), "path").filter(
        (F.col("midpoint") > MIN_SECONDS) & (F.col("midpoint") < F.col("duration") - MIN_SECONDS))
    scan = OrderedScan(marks, ["path"], ["line_no"], POSITIONS).running(
        Running("_previous", "last", F.col("midpoint"), inclusive=False))
    seen = scan.result()
    tail = seen.groupBy("path").agg(
        (F.max("line_no") + 1).alias("seq"), F.max_by("midpoint", "line_no").alias("chapter_start"),
        F.any_value("duration").alias("chapter_end"))
    cut = seen.select(
        "path", F.col("line_no").alias("seq"), F.coalesce("_previous", F.lit(0.0)).alias("chapter_start"),
        F.col("midpoint").alias("chapter_end"))
    pieces = _next(cut.unionByName(tail), "chapter_start", "_next", ["chapter_start", "seq"], width)
    timed = spread(pieces, "path").join(files.select("path", "duration"), "path")
    return timed.select(
        "path", "seq", "chapter_start", "chapter_end",
        (F.coalesce("_next", "duration") - F.col("chapter_start")).alias("segment_duration"))


#: Rounds of folding in one job, and how much wider the buckets of the next job are.
ROUNDS, WIDER = 2, 8

#: Segments that one task folds; each of them takes some kilobytes there, as a round sorts them several times.
FOLDED = 50_000


def merge_short(segs: DataFrame, min_seconds: float = MIN_SECONDS, compat_hole: bool = False,
                width: float = WIDTH) -> DataFrame:
    """Fold the shortest segment into the one before it until none is shorter than min_seconds.

    A short segment that is shorter than both neighbours (of equal ones the first) is folded before either of them changes, as
    lengths only grow; so all such segments fold at once, and the order of folds elsewhere does not matter. Two kinds of chains fold in
    the same round: rising ones behind a segment that stays, one after the other into it, and falling ones, pair by pair from their
    end. A round takes a share of every chain, so rounds grow with the logarithm of a run, not with its length.

    Rounds work inside buckets of `width` seconds, where the first and last row wait for a neighbour they do not see; buckets grow
    from job to job while the rows get fewer, until no short segment is left. So a file's run of short segments is spread over as many
    tasks as it has buckets, and no task gets many more than FOLDED rows. Every job writes its rows to the checkpoint folder; the driver sees
    two counts each.

    The first segment of a file is never folded. compat_hole=True leaves the end of the surviving segment where it was.
    """
    rows = durable(segs.select("path", "seq", "chapter_start", "chapter_end", "segment_duration"))
    while True:
        ends = rows.groupBy("path").agg(F.min(F.struct("chapter_start", "seq")).alias("_low"), F.max(F.struct("chapter_start", "seq")).alias("_high"))
        place = F.struct("chapter_start", "seq")
        state = rows.join(ends, "path").withColumns({
            "_opens": place == F.col("_low"), "_closes": place == F.col("_high"),
            "_bucket": F.floor(F.col("chapter_start") / F.lit(float(width)))}).drop("_low", "_high")
        state = spread(state, "path", "_bucket", parts=rows.count() // FOLDED)
        for _ in range(ROUNDS):
            state = _fold_once(state, min_seconds)
        left = F.max((F.col("segment_duration") < min_seconds) & ~F.col("_opens"))
        state = durable(state)
        rows = state.drop("_opens", "_closes", "_bucket")
        if not state.agg(left).first()[0]:
            break
        width *= WIDER
    if compat_hole:
        return rows
    return rows.withColumn("chapter_end", F.col("chapter_start") + F.col("segment_duration"))


def _fold_once(state: DataFrame, min_seconds: float) -> DataFrame:
    """One round inside the buckets (path, _bucket); _opens and _closes mark the first and last segment of a file."""
    part, order = ["path", "_bucket"], ["chapter_start", "seq"]
    ahead, back = Window.partitionBy(*part).orderBy(*order), Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    size = F.col("segment_duration")
    foldable = ~F.col("_opens") & F.coalesce(size < min_seconds, F.lit(False))
    seen = state.withColumn("_fold", foldable).withColumns({
        "_at": F.row_number().over(ahead), "_before": F.lag(F.struct("segment_duration", "_fold")).over(ahead),
        "_next": F.lead("segment_duration").over(ahead), "_second": F.lead("segment_duration", 2).over(ahead)})
    rises = F.col("_fold") & F.when(F.col("_next").isNull(), F.col("_closes")).otherwise(size <= F.col("_next"))
    falls = F.col("_fold") & F.col("_before").isNotNull() & (~F.col("_before._fold") | (size < F.col("_before.segment_duration")))
    seen = seen.withColumns({"_rises": rises, "_falls": falls})
    seen = seen.withColumn("_least", F.col("_rises") & F.col("_falls"))
    # behind a segment that stays, everything that rises up to here
    upto = ahead.rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumns({
        "_stays": F.max(F.when(~F.col("_fold"), F.col("_at"))).over(upto),
        "_stops": F.max(F.when(F.col("_fold") & ~F.col("_rises"), F.col("_at"))).over(upto),
        "_least_next": F.coalesce(F.lead("_least").over(ahead), F.lit(False))})
    rising = F.col("_rises") & F.col("_stays").isNotNull() & F.coalesce(F.col("_stops") < F.col("_stays"), F.lit(True))
    # down to the least segment that follows, every second one, while what is folded there is no shorter than the one before
    early = ~F.col("_least") & ~F.col("_least_next") & ~F.coalesce(size <= F.col("_next") + F.col("_second"), F.lit(False))
    onward = back.rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumns({
        "_end": F.min(F.when(F.col("_least"), F.col("_at"))).over(onward),
        "_breaks": F.min(F.when(~F.col("_falls") | early, F.col("_at"))).over(onward)})
    falling = (F.col("_end").isNotNull() & F.coalesce(F.col("_breaks") > F.col("_end"), F.lit(True))
               & ((F.col("_end") - F.col("_at")) % 2 == 0))
    folded = seen.withColumn("_gone", rising | falling)
    group = F.sum((~F.col("_gone")).cast("int")).over(upto)
    grouped = folded.withColumn("_group", group)
    own = Window.partitionBy(*part, "_group")
    running = F.sum("segment_duration").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = grouped.withColumn("_sum", running).withColumns({
        "segment_duration": F.max("_sum").over(own), "_closes": F.max("_closes").over(own)})
    return summed.filter(~F.col("_gone")).select(*state.columns)


def thin_segments(segs: DataFrame, wanted: Column | int, width: float = WIDTH, positions: int = POSITIONS) -> DataFrame:
    """At most `wanted` segments per file: evenly spread breaks are kept, neighbours merged.

    Segments are shuffled once, into buckets of `width` seconds; how many stand before a bucket, and the next kept start behind it, are
    found from one row of each bucket. positions changes nothing any more; kept breaks follow each other inside the same buckets.
    """
    m = wanted if isinstance(wanted, Column) else F.lit(wanted)
    place, row = ["path", "_bucket"], ["chapter_start", "seq", "chapter_end", "_m"]
    rows = spread(_bucketed(segs.withColumn("_m", m.cast("bigint")).select("path", *row), width, _FIRST), *place)
    # the whole row, so that the totals read the same shuffle as the rows; of equal marks the one that ends first is the last
    ends_first = F.struct("chapter_start", "seq", (-F.col("chapter_end")).alias("_back"))
    tail = F.struct(ends_first.alias("_place"), F.struct(*row).alias("_row"))
    totals = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_count"), F.max(tail).alias("_tail"))
    file = Window.partitionBy("path")
    earlier = file.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = spread(totals, "path").select(
        *place, F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"), F.sum("_count").over(file).alias("_n"),
        F.max("_tail").over(file)["_row"]["chapter_end"].alias("_last"))
    order = Window.partitionBy(*place).orderBy("chapter_start", "seq")
    sized = rows.withColumn("_at", F.row_number().over(order)).join(spread(carry, *place), place).withColumn(
        "_index", F.col("_before") + F.col("_at") - 1).filter("_m > 0")
    step = (F.col("_n") - 1) / F.nullif(F.col("_m") - 1, F.lit(0)).cast("double")
    near = F.floor(F.col("_index") / step)
    chosen = F.exists(
        F.sequence(F.greatest(near - 1, F.lit(1)), F.greatest(near + 1, F.lit(1))),
        lambda i: (i <= F.col("_m") - 1) & (F.bround(i * step) == F.col("_index")))
    whole = F.col("_n") <= F.col("_m")
    kept = sized.filter(whole | (F.col("_index") == 0) | F.coalesce(chosen, F.lit(False))).select(
        *place, "_index", "chapter_start", F.when(whole, F.col("chapter_end")).otherwise(F.col("_last")).alias("_end"), whole.alias("_whole"))
    heads = kept.groupBy(*place).agg(F.min(F.struct("_index", "chapter_start", "_end", "_whole")).alias("_head"))
    behind = file.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    after = spread(heads, "path").select(*place, F.last("_head.chapter_start", ignorenulls=True).over(behind).alias("_after"))
    followed = kept.withColumn("_next", F.lead("chapter_start").over(Window.partitionBy(*place).orderBy("_index")))
    return followed.join(spread(after, *place), place).select(
        "path", "chapter_start",
        F.when(F.col("_whole"), F.col("_end")).otherwise(F.coalesce("_next", "_after", "_end")).alias("chapter_end"))
