"""Named episode sequences: which episode each airing gets, and where cursors stand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from airlog.functions.calendar import BROADCAST_START, weekday_number
from airlog.functions.values import seeded_number
from airlog.operators.intervals import _ntz
from airlog.operators.scan import DAY_US, OrderedScan, Running, numbered, numbered_by_digits

KEY = ("station", "sequence_name", "tag_path")


def sequence_bounds(sequences: DataFrame, episodes: DataFrame, keys: Sequence[str] = KEY, seed: int = 0) -> DataFrame:
    """Length, start and end index of each sequence. A negative start fraction means a seeded random start."""
    sizes = episodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"))
    end = F.floor(F.col("end_perc") * F.col("length"))
    random = F.coalesce(F.pmod(seeded_number(seed, *keys), F.nullif(end, F.lit(0))), F.lit(0))
    start = F.when(F.col("start_perc") < 0, random).otherwise(F.floor(F.col("start_perc") * F.col("length")))
    return sequences.join(sizes, list(keys)).select(
        *keys, "length", start.alias("start_index"), end.alias("end_index"))


def episode_index(k: Column, start: Column, end: Column) -> Column:
    """Episode of the k-th airing (from 0): from the start index to the end, then around from 0."""
    first = F.greatest(end - start, F.lit(0))
    around = F.coalesce(F.pmod(k - first, F.nullif(end, F.lit(0))), F.lit(0))
    return F.when(k < first, start + k).otherwise(around)


def assign_episodes(
    airings: DataFrame,
    sequences: DataFrame,
    episodes: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = KEY,
    seed: int = 0,
    width: float | None = DAY_US,
) -> DataFrame:
    """Give every airing its episode. Episodes are taken in path order, airings in the given order.

    The order of airings starts with a time or number, of which width is scanned together. Episodes are numbered by digits of their
    paths, so a sequence may hold any share of all files.
    """
    placed = numbered_by_digits(episodes, keys, ["fpath", "id"], "_n")
    placed = placed.select(*keys, (F.col("_n") - 1).alias("episode_index"), "fpath")
    aired = numbered(airings, keys, order, "_k", width)
    timed = aired.join(sequence_bounds(sequences, episodes, keys, seed), list(keys))
    index = episode_index(F.col("_k") - 1, F.col("start_index"), F.col("end_index"))
    chosen = timed.withColumn("episode_index", index).drop("_k", "length", "start_index", "end_index")
    return chosen.join(placed, [*keys, "episode_index"])


def rewind_cursors(blocks: DataFrame, positions: DataFrame, today, keys: Sequence[str] = KEY) -> DataFrame:
    """New cursor of each sequence: the position of its earliest airing from today on.

    blocks carry the sequence keys and the aired path; positions come from sequence_position.
    """
    ahead = blocks.filter(F.col("start_time") >= _ntz(today))
    earliest = ahead.groupBy(*keys).agg(
        F.min(F.struct("start_time", "end_time", "id", F.col("path").alias("fpath"))).alias("_b"))
    wanted = earliest.select(*keys, "_b.fpath")
    return wanted.join(positions, [*keys, "fpath"]).select(*keys, F.col("sequence_index").alias("current_index"))


def resync_cursor(cursors: DataFrame, old: DataFrame, new: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Cursors after a file list changed: follow the file, else keep the index, else go to 0.

    cursors: keys + current_index; old: keys + fpath, sequence_index; new: keys + fpath.
    """
    fresh = numbered_by_digits(new.select(*keys, "fpath").distinct(), keys, ["fpath"], "_n")
    fresh = fresh.select(*keys, "fpath", (F.col("_n") - 1).alias("_new_index"))
    sizes = fresh.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    at = old.select(*keys, F.col("sequence_index").alias("current_index"), "fpath")
    held = cursors.join(at, [*keys, "current_index"], "left").join(fresh, [*keys, "fpath"], "left").join(
        sizes, list(keys), "left")
    moved = F.coalesce(
        "_new_index", F.when(F.col("current_index") < F.coalesce("_size", F.lit(0)), F.col("current_index")), F.lit(0))
    return held.select(*keys, moved.alias("current_index"))


def fill_continued(slots: DataFrame, scope: Sequence[str] = ("station",)) -> DataFrame:
    """Give slots marked continued the tags of the last slot with tags, in broadcast-day order.

    slots: scope columns, day (weekday name), hour, tags, continued. A continued slot without any
    slot before it gets the error no_preceding_tags.
    """
    at = slots.withColumns({
        "_day": weekday_number("day"),
        "_hour": F.pmod(F.col("hour") - BROADCAST_START, F.lit(24)),
    })
    scan = OrderedScan(at, list(scope), ["_day", "_hour"]).running(
        Running("_held", "last", F.col("tags")))
    inherits = F.col("tags").isNull() & F.coalesce("continued", F.lit(False))
    return scan.result().withColumns({
        "error": F.when(inherits & F.col("_held").isNull(), "no_preceding_tags"),
        "tags": F.when(inherits, F.col("_held")).otherwise(F.col("tags")),
    }).drop("_day", "_hour", "_held")
