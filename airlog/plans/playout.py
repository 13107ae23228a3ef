"""Plan timelines and the entry playing at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from airlog.functions.values import micros
from airlog.operators.intervals import now_playing
from airlog.operators.scan import DAY_US, HOUR_US, OrderedScan, Running


def plan_rows(blocks: DataFrame, plan: str = "plan") -> DataFrame:
    """One row per plan entry with its position; blocks without a plan give no rows."""
    keep = [c for c in blocks.columns if c != plan]
    return blocks.select(*keep, F.posexplode(plan).alias("position", "_entry")).select(*keep, "position", "_entry.*")


def plan_timeline(
    entries: DataFrame,
    block: str = "block_id",
    order: Sequence[str] = ("position",),
    width: float | None = None,
) -> DataFrame:
    """Position of each entry and its offsets from_us and until_us inside its block.

    A plan is one value of one row, so its entries fit in a task; width cuts longer orders into buckets.
    """
    sized = entries.withColumn("_us", F.round(F.col("duration") * 1000000).cast("bigint"))
    scan = OrderedScan(sized, [block], list(order), width).running(
        Running("until_us", "sum", F.col("_us")), Running("entry", "count", F.lit(1)))
    return scan.result().withColumns(
        {"from_us": F.col("until_us") - F.col("_us"), "entry": F.col("entry") - 1}).drop("_us")


def play_point(blocks: DataFrame, timeline: DataFrame, probes: DataFrame, closed: bool = False,
               width: int = DAY_US) -> DataFrame:
    """Entry index and offset playing at each probe (station, at); null past the end of the plan.

    Inside its block a probe looks back to the last entry that began before it. Probes with nothing on air pass through the same scan
    by their own time, so that no probe is joined with its answer.
    """
    on_air = now_playing(blocks, probes, closed, width)
    since = F.coalesce(micros("at") - F.col("start_us"), micros("at"))
    entry = F.struct("entry", "from_us", "until_us")
    begun = timeline.filter("block_id IS NOT NULL").select(
        "block_id", F.col("from_us").alias("_us"), F.lit(0).alias("_side"), F.col("entry").alias("_n"), entry.alias("_entry"))
    asked = on_air.select("block_id", since.alias("_us"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_n"), "station", "at")
    seen = OrderedScan(
        begun.unionByName(asked, allowMissingColumns=True), ["block_id"], ["_us", "_side", "_n"], HOUR_US
    ).running(Running("_hit", "last", F.col("_entry"))).result().filter("_side = 1")
    hit = F.when(F.col("_us") < F.col("_hit.until_us"), F.col("_hit"))
    return seen.withColumn("_hit", hit).select(
        "station", "at", "block_id", F.col("_hit.entry").alias("index"), (F.col("_us") - F.col("_hit.from_us")).alias("offset_us"))
