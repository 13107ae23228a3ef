"""What is on beside what should be: status events against schedule blocks that are appended meanwhile, both as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from airlog.operators.intervals import with_micros
from airlog.streaming import sinks


def _pieces(blocks: DataFrame, longest_hours: int) -> DataFrame:
    """Blocks in stretches of at most so many hours, so that the join knows how long a block has to wait for events."""
    width = longest_hours * 3_600_000_000
    last = F.floor((F.col("end_us") - F.col("start_us") - 1) / F.lit(width))
    cut = with_micros(blocks).filter("end_us > start_us").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    begin = F.col("start_us") + F.col("_piece") * width
    return cut.select(
        F.col("station").alias("_station"), F.col("id").alias("block_id"), F.col("title").alias("block_title"),
        F.timestamp_micros(begin).alias("_from"), F.timestamp_micros(F.least(F.col("end_us"), begin + width)).alias("_until"))


def on_schedule(events: DataFrame, blocks: DataFrame, delay: str = "1 hour", longest_hours: int = 24) -> DataFrame:
    """Every status event with each block of its station that covers its moment, or without one: the columns of the events,
    block_id, block_title and whether the titles agree.

    events: station, at (a timestamp), title; blocks: station, id, title, start_time, end_time. For tables or for streams. In a
    stream both sides wait: an event without a block comes out when the watermark, the later of the two delays, has passed it. A block
    is kept for `longest_hours` and the delay, longer ones in stretches; rows later than the delay are left out, as streams do.
    """
    seen = events.withWatermark("at", delay)
    due = _pieces(blocks, longest_hours).withWatermark("_from", delay)
    inside = (F.col("station") == F.col("_station")) & (F.col("at") >= F.col("_from")) & (F.col("at") < F.col("_until"))
    bound = F.col("at") < F.col("_from") + F.expr(f"INTERVAL {longest_hours} HOURS")
    found = seen.join(due, inside & bound, "left_outer").drop("_station", "_from", "_until")
    return found.withColumn("agrees", F.col("title").eqNullSafe(F.col("block_title")) & F.col("block_id").isNotNull())


def watch_status(events: DataFrame, blocks: DataFrame, folder: str, checkpoint: str, delay: str = "1 hour", longest_hours: int = 24,
                 **trigger) -> StreamingQuery:
    """Write what on_schedule finds in every micro-batch under its id."""

    def store(found: DataFrame, batch_id: int) -> None:
        sinks.write_batch(found, folder, batch_id)

    writer = on_schedule(events, blocks, delay, longest_hours).writeStream.outputMode("append").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
