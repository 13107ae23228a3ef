"""Play counts from a stream of plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from airlog.streaming import sinks


def deduplicated(plays: DataFrame, keys: list[str], event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Plays without repeats that arrive within the delay; older state is dropped."""
    return plays.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def count_plays(plays: DataFrame, folder: str, checkpoint: str, every: int = sinks.EVERY, **trigger) -> StreamingQuery:
    """Write the plays of each micro-batch as counts per (station, path), once per batch, and merge them every so many batches."""

    def merged(counts: DataFrame) -> DataFrame:
        return counts.groupBy("station", "path").agg(F.sum("plays").alias("plays"), F.max("batch_id").alias("batch_id"))

    def store(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("station", "path").agg(F.count(F.lit(1)).alias("plays"))
        sinks.write_batch(counts, folder, batch_id)
        sinks.compact(batch.sparkSession, folder, batch_id, merged, every)

    writer = plays.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def play_totals(spark: SparkSession, folder: str, every: int = sinks.EVERY) -> DataFrame:
    """Plays of each (station, path) over all batches."""
    return sinks.stored(spark, folder, every=every).groupBy("station", "path").agg(F.sum("plays").alias("plays"))


def counted_catalog(catalog: DataFrame, totals: DataFrame) -> DataFrame:
    """Catalog with the streamed plays added to its counts."""
    return catalog.join(totals, ["station", "path"], "left").withColumn(
        "count", F.col("count") + F.coalesce("plays", F.lit(0))).drop("plays")
