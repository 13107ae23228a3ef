"""Latest player status per channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airlog import schemas


def read_status(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Status events written as JSON lines."""
    reader = spark.readStream.schema(schemas.STATUS)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def latest_status(events: DataFrame) -> DataFrame:
    """Last event of each channel, for a batch or, in update mode, a stream.

    The state is one row per channel. Events of one instant are ordered by title and path, so the
    result does not depend on their arrival.
    """
    fields = [c for c in events.columns if c != "channel_number"]
    order = F.struct("timestamp", F.coalesce("title", F.lit("")), F.coalesce("file_path", F.lit("")), "status")
    last = events.groupBy("channel_number").agg(F.max_by(F.struct(*fields), order).alias("_s"))
    found = last.select("channel_number", "_s.*")
    return found.withColumn("content_type", F.coalesce(F.nullif("content_type", F.lit("")), F.lit("unknown")))
