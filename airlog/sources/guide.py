"""Guide documents: channels and listings as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def guide_listings(blocks: DataFrame, meta: bool = False) -> DataFrame:
    """One JSON listing per block with its place in the station's guide."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    fields = [F.col("title"), F.date_format("start_time", stamp).alias("start_time"),
              F.date_format("end_time", stamp).alias("end_time")]
    if meta:
        fields.append(F.col("meta"))
    return blocks.select("station", "id", F.col("start_time").alias("at"), F.to_json(F.struct(*fields)).alias("listing"))


def export_guide(blocks: DataFrame, channels: DataFrame, folder: str, meta: bool = False) -> None:
    """Write channels and listings as JSON lines: one listing per line, partitioned by station.

    A station's listings are split over as many sorted files as their number needs; no station is
    gathered into one document.
    """
    channels.write.mode("overwrite").json(f"{folder}/channels")
    listed = guide_listings(blocks, meta)
    placed = listed.repartitionByRange("station", "at", "id").sortWithinPartitions("station", "at", "id")
    placed.write.mode("overwrite").partitionBy("station").json(f"{folder}/schedules")
