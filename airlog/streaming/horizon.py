"""Stations about to run out of schedule, from a stream of appended blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from airlog.operators.intervals import _ntz
from airlog.sources.manifests import subfolders


def schedule_ends(blocks: DataFrame) -> DataFrame:
    """End of the last-starting block of each station; one row of state per station."""
    return blocks.groupBy("station").agg(
        F.max_by("end_time", F.struct("start_time", "end_time", "id")).alias("schedule_end"))


def horizon_alerts(blocks: DataFrame, stations: DataFrame, folder: str, checkpoint: str, now, hours: int,
                   **trigger) -> StreamingQuery:
    """After every micro-batch, write the stations whose schedule ends before now + hours.

    `now` is a time or a function giving one, asked once per batch. Each batch overwrites the alert
    folder of its id; read the newest with current_alerts.
    """

    def store(ends: DataFrame, batch_id: int) -> None:
        moment = now() if callable(now) else now
        limit = _ntz(moment) + F.expr(f"INTERVAL {hours} HOURS")
        due = stations.select("station").join(ends, "station", "left").filter(
            F.col("schedule_end").isNull() | (F.col("schedule_end") < limit))
        due.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    writer = schedule_ends(blocks).writeStream.outputMode("complete").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_alerts(spark: SparkSession, folder: str) -> DataFrame:
    newest = max(int(b) for b in subfolders(spark, folder, "batch_id="))
    return spark.read.parquet(f"{folder}/batch_id={newest}")
