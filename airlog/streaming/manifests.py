"""Incremental manifest ingest into the file cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from airlog.operators.catalog import first_per
from airlog.operators.diff import cache_delta
from airlog.streaming import sinks

META = ("path", "size", "mtime_ns", "meta", "media_type")


def ingest_manifest(files: DataFrame, meta: DataFrame, folder: str, checkpoint: str, every: int = sinks.EVERY,
                    **trigger) -> StreamingQuery:
    """Write what each micro-batch of manifest rows changes: path, size, mtime_ns, action.

    A row is judged against the starting cache and all earlier batches. Of several rows of one path in
    a batch the newest counts. Changes are merged every so many batches, so a batch reads one version and few batches.
    """
    spark = files.sparkSession
    empty = meta.limit(0).selectExpr("path", "size", "mtime_ns", "'' AS action")
    sinks.start(empty, folder)

    def store(batch: DataFrame, batch_id: int) -> None:
        newest = first_per(
            batch.select("path", "size", "mtime_ns").selectExpr("*", "-mtime_ns AS _older"), ["path"], ["_older", "size"]
        ).drop("_older")
        known = cached(spark, meta, folder, batch_id, every)
        sinks.write_batch(cache_delta(newest, known).filter("action <> 'unchanged'"), folder, batch_id)
        sinks.compact(spark, folder, batch_id, _newest, every)

    writer = files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _newest(changes: DataFrame) -> DataFrame:
    """The newest change of each path."""
    aged = changes.selectExpr("path", "size", "mtime_ns", "action", "batch_id", "-batch_id AS _age")
    return first_per(aged, ["path"], ["_age"]).drop("_age")


def cached(spark: SparkSession, meta: DataFrame, folder: str, before: int | None = None, every: int = sinks.EVERY) -> DataFrame:
    """The cache after the stored batches, or after those before a batch: newest row of each path.

    A file that was refreshed and had no metadata has {} from then on, so it is not refreshed each time it is listed.
    """
    start = meta.select(*META)
    newest = _newest(sinks.stored(spark, folder, before, every))
    details = start.select("path", "meta", "media_type")
    told = F.when(F.col("action") == "refresh", F.coalesce(F.nullif("meta", F.lit("")), F.lit("{}"))).otherwise(F.col("meta"))
    updated = newest.join(details, "path", "left").withColumn("meta", told)
    return start.join(newest.select("path"), "path", "left_anti").unionByName(updated.select(*META))
