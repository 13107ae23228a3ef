"""Versioned tables that micro-batches write to.

A batch is written to its own partition, so running it again after a failure replaces what it wrote
and nothing is counted twice. A partition of a batch that never finished is overwritten by its retry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from airlog.sources.manifests import subfolders

#: Batches between two versions; it changes no result.
EVERY = 16


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """Store one micro-batch under its id."""
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)


def stored(spark: SparkSession, folder: str, before: int | None = None, every: int = EVERY) -> DataFrame:
    """Rows of all batches, or of those before one, with their batch_id: the newest version and at most `every` batches after it.

    A version of batch v was complete before batch v began, so it is there whenever that batch is.
    """
    kept = [int(b) for b in subfolders(spark, folder, "batch_id=")]
    before = max(kept) + 1 if before is None else before
    version = max(before - 1, 0) // every * every
    recent = [b for b in kept if b < before and (b >= version or version == 0)]
    if not recent:
        return spark.read.parquet(f"{folder}_versions/version={version}")
    rows = spark.read.option("basePath", folder).parquet(*[f"{folder}/batch_id={b}" for b in sorted(recent)])
    return rows.unionByName(spark.read.parquet(f"{folder}_versions/version={version}")) if version else rows


def compact(spark: SparkSession, folder: str, batch_id: int, merge: Callable[[DataFrame], DataFrame], every: int = EVERY) -> None:
    """After each `every`-th batch, merge what is stored so far into a version that later batches read instead.

    merge takes and returns the columns of the batches with batch_id. A batch run again writes the same version again: it reads the
    version before and the batches since. Whatever is older than two versions is removed, so a folder holds at most three times
    `every` batches and three versions, however long a stream runs.
    """
    if (batch_id + 1) % every == 0:
        merge(stored(spark, folder, batch_id + 1, every)).write.mode("overwrite").parquet(
            f"{folder}_versions/version={batch_id + 1}")
        oldest = batch_id + 1 - 2 * every
        for parent, prefix in ((folder, "batch_id="), (f"{folder}_versions", "version=")):
            for number in subfolders(spark, parent, prefix):
                if int(number) < oldest:
                    remove(spark, f"{parent}/{prefix}{number}")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that a stream wrote and no later batch reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def start(empty: DataFrame, folder: str) -> None:
    """Store an empty batch -1, so that the table can be read before the first batch."""
    write_batch(empty, folder, -1)


def latest_of_each(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of every key, the row of the newest batch that wrote it."""
    kept = read_batches(spark, folder)
    row = F.struct(*[c for c in kept.columns if c not in (*keys, "batch_id")])
    return kept.groupBy(*keys).agg(F.max_by(row, "batch_id").alias("_row")).select(*keys, "_row.*")
