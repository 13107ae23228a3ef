"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlog.session import ensure_checkpoint_dir

#: A word is a run of characters other than space, tab and the four line characters that follow it in ASCII.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared checkpoint folder, which driver and executors all reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: what is read later comes from the files, however many executors are lost meanwhile.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def portions(batch: pa.RecordBatch, text: int, size: int = 300_000, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of at most so many rows and about so many bytes of text, so that little is unpacked at once.

    text: number of the column with the texts. A longer text is a stretch of its own with what stands before it.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // size + np.arange(len(lengths)) // rows
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    for low, high in zip(cuts[:-1], cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)
