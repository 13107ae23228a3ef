"""Metadata sidecars of media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airlog.functions.metadata import parse_sidecar
from airlog.sources.manifests import relative_to, source_file


def read_sidecars(spark: SparkSession, root: str, pattern: str = "*.nfo") -> DataFrame:
    """path relative to the folder and text of every sidecar below it, one row per file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    named = files.select(source_file().alias("path"), F.col("value").alias("text"))
    return named.select(relative_to("path", root).alias("path"), "text")


def parse_sidecars(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `meta`, the parsed metadata; null where nothing usable was found."""
    return df.withColumn("meta", parse_sidecar(text))


def stem(path: Column | str) -> Column:
    """Path without the extension of its last component."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", "")


def pair_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Each media file with the metadata of the sidecar of the same stem."""
    known = parse_sidecars(sidecars).select(stem(F.col("path")).alias("_stem"), "meta")
    return files.withColumn("_stem", stem(F.col("path"))).join(known, "_stem", "left").drop("_stem")
