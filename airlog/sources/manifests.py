"""File manifests: what is in a media library, what is left out and why, and kept snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airlog.functions.paths import VIDEO_FORMATS, extension
from airlog.sources.listing import list_library


def source_file() -> Column:
    """Path of the file a row was read from; Spark gives it with escapes, a plus sign stands for itself."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def relative_to(path: str, root: str) -> Column:
    """A listed file's path below the folder it was listed from, whatever scheme it carries."""
    base = root.rstrip("/") + "/"
    return F.substr(path, F.instr(path, base) + F.lit(len(base)))


def skip_reason(path: Column | str, extensions: Sequence[str] = VIDEO_FORMATS) -> Column:
    """hidden_directory, hidden or unsupported_extension; null for a file that is kept."""
    p = F.split(F.col(path) if isinstance(path, str) else path, "/")
    folders, name = F.slice(p, F.lit(1), F.size(p) - 1), F.element_at(p, -1)
    dot = F.lit(".")
    return (
        F.when(F.exists(folders, lambda x: F.startswith(x, dot)), "hidden_directory")
        .when(F.startswith(name, dot), "hidden")
        .when(~extension(name).isin(*extensions), "unsupported_extension")
    )


def classify_manifest(listing: DataFrame, extensions: Sequence[str] = VIDEO_FORMATS) -> tuple[DataFrame, DataFrame]:
    """Split a listing into kept files and skipped rows (path, reason).

    A hidden directory is reported once, by its own path, however many files it holds.
    """
    marked = listing.withColumn("reason", skip_reason("path", extensions))
    p = F.split("path", "/")
    hidden_at = F.array_position(F.transform(p, lambda x: F.startswith(x, F.lit("."))), True)
    shown = F.when(F.col("reason") == "hidden_directory", F.array_join(F.slice(p, F.lit(1), hidden_at.cast("int")), "/"))
    skipped = marked.filter("reason IS NOT NULL").select(F.coalesce(shown, F.col("path")).alias("path"), "reason")
    return marked.filter("reason IS NULL").drop("reason"), skipped.distinct()


def listing_errors(listing: DataFrame) -> DataFrame:
    """(path, error) of listed files of a kept kind that could not be read.

    listing: path, size, mtime_ns and, where the lister reports it, error. A row with an error, or without a size or a time, is one.
    """
    told = F.col("error") if "error" in listing.columns else F.lit(None).cast("string")
    error = F.coalesce(told, F.when(F.col("size").isNull() | F.col("mtime_ns").isNull(), "not readable"))
    return listing.filter(skip_reason("path").isNull()).select("path", error.alias("error")).filter("error IS NOT NULL")


def readable(listing: DataFrame) -> DataFrame:
    """The listed rows without an error: path, size, mtime_ns."""
    sound = F.col("size").isNotNull() & F.col("mtime_ns").isNotNull()
    if "error" in listing.columns:
        sound = sound & F.col("error").isNull()
    return listing.filter(sound).select("path", "size", "mtime_ns")


def usable_baseline(errors: DataFrame) -> DataFrame:
    """One row (usable, errors): a snapshot with errors is no baseline, as files would seem to be missing."""
    return errors.agg(F.count(F.lit(1)).alias("errors")).select((F.col("errors") == 0).alias("usable"), "errors")


def split_listing(listing: DataFrame, extensions: Sequence[str] = VIDEO_FORMATS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (path, size, mtime_ns), skipped rows (path, reason) and errors (path, error) of a listing of a library.

    A hidden folder is one skipped row and is not looked into. A file is skipped by its name before it is looked at, so only a folder
    or a file of a kept kind can be an error.
    """
    reason = F.when(F.col("is_folder"), F.when(F.startswith(F.element_at(F.split("path", "/"), -1), F.lit(".")), "hidden_directory")
                    ).otherwise(skip_reason("path", extensions))
    marked = listing.withColumn("reason", reason)
    kept = marked.filter("reason IS NULL")
    return (kept.filter("error IS NULL").select("path", "size", "mtime_ns"),
            marked.filter("reason IS NOT NULL").select("path", "reason"),
            kept.filter("error IS NOT NULL").select("path", "error"))


def scan_manifest(spark: SparkSession, root: str, extensions: Sequence[str] = VIDEO_FORMATS,
                  parts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, skipped rows and errors below a folder that all executors have mounted; see split_listing."""
    return split_listing(list_library(spark, root, parts), extensions)


def manifest_stats(manifest: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """path, realpath, size and mtime_ns; `links` maps a path to the file it stands for."""
    if links is None:
        return manifest.select("path", F.col("path").alias("realpath"), "size", "mtime_ns")
    return manifest.join(links.select("path", "realpath"), "path", "left").select(
        "path", F.coalesce("realpath", "path").alias("realpath"), "size", "mtime_ns")


def save_snapshot(manifest: DataFrame, folder: str, snapshot_id: str) -> None:
    """Keep a manifest under its snapshot id, next to the earlier ones."""
    manifest.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(folder)


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with the greatest snapshot id; other snapshots are not opened."""
    newest = max(subfolders(spark, folder, "snapshot_id="))
    return spark.read.parquet(f"{folder}/snapshot_id={newest}").withColumn("snapshot_id", F.lit(unquote(newest)))


def subfolders(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """What follows a prefix in the names of a folder's folders. One listing of names; no file is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [status.getPath().getName() for status in listed if status.isDirectory()]
    return [name.removeprefix(prefix) for name in names if name.startswith(prefix)]
