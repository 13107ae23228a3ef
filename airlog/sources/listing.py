"""A data source that lists a mounted media library from the executors.

    spark.dataSource.register(LibraryListing)
    spark.read.format("library").load("/mnt/media")        # one row a file or hidden folder
    spark.readStream.format("library").load("/mnt/media")  # what changed since the batch before

The driver lists nothing. The folder tree is dealt by hashes of folder paths: every task lists the folders of the first `levels`
levels, which are few, and goes on below those that fall to it. Names that begin with `.` or `_`, unreadable folders and files that
cannot be looked at are rows, not gaps. Links are followed; a folder that is reached twice is kept under its first path in the order
of names. The library must be mounted at the same path on every executor.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: path and folder are relative to the root; folder_key names the folder itself, whatever path it was reached by. changed_ns is when an
#: entry or a folder above it last changed: a folder that is moved in brings files whose own times are old.
SCHEMA = ("path string, folder string, folder_key string, is_folder boolean, size long, mtime_ns long, changed_ns long, error string")


def _reason(error: OSError) -> str:
    return error.strerror or str(error)


def _readable(path: str) -> None:
    if not os.access(path, os.R_OK):
        raise PermissionError(0, "not readable")


def walk(root: str, part: int = 0, parts: int = 1, levels: int = 2, after_ns: int | None = None,
         before_ns: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA for the folders that fall to one of `parts` parts; all parts together give every folder.

    With bounds only rows that changed after one and not after the other are given. Rows without a time, which stand for what could
    not be looked at, are given whenever they are met.
    """
    seen: set[str] = set()
    todo = [("", 0, 0)]
    while todo:
        folder, depth, above_ns = todo.pop()
        mine = zlib.crc32(folder.encode("utf-8", "surrogateescape")) % parts == part
        if depth == levels and not mine:
            continue
        own = mine or depth > levels
        try:
            status = os.stat(os.path.join(root, folder))
            key = f"{status.st_dev}:{status.st_ino}"
            if key in seen:
                continue
            seen.add(key)
            above_ns = max(above_ns, status.st_ctime_ns)
            with os.scandir(os.path.join(root, folder)) as listed:
                entries = sorted(listed, key=lambda e: e.name)
        except OSError as error:
            if own:
                yield (folder or ".", folder, None, True, None, None, None, _reason(error))
            continue
        below = []
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            try:
                is_folder = entry.is_dir()
            except OSError:
                is_folder = False
            if is_folder and not entry.name.startswith("."):
                below.append((path, depth + 1, above_ns))
                continue
            if not own:
                continue
            try:
                found = entry.stat()
                if not is_folder:
                    _readable(entry.path)
            except OSError as error:
                yield (path, folder, key, is_folder, None, None, None, _reason(error))
                continue
            changed = max(found.st_mtime_ns, found.st_ctime_ns, above_ns)
            if (after_ns is None or changed > after_ns) and (before_ns is None or changed <= before_ns):
                size = None if is_folder else found.st_size
                yield (path, folder, key, is_folder, size, found.st_mtime_ns, changed, None)
        todo += reversed(below)


class _Part(InputPartition):
    def __init__(self, part: int, after_ns: int | None = None, before_ns: int | None = None):
        super().__init__(part)
        self.after_ns, self.before_ns = after_ns, before_ns


class _Lister:
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.parts, self.levels = int(options.get("parts", "64")), int(options.get("levels", "2"))

    def read(self, partition: _Part) -> Iterator[tuple]:
        return walk(self.root, partition.value, self.parts, self.levels, partition.after_ns, partition.before_ns)


class _Reader(_Lister, DataSourceReader):
    def partitions(self):
        return [_Part(k) for k in range(self.parts)]


class _StreamReader(_Lister, DataSourceStreamReader):
    """Offsets are moments: a batch gives what changed after its start and not after its end, and what lies below a folder that did.

    So an entry may come again unchanged, and none is missed. The end stays a little behind the clock, so that entries of the same
    moment are not cut in two.
    """

    def __init__(self, options):
        super().__init__(options)
        self.lag_ns = int(float(options.get("lagSeconds", "1")) * 1e9)

    def initialOffset(self) -> dict:
        return {"changed_ns": 0}

    def latestOffset(self) -> dict:
        return {"changed_ns": time.time_ns() - self.lag_ns}

    def partitions(self, start: dict, end: dict):
        return [_Part(k, start["changed_ns"], end["changed_ns"]) for k in range(self.parts)]

    def commit(self, end: dict) -> None:
        pass


class LibraryListing(DataSource):
    """Format "library". Options: path; parts, the number of tasks (64); levels, the folder levels that every task lists (2);
    lagSeconds, how far a stream's batches stay behind the clock (1)."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _options(parts: int | None, spark: SparkSession) -> dict[str, str]:
    return {"parts": str(parts or spark.conf.get("spark.sql.shuffle.partitions"))}


def list_library(spark: SparkSession, root: str, parts: int | None = None) -> DataFrame:
    """Rows of SCHEMA for everything below a folder, each folder under its first path only."""
    spark.dataSource.register(LibraryListing)
    listed = spark.read.format("library").options(**_options(parts, spark)).load(root)
    return once_each(listed)


def once_each(listed: DataFrame) -> DataFrame:
    """Without the rows of folders that another path, earlier in the order of names, leads to as well."""
    folders = listed.filter("folder_key IS NOT NULL").groupBy("folder_key").agg(
        F.min_by("folder", F.split("folder", "/")).alias("_first"))
    kept = listed.join(folders, "folder_key", "left").filter("_first IS NULL OR _first = folder")
    return kept.drop("_first").select(*listed.columns)


def stream_library(spark: SparkSession, root: str, parts: int | None = None, lag_seconds: float = 1) -> DataFrame:
    """A stream of rows of SCHEMA: all there is, then what changes; see newest_of_each for what they add up to."""
    spark.dataSource.register(LibraryListing)
    return spark.readStream.format("library").options(**_options(parts, spark)).option("lagSeconds", str(lag_seconds)).load(root)


def newest_of_each(streamed: DataFrame) -> DataFrame:
    """The newest row of every path of a stream's rows, each folder under its first path only."""
    row = F.struct(*streamed.columns)
    newest = streamed.groupBy("path").agg(F.max_by(row, F.coalesce("changed_ns", F.lit(0))).alias("_row"))
    return once_each(newest.select("_row.*"))
