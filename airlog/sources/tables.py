"""Table maintenance: JSON columns, older layouts, upserts and range replacement.

Tables are versions in shared storage: a change is written as a new version or partition and read
back from there, never updated in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from airlog import schemas
from airlog.functions.hints import decode_hints
from airlog.functions.values import id_array
from airlog.operators.intervals import _ntz


def decode_blocks(raw: DataFrame) -> DataFrame:
    """Typed columns for the JSON text of schedule rows; text a row cannot hold becomes null."""
    plan = F.from_json("plan_json", T.ArrayType(schemas.PLAN_ENTRY))
    filled = F.transform(plan, lambda e: F.struct(
        e["path"].alias("path"), e["skip"].alias("skip"), e["duration"].alias("duration"), e["is_stream"].alias("is_stream"),
        F.coalesce(e["content_type"], F.lit("feature")).alias("content_type"),
        F.coalesce(e["media_type"], F.lit("video")).alias("media_type")))
    return raw.withColumns({
        "sequence_key": F.from_json("sequence_key", schemas.SEQUENCE_KEY),
        "break_info": F.try_parse_json("break_info"),
        "content_is_list": F.coalesce(F.startswith(F.trim("content_json"), F.lit("[")), F.lit(False)),
        "content_ids": id_array("content_json"),
        "plan": F.coalesce(filled, F.array().cast(T.ArrayType(schemas.PLAN_ENTRY))),
    }).drop("content_json", "plan_json")


def decode_catalog(raw: DataFrame) -> DataFrame:
    """Catalog rows with typed hints; unknown hints are dropped."""
    return raw.withColumn("hints", decode_hints("hints"))


def widen(df: DataFrame, defaults: Mapping[str, object], schema: T.StructType | None = None) -> DataFrame:
    """Add columns an older table does not have, and fill their nulls, with the given defaults."""
    for name, value in defaults.items():
        kind = schema[name].dataType if schema is not None else T.StringType()
        default = F.lit(value).cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)
    return df


def union_versions(old: DataFrame, new: DataFrame, defaults: Mapping[str, object], schema: T.StructType | None = None) -> DataFrame:
    """Rows of a narrow and a wide table in one layout."""
    return widen(old.unionByName(new, allowMissingColumns=True), defaults, schema)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Target rows with updates laid over them; the greatest `order` wins among updates of one key."""
    latest = updates
    if order is not None:
        row = F.struct(*[c for c in target.columns if c not in keys])
        best = updates.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
        latest = best.select(*keys, "_row.*")
    kept = target.join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest.select(*target.columns))


def replace_station(df: DataFrame, folder: str) -> None:
    """Write full station sets; stations that are not in df keep their partition."""
    _clustered(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("station").parquet(folder)


def _clustered(df: DataFrame) -> DataFrame:
    """Rows ranged by station and time, so a station has few files and each of them a span of time that a scan can skip."""
    order = [c for c in ("station", "start_time") if c in df.columns]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def append_blocks(df: DataFrame, folder: str) -> None:
    """Append schedule rows. There is no unique key: appending twice stores twice."""
    _clustered(df).write.mode("append").partitionBy("station").parquet(folder)


def _in_range(station: str, lo, hi):
    return (F.col("station") == station) & (F.col("start_time") >= _ntz(lo)) & (F.col("start_time") < _ntz(hi))


def replace_range(base: DataFrame, rows: DataFrame, station: str, lo, hi) -> DataFrame:
    """A station's blocks starting in [lo, hi) replaced; everything else as it was."""
    return base.filter(~_in_range(station, lo, hi)).unionByName(rows.select(*base.columns))


def replacement_problems(base: DataFrame, rows: DataFrame, station: str, lo, hi, seam=None) -> DataFrame:
    """Why a range replacement must not be applied, as (code, id); empty when it is safe."""
    at = F.col("station") == station
    crosses_end = base.filter(at & (F.col("start_time") < _ntz(hi)) & (F.col("end_time") > _ntz(hi)))
    kept = base.filter(~_in_range(station, lo, hi))
    into_seam = kept.filter(
        at & (F.col("start_time") < _ntz(lo)) & (F.col("end_time") > _ntz(lo if seam is None else seam)))
    taken = rows.select("id").join(kept.select("id"), "id", "left_semi")
    outside = rows.filter(~_in_range(station, lo, hi))

    def found(df: DataFrame, code: str) -> DataFrame:
        return df.select(F.lit(code).alias("code"), "id")

    return (
        found(crosses_end, "crosses_range_end").unionByName(found(into_seam, "overlaps_seam"))
        .unionByName(found(taken, "id_collision")).unionByName(found(outside, "outside_range"))
    )


def untouched_differences(before: DataFrame, after: DataFrame, station: str, lo, hi) -> DataFrame:
    """Rows outside the replaced range that were lost or added; empty proves they are untouched."""
    a, b = before.filter(~_in_range(station, lo, hi)), after.filter(~_in_range(station, lo, hi)).select(*before.columns)
    return a.exceptAll(b).withColumn("side", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))
