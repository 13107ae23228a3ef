"""The given tables shaped as schedules, catalogs, plans and manifests."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from airlog.functions.values import micros_interval, seconds_interval


class Tables:
    """Lazy views over one folder of parquet files. sql_views.py holds the same views in SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def blocks(self) -> DataFrame:
        us = F.round(F.col("value") * 100).cast("bigint") * 200000
        return self.read("events").select(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("station"),
            F.col("event_type").alias("title"),
            F.col("user_id").alias("content_id"),
            F.col("ts").alias("start_time"),
            (F.col("ts") + micros_interval(us)).alias("end_time"),
        )

    @cached_property
    def blocks_by_user(self) -> DataFrame:
        return self.blocks.withColumn("station", F.col("content_id").cast("string"))

    @cached_property
    def baseline(self) -> DataFrame:
        return self.blocks.filter("id % 7 <> 0")

    @cached_property
    def proposed(self) -> DataFrame:
        return self.blocks.filter("id % 11 <> 0").withColumns(
            {
                "title": F.when(F.col("id") % 13 == 0, F.concat("title", F.lit(" (new)"))).otherwise(F.col("title")),
                "end_time": F.when(F.col("id") % 17 == 0, F.col("end_time") + F.expr("INTERVAL 1 MINUTE"))
                .otherwise(F.col("end_time")),
            }
        )

    def _windows(self, blocks: DataFrame) -> DataFrame:
        return blocks.select("station").distinct().select(
            "station",
            F.expr("TIMESTAMP_NTZ'2024-01-05 00:00:00'").alias("seam"),
            F.expr("TIMESTAMP_NTZ'2024-01-25 00:00:00'").alias("horizon"),
        )

    @cached_property
    def windows(self) -> DataFrame:
        return self._windows(self.blocks)

    @cached_property
    def windows_by_user(self) -> DataFrame:
        return self._windows(self.blocks_by_user)

    @cached_property
    def parts_as_items(self) -> DataFrame:
        """Catalog rows without play counts."""
        path = F.concat_ws("/", "p_brand", "p_type", F.concat(
            F.col("p_name"), F.lit(" s"), F.col("p_size"), F.lit("e"), F.col("p_partkey") % 20, F.lit(".mp4")))
        return self.read("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_brand").alias("station"),
            F.col("p_type").alias("tag"),
            F.col("p_name").alias("title"),
            path.alias("path"),
            (F.col("p_size") * 60).cast("double").alias("duration"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        plays = self.read("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("count"))
        return self.parts_as_items.join(plays, "id", "left").withColumn("count", F.coalesce("count", F.lit(0)))

    @cached_property
    def plays(self) -> DataFrame:
        items = self.parts_as_items.select("id", "station", "path")
        return self.read("lineitem").join(items, F.col("l_partkey") == F.col("id")).select(
            "station", "path", F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
        )

    @cached_property
    def plan_entries(self) -> DataFrame:
        """Plan entries in exploded form: one row per entry, in order within its block."""
        order = ["l_linenumber", "l_partkey", "l_suppkey"]
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("block_id"),
            *order,
            (F.col("l_quantity") * 10).alias("duration"),
        )

    @cached_property
    def plan_blocks(self) -> DataFrame:
        total = self.plan_entries.groupBy(F.col("block_id").alias("id")).agg(F.sum("duration").alias("seconds"))
        starts = self.read("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("station"),
            F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("start_time"))
        return starts.join(total, "id").withColumn(
            "end_time", F.col("start_time") + seconds_interval("seconds"))

    @cached_property
    def manifest(self) -> DataFrame:
        return self.read("documents").select(
            "doc_id",
            F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".mp4"))).alias("path"),
            F.col("n_chars").alias("size"),
            (F.col("doc_id") * 1000).alias("mtime_ns"),
        )

    @cached_property
    def manifest_before(self) -> DataFrame:
        return self.manifest.filter("doc_id % 9 <> 0").drop("doc_id")

    @cached_property
    def manifest_after(self) -> DataFrame:
        grown = F.when(F.col("doc_id") % 6 == 0, F.col("size") + 1).otherwise(F.col("size"))
        return self.manifest.filter("doc_id % 10 <> 0").withColumn("size", grown).drop("doc_id")
