"""Text search in a stored catalog by an inverted table of trigrams.

    store_catalog(items, folder)                     # the catalog by ranges of ids, and its postings by trigram
    search_stored(spark, folder, "b_lt", ["title"])  # the rows that catalog.search finds, from few files

A posting row holds the ids of one range whose column contains a trigram. Postings are kept in folders by the hash of the trigram and
sorted inside, so the few that a search needs are found by folder and by the bounds of row groups; so are the ranges of the catalog,
by the hash of their number. There are so many folders at any size, as a search lists them all. A search looks up in a small table
of its own how often the trigrams of its text occur, intersects the ids of the rarest, reads the catalog's ranges that hold any of them and tests these rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airlog.operators.catalog import search
from airlog.session import durable

COLUMNS = ("title", "tag", "path")
#: Ids of a range, folders of postings, trigrams that are intersected, and ranges that are named one by one in a scan.
RANGE, FOLDERS, RAREST, NAMED = 100_000, 512, 3, 1000


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a text in lower case; none of a shorter or null text."""
    lower = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(lower) - 2), lambda i: F.substr(lower, i, F.lit(3)))
    return F.array_distinct(F.when(F.length(lower) >= 3, runs).otherwise(F.array()))


def _folder_of(value: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(folders)).cast("int")


def store_catalog(items: DataFrame, folder: str, columns: Sequence[str] = COLUMNS, span: int = RANGE, folders: int = FOLDERS) -> None:
    """Write a catalog by ranges of its ids, `span` of them in each, and the postings of some of its columns.

    Ids are unique whole numbers. A posting row has at most `span` ids, so no trigram is gathered in one row, however common it is.
    """
    ranged = items.withColumn("id_range", F.floor(F.col("id") / span))
    placed = ranged.withColumn("range_folder", _folder_of(F.col("id_range"), folders))
    rows = ["range_folder", "id_range", "id"]
    placed.repartitionByRange(*rows).sortWithinPartitions(*rows).write.mode("overwrite").partitionBy("range_folder").parquet(f"{folder}/items")
    texts = ranged.select("id", "id_range", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), trigrams(F.col(c)).alias("grams")) for c in columns])).alias("_t"))
    postings = texts.select("id", "id_range", "_t.column", F.explode("_t.grams").alias("gram")).groupBy("gram", "column", "id_range").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    kept = postings.select("gram", "column", F.size("ids").alias("n"), "id_range", "ids", _folder_of(F.col("gram"), folders).alias("folder"))
    order = ["folder", "gram", "column", "id_range"]
    kept.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("folder").parquet(f"{folder}/postings")
    counts = items.sparkSession.read.parquet(f"{folder}/postings").groupBy("gram", "column").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("gram", "column").sortWithinPartitions("gram", "column").write.mode("overwrite").parquet(f"{folder}/counts")


def pattern_trigrams(text: str) -> list[str]:
    """The trigrams that any text matching a search must have: those between its wildcards."""
    runs = re.split(r"[%_]", text.lower())
    return sorted({run[i:i + 3] for run in runs for i in range(len(run) - 2)})


def search_stored(spark: SparkSession, folder: str, text: str, columns: Sequence[str] = COLUMNS, station: str | None = None,
                  folders: int = FOLDERS) -> DataFrame:
    """The rows of a stored catalog that catalog.search would find.

    Without three characters in a row between its wildcards a search has no trigram, and reads the whole catalog. What is looked up
    while the query is built: one count for each trigram and column of the search, and at most NAMED ranges with a candidate; with
    more than these, all ranges are read.
    """
    items = spark.read.parquet(f"{folder}/items")
    grams = pattern_trigrams(text)
    if not grams:
        return search(items, text, columns, station).drop("id_range", "range_folder")
    numbers = spark.range(1).select(F.array(*[_folder_of(F.lit(g), folders) for g in grams])).first()[0]
    folder_of = dict(zip(grams, numbers))

    def of(some: Sequence[str]) -> Column:
        return F.col("folder").isin([folder_of[g] for g in some]) & F.col("gram").isin(list(some))

    counts = spark.read.parquet(f"{folder}/counts").filter(F.col("gram").isin(grams) & F.col("column").isin(list(columns))).collect()
    wanted, used = F.lit(False), set()
    for column in columns:
        found = sorted((r["n"], r["gram"]) for r in counts if r["column"] == column)
        if len(found) == len(grams):  # a trigram that a column never has rules it out
            rarest = [g for _, g in found[:RAREST]]
            wanted, used = wanted | ((F.col("column") == column) & F.col("gram").isin(rarest)), used | set(rarest)
    if not used:
        return search(items.filter("false"), text, columns, station).drop("id_range", "range_folder")
    several = min(RAREST, len(grams))
    hits = spark.read.parquet(f"{folder}/postings").filter(of(sorted(used)) & wanted).select("column", "id_range", F.explode("ids").alias("id")).groupBy("column", "id_range", "id").agg(
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == several)
    candidates = durable(hits.select("id_range", "id").distinct())
    ranges = candidates.select("id_range", _folder_of(F.col("id_range"), folders).alias("range_folder")).distinct().limit(NAMED + 1).collect()
    near = items if len(ranges) > NAMED else items.filter(
        F.col("range_folder").isin(sorted({r["range_folder"] for r in ranges})) & F.col("id_range").isin([r["id_range"] for r in ranges]))
    return search(near.join(candidates, ["id_range", "id"], "left_semi"), text, columns, station).drop("id_range", "range_folder")
