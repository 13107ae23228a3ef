"""Fingerprints of tables that do not depend on the order of rows, and trees of them that show where two tables differ.

The canonical text of a row is hashed, its hash cut into parts, and the parts are summed; so a fingerprint combines before it is
shuffled, nothing is sorted, and equal rows count as often as they occur. As sums add up, the fingerprint of a range of keys is that
of its parts: a tree over ranges of keys costs one pass over the rows, and two trees are compared from the root down, reading
below unequal nodes only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airlog.functions.values import canonical
from airlog.session import durable

#: A row's digest is so many numbers of 15 hexadecimal digits, and each is summed in pieces of 20 bits, so that no sum overflows.
PARTS, PIECES, BITS = 4, 3, 20
_SUMS = [f"s{i}_{j}" for i in range(PARTS) for j in range(PIECES)]


def hashed_rows(df: DataFrame, *keep: Column) -> DataFrame:
    """The kept columns and the pieces of each row's digest."""
    parts = [F.conv(F.substr("_d", F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("bigint").alias(f"_p{i}") for i in range(PARTS)]
    numbers = df.select(*keep, F.sha2(canonical(df, df.columns), 256).alias("_d")).select("*", *parts).drop("_d")
    pieces = [F.shiftright(f"_p{i}", BITS * (PIECES - 1 - j)).bitwiseAND(F.lit((1 << BITS) - 1)).alias(f"s{i}_{j}")
              for i in range(PARTS) for j in range(PIECES)]
    return numbers.select("*", *pieces).drop(*[f"_p{i}" for i in range(PARTS)])


def _digest() -> Column:
    """The digest of summed pieces, as hexadecimal text."""
    def whole(i: int) -> Column:
        return reduce(lambda high, j: high * (1 << BITS) + F.col(f"s{i}_{j}").cast("decimal(38,0)"), range(1, PIECES),
                      F.col(f"s{i}_0").cast("decimal(38,0)")).cast("decimal(38,0)")

    return F.sha2(F.concat_ws(":", F.col("row_count"), *[whole(i).cast("string") for i in range(PARTS)]), 256)


def fingerprint(df: DataFrame, table: str) -> DataFrame:
    """One row (table, columns, row_count, digest)."""
    layout = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
    summed = hashed_rows(df).agg(F.count(F.lit(1)).alias("row_count"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in _SUMS])
    return summed.select(F.lit(table).alias("table"), F.lit(layout).alias("columns"), "row_count", _digest().alias("digest"))


def diff_fingerprints(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per table: added, removed, schema_changed, changed or same, with row counts and digests of both sides."""
    sides = [df.select("table", F.col("columns").alias(f"_c_{n}"), F.col("row_count").alias(f"rows_{n}"), F.col("digest").alias(f"digest_{n}"))
             for df, n in ((before, "before"), (after, "after"))]
    equal = (F.col("rows_before") == F.col("rows_after")) & (F.col("digest_before") == F.col("digest_after"))
    change = (
        F.when(F.col("_c_before").isNull(), "added").when(F.col("_c_after").isNull(), "removed")
        .when(F.col("_c_before") != F.col("_c_after"), "schema_changed").when(~equal, "changed").otherwise("same")
    )
    return sides[0].join(sides[1], "table", "full_outer").select(
        "table", change.alias("change"), "rows_before", "rows_after", "digest_before", "digest_after")


def runs_match(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: whether two runs gave the same rows, with both digests and counts."""
    both = fingerprint(first, "first").unionByName(fingerprint(second, "second"))

    def of(run: str, name: str) -> Column:
        return F.max(F.when(F.col("table") == run, F.col(name)))

    return both.agg(
        of("first", "digest").alias("digest_1"), of("second", "digest").alias("digest_2"),
        of("first", "row_count").alias("rows_1"), of("second", "row_count").alias("rows_2"),
    ).withColumn("passed", F.col("digest_1") == F.col("digest_2"))


# ---- trees ---------------------------------------------------------------------------------

#: Keys of a leaf, children of a node, and nodes that are named one by one in a scan.
WIDTH, FANOUT, NAMED = 4096, 16, 100
_STORED = ", ".join(["node bigint", "row_count bigint", *[f"{s} bigint" for s in _SUMS], "level int"])


def tree(df: DataFrame, key: str, width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """(level, node, row_count, digest parts) of every node: a leaf, level 0, covers `width` whole-numbered keys, a node of level k
    `fanout` nodes of level k - 1. The top level has one node or, if there are negative keys as well, two; rows without a key are
    the node null of every level. Only leaves are summed from rows, once; the rest is summed from them.
    """
    sums = [F.count(F.lit(1)).alias("row_count"), *[F.sum(s).alias(s) for s in _SUMS]]
    leaves = hashed_rows(df, F.floor(F.col(key) / width).alias("node")).groupBy("node").agg(*sums)
    levels = 1
    while width * fanout ** (levels - 1) < 1 << 62:
        levels += 1
    # from the leaves to the first level on which both ends fall into the same node or into the two next to 0
    leaves = durable(leaves)
    low, high = leaves.agg(F.coalesce(F.min("node"), F.lit(0)), F.coalesce(F.max("node"), F.lit(0))).first()
    top = 0
    while top < levels and not (-1 <= low // fanout ** top and high // fanout ** top <= 0):
        top += 1
    placed = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    power = F.get(F.array(*[F.lit(fanout ** k) for k in range(top + 1)]), F.col("level"))
    added = [F.sum(c).alias(c) for c in ("row_count", *_SUMS)]
    return placed.withColumn("node", F.floor(F.col("node") / power)).groupBy("level", "node").agg(*added)


def store_tree(df: DataFrame, folder: str, key: str, width: int = WIDTH, fanout: int = FANOUT) -> None:
    """Write a tree by level, ordered by node."""
    tree(df, key, width, fanout).repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.mode("overwrite").partitionBy(
        "level").parquet(folder)


def _any_of(tests: Sequence[Column]) -> Column:
    """Whether one of some tests holds, halved again and again: a chain of as many ORs would be as deep as it is long."""
    if len(tests) < 2:
        return tests[0] if tests else F.lit(False)
    return _any_of(tests[:len(tests) // 2]) | _any_of(tests[len(tests) // 2:])


def _children(nodes: DataFrame, parents: DataFrame, named: Sequence[int | None] | None, fanout: int) -> DataFrame:
    """Nodes of a level below some nodes of the next; a few are named in the scan, so that only their row groups are read."""
    if named is not None:
        ranges = [F.col("node").between(p * fanout, p * fanout + fanout - 1) if p is not None else F.col("node").isNull() for p in named]
        return nodes.filter(_any_of(ranges))
    return nodes.withColumn("_p", F.floor(F.col("node") / fanout)).join(
        parents.select(F.col("node").alias("_parent")), F.col("_p").eqNullSafe(F.col("_parent")), "left_semi").drop("_p")


def changed_ranges(spark: SparkSession, before: str, after: str, width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """(low_key, high_key, rows_before, rows_after) of the leaves in which two stored trees of equal width differ.

    Levels are compared from the top, each below the unequal nodes of the one above only. Rows without a key are the range null.
    """
    trees = [spark.read.schema(_STORED).parquet(f) for f in (before, after)]
    tops = [t.agg(F.max("level")).first()[0] for t in trees]
    empty = "node bigint, rows_before bigint, rows_after bigint"
    unequal, named = spark.createDataFrame([], empty), None
    # a level that both trees have; every row lies below its nodes
    highest = min([t for t in tops if t is not None], default=None)
    if highest is None:
        return unequal.select(*_bounds(width))
    for level in range(highest, -1, -1):
        sides = []
        for nodes, name in zip(trees, ("before", "after")):
            own = nodes.filter(F.col("level") == level).drop("level")
            if level < highest:
                own = _children(own, unequal, named, fanout)
            sides.append(own.select("node", F.struct("row_count", *_SUMS).alias(f"_{name}"), F.col("row_count").alias(f"rows_{name}")))
        both = sides[0].withColumnRenamed("node", "_node").join(
            sides[1], F.col("_node").eqNullSafe(F.col("node")), "full_outer").withColumn("node", F.coalesce("node", "_node"))
        unequal = durable(both.filter(~F.col("_before").eqNullSafe(F.col("_after"))).select(
            "node", F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after")))
        some = [r["node"] for r in unequal.select("node").limit(NAMED + 1).collect()]
        named = some if len(some) <= NAMED else None
    return unequal.select(*_bounds(width))


def _bounds(width: int) -> list[Column]:
    return [(F.col("node") * width).alias("low_key"), (F.col("node") * width + (width - 1)).alias("high_key"),
            F.col("rows_before"), F.col("rows_after")]


def changed_rows(before: DataFrame, after: DataFrame, ranges: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(change, copies and all columns) of the rows inside some ranges that one table has more often than the other.

    change is lost or added. A few ranges are named in both scans; more are joined.
    """
    lows = [r["low_key"] for r in ranges.select("low_key").limit(NAMED + 1).collect()]

    def inside(df: DataFrame) -> DataFrame:
        if len(lows) <= NAMED:
            return df.filter(_any_of([
                F.col(key).between(low, low + width - 1) if low is not None else F.col(key).isNull() for low in lows]))
        starts = ranges.select(F.col("low_key").alias("_low"))
        return df.join(starts, (F.floor(F.col(key) / width) * width).eqNullSafe(F.col("_low")), "left_semi")

    columns = before.columns
    both = inside(before).withColumn("_n", F.lit(-1)).unionByName(inside(after).withColumn("_n", F.lit(1)))
    counted = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return counted.select(F.when(F.col("_n") < 0, "lost").otherwise("added").alias("change"), F.abs("_n").alias("copies"), *columns)
