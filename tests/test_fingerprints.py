"""Trees of fingerprints against row-by-row comparison."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from airlog.operators import fingerprints as fp
from conftest import rows

KIND = "k bigint, a string, n int"


def versions(seed):
    rnd = random.Random(seed)
    made = [(rnd.randrange(-3000, 200_000), rnd.choice("ab"), rnd.randrange(3)) for _ in range(3000)] + [(None, "a", 1), (None, "b", 1)]
    after = [r for r in made if rnd.random() > 0.001] + rnd.sample(made, 3) + [(900_000_000 + seed, "far", 1)] * 2
    return made, after


@pytest.mark.parametrize("seed, named", [(1, 1000), (2, 1000), (3, 0)])
def test_differences_are_located(spark, tmp_path, monkeypatch, seed, named):
    monkeypatch.setattr(fp, "NAMED", named)
    made, after = versions(seed)
    a, b = spark.createDataFrame(made, KIND), spark.createDataFrame(after, KIND)
    for name, df in (("a", a), ("b", b)):
        fp.store_tree(df, str(tmp_path / name), "k", width=10, fanout=4)
    found = fp.changed_ranges(spark, str(tmp_path / "a"), str(tmp_path / "b"), width=10, fanout=4)
    lost, added = Counter(made) - Counter(after), Counter(after) - Counter(made)
    leaves = {None if r[0] is None else r[0] // 10 for r in [*lost, *added]}

    def size(side, leaf):
        return sum((None if r[0] is None else r[0] // 10) == leaf for r in side)

    want = [(None if leaf is None else leaf * 10, None if leaf is None else leaf * 10 + 9, size(made, leaf), size(after, leaf)) for leaf in leaves]
    assert rows(found) == sorted(want, key=repr)
    changes = fp.changed_rows(a, b, found, "k", width=10)
    assert rows(changes) == sorted([("lost", n, *r) for r, n in lost.items()] + [("added", n, *r) for r, n in added.items()], key=repr)


def test_equal_and_empty_tables(spark, tmp_path):
    made, _ = versions(4)
    df = spark.createDataFrame(made, KIND)
    for name, some in (("a", df), ("b", df.orderBy("n")), ("none", df.filter("false")), ("none2", df.filter("false"))):
        fp.store_tree(some, str(tmp_path / name), "k", width=100)
    assert fp.changed_ranges(spark, str(tmp_path / "a"), str(tmp_path / "b"), width=100).collect() == []
    assert fp.changed_ranges(spark, str(tmp_path / "none"), str(tmp_path / "none2"), width=100).collect() == []
    every = fp.changed_ranges(spark, str(tmp_path / "none"), str(tmp_path / "a"), width=100)
    assert every.agg(F.sum("rows_before"), F.sum("rows_after")).first() == (0, len(made))


def test_only_children_of_unequal_nodes_are_read(spark, tmp_path, monkeypatch):
    """One changed row in 200,000 leaves: every level names the children of one node in its scan."""
    a = spark.range(200_000).selectExpr("id * 10 AS k", "'a' AS a", "1 AS n")
    b = a.withColumn("n", F.expr("IF(k = 777770, 2, n)"))
    for name, df in (("a", a), ("b", b)):
        fp.store_tree(df, str(tmp_path / name), "k", width=10, fanout=16)
    read, plain = [], fp.durable

    def kept(df):
        read.append(df._jdf.queryExecution().toString())
        return plain(df)

    monkeypatch.setattr(fp, "durable", kept)
    found = fp.changed_ranges(spark, str(tmp_path / "a"), str(tmp_path / "b"), width=10, fanout=16)
    assert rows(found) == [(777770, 777779, 1, 1)]
    lower = read[1:]
    assert len(lower) >= 4 and all("GreaterThanOrEqual(node," in p and "PartitionFilters: [isnotnull(level" in p for p in lower)
    last = spark.read.parquet(str(tmp_path / "a")).filter("level = 0")
    assert last.count() == 200_000


def test_many_unequal_leaves(spark, tmp_path):
    """Nearly a thousand unequal leaves do not overflow the stack."""
    a = spark.range(40_000).selectExpr("id AS k", "1 AS v")
    b = a.withColumn("v", F.expr("IF(k % 40 = 3 AND k < 39000, 2, v)"))
    for name, df in (("a", a), ("b", b)):
        fp.store_tree(df, str(tmp_path / name), "k", width=10, fanout=4)
    found = fp.changed_ranges(spark, str(tmp_path / "a"), str(tmp_path / "b"), width=10, fanout=4)
    assert rows(found) == sorted(((k, k + 9, 10, 10) for k in range(0, 39_000, 40)), key=repr)
    assert fp.changed_rows(a, b, found, "k", width=10).count() == 2 * 975
    tests = fp._any_of([F.col("id") == n for n in range(0, 2000, 2)])
    assert spark.range(10).select(tests.alias("even")).filter("even").count() == 5


def test_sums_are_those_of_the_rows(spark):
    """A node's digest parts are the sums of its rows' parts, so a fingerprint does not depend on how rows are split."""
    df = spark.createDataFrame(versions(5)[0], KIND)
    top = fp.tree(df, "k", width=1000).groupBy("level").agg(*[F.sum(c).alias(c) for c in ("row_count", *fp._SUMS)])
    assert len({tuple(r)[1:] for r in top.collect()}) == 1
    one = fp.hashed_rows(df).agg(F.count(F.lit(1)), *[F.sum(s) for s in fp._SUMS]).first()
    assert tuple(top.first())[1:] == tuple(one)
