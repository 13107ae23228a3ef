"""Chat format, vectors, components, registered queries and the pipeline against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airlog.llm import chat, embeddings, maxscore
from airlog.llm.common import written
from airlog.llm.components import connected_components
from airlog.llm.queries import ORACLES, QUERIES
from scripts.check_oracle import TABLES, rows_of

NAMES = ["role", "a\nb", "assistant", None, "<|im_end|>"]


def test_chat_round_trip(spark):
    rnd = random.Random(2)
    texts = ["hi", "", None, "<|im_end|>\n", "<\\|x", "<|im_sep|><|im_start|>assistant\n", "<<|", "é日\n\n", "\\", "$1 \\1", "x" * 9000 + "<|"]
    rows = [(c, t, rnd.choice(NAMES), rnd.choice(texts)) for c in [1, 2, None] for t in [0, 1, 2, 2, 3, None]]
    rows += [(9, t, rnd.choice(["user", "assistant"]), rnd.choice(texts[:8])) for t in range(1500)] + [rows[0]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat.format_conversations(turns)
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", "loss_spans", chat.parse_turns(F.col("formatted")).alias(
        "turns"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {1, 2, 9, None}
    for conv, r in got.items():
        own = sorted(((t is None, t or 0), role or "", text or "", ) for c, t, role, text in rows if c == conv)
        said = [(role, text) for _, role, text in own]
        assert sorted((t.role, t.text) for t in r.turns) == sorted(said)
        assert [t.role for t in r.turns] == [role for role, _ in said]
        assert list(r.loss) == [t.text for t in r.turns if t.role == "assistant"]
        assert r.formatted.count("<|im_start|>") == sum(k == 0 or said[k][0] != said[k - 1][0] for k in range(len(said)))
    assert chat.format_conversations(turns.where("false")).collect() == []


def vector_table(spark, count=400, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((30, 16))
    rows = [(int(k), [float(x) for x in np.float32(centers[k % 30] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.2, 1.0]))],
             int(k % 3)) for k in range(count)]
    rows += [rows[5], (1000, [2 * x for x in rows[5][1]], rows[5][2]), (1001, None, 1), (1002, [0.0] * 16, 1), (1003, rows[0][1], None),
             (1004, [float("nan")] * 16, 1), (1005, [1.0, None] * 8, 1), (1006, [float("inf")] * 16, 1), (1007, [], 1),
             (1008, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)), rows


def whole(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


@pytest.mark.parametrize("tile", [8192, 7])
def test_similar_vectors(spark, tile, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", tile)
    table, rows = vector_table(spark, 400 if tile > 7 else 90)
    use = [whole(v) and label is not None and any(v) for _, v, label in rows]
    full = [np.pad(np.array(v, float), (0, 16 - len(v))) if ok else None for (_, v, _), ok in zip(rows, use)]
    full = [None if f is None else f / np.linalg.norm(f) for f in full]
    near = [[b for b in range(len(rows)) if a != b and use[a] and use[b] and rows[a][2] == rows[b][2] and full[a] @ full[b] >= 0.93]
            for a in range(len(rows))]
    expected = Counter()
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            fresh = [b for b in near[todo.pop()] if b not in seen]
            seen.update(fresh)
            todo += fresh
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        expected[rows[a][0], len(near[a]), least, rows[a][0] == least] += 1
    assert Counter(tuple(r) for r in embeddings.similar(table).collect()) == expected
    assert embeddings.similar(table.where("false")).collect() == []


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 60)
    monkeypatch.setattr(maxscore, "BLOCK", 7)
    monkeypatch.setattr(maxscore, "STRETCH", 13)
    table, rows = vector_table(spark, 300)
    scaled = table.withColumn("vector", F.transform("embedding", lambda x: F.when(
        F.abs(x) < float("inf"), F.floor(8 * x.cast("double")))))
    queries = scaled.where("vec_id % 10 = 0")
    vectors = [(i, np.pad(np.floor(8 * np.array(v, float)), (0, 16 - len(v)))) for i, v, _ in rows
               if i is not None and v is not None and (whole(v) or v == [])]
    expected = set()
    for q, x in vectors:
        if q % 10 == 0:
            best = sorted((-int(x @ y), i) for i, y in vectors if i != q)[:5]
            expected |= {(q, rank + 1, i, -score) for rank, (score, i) in enumerate(best)}
    assert {tuple(r) for r in maxscore.top_k(scaled, queries).collect()} == expected
    few = maxscore.top_k(scaled.where("vec_id IN (10, 11, 12)"), queries.where("vec_id = 10"))
    assert few.count() == 2
    assert maxscore.top_k(scaled.where("false"), queries).collect() == [] == maxscore.top_k(scaled, queries.where("false")).collect()


def test_components(spark):
    rnd = random.Random(8)
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [
        (rnd.randrange(3000, 3300), rnd.randrange(3000, 3300)) for _ in range(200)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {n: top(n) for n in parent if n != top(n)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(name, spark, folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, folder)
    result = con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op") and n not in ORACLES))
def test_queries_without_sql(name, spark, folder):
    table = "embeddings" if name.startswith("op4") else "documents"
    assert QUERIES[name](spark, folder).count() == spark.read.parquet(f"{folder}/{table}.parquet").count()


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    before = docs
    for stage in stages[:-1]:
        after = written(stage(spark, before, folder), "stage")
        assert after.columns == docs.columns
        assert after.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
        before = after
    rows = corpus_pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in rows.collect()) == Counter(r.doc_id for r in before.collect())
