"""Exact top-k search by inner product with MaxScore over shards.

A vector's components are terms: each term's postings are the rows with a value of one sign, and the largest value among them
bounds what the term adds to a score. Of a query's terms, those with the smallest bounds are non-essential as long as their
bounds add up to less than the k-th best score so far: a row that is only in their postings can not be among the best. Rows are
scored on the essential terms, and only those that can still compete with the bounds of the others are scored in full.

Rows are dealt into shards and queries into blocks; every block meets every shard in a task of its own, for many queries at a
time, and the best of all shards are merged. Scores are whole numbers, exact in double precision up to 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, queries of a block, and rows that are looked at between two renewals of the thresholds.
SHARD, BLOCK, STRETCH = 4096, 1024, 1024


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def best_of_shard(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query, row, score) arrays that hold each query's k best rows, ties to the smaller id, without rows of its own id."""
    high, low = rows.max(axis=0, initial=0), rows.min(axis=0, initial=0)
    bounds = np.where(queries > 0, queries * high, queries * low)
    order = np.argsort(bounds, axis=1, kind="stable")
    totals = np.cumsum(np.take_along_axis(bounds, order, axis=1), axis=1)
    count = len(queries)
    best_score, best_row = np.full((count, k), -np.inf), np.full((count, k), -1, dtype=np.int64)
    by_id = np.argsort(ids, kind="stable")
    for at in range(0, len(rows), STRETCH):
        some = by_id[at:at + STRETCH]
        threshold = best_score[:, -1]
        rest = (totals < threshold[:, None]).sum(axis=1)  # so many terms are non-essential
        bound = np.where(rest > 0, np.take_along_axis(totals, np.maximum(rest - 1, 0)[:, None], axis=1)[:, 0], 0)
        essential = np.empty(queries.shape, dtype=bool)
        np.put_along_axis(essential, order, np.arange(queries.shape[1])[None, :] >= rest[:, None], axis=1)
        partial = np.where(essential, queries, 0) @ rows[some].T
        # rows come by id, so an equal score of a later row never wins
        may = partial + bound[:, None] > threshold[:, None]
        may &= ids[some][None, :] != query_ids[:, None]
        query, row = np.nonzero(may)
        score = partial[query, row]
        for part in range(0, len(query), 200_000):
            own = slice(part, part + 200_000)
            others = np.where(essential[query[own]], 0, queries[query[own]])
            score[own] += np.einsum("ij,ij->i", others, rows[some[row[own]]])
        merged_query = np.concatenate([np.repeat(np.arange(count), k), query])
        merged_score = np.concatenate([best_score.ravel(), score])
        merged_row = np.concatenate([best_row.ravel(), some[row]])
        place = np.concatenate([np.tile(np.arange(k), count) - k, at + row])
        ranked = np.lexsort((place, -merged_score, merged_query))
        first = np.searchsorted(merged_query[ranked], np.arange(count))
        top = ranked[first[:, None] + np.arange(k)[None, :]]
        best_score, best_row = merged_score[top], merged_row[top]
    query, rank = np.nonzero(best_row >= 0)
    return query, best_row[query, rank], best_score[query, rank]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest inner products for each query, ties to smaller ids.

    Vectors hold whole numbers. Null vectors, vectors with a null or non-finite component, and rows without an id take no part;
    shorter vectors count as ending in zeros. Rows with a query's id are the query's own and are left out; other repeated rows
    count each. Queries with one id and vector are one query. An empty side gives an empty result.

    The numbers of shards and blocks follow from the counts of both sides, so a task always has about SHARD + BLOCK rows.
    """

    def part(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
            usable(F.col("vector")) & F.col("id").isNotNull())

    own_rows, own_queries = part(rows), part(queries).distinct()
    shards = max(1, -(-own_rows.count() // SHARD))
    blocks = max(1, -(-own_queries.count() // BLOCK))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    number = F.xxhash64("id", "vector")
    dealt = own_rows.select("id", "vector", F.lit(False).alias("asks"), F.pmod(number, F.lit(shards)).alias("shard"),
                            every(blocks).alias("block"))
    asked = own_queries.select("id", "vector", F.lit(True).alias("asks"), every(shards).alias("shard"),
                               F.pmod(number, F.lit(blocks)).alias("block"))

    def searched(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        vectors = matrix(table.column("vector").combine_chunks())
        if asks.all() or not asks.any():
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = best_of_shard(vectors[asks], ids[asks], vectors[~asks], ids[~asks], k)
        query, row, score = found
        return pa.table({"query_id": ids[asks][query], "vec_id": ids[~asks][row], "score": score.astype(np.int64)})

    best = dealt.unionByName(asked).groupBy("shard", "block").applyInArrow(searched, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
