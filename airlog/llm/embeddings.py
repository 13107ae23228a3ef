"""Near-duplicate embeddings by a subspace pigeonhole join.

Two vectors of length one have the cosine c if their squared distance is 2 - 2c. The vectors are rotated and cut into BLOCKS
subspaces of nearly equal dimension. If a whole squared distance is at most the budget, then in one subspace at least the squared
distance is at most the subspace's share of it, in proportion to its dimensions. So each subspace has a range join of its own:
cells of a grid over its first coordinates, where a vector is at home in one cell and visits those that its range reaches. A
pair is counted in the first subspace that finds it, in the home cell of its smaller number, and only if the cosine of the
original vectors is large enough; so the union of all candidates is verified and no pair counts twice.

Equal vectors are one class. Of the links in a cell only the numbers for each vector are returned, and as many links as connect
what they connect. A cell of more than TILE rows is cut into tiles, each pair of which is a task's group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlog.llm.common import written
from airlog.llm.components import connected_components
from airlog.llm.maxscore import matrix, usable
from airlog.llm.simhash import merge_labels

#: Subspaces, grid coordinates of each, width of a cell in ranges, rows of a tile, and pairs that are verified at a time.
BLOCKS, GRID, WIDTH, TILE, PAIRS = 4, 2, 2.0, 8192, 200_000
#: Added to the budget, far above what rounding can take from a squared distance.
SLACK = 1e-9


def rotation(dimensions: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def rotated_units(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Vectors of length one, rotated. Every number depends on its own row alone, whichever rows are beside it."""
    units = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    length = np.zeros(len(units))
    for k in range(units.shape[1]):
        length += units[:, k] * units[:, k]
    units /= np.sqrt(length)[:, None]
    out = np.zeros_like(units)
    for k in range(units.shape[1]):
        out += units[:, k, None] * turn[k][None, :]
    return out


class Subspaces:
    def __init__(self, dimensions: int, threshold: float, blocks: int = BLOCKS, grid: int = GRID):
        count = min(blocks, dimensions)
        self.turn = rotation(dimensions)
        self.parts = [range(dimensions * i // count, dimensions * (i + 1) // count) for i in range(count)]
        total = max(0.0, 2 - 2 * threshold) + SLACK
        self.budgets = [total * len(p) / dimensions for p in self.parts]
        self.grid = [min(grid, len(p)) for p in self.parts]

    def cells(self, turned: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(subspace, row, cell number, at home) arrays: where each row is at home and which cells it visits."""
        for block, (part, budget, grid) in enumerate(zip(self.parts, self.budgets, self.grid)):
            reach = np.sqrt(budget)
            width = WIDTH * reach
            place = turned[:, part.start:part.start + grid]
            home = np.floor(place / width).astype(np.int64)
            low, high = np.floor((place - reach) / width).astype(np.int64), np.floor((place + reach) / width).astype(np.int64)
            for step in product((-1, 0, 1), repeat=grid):
                cell = home + np.array(step)
                inside = ((cell >= low) & (cell <= high)).all(axis=1)
                number = np.zeros(len(cell), dtype=np.int64)
                for k in range(grid):
                    number = number * 4096 + cell[:, k] + 2048  # coordinates lie between -1 and 1
                rows = np.flatnonzero(inside)
                yield block, rows, number[rows], np.full(len(rows), not any(step))

    def distances(self, block: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances in a subspace between rows of a and b, added up in one order: the same wherever a pair is met."""
        part = self.parts[block]
        out = 0.0
        for k in part:
            difference = a[..., k] - b[..., k]
            out = out + difference * difference
        return out

    def candidates(self, block: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that this subspace is the first to find."""
        part = slice(self.parts[block].start, self.parts[block].stop)
        x, y = a[:, part], b[:, part]
        # a product of matrices first, whose rounding depends on the rows beside: with slack, and then exactly for what is left
        about = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
        left, right = np.nonzero(about <= self.budgets[block] + SLACK)
        for at_most, other in [(True, block), *((False, before) for before in range(block))]:
            stays = np.ones(len(left), dtype=bool)
            for at in range(0, len(left), PAIRS):
                own = slice(at, at + PAIRS)
                stays[own] = (self.distances(other, a[left[own]], b[right[own]]) <= self.budgets[other]) == at_most
            left, right = left[stays], right[stays]
        return left, right


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _eligible(label: Column, vector: Column) -> Column:
    return label.isNotNull() & usable(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def similar(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", label_col: str = "label",
            vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are other rows with an equal label and a cosine of at least
    threshold, in double precision.

    Rows with a null label, a null or zero vector, or a null or non-finite component link with nothing and are their own
    component; so do vectors of other dimension than the rest of a label's longest ones, as if they ended in zeros. Rows with one
    id are different vectors. component_id is the smallest id reachable; null ids come last. An empty table stays empty.
    """
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    eligible = own.where(_eligible(F.col("label"), F.col("vector")))
    classes = written(eligible.groupBy("label", "vector").agg(
        F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("least")).withColumn(
        "node", F.monotonically_increasing_id()), "vector-classes")
    dimensions = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    spaces = Subspaces(dimensions, threshold)
    label_type, vector_type = classes.schema["label"].dataType, classes.schema["vector"].dataType

    def full(vectors: pa.ListArray) -> np.ndarray:
        found = matrix(vectors)
        return np.pad(found, ((0, 0), (0, dimensions - found.shape[1])))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = rotated_units(full(batch.column(1)), spaces.turn)
            for block, row, cell, home in spaces.cells(turned):
                some = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(np.full(len(row), block, np.int32)), pa.array(cell), pa.array(home)],
                    names=["label", "vector", "members", "node", "block", "cell", "home"])

    keys = ["label", "block", "cell"]
    cells = classes.select("label", "vector", "members", "node").mapInArrow(
        placed, f"label {label_type.simpleString()}, vector {vector_type.simpleString()}, members long, node long, block int, "
                "cell long, home boolean")
    places = written(cells, "cells")
    large = places.groupBy(*keys).count().where(F.col("count") > TILE).select(
        *keys, F.ceil(F.col("count") / TILE).cast("int").alias("pieces"))
    pieces = F.coalesce("pieces", F.lit(1))
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    dealt = places.join(large, keys, "left").withColumn("pieces", pieces).withColumn(
        "piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    # a row stands in the tiles of its piece's column, and if at home also in those of its row
    columns = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("piece").alias("j")))
    lines = F.transform(every, lambda j: F.struct(F.col("piece").alias("i"), j.alias("j")))
    tiles = dealt.withColumn("tile", F.explode(F.array_distinct(
        F.when(F.col("home"), F.concat(columns, lines)).otherwise(columns)))).select(
        *keys, "tile.i", "tile.j", "piece", "home", "node", "members", "vector")

    def joined(table: pa.Table) -> pa.Table:
        block, i, j = (table.column(c)[0].as_py() for c in ("block", "i", "j"))
        home, piece, node, members = (table.column(c).to_numpy() for c in ("home", "piece", "node", "members"))
        vectors = full(table.column("vector").combine_chunks())
        turned = rotated_units(vectors, spaces.turn)
        at_home, others = np.flatnonzero(home & (piece == i)), np.flatnonzero(piece == j)
        links, labels = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for start in range(0, len(at_home), 256):
            here = at_home[start:start + 256]
            a, b = spaces.candidates(block, turned[here], turned[others])
            a, b = here[a], others[b]
            first = node[a] < node[b]
            a, b = a[first], b[first]
            for at in range(0, len(a), PAIRS):
                x, y = a[at:at + PAIRS], b[at:at + PAIRS]
                linked = cosines(vectors[x], vectors[y]) >= threshold
                x, y = x[linked], y[linked]
                links += np.bincount(x, weights=members[y], minlength=len(node)).astype(np.int64)
                links += np.bincount(y, weights=members[x], minlength=len(node)).astype(np.int64)
                merge_labels(labels, x, y)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "root": node[labels[some]]})

    found = written(tiles.groupBy(*keys, "i", "j").applyInArrow(joined, "node long, links long, root long"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = classes.select("node", "label", "vector", "members", "least").join(counts, "node", "left").join(
        groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    marks = rooted.join(smallest, "root").select(
        F.col("label").alias("class_label"), F.col("vector").alias("class_vector"),
        (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined_rows = own.join(marks, (F.col("label") == F.col("class_label")) & (F.col("vector") == F.col("class_vector")), "left")
    component = F.when(F.col("class_label").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined_rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
