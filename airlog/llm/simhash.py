"""SimHash near duplicates, linked through BK-trees.

A fingerprint has a bit for each of the 64 bits of a hash: 1 if more than half of the hashes of a text's word shingles have it.
Documents whose fingerprints differ in at most `radius` bits are linked; a component of links is a group of near duplicates.

Links are found among distinct fingerprints. A BK-tree keeps under each node one child for each Hamming distance; a search
follows only the edges whose distance lies within the radius of its own distance to the node. One tree over a whole corpus, or
every tree sent to every task, has no size bound. So the trees are sharded by what linked fingerprints must share: of
radius + 2 equal parts of the bits, two fingerprints within the radius agree in two at least. Each pair of parts deals the
fingerprints into shards by their bits there, and every shard is a tree that only the fingerprints of its own shard search. A
shard of more than `tree_size` fingerprints is cut into several trees, and each is sent to each piece of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlog.llm.common import portions, written
from airlog.llm.components import connected_components

#: Rows of a partition that are turned into trees together, and pairs of a search that are looked at together.
FOREST_ROWS, FRONTIER = 100_000, 2_000_000


def simhash(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of one UTF-8 text; 0 if it has no word. A-Z count as a-z."""
    words = (text or b"").lower().split()  # bytes: only ASCII letters change, only ASCII white space separates
    if not words:
        return 0
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)))], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at:at + 65_536]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) of every row: the 64 bits as a signed number. Null and empty texts have fingerprint 0."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp long"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([
                simhash(t, width, seed) for some in portions(batch, 1) for t in some.column(1).cast(pa.binary()).to_pylist()
            ], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(hashed, schema)


class Forest:
    """BK-trees of many shards in common arrays. rows: distinct values of a shard lie together; root: first row of a row's shard."""

    def __init__(self, values: np.ndarray, root: np.ndarray):
        self.values, self.root = values, root
        self.child = np.full((len(values), 65), -1, dtype=np.int32)
        rows = np.flatnonzero(root != np.arange(len(values)))
        at = root[rows]
        while len(rows):
            distance = np.bitwise_count(values[rows] ^ values[at]).astype(np.int64)
            below = self.child[at, distance]
            free = np.flatnonzero(below < 0)
            _, first = np.unique(at[free] * 65 + distance[free], return_index=True)
            placed = free[first]
            self.child[at[placed], distance[placed]] = rows[placed]
            stay = np.ones(len(rows), dtype=bool)
            stay[placed] = False
            at = np.where(below < 0, at, below)[stay]
            rows = rows[stay]

    def search(self, values: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position in values, tree row) within the radius, some at a time."""
        query, node = np.arange(len(values)), roots
        while len(query):
            distance = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            queries, nodes = [], []
            for edge in range(-radius, radius + 1):
                to = distance + edge
                fits = (to >= 1) & (to <= 64)
                below = self.child[node[fits], to[fits]]
                there = below >= 0
                queries.append(query[fits][there])
                nodes.append(below[there].astype(np.int64))
            query, node = np.concatenate(queries), np.concatenate(nodes)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give every two linked rows, and all that have their labels, the smallest label among them."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def _links(table: pa.Table, radius: int) -> pa.RecordBatch:
    """Of the links inside each tile of whole tiles: as many as connect what they connect."""
    part, key, left, right, piece, fp = (table.column(c).to_numpy() for c in ("part", "key", "left", "right", "piece", "fp"))
    values, rows = fp.view(np.uint64), np.arange(len(fp))
    starts = np.ones(len(fp), dtype=bool)
    starts[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    tile = np.cumsum(starts) - 1
    in_tree, asks = piece == left, piece == right
    tree_rows = np.flatnonzero(in_tree)
    place = np.cumsum(in_tree) - 1
    first = np.full(tile[-1] + 1, -1, dtype=np.int64)
    first[tile[tree_rows][::-1]] = place[tree_rows][::-1]
    forest = Forest(values[tree_rows], first[tile[tree_rows]])
    size = np.bincount(tile[tree_rows], minlength=tile[-1] + 1)
    asking = rows[asks & (size[tile] > 0)]
    asking = asking[(size[tile[asking]] > 1) | (left[asking] != right[asking])]
    labels = rows.copy()
    cuts = np.flatnonzero(np.diff(np.cumsum(size[tile[asking]]) // FRONTIER)) + 1
    for some in np.split(asking, cuts):
        for query, node in forest.search(values[some], first[tile[some]], radius):
            merge_labels(labels, some[query], tree_rows[node])
    linked = labels != rows
    return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[labels[linked]])], names=["a", "b"])


def fingerprint_links(values: DataFrame, radius: int = 2, tree_size: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct numbers fp of a table that connect all that differ in at most radius bits.

    Not every pair is returned: of the links found inside a shard, as many as connect the same fingerprints.
    """
    parts = radius + 2
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = []
    for i, j in combinations(range(parts), 2):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in (i, j))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    shards = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "key"))
    large = shards.groupBy("part", "key").count().where(F.col("count") > tree_size).select(
        "part", "key", F.ceil(F.col("count") / tree_size).cast("int").alias("pieces"))
    dealt = shards.join(large, ["part", "key"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn(
        "piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "part", "key", F.least("piece", "other").alias("left"), F.greatest("piece", "other").alias("right"), "piece", "fp")
    keys = ["part", "key", "left", "right"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < FOREST_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.slice(count - 1).select(keys).to_pylist()[0]
            same = np.logical_and.reduce([table.column(k).to_numpy() == last[k] for k in keys])
            whole = int(np.argmax(same))  # rows are sorted: the last tile may go on in the next batch
            if whole:
                yield _links(table.slice(0, whole).combine_chunks(), radius)
            rest = table.slice(whole)
            held, count = rest.to_batches(), rest.num_rows
        if count:
            yield _links(pa.Table.from_batches(held).combine_chunks(), radius)

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3,
                    tree_size: int = 4096) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id of the rows reachable by links.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Rows with a null id take part; the smallest id
    of a component that has no other is null. Repeated rows are repeated in the result. An empty table gives an empty one.
    """
    marks = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    rooted = _rooted(written(marks.groupBy("fp").agg(F.min("id").alias("least")), "classes"), radius, tree_size)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def _rooted(classes: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """(fp, least, root) of the distinct fingerprints of a written table (fp, least): root is one fingerprint of the component."""
    groups = connected_components(fingerprint_links(classes.select("fp"), radius, tree_size))
    return classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3,
                 tree_size: int = 4096) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: one with the smallest id of the group, null last.

    Rows that share an id but not their text are rows like others, also those without an id: each counts in the group of its
    own text. If a group has several texts under its smallest id, the one with the smallest md5 stays; of rows that are equal
    in id and text, the one with the smallest hash of all columns.
    """
    ident, text = (F.md5(docs[c].cast("string").cast("binary")) for c in (id_col, text_col))
    key = F.concat(F.coalesce(ident, F.lit("null")), F.lit(" "), F.coalesce(text, F.lit("null")))
    marked = docs.select(F.struct(docs[id_col].isNull().alias("missing"), docs[id_col].alias("id"), key.alias("key")).alias("place"),
                         docs[text_col].alias("text"))
    marks = fingerprints(marked, "place", "text", width)
    classes = written(marks.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    kept = written(_rooted(classes, radius, tree_size).groupBy("root").agg(F.min("least").alias("least")).select(
        F.col("least.key").alias("key")), "kept")
    # equal rows are combined before their shuffle, which also serves the join
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.groupBy(key.alias("key")).agg(F.min_by(row, F.xxhash64(row.cast("string"))).alias("row"))
    # the kept keys grow with the corpus: a merge join at every size, never a broadcast
    return rows.join(kept.hint("merge"), "key", "left_semi").select("row.*")
