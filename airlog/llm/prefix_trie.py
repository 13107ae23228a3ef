"""Prefix tries of conversations in double arrays.

A conversation is a path of turns; a node is a prefix that conversations share. The different paths are dealt by ranges of their
order, so every shard holds neighbouring prefixes, a crowded prefix is spread over as many shards as it fills, and equal paths are
one. A shard numbers its different turns from 1 and packs its trie into two arrays: the child of the node in slot s by turn t is in
slot BASE[s] + t, if CHECK there is s. All paths walk these arrays together, turn by turn, and add to the nodes they pass.

Only prefixes of a shard's first or last path can go on in another shard. These upper nodes leave their shard as partial sums; they
are merged by prefix, their subtrees are added up once for all shards, and the nodes right below them look up their parents there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlog.llm.common import shuffle_partitions, word_count, written

#: Characters of a turn's key in a path (base64 of 120 bits of its digest).
KEY = 20
#: Neighbouring conversation ids whose decimals are joined before the shuffle; turns of a shard at most, where paths differ.
IDS, SHARD_TURNS = 4096, 1_000_000

_PARTIAL = ("upper boolean, node binary, parent binary, depth long, first long, parent_first long, n_convs long, n_children long, "
            "n_leaves long, saved_tokens long, words long, ends_sha256 string")


def turn_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """(conv_id, turns) of every conversation: its turns as an array of (key, words), by number, null first, then key.

    The key is a digest of role and text, null as empty, so no text is shuffled. A null conversation id is a conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    key = F.base64(F.substring(digest, 1, KEY * 3 // 4))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), key.alias("key"), word_count(text).alias("words")).alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt(paths: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """Conversations that begin as another does: the first h turns of conversation c - c % group, then c's own after its first h.

    h is the CRC-32 of c's decimal modulo most + 1. A null id has the empty decimal, so h is 0.
    """
    shared = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % (most + 1)
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = paths.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    whole = paths.withColumn("h", shared.cast("int")).withColumn("base", base).join(heads, "base", "left")
    nothing = F.slice("turns", 1, 0)
    return whole.select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), nothing),
        F.when(F.col("h") < F.size("turns"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(nothing)).alias("turns"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> list[list]:
    """The different paths of sorted rows: [path, words, conversations, first id, hash of the joined ids]."""
    found: list[list] = []
    for batch in batches:
        for path, words, n, first, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if not found or found[-1][0] != path:
                found.append([path, words, 0, first, hashlib.sha256()])
            last = found[-1]
            last[4].update((f",{ids}" if last[2] else ids).encode())
            last[2] += n
            if last[3] is None:
                last[3] = first
    return found


class DoubleArray:
    """A trie over sorted, different rows of turn numbers from 1, packed into BASE and CHECK."""

    def __init__(self, paths: list[np.ndarray]):
        # a node for each turn that a path does not share with the one before; slot numbers replace node numbers below
        children: list[list[tuple[int, int]]] = [[]]
        trail, before = [0], np.zeros(0, np.int64)
        for path in paths:
            size = min(len(path), len(before))
            differ = np.flatnonzero(path[:size] != before[:size])
            del trail[(int(differ[0]) if len(differ) else size) + 1:]
            for turn in path[len(trail) - 1:].tolist():
                children[trail[-1]].append((turn, len(children)))
                trail.append(len(children))
                children.append([])
            before = path
        self._pack(children)

    def _pack(self, children: list[list[tuple[int, int]]]) -> None:
        """Slots for all children of a node at one base, nodes with most children first; single children fill the holes."""
        widest = max((t for own in children for t, _ in own), default=0)
        size = len(children) + widest + 2
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[0] = 0
        slot = np.zeros(len(children), np.int64)
        order = sorted((node for node, own in enumerate(children) if own), key=lambda node: (-len(children[node]), node))
        # parents are placed by number of children, so check holds node numbers until every slot is known
        bases, free = np.zeros(len(children), np.int64), 1
        for node in order:
            turns = np.array([t for t, _ in children[node]])
            turns.sort()
            while self.check[free] >= 0:
                free += 1
            at = free
            while True:
                places = turns + (at - turns[0])
                if places[-1] >= len(self.check):
                    more = max(len(self.check), int(places[-1]) + 1 - len(self.check))
                    self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
                    self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
                if len(turns) == 1 or (self.check[places] < 0).all():
                    break
                at += 1
                while at < len(self.check) and self.check[at] >= 0:
                    at += 1
            self.check[places] = node
            bases[node] = at - turns[0]
            for turn, child in children[node]:
                slot[child] = bases[node] + turn
        self.base[slot] = bases
        taken = np.flatnonzero(self.check[1:] >= 0) + 1
        self.check[taken] = slot[self.check[taken]]

    def walk(self, slots: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The slots of the children by these turns; -1 where there is none."""
        places = self.base[slots] + turns
        there = (places > 0) & (places < len(self.check))
        there[there] &= self.check[places[there]] == slots[there]
        return np.where(there, places, -1)


def _prefixes(path: str, seed: bytes = b"") -> list[bytes]:
    """A digest of every prefix of a path, from the empty one."""
    digests = [hashlib.sha256(seed).digest()[:16]]
    for at in range(0, len(path), KEY):
        digests.append(hashlib.sha256(digests[-1] + path[at:at + KEY].encode()).digest()[:16])
    return digests


def _least(values: np.ndarray, at: np.ndarray, found: np.ndarray) -> None:
    np.minimum.at(values, at, found)


#: Stands for a null id in comparisons: after all others.
_LAST = np.iinfo(np.int64).max


def shard_nodes(rows: list[list]) -> pa.RecordBatch | None:
    """The nodes of a shard's sorted paths, whole or, on its first and last path, as partial sums without other such nodes."""
    if not rows:
        return None
    lengths = np.array([len(r[0]) // KEY for r in rows])
    keys = np.frombuffer("".join(r[0] for r in rows).encode(), dtype=f"S{KEY}")
    numbers = np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1 if len(keys) else np.zeros(0, np.int64)
    words = np.concatenate([np.array(r[1], np.int64) for r in rows])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    trie = DoubleArray([numbers[a:b] for a, b in zip(starts.tolist(), ends.tolist())])

    size = len(trie.check)
    convs, first = np.zeros(size, np.int64), np.full(size, _LAST)
    text_words, depths = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    upper, closing = np.zeros(size, bool), np.full(size, -1, np.int64)
    count, least = np.array([r[2] for r in rows]), np.array([_LAST if r[3] is None else r[3] for r in rows])
    slots, alive, levels = np.zeros(len(rows), np.int64), np.arange(len(rows)), []
    for depth in range(int(lengths.max()) + 1):
        if depth:
            alive = alive[lengths[alive] >= depth]
            at = starts[alive] + depth - 1
            slots[alive] = trie.walk(slots[alive], numbers[at])
            text_words[slots[alive]] = words[at]
        here = slots[alive]
        np.add.at(convs, here, count[alive])
        _least(first, here, least[alive])
        depths[here] = depth
        upper[here[(alive == 0) | (alive == len(rows) - 1)]] = True
        closing[here[lengths[alive] == depth]] = alive[lengths[alive] == depth]
        levels.append(np.unique(here))
    children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth]
        inner = here[~upper[here]]
        leaves[inner] += children[inner] == 0
        saved[inner] += (convs[inner] - 1) * text_words[inner]
        if depth:  # upper nodes are counted when they are merged
            above = trie.check[inner]
            np.add.at(children, above, 1)
            np.add.at(leaves, above, leaves[inner])
            np.add.at(saved, above, saved[inner])
    nodes = np.concatenate(levels)
    digest_of: dict[int, bytes] = {}
    for row in {0, len(rows) - 1}:
        slot = np.zeros(1, np.int64)
        for depth, digest in enumerate(_prefixes(rows[row][0])):
            if depth:
                slot = trie.walk(slot, numbers[starts[row] + depth - 1:starts[row] + depth])
            digest_of[int(slot[0])] = digest
    parents = trie.check[nodes]
    own = upper[nodes]
    below = ~own & upper[parents]

    def ids(values: np.ndarray, there: np.ndarray) -> pa.Array:
        return pa.array(values, pa.int64(), mask=~there | (values == _LAST))

    empty = hashlib.sha256().hexdigest()
    return pa.RecordBatch.from_arrays([
        pa.array(own), pa.array([digest_of[n] if u else None for n, u in zip(nodes.tolist(), own)], pa.binary()),
        pa.array([digest_of[p] if n and (u or b) else None for n, p, u, b in zip(nodes.tolist(), parents.tolist(), own, below)], pa.binary()),
        pa.array(depths[nodes]), ids(first[nodes], np.ones(len(nodes), bool)), ids(first[parents], ~own & ~below),
        pa.array(convs[nodes]), pa.array(children[nodes]), pa.array(leaves[nodes]), pa.array(saved[nodes]), pa.array(text_words[nodes]),
        pa.array([rows[c][4].hexdigest() if c >= 0 else None if u else empty for c, u in zip(closing[nodes].tolist(), own)], pa.string()),
    ], names=[part.split()[0] for part in _PARTIAL.split(", ")])


def merged_upper(partial: DataFrame) -> DataFrame:
    """The upper nodes of all shards, whole: their sums by prefix, then those of the upper nodes below them.

    These are prefixes of two paths a shard. A node passes its sums on to its parent when all its own have come, deepest first: one
    task reads them in that order. Its memory is bounded by the number of shards times twice the longest path.
    """
    sums = partial.where("upper").groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("first").alias("first"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"),
        F.max("ends_sha256").alias("ends_sha256"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in ([row for batch in batches for row in batch.to_pylist()],):
            place = {row["node"]: row for row in rows}
            for row in rows:
                row["n_leaves"] += row["n_children"] == 0
                row["saved_tokens"] += (row["n_convs"] - 1) * row["words"]
                above = place.get(row["parent"])
                row["parent_first"] = above["first"] if above else None
                if above:
                    above["n_children"] += 1
                    above["n_leaves"] += row["n_leaves"]
                    above["saved_tokens"] += row["saved_tokens"]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    fields = "node binary, parent binary, depth long, first long, n_convs long, n_children long, n_leaves long, saved_tokens long, " \
             "words long, ends_sha256 string, parent_first long"
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    shape = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])
    ordered = sums.repartition(1).sortWithinPartitions(F.desc("depth"))
    return ordered.mapInArrow(passed, fields)


def prefix_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of a table (conv_id, turns), turns an array of (key, words) as from turn_paths.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node: its smallest member, the
    parent's, how many conversations begin with it, its children, the childless nodes of its subtree, the words that need not be
    stored twice there, and the hash of the ids that end in it. A conversation without turns is a member of the root alone; an empty
    table has no node. Null ids come after all others and have an empty decimal. Repeated turns and ties are turns like others.

    A path is a row, so the longest conversation bounds the memory of a row (28 bytes a turn). The ids of equal conversations are joined
    in stretches and pass through one task in order, as their hash needs, but are never held together there.
    """
    spark = paths.sparkSession
    keys = F.array_join(F.transform("turns", lambda t: t["key"]), "")
    words = F.transform("turns", lambda t: t["words"].cast("int"))
    rows = paths.select(keys.alias("path"), words.alias("words"), "conv_id", F.floor(F.col("conv_id") / IDS).alias("stretch"))
    ids = F.array_sort(F.collect_list("conv_id"))
    stretches = rows.groupBy("path", "stretch").agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), ids.alias("ids"))
    stretches = written(stretches.select("path", "words", "n", "first", F.coalesce(F.array_join(F.transform(
        "ids", lambda i: i.cast("string")), ","), F.lit("")).alias("ids")), "paths")
    turns = stretches.agg(F.sum(F.length("path"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-turns // (KEY * shard_turns)))
    dealt = stretches.repartitionByRange(shards, "path").sortWithinPartitions("path", F.col("first").asc_nulls_last())

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shard_nodes(_streamed(batches))
        for at in range(0, found.num_rows if found else 0, 8192):
            yield found.slice(at, 8192)

    partial = written(dealt.select("path", "words", "n", "first", "ids").mapInArrow(built, _PARTIAL), "nodes")
    upper = written(merged_upper(partial), "upper-nodes")
    out = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    above = upper.select(F.col("node").alias("parent"), F.col("first").alias("upper_first"))
    inner = partial.where("NOT upper").join(above, "parent", "left").select(
        F.col("first").alias("conv_id"), "depth", F.coalesce("parent_first", "upper_first").alias("parent_conv_id"), *out, "ends_sha256")
    empty = hashlib.sha256().hexdigest()
    return inner.unionByName(upper.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), *out,
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))
