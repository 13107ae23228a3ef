"""Token counts of documents that are kept up while the documents are edited.

A document is cut into stretches of whole pre-tokens, the leaves of a segment tree whose nodes hold the characters and tokens
below them. A cut lies only between another character and the white space after it: the tokenizer always begins a pre-token
there, whatever stands on either side. An edit is found by its place through the tree; the leaves from the one with the
character before it to the one with the character after it become one leaf, which alone is encoded again, and the sums on the
paths from these leaves to the root are renewed.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlog.llm.common import portions

#: Characters after which a leaf ends at the next place where it may.
LEAF = 512
_CUT = re.compile(r"(?<=\S)[ \n]")
_OPEN: dict[tuple[str, str], object] = {}

#: What edits look like: place and characters removed, in the text as the edits before have left it, and what is put there.
EDITS = "array<struct<start: bigint, removed: bigint, put: string>>"


def open_ranks(path: str, pattern: str):
    """The byte-pair encoding with the ranks in a file, one a line: base64 bytes and number."""
    if (path, pattern) not in _OPEN:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _OPEN[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[path, pattern]


def leaves_of(text: str) -> list[str]:
    leaves, start = [], 0
    while (cut := _CUT.search(text, start + LEAF)) is not None:
        leaves.append(text[start:cut.start()])
        start = cut.start()
    return [*leaves, text[start:]]


class CountTree:
    """Characters and tokens of one document: heaps of sums over its leaves."""

    def __init__(self, text: str, encoding):
        self.encoding, self.leaves = encoding, leaves_of(text)
        self.first = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros((2, 2 * self.first), dtype=np.int64)
        own = slice(self.first, self.first + len(self.leaves))
        self.chars[own] = [len(leaf) for leaf in self.leaves]
        self.tokens[own] = [len(encoding.encode_ordinary(leaf)) for leaf in self.leaves]
        level = self.first
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2:level] = sums[level:2 * level:2] + sums[level + 1:2 * level:2]
            level //= 2
        self.encoded_again = 0

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf with the character at a place, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.first:
            left = int(self.chars[2 * node])
            if place - begin < left:
                node = 2 * node
            else:
                node, begin = 2 * node + 1, begin + left
        return node - self.first, begin

    def edit(self, start: int, removed: int, put: str) -> None:
        """Replace characters; a place or number outside the text is moved to its nearest end."""
        start = min(max(start, 0), self.n_chars)
        removed = min(max(removed, 0), self.n_chars - start)
        if not self.n_chars:
            first = last = begin = 0
        else:
            first, begin = self.find(max(start - 1, 0))
            last, _ = self.find(min(start + removed, self.n_chars - 1))
        region = "".join(self.leaves[first:last + 1])
        region = region[:start - begin] + put + region[start - begin + removed:]
        self.encoded_again += len(region)
        for leaf in range(first, last + 1):
            own = region if leaf == first else ""
            self.leaves[leaf] = own
            self.chars[self.first + leaf] = len(own)
            self.tokens[self.first + leaf] = len(self.encoding.encode_ordinary(own)) if own else 0
        low, high = (self.first + first) // 2, (self.first + last) // 2
        while low >= 1:
            for sums in (self.chars, self.tokens):
                sums[low:high + 1] = sums[2 * low:2 * high + 2:2] + sums[2 * low + 1:2 * high + 2:2]
            low, high = low // 2, high // 2


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents with a column edits, from a table (id, number, start, removed, put); edits follow their numbers.

    Documents without edits have an empty list; edits of other ids, and of null ids, are left out.
    """
    listed = edits.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("edited_id")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("number", "start", "removed", "put"))),
        lambda e: F.struct(e["start"].cast("long").alias("start"), e["removed"].cast("long").alias("removed"),
                           e["put"].alias("put"))).alias("edits"))
    return docs.join(listed, docs[id_col] == listed["edited_id"], "left").drop("edited_id").withColumn(
        "edits", F.coalesce("edits", F.array().cast(EDITS)))


def count_edited(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 edits_col: str = "edits") -> DataFrame:
    """(id, n_tokens, edited_text, edited_tokens, encoded_again) of every row: counts before and after its edits.

    encoded_again counts the characters of the regions that were encoded again. Null and empty texts have no token and can be
    edited; null edits count as none, a null place or number as 0, null text put as empty. Repeated rows are repeated, an empty
    table stays empty. ranks: path of the vocabulary on every executor; pattern: how it cuts pre-tokens.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = open_ranks(ranks, pattern)
        for batch in batches:
            for some in portions(batch, 1):
                before, texts, after, again = [], [], [], []
                for text, edits in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                    tree = CountTree(text or "", encoding)
                    before.append(tree.n_tokens)
                    for e in edits or ():
                        tree.edit(e["start"] or 0, e["removed"] or 0, e["put"] or "")
                    texts.append(tree.text())
                    after.append(tree.n_tokens)
                    again.append(tree.encoded_again)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(before, pa.int64()), pa.array(texts, pa.string()), pa.array(after, pa.int64()),
                     pa.array(again, pa.int64())], names=["id", "n_tokens", "edited_text", "edited_tokens", "encoded_again"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(edits_col).cast(EDITS).alias("edits")).mapInArrow(
        counted, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, edited_text string, edited_tokens long, "
                 "encoded_again long")
