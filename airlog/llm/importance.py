"""Importance resampling towards a target corpus over hashed word n-grams.

A text's words are lower-cased (A-Z only) and its separators are collapsed to one space each. Overlapped scans with boundary
lookarounds then give the span of every run of 1 .. n words, and the CRC-32 of the bytes of a span is its bucket. The share of a
bucket among the features of the target against its share in the documents is its gain; a document's weight is the mean gain of its
features. With Gumbel noise from the hash of its id added, the highest scores are a draw without replacement in proportion to the
exponential of the weights.

A document is scanned once: its histogram is written to the shared folder, and both the corpus counts and the weights read it there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlog.llm.common import portions, written

#: Lower-cases A-Z and makes a space of every ASCII character that is neither a digit nor a letter. Bytes above belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Spans whose buckets are counted together.
SPANS = 1 << 16
#: Neighbouring scores that are counted together.
SCORES = 64


def _scan(words: int) -> regex.Pattern:
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (words - 1))


def histogram(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words of a text, and how many of its runs of 1 .. longest words fall into each bucket."""
    folded = regex.sub(rb"  +", b" ", text.translate(FOLD)).strip(b" ")
    counts = np.zeros(buckets, np.int64)
    words = 0
    for size in range(1, longest + 1):
        spans = _scan(size).finditer(folded, overlapped=True)
        while len(hashes := np.fromiter((crc32(span[0]) for span in islice(spans, SPANS)), np.uint32)):
            counts += np.bincount(hashes % buckets, minlength=buckets)
            words += len(hashes) if size == 1 else 0
    return words, counts


def features(docs: DataFrame, longest: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, features, buckets, counts) of every row: its histogram as two arrays of little-endian integers, 2 and 4 bytes each.

    A null text has no features. Repeated rows are repeated, an empty table stays empty. Memory for a text is a few copies of it.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket has two bytes")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, 1):
                found = [histogram(text or b"", longest, buckets) for text in some.column(1).to_pylist()]
                there = [np.flatnonzero(counts) for _, counts in found]
                yield pa.RecordBatch.from_arrays([
                    some.column(0), pa.array([words for words, _ in found], pa.int64()),
                    pa.array([int(counts.sum()) for _, counts in found], pa.int64()),
                    pa.array([b.astype("<u2").tobytes() for b in there], pa.binary()),
                    pa.array([counts[b].astype("<u4").tobytes() for b, (_, counts) in zip(there, found)], pa.binary()),
                ], names=["id", "words", "features", "buckets", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        counted, f"id {kind}, words long, features long, buckets binary, counts binary")


def bucket_totals(found: DataFrame, buckets: int) -> np.ndarray:
    """Features of a whole table by bucket. Every partition sends at most one row a bucket; the driver gets one row a bucket."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in portions(batch, 0, rows=1024):
                at, counts = (np.frombuffer(b"".join(c.to_pylist()), kind) for c, kind in zip(some.columns, ("<u2", "<u4")))
                total += np.bincount(at, counts, minlength=buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    sums = found.select("buckets", "counts").mapInArrow(added, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in sums.collect():
        total[row.bucket] = row.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the source, one feature added to every bucket."""
    buckets = len(source)
    share = (target + 1.0) * (source.sum() + float(buckets)) / ((source + 1.0) * (target.sum() + float(buckets)))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, words, features, weight) of every row of a table of histograms: the floored mean gain of its features, 0 without any."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, 3, rows=1024):
                sums = [int(gain[np.frombuffer(b, "<u2")] @ np.frombuffer(c, "<u4").astype(np.int64))
                        for b, c in zip(some.column(3).to_pylist(), some.column(4).to_pylist())]
                means = [total // max(n, 1) for total, n in zip(sums, some.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(means, pa.int64())],
                                                 names=["id", "words", "features", "weight"])

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(weighed, f"id {kind}, words long, features long, weight long")


def noise(ident: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256("seed:id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored with a column rank: 1, 2, .. by falling score and rising id among the rows with enough words, null for all others and
    for those behind `percent` of their number.

    Running counts come in three levels, stretches of scores, scores and ids, and equal rows are counted before they are ordered;
    so no task orders more than the rows of one score that differ. Null ids come last.
    """
    equal = written(scored.groupBy(*scored.columns).agg(F.count(F.lit(1)).alias("copies")), "scores")
    rows = equal.where(F.col("words") >= least_words).withColumn("stretch", F.floor(F.col("score") / SCORES))
    by_score = rows.groupBy("stretch", "score").agg(F.sum("copies").alias("n"))
    # scores lie within the logarithms of counts, so stretches are few
    by_stretch = by_score.groupBy("stretch").agg(F.sum("n").alias("m"))
    higher = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    before_stretch = by_stretch.select("stretch", F.coalesce(F.sum("m").over(higher), F.lit(0)).alias("before_stretch"))
    inside = Window.partitionBy("stretch").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before_score = written(by_score.join(before_stretch, "stretch").select(
        "score", (F.col("before_stretch") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"), "n"), "score-counts")
    drawn = before_score.agg(F.sum("n")).first()[0] or 0
    budget = drawn * percent // 100
    others = [c for c in scored.columns if c not in ("score", "id")]
    tie = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), *others).rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.drop("stretch").join(before_score.where(F.col("before") < budget).drop("n"), "score")
    placed = reached.withColumn("before", F.col("before") + F.coalesce(F.sum("copies").over(tie), F.lit(0)))
    numbered = placed.select(*scored.columns, F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("copies"))).alias("rank"))
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= budget, F.col("rank")))
    rest = equal.join(before_score.where(F.col("before") < budget).select("score", F.lit(True).alias("ordered")), "score", "left").where(
        (F.col("words") < least_words) | F.col("ordered").isNull())
    unranked = rest.select(*scored.columns, "copies", F.lit(None).cast("long").alias("rank")).withColumn(
        "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    return numbered.unionByName(unranked)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000,
              seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, words, features, weight, score, rank) of every row of docs; the rows with a rank are the draw, in its order.

    A null or empty text has no features and weight 0. Null ids share one noise, as do rows that repeat an id; equal rows get
    consecutive ranks. An empty target counts as one feature in every bucket; an empty table of documents gives an empty result.
    Other columns are not read.
    """
    found = written(features(docs, longest, buckets, id_col, text_col), "features")
    numbered = target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text"))
    gain = gains(bucket_totals(found, buckets), bucket_totals(features(numbered, longest, buckets, "id"), buckets))
    scored = weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return ranked(scored, percent, least_words)
