"""Language identification by the nearest of several centroids per language.

A text's vector has the weights log(1 + count) * idf of its character n-grams (one to three letters, words padded with a space),
hashed into BINS numbers and scaled to length one. Each language has several centroids, found by spherical k-means among the
vectors of its training texts. A text gets the language of the centroid with the largest cosine, and is rejected if its distance
from it, 1 - cosine, is above the language's radius for its length in different n-grams: a short text shares fewer with a centroid
than a long one. The radii come from training texts, whole and cut short, that were held back from the centroids they are measured against.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlog.llm.common import portions, written

BINS = 4096
#: Characters of a text that are counted at once, and texts.
PIECE, TEXTS = 300_000, 256
UNKNOWN = "und"
#: Characters of the beginnings of training texts that stand for short texts; classes of length, two for each doubling of its
#: different n-grams.
STARTS, CLASSES = (4, 8, 16, 32, 64, 128, 256, 1024), 2 * BINS.bit_length() - 1
#: A training text's distance is measured without this part of the texts; a class of fewer distances says nothing by itself.
FOLDS, FEW = 4, 20
#: Ids of a label are counted by so many first bits of their hash before any are ordered.
STRETCH_BITS = 12


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _folded(text: str, padded: bool) -> np.ndarray:
    """Codes of a text's letters with one space for each stretch of others, and one in front if it is padded."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(_letters()[codes], codes, 32).astype(np.uint32)
    if padded:
        codes = np.insert(codes, 0, 32)
    blank = codes == 32
    return codes[~(blank & np.insert(blank[:-1], 0, False))] if len(codes) else codes


def _pieces(text: str) -> Iterator[tuple[str, int, bool]]:
    """A text in stretches: (the last two folded characters before it and the stretch, how many those are, whether it ends the text)."""
    before = ""
    for at in range(0, len(text), PIECE):
        piece = before + text[at:at + PIECE].lower()
        last = at + PIECE >= len(text)
        yield piece, len(before), last
        if not last:
            before = "".join(map(chr, _folded(piece, not before)[-2:].tolist()))


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """A row of n-gram counts for each text; a row of zeros for a text without a letter.

    A long text is counted in stretches, each with the two characters before it, so the counts are those of the whole text.
    """
    counts = np.zeros((len(texts), BINS), dtype=np.float32)
    rows, pieces, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in _pieces(text or ""):
            if pieces and size + len(piece[0]) > PIECE:
                _count_into(counts, rows, pieces)
                rows, pieces, size = [], [], 0
            rows.append(row)
            pieces.append(piece)
            size += len(piece[0])
    if pieces:
        _count_into(counts, rows, pieces)
    return counts


def _count_into(counts: np.ndarray, rows: list[int], pieces: list[tuple[str, int, bool]]) -> None:
    folded = [_folded(text + " " * last, not led) for text, led, last in pieces]
    lengths = np.array([len(f) for f in folded])
    codes, owner = np.concatenate(folded), np.repeat(np.arange(len(pieces)), lengths)
    # characters of the stretch before, of which every gram that ends in them has been counted
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fresh = place >= np.repeat([led for _, led, _ in pieces], lengths)
    numbers, width = np.array(rows)[owner] * BINS, counts.size
    mixed = codes * np.uint32(0x9E3779B1)
    alone = (codes != 32) & fresh
    bins, places = [mixed[alone] >> np.uint32(20)], [numbers[alone]]
    for more in (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)):
        if len(mixed) < 2:
            break
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * more + codes[len(codes) - len(mixed) + 1:] * np.uint32(0x27D4EB2F)
        span = len(codes) - len(mixed)
        inside = (owner[span:] == owner[:len(owner) - span]) & fresh[span:]
        if span == 2:  # only the middle of a gram of three may not be a space
            inside &= codes[1:-1] != 32
        bins.append((mixed >> np.uint32(20))[inside])
        places.append(numbers[span:][inside])
    flat = np.bincount(np.concatenate(places) + np.concatenate(bins), minlength=width)
    counts += flat.reshape(counts.shape)


def _length_class(counts: np.ndarray) -> np.ndarray:
    # different n-grams, as repeated ones add little to the vector
    return np.rint(2 * np.log2(np.maximum(np.count_nonzero(counts, axis=1), 1))).astype(int)


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    owners: np.ndarray
    idf: np.ndarray
    radius: np.ndarray  # by language and class of length

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.idf
        norms = np.linalg.norm(weighted, axis=1, keepdims=True)
        return np.divide(weighted, norms, out=np.zeros_like(weighted), where=norms > 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, for each text."""
        names, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        for at in range(0, len(texts), TEXTS):
            counts = gram_counts(texts[at:at + TEXTS])
            if not len(self.languages):
                names += [UNKNOWN] * len(counts)
                continue
            cosines = self.vectors(counts) @ self.centroids.T
            best = cosines.argmax(axis=1)
            language = self.owners[best]
            score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
            there = counts.any(axis=1)
            names += [self.languages[k] if known else UNKNOWN for k, known in zip(language, there)]
            scores[at:at + TEXTS] = np.where(there, score, 0)
            rejected[at:at + TEXTS] = ~there | (1 - score > self.radius[language, _length_class(counts)])
        return names, scores, rejected


def _cluster(vectors: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun with the mean's nearest vector and then the vector farthest from all before."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centers = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[own == k].sum(axis=0) if (own == k).any() else centers[k] for k in range(len(centers))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)
    return centers


def _radii(model: Model, counts: np.ndarray, starts: list[list[bytes]], labels: np.ndarray, centroids: int, quantile: float,
           slack: float) -> np.ndarray:
    """The radius of each language and class of length, from the distances of held-back texts and of their beginnings."""
    seen = []
    for language in model.languages:
        own = np.flatnonzero(labels == language)
        classes, cosines = [np.zeros(0, int)], [np.zeros(0)]
        for fold in range(min(FOLDS, len(own)) if len(own) > 1 else 0):
            held = own[fold::FOLDS]
            centers = _cluster(model.vectors(counts[np.setdiff1d(own, held)]), centroids)
            short = [np.bincount(np.frombuffer(b, "<u2"), minlength=BINS) for row in held for b in starts[row] if b]
            texts = np.concatenate([counts[held], np.array(short, np.float32).reshape(-1, BINS)])
            classes.append(_length_class(texts))
            cosines.append((model.vectors(texts) @ centers.T).max(axis=1).clip(0, 1))
        seen.append((np.concatenate(classes), np.concatenate(cosines)))

    together = [np.concatenate(parts) for parts in zip(*seen)]
    floors = []
    for own in seen:
        floor = np.full(CLASSES, np.nan)
        for classes, cosines in (together, own):
            for c in np.flatnonzero(np.bincount(classes, minlength=CLASSES) >= FEW):
                floor[c] = np.quantile(cosines[classes == c], 1 - quantile)
        known = np.flatnonzero(~np.isnan(floor))
        if len(known):  # of shorter texts than any known, the cosine falls with the square root of their n-grams
            fall = 2.0 ** (np.minimum(np.arange(CLASSES) - known[0], 0) / 4)
            floors.append(np.interp(np.arange(CLASSES), known, floor[known]) * fall)
        else:
            floors.append(np.zeros(CLASSES))
    return 1 - (1 - slack) * np.array(floors)


def fit(labelled: DataFrame, per_language: int = 200, centroids: int = 4, quantile: float = 0.95, slack: float = 0.4,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from a table of labelled texts.

    The sample is bounded for each language: the per_language ids with the smallest hash, and of the rows of an id and label the
    text with the smallest md5; rows with a null label or id are left out. The number of labels is not bounded, as none may be
    left out: the driver's memory grows with it, by 5 MB a label and as much again while they are sorted and stacked. Their counts, 16 KB a row, and those of their beginnings, some 10 KB, go to the driver. A language's radius
    for a length lies between the quantile of the distances of held-back texts of that length and 1 (a text that shares no
    n-gram): slack of the way. Without enough such texts of a length in a language, those of all languages count; without these,
    the lengths near it. If no length has enough, only texts that share nothing are rejected. Texts without a letter teach
    nothing. Without any text the model rejects everything.
    """
    order = Window.partitionBy("label").orderBy("hash", "id")
    known = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"),
                            F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND label IS NOT NULL")
    names = known.select("id", "label").distinct().withColumn("hash", F.xxhash64("id"))
    # the smallest hashes lie in the first stretches of a label that hold enough ids; only these are ordered
    names = names.withColumn("stretch", F.shiftright("hash", 64 - STRETCH_BITS))
    earlier = Window.partitionBy("label").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each label; written, so that its size is known before the ids meet it
    ends = written(names.groupBy("label", "stretch").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).where(
        F.col("before") < per_language).groupBy("label").agg(F.max("stretch").alias("end")), "stretches")
    near = names.join(ends, "label").where("stretch <= end")
    picked = written(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select(
        F.col("id").alias("picked_id"), F.col("label").alias("picked_label")), "training-rows")
    found = known.join(picked, (F.col("id") == F.col("picked_id")) & (F.col("label") == F.col("picked_label")))
    texts = found.groupBy("id", "label").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, 2):
                read = some.column(2).to_pylist()
                starts = [[] for _ in read]
                for size in STARTS:  # a text that is not longer stands for itself
                    for row, c in zip(starts, gram_counts([t[:size] if len(t or "") > size else None for t in read])):
                        row.append(np.repeat(np.arange(BINS, dtype="<u2"), c.astype(int)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([c.tobytes() for c in gram_counts(read)], pa.binary()),
                     pa.array(starts, pa.list_(pa.binary()))], names=["id", "label", "counts", "starts"])

    kind = labelled.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(counted, f"id {kind}, label string, counts binary, starts array<binary>").collect()
    rows = sorted((r.label, r.id, bytes(r.counts), [bytes(b) for b in r.starts]) for r in rows)
    counts = np.array([np.frombuffer(r[2], dtype=np.float32) for r in rows]).reshape(-1, BINS)
    labels = np.array([r[0] for r in rows])
    there = counts.any(axis=1)
    starts = [r[3] for r, full in zip(rows, there) if full]
    counts, labels = counts[there], labels[there]
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(sorted(set(labels.tolist())), np.zeros((0, BINS), np.float32), np.zeros(0, int), idf,
                  np.zeros((0, CLASSES)))
    vectors = model.vectors(counts)
    centers, owners = [], []
    for k, language in enumerate(model.languages):
        found = _cluster(vectors[labels == language], centroids)
        centers.append(found)
        owners += [k] * len(found)
    if centers:
        model.centroids, model.owners = np.concatenate(centers), np.array(owners)
        model.radius = _radii(model, counts, starts, labels, centroids, quantile, slack)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row.

    A null, empty or letterless text is `und` with score 0 and rejected. Ties go to the language first by code point. Repeated
    rows are repeated, an empty table stays empty.
    """

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, 1):
                names, scores, rejected = model.predict(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                    names=["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        predicted, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text the model does not reject, with all their columns."""
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, place):
                yield some.filter(pa.array(~model.predict(some.column(place).to_pylist())[2]))

    return docs.mapInArrow(kept, docs.schema)
