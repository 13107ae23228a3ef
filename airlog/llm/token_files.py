"""Token ids of documents in compressed files: interleaved range asymmetric numeral coding with shared frequency tables.

A file is the stretch of one task in the order of document ids. Its sections of about SECTION ids share a frequency table each,
counted over all ids of the section; a section's blocks of whole documents, about BLOCK ids, are coded on their own, with
checkpoints inside and a checksum. So documents are tokenized once and no pass over the corpus is needed for the tables. The
files are Parquet files with a row for each table and each block: Spark's commit keeps them whole when a task is run again.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlog.llm import rans
from airlog.llm.common import portions, written

SECTION, BLOCK = 1 << 22, 1 << 19
#: Units, and words of units, that a worker remembers; characters of words that are tokenized as one text.
REMEMBERED, JOINED = 500_000, 20_000
_OPEN: dict[str, Units] = {}


class Units:
    """Token ids of whole texts by the tokenizers library, through ids remembered for each unit of a text.

    The tokenizer cuts a text into pre-tokens before anything else, and always before a space that follows another character than
    white space. So a text without a space after white space is, at its spaces, a sequence of units whose ids do not depend on
    their neighbours. Other texts are encoded as they are. A unit of Latin letters with one stop or comma after them is two
    pre-tokens; words of letters not met before are encoded many at a time, parted by the tokens that begin with a space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.begins_word = np.array([(self.tokenizer.id_to_token(k) or "").startswith("Ġ") for k in range(size)])
        self.ends = {c: self._ids([c])[0] for c in ".,"}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, each with a space before it."""
        found: dict[str, bytes] = {}
        per_text = max(1, JOINED // (1 + max(map(len, words), default=1)))
        for at in range(0, len(words), per_text):
            some = words[at:at + per_text]
            ids = np.array(self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False).ids, dtype="<u4")
            starts = (4 * np.flatnonzero(self.begins_word[ids])).tolist()
            if len(starts) != len(some) or starts[0]:
                found.update(zip(some, self._ids([" " + w for w in some])))
                continue
            packed = ids.tobytes()
            found.update(zip(some, [packed[a:b] for a, b in zip(starts, [*starts[1:], len(packed)])]))
        return found

    def _learn(self, units: list[str]) -> dict[str, bytes | None]:
        """Ids of units; none for one that can not be followed by a space, because it is empty or ends in white space."""
        plain, split, others = [], [], []
        for unit in units:
            word = unit[:-1] if unit[-1:] in self.ends else unit
            if word.isalpha() and max(word) < "\u0250":
                (plain if word is unit else split).append(unit)
            else:
                others.append(unit)
        wanted = {*plain, *(u[:-1] for u in split)}
        new = self._words(sorted(wanted.difference(self.words), key=len))
        get = lambda w: self.words.get(w) or new[w]
        fresh: dict[str, bytes | None] = {u: get(u) for u in plain}
        fresh.update((u, get(u[:-1]) + self.ends[u[-1]]) for u in split)
        fresh.update(zip(others, self._ids([u[1:] if u[:1] == " " else " " + u for u in others])))
        fresh.update((u, None) for u in others if not u or u[-1].isspace())
        if len(self.words) < REMEMBERED:
            self.words.update(new)
        if len(self.known) < REMEMBERED:
            self.known.update(fresh)
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        get, rows, missing = self.known.get, [], set()
        for text in texts:
            parts = text.split(" ")
            parts[0] = " " + parts[0]  # no other unit has a space: this marks the one unit without a space before it
            found = list(map(get, parts))
            gaps = [k for k, ids in enumerate(found) if ids is None]
            missing.update([parts[k] for k in gaps])
            rows.append((parts, found, gaps))
        fresh = self._learn(list(missing))
        out: list[bytes] = []
        for text, (parts, found, gaps) in zip(texts, rows):
            for k in gaps:
                found[k] = fresh[parts[k]]
            try:
                out.append(b"".join(found))
            except TypeError:  # a space after white space
                out.append(self._ids([text])[0])
        return out


def open_units(path: str) -> Units:
    if path not in _OPEN:
        _OPEN[path] = Units(path)
    return _OPEN[path]


def _checksum(crc: int, section_start: int, ids: pa.Array, lengths: np.ndarray, count: int, checkpoints: bytes, payload: bytes) -> int:
    """CRC-32 of all that a block is decoded from, begun with that of the frequencies: place, document ids, lengths, number of ids,
    checkpoints and codes."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    for part in (np.array([section_start, count, len(lengths)], "<i8"), known, ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
                 np.asarray(lengths, "<i8")):
        crc = zlib.crc32(part.tobytes(), crc)
    return zlib.crc32(payload, zlib.crc32(checkpoints, crc))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Tokenize every text, append end_id, and write the ids in ascending order of document ids below path.

    Null and empty texts have the end id only. Rows with one document id follow each other by a hash of their texts, and may fill several
    files; repeated rows are repeated; null ids come first. An empty table writes files without rows.
    """
    block_type = pa.struct([
        ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("checkpoints", pa.binary()),
        ("payload", pa.binary()), ("crc32", pa.int64())])
    schema = pa.schema([("file_no", pa.int32()), ("section", pa.int32()), ("section_start", pa.int64()),
                        ("n_tokens", pa.int64()), ("frequencies", pa.binary()), ("blocks", pa.list_(block_type))])
    end = array("I", [end_id]).tobytes()

    def section_row(file_no: int, section: int, start: int, ids: list, coded: list[bytes]) -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(coded), dtype="<u4")
        frequencies = rans.Table.of(np.bincount(tokens))
        lengths = np.array([len(c) // 4 for c in coded], dtype=np.int64)
        ends = np.cumsum(lengths)
        number = (ends - lengths) // BLOCK
        firsts = np.flatnonzero(np.diff(number, prepend=-1))
        lasts = np.append(firsts[1:], len(ids))
        cut = [tokens[ends[a] - lengths[a]:ends[b - 1]] for a, b in zip(firsts, lasts)]
        table_bytes = frequencies.to_bytes()
        table_crc = zlib.crc32(table_bytes)
        # blocks coded side by side are padded to the longest, so a block of one long document is coded by itself
        coded_blocks = dict(zip(usual, rans.encode([cut[k] for k in usual], frequencies))) if (
            usual := [k for k, some in enumerate(cut) if len(some) <= 2 * BLOCK]) else {}
        for k, some in enumerate(cut):
            if k not in coded_blocks:
                coded_blocks[k] = rans.encode([some], frequencies)[0]
        blocks = [{"ids": ids[a:b], "lengths": lengths[a:b].tolist(), "n_tokens": len(cut[k]), "checkpoints": coded_blocks[k][0],
                   "payload": coded_blocks[k][1],
                   "crc32": _checksum(table_crc, start, pa.array(ids[a:b], pa.int64()), lengths[a:b], len(cut[k]), *coded_blocks[k])}
                  for k, (a, b) in enumerate(zip(firsts, lasts))]
        values = [[file_no], [section], [start], [len(tokens)], [table_bytes], [blocks]]
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, schema)], schema=schema)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, file_no, section, start, held = open_units(tokenizer), 0, 0, 0, 0
        ids: list = []
        coded: list[bytes] = []
        for batch in batches:
            for some in portions(batch, 1):
                file_no = some.column(2)[0].as_py()
                ids += some.column(0).to_pylist()
                for one in units.encode(some.column(1).to_pylist()):
                    coded.append(one + end)
                    held += len(one) // 4 + 1
                if held >= SECTION:
                    yield section_row(file_no, section, start, ids, coded)
                    ids, coded, held, section, start = [], [], 0, section + 1, start + held
        if coded:
            yield section_row(file_no, section, start, ids, coded)

    docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
                ).withColumn("hash", F.xxhash64("text")).repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select(
        "id", "text", F.spark_partition_id().alias("file_no")).mapInArrow(encoded, (
            "file_no int, section int, section_start long, n_tokens long, frequencies binary, blocks array<struct<ids: "
            "array<bigint>, lengths: array<bigint>, n_tokens: bigint, checkpoints: binary, payload: binary, crc32: "
            "bigint>>")).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens) of every document, decoded from the files; start counts the ids of all documents before.

    tokens are the ids as little-endian unsigned 32-bit integers. A block that does not fit its checksum, which covers all that it is
    decoded from, raises an error.
    """
    sections = spark.read.parquet(path)
    sums = sections.groupBy("file_no").agg(F.sum("n_tokens").alias("count"))
    # one row for each file; written, so that its size is known and it is sent to the sections, not they to it
    files = written(sums.select("file_no", (F.sum("count").over(Window.orderBy("file_no")) - F.col("count")).alias(
        "file_start")), "file-starts")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, frequencies, own = (batch.column(k)[row].as_py() for k in (0, 1, 3))
                decoder, table_crc = rans.Decoder(rans.Table.from_bytes(frequencies)), zlib.crc32(frequencies)
                for number, block in enumerate(batch.column(2)[row]):
                    one = {k: block[k].as_py() for k in ("n_tokens", "checkpoints", "payload", "crc32")}
                    found = _checksum(table_crc, own, block["ids"].values, block["lengths"].values.to_numpy(), one["n_tokens"],
                                      one["checkpoints"], one["payload"])
                    if found != one["crc32"]:
                        raise ValueError(f"block {number} of the section at {start} is damaged")
                    tokens = decoder.block(one["checkpoints"], one["payload"], one["n_tokens"]).astype("<u4")
                    ids, lengths = block["ids"].values, block["lengths"].values.to_numpy()
                    ends = np.cumsum(lengths)
                    for at in range(0, len(lengths), 500):
                        some = slice(at, at + 500)
                        yield pa.RecordBatch.from_arrays([
                            ids[some], pa.array(start + ends[some] - lengths[some]), pa.array(lengths[some]),
                            pa.array([tokens[e - n:e].tobytes() for n, e in zip(lengths[some], ends[some])], pa.binary()),
                        ], names=["id", "start", "n_tokens", "tokens"])
                    start += one["n_tokens"]

    return sections.join(files, "file_no").select(
        (F.col("file_start") + F.col("section_start")).alias("start"), "frequencies", "blocks", "section_start").mapInArrow(
        decoded, "id long, start long, n_tokens long, tokens binary")
