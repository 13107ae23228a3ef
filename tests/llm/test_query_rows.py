"""The rows of registered queries against plain versions, and the cases that earlier forms of op3, op7 and op9 got wrong."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from airlog.llm import language, mixing, personal_data, pieces, sharding, token_counts
from airlog.llm.queries import QUERIES
from tests.llm.test_documents import components, fingerprint, groups_of
from tests.llm.test_marks import plain_spans


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_op2_rows(spark, folder, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, expected = 0, set()
    for doc_id, text, *_ in sorted(rows):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.add((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = QUERIES["op2_rans_token_files"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert {tuple(r) for r in got.collect()} == expected


def test_op4_rows(spark, folder):
    vectors = [(r.vec_id, r.label, np.array(r.embedding, float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    whole = [label is not None and v.size and np.isfinite(v).all() and v.any() for _, label, v in vectors]
    unit = np.stack([v / np.linalg.norm(v) if ok else np.zeros(len(vectors[0][2])) for (_, _, v), ok in zip(vectors, whole)])
    near = unit @ unit.T >= 0.93
    near &= np.array([[a == b for b in (x[1] for x in vectors)] for a in (x[1] for x in vectors)])
    np.fill_diagonal(near, False)
    tops = components(range(len(vectors)), lambda a, b: near[a, b])
    least = {t: min(v[0] for v, top in zip(vectors, tops) if top == t) for t in set(tops)}
    expected = {(v[0], int(near[k].sum()), least[tops[k]], v[0] == least[tops[k]]) for k, v in enumerate(vectors)}
    assert {tuple(r) for r in QUERIES["op4_subspace_pigeonhole"](spark, folder).select(
        "vec_id", "n_links", "component_id", "kept").collect()} == expected


def test_op5_rows(spark, folder, rows):
    own = pieces.open_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op5_nbest_pieces"](spark, folder).collect()}
    assert set(got) == {r[0] for r in rows} and all(r.round_trip for r in got.values())
    for doc_id, text, *_ in rows:
        if len(text or "") < 300:
            best = next(own.n_best([text or ""], 3))
            assert list(got[doc_id].scores) == [s for s, _ in best] and got[doc_id].n_pieces == len(best[0][1]) // 4
            assert got[doc_id].scores[0] == pytest.approx(viterbi(own, f" {text}" if text else ""))


def viterbi(own, text):
    """The best score of all segmentations, by plain dynamic programming."""
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - own.longest), end):
            if text[start:end] in own.pieces:
                best[end] = max(best[end], best[start] + own.pieces[text[start:end]][1])
        if text[end - 1] not in own.pieces:
            best[end] = max(best[end], best[end - 1] + len(text[end - 1].encode()) * own.fallback)
    return best[-1]


def test_op6_rows(spark, folder, rows):
    encoding = token_counts.open_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in QUERIES["op6_edited_token_counts"](spark, folder).collect()}
    ids = spark.createDataFrame([(r[0], len(r[1] or "")) for r in rows], "doc_id long, size int")
    places = {r.doc_id: (r.a, r.b, r.c) for r in ids.selectExpr(
        "doc_id", *[f"pmod(xxhash64({k}, doc_id), size + 1) AS {name}" for k, name in ((1, "a"), (2, "b"), (3, "c"))]).collect()}
    for doc_id, text, *_ in rows:
        text = text or ""
        assert got[doc_id].n_tokens == len(encoding.encode_ordinary(text))
        for place, removed, put in zip(places[doc_id], (12, 0, 40), ("'s new\n", " 2 words", "")):
            text = text[:place] + put + text[place + removed:]
        found = got[doc_id]
        assert (found.edited_tokens, found.edited_chars, found.edited_crc32) == (
            len(encoding.encode_ordinary(text)), len(text), zlib.crc32(text.encode()))


def plain_grams(text):
    folded = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    folded = " " + " ".join(folded.split()) + " "
    counts = Counter()
    for size in (1, 2, 3):
        for at in range(len(folded) - size + 1):
            gram = folded[at:at + size]
            if (size == 1 and gram != " ") or (size == 2 and gram != "  ") or (size == 3 and gram[1] != " "):
                counts[gram] += 1
    return counts if folded.strip() else Counter()


def gram_bin(gram):
    codes = [ord(c) for c in gram]
    mixed = codes[0] * 0x9E3779B1 & 0xFFFFFFFF
    for code, more in zip(codes[1:], (0x85EBCA6B, 0xC2B2AE35)):
        mixed = ((mixed ^ mixed >> 15) * more + code * 0x27D4EB2F) & 0xFFFFFFFF
    return mixed >> 20


def test_op7_counts_and_rows(spark, folder, rows, monkeypatch):
    """Whole texts are counted gram by gram, and every language is that of the nearest centroid."""
    texts = ["", None, "12 .", "a", " ab", "é日-x y", "So it  goes\n(on)!"] + [r[1] for r in rows if len(r[1] or "") < 2000][:40]
    for piece in (300_000, 1, 7, 100):
        monkeypatch.setattr(language, "PIECE", piece)
        for text, counts in zip(texts, language.gram_counts(texts)):
            plain = np.zeros(language.BINS)
            for gram, n in plain_grams(text).items():
                plain[gram_bin(gram)] += n
            assert (counts == plain).all(), (piece, text)
    monkeypatch.setattr(language, "PIECE", 300_000)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows}
    model = language.fit(docs.where(docs.doc_id.isin([k for k, h in held.items() if not h])))
    got = {r.doc_id: r for r in QUERIES["op7_nearest_centroid"](spark, folder).collect()}
    for doc_id, text, *_ in rows:
        counts = np.zeros(language.BINS)
        for gram, n in plain_grams(text).items():
            counts[gram_bin(gram)] += n
        weights = np.log1p(counts) * model.idf
        cosines = model.centroids @ (weights / (np.linalg.norm(weights) or 1))
        best = int(cosines.argmax())
        name, score = (model.languages[model.owners[best]], float(np.clip(cosines[best], 0, 1))) if counts.any() else ("und", 0.0)
        assert (got[doc_id].held_out, got[doc_id].lang_pred) == (held[doc_id], name)
        assert got[doc_id].score == pytest.approx(score, abs=1e-5)
    right = [got[k].lang_pred == lang for k, text, lang, _ in rows if held[k] and lang and plain_grams(text)]
    assert np.mean(right) > 0.95


def highest_shard(spark, ids, shards):
    scores = spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id", f"transform(sequence(0, {shards - 1}), s -> xxhash64(0, s, id)) AS h")
    return {r.id: int(np.argmax(r.h)) for r in scores.collect()}


def test_op9_rows(spark, folder, rows):
    got = QUERIES["op9_external_shuffle"](spark, folder).collect()
    now, grown = (highest_shard(spark, [r[0] for r in rows], n) for n in (16, 17))
    expected = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", now[k], grown[k]) for k, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op10_rows(spark, folder, rows):
    prints = [fingerprint(r[1]) for r in rows]
    expected = {(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, groups_of([r[0] for r in rows], prints))}
    assert {tuple(r) for r in QUERIES["op10_simhash_bk_tree"](spark, folder).collect()} == expected


def test_op13_rows(spark, folder, rows):
    got = {r.doc_id: r for r in QUERIES["op13_personal_data"](spark, folder).collect()}
    for doc_id, text, *_ in rows:
        spans = sorted(plain_spans(text or ""))
        listed = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(",")) and (r.n_learned or r.spans == listed)


@pytest.mark.parametrize("null_every", [4, 2])
def test_mix_of_rows_without_ids(spark, null_every):
    """Rows without an id, or with one id for many, are places of their own, so a source comes near its target."""
    rnd = random.Random(null_every)
    rows = [(None if k % null_every == 0 else 7 if k % 5 == 0 else k, " ".join(f"w{rnd.randrange(99)}" for _ in range(1 + k % 9)), f"s{k % 3}")
            for k in range(3000)]
    taken, targets = Counter(), {}
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by_size = {r.source_size: r.target for r in plan}
    for r in plan:
        taken[r.source_size] += r["size"] * r.copies
        targets[r.source_size] = r.target
    assert by_size == targets and all(abs(taken[s] - targets[s]) <= 9 * 3 for s in targets)


def test_shards_of_repeated_rows_and_text_ids(spark):
    """Half of the rows are one row: its copies are dealt over the buckets, and every bucket keeps its bound."""
    rows = [(None, "the same words")] * 1500 + [(f"id{k}", f"text {k} " * 2) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found, again = (sharding.sharded(docs, shards=4, bucket_bytes=2000) for _ in range(2))
    got = found.collect()
    assert Counter((r.id, r.text) for r in got) == Counter(rows)
    assert Counter((r.id, r.slot, r.shard) for r in got) == Counter((r.id, r.slot, r.shard) for r in again.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the copies stand all over their shard, as they do when every bucket has its share
    hot = next(r.shard for r in got if r.id is None)
    places = sorted(r.slot for r in got if r.id is None)
    buckets = -(-sum(len(t.encode()) + 1 for _, t in rows) // (4 * 2000))
    width = -(-len(slots[hot]) // buckets)
    assert buckets > 3 and all(sum(low <= p < low + 2 * width for p in places) > 0 for low in range(0, len(slots[hot]), 2 * width))
