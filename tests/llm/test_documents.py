"""Operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from airlog.llm import language, mixing, pieces, rans, sharding, simhash, token_counts, token_files
from airlog.llm.common import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, id long, fp long, size long, queue string, kept_id long, row string"
LONG = "one two three four five six seven eight nine ten " * 4000
TEXTS = [
    "the cat sat on the mat and then it slept all day long", "The Cat sat on the mat and then it slept all day long", None, "", "  ",
    LONG, "le chat est assis sur le tapis", "x", "a  b\n\n c\t", "déjà-vu 日本 ▁ <|endoftext|> it's 'll", "1234 !!", "the cat sat"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k == 7 else ("fr" if k == 6 else "en"), None if k % 5 == 4 else f"s{k % 3}", 1, 2, 3, "q", 4, "r")
            for k, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, TEXTS[0], "en", "s0", 1, 2, 3, "q", 4, "r"), (None, "nothing like it", "en", None, 1, 2, 3, "q", 4, "r")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    parent = list(range(len(values)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                parent[top(a)] = top(b)
    return [top(k) for k in range(len(values))]


def groups_of(ids, values):
    tops = components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for t, i in zip(tops, ids):
        if i is not None:
            least[t].append(i)
    return [min(least[t], default=None) for t in tops]


def test_simhash_groups(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    expected = Counter((r.doc_id, p - (1 << 64) if p >> 63 else p, c)
                       for r, p, c in zip(rows, prints, groups_of([r.doc_id for r in rows], prints)))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == expected
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("tree_size", [3, 4096])
def test_close_fingerprints_are_connected(spark, tree_size):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.choice([0, 1, 2, 3]))) for b in base for _ in range(12)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, tree_size).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 6 for r in links)
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in links}
    found = components(values, lambda a, b: (min(a, b), max(a, b)) in pairs)
    plain = components(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert [found.index(t) for t in found] == [plain.index(t) for t in plain]


def test_one_document_of_each_group_stays(docs, empty):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    groups = groups_of([r.doc_id for r in rows], [fingerprint(r.text) for r in rows])
    assert Counter(r.doc_id for r in kept.collect()) == Counter({g for g in groups})
    assert simhash.deduplicated(empty).collect() == []


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    other, more = "a dog ran over the green hill at noon", "she sells sea shells by the shore each day"
    rows = [(1, TEXTS[0], "a"), (None, TEXTS[0], "b"), (None, other, "c"), (None, more, "d"), (None, None, "e"), (None, "", "f"),
            (2, "first words of a row that shares its id", "g"), (2, "quite another sentence under one number", "h"),
            (2, TEXTS[1], "i"), (3, LONG, "j"), (3, LONG, "k"), (4, LONG, "l")]
    table = spark.createDataFrame(rows, "doc_id long, text string, row string")
    groups = components([fingerprint(t) for _, t, _ in rows], lambda a, b: (a ^ b).bit_count() <= 2)
    kept = simhash.deduplicated(table).collect()
    top = {r: g for (_, _, r), g in zip(rows, groups)}
    assert sorted(top[r.row] for r in kept) == sorted(set(groups)) and len(kept) == 7
    assert {r.row for r in kept} - {"e", "f", "j", "k"} == {"a", "c", "d", "g", "h"}


def test_mix(docs, empty):
    plan = mixing.mix_plan(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [3, 1, 2] * 9))
    targets, budget = {}, 1.5 * sum(sizes.values())
    while True:  # shares by weight; what is above twice the size goes to the rest
        rest = [s for s in sizes if s not in targets]
        level = (budget - sum(targets.values())) / (sum(weights[s] for s in rest) or 1)
        full = {s: 2.0 * sizes[s] for s in rest if weights[s] * level > 2 * sizes[s]}
        if not full:
            targets |= {s: weights[s] * level for s in rest}
            break
        targets |= full
    assert sum(r.size for r in plan) == sum(sizes.values()) and all(0 <= r.copies <= 2 for r in plan)
    assert {(r.source_size, round(r.target, 6)) for r in plan} == {(sizes[s], round(targets[s], 6)) for s in sizes}
    assert sum(r.size * r.copies for r in plan) <= budget
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.id: 0 for r in plan}) + Counter(
        {i: sum(r.copies for r in plan if r.id == i) for i in {r.id for r in plan}})
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, plan))
    assert mixing.mix_plan(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_shares_of_many_small_documents(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 AS int)) AS text",
                                        "IF(id < 1000, 'a', IF(id < 2800, 'b', NULL)) AS source")
    got = defaultdict(int)
    for r in mixing.mix_plan(docs).collect():
        got[r.target] += r.size * r.copies
    assert all(abs(taken - target) <= 14 for target, taken in got.items()) and len(got) == 3


def test_shards(docs, empty):
    rows = sharding.sharded(docs, shards=5, bucket_bytes=64).collect()
    assert Counter((r.id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(r.size == len((r.text or "").encode()) + 1 and r.grown_shard in (r.shard, 5) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, sharding.sharded(docs, shards=5, bucket_bytes=64).collect())) == sorted(map(str, rows))
    grown = {(r.id, r.text): r.shard for r in sharding.sharded(docs, shards=6).collect()}
    assert all(grown[r.id, r.text] == r.grown_shard for r in rows)
    assert sharding.sharded(empty).collect() == []


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path, vocabulary = shared_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(docs, path, vocabulary)
    got = sorted(((r.id is not None, r.id), r.start, r.n_tokens, bytes(r.tokens)) for r in token_files.read_token_files(
        spark, path).collect())
    tokenizer, at = Tokenizer.from_file(vocabulary), 0
    rows = sorted(((r.doc_id is not None, r.doc_id), r.text or "") for r in docs.collect())
    assert sorted(g[0] for g in got) == sorted(r[0] for r in rows)
    coded = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows]
    assert Counter((r[0], c) for r, c in zip(rows, coded)) == Counter((g[0], g[3]) for g in got)
    for _, start, count, tokens in sorted(got, key=lambda g: g[1]):
        assert (start, count) == (at, len(tokens) // 4)
        at += count
    none = shared_folder(spark, "tokens")
    token_files.write_token_files(empty, none, vocabulary)
    assert token_files.read_token_files(spark, none).collect() == []


@pytest.mark.parametrize("part", ["frequencies", "ids", "lengths", "n_tokens", "checkpoints", "payload", "section_start"])
def test_every_damage_is_seen(spark, tmp_path, part):
    """A changed bit in any part that a block is decoded from is an error, not other ids."""
    rows = [(k, f"some words {k * k} and more {k ** 3} of them") for k in range(900)] + [(None, "nothing")]
    path, vocabulary = str(tmp_path / "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, vocabulary)
    files = spark.read.parquet(path)
    spoiled = files.collect()[0].asDict(recursive=True)
    block = spoiled["blocks"][0]
    if part in ("checkpoints", "payload"):
        block[part] = bytearray(block[part])
        block[part][len(block[part]) // 2] ^= 4
    elif part in ("ids", "lengths"):
        block[part][3] += 1
    elif part == "n_tokens":
        block[part] -= 1
    elif part == "frequencies":
        spoiled[part] = bytearray(spoiled[part])
        spoiled[part][-1] ^= 1
    else:
        spoiled[part] += 1
    bad = str(tmp_path / "bad")
    spark.createDataFrame([spoiled], files.schema).write.parquet(bad)
    with pytest.raises(Exception, match="is damaged|Error"):
        token_files.read_token_files(spark, bad).collect()


def test_a_document_longer_than_a_block(spark, tmp_path, monkeypatch):
    """Such a document is a block by itself and does not pad the others."""
    monkeypatch.setattr(token_files, "BLOCK", 64)
    rows = [(k, f"some words {k} " * (1 if k != 3 else 900)) for k in range(9)] + [(5, "twice"), (5, "twice"), (None, None)]
    path, vocabulary = str(tmp_path / "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, vocabulary)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    plain = Counter((k, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in rows)
    assert Counter((r.id, bytes(r.tokens)) for r in token_files.read_token_files(spark, path).collect()) == plain


@pytest.mark.parametrize("count", [1, 511, 513, 140_000])
def test_coder_round_trip(count):
    ids = (np.random.default_rng(count).zipf(1.4, count) % 50_000).astype(np.uint32)
    blocks = [ids, ids[: count // 2 + 1]]
    shared = rans.Table.from_bytes(rans.Table.of(np.bincount(ids)).to_bytes())
    assert shared.shares.sum() == 1 << rans.SCALE
    for block, (checkpoints, payload) in zip(blocks, rans.encode(blocks, shared)):
        decoder = rans.Decoder(shared)
        assert (decoder.block(checkpoints, payload, len(block)) == block).all()
        last = (len(block) - 1) // (rans.LANES * rans.CHECKPOINT)
        part = decoder.block(checkpoints, payload, len(block), first=last)
        assert (part == block[last * rans.LANES * rans.CHECKPOINT:]).all()


def test_units_equal_the_tokenizer():
    units = token_files.Units(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    for _ in range(60):
        texts = ["".join(rnd.choice(rnd.choice(["ab .,", "é\n d's", "  \t9x. ", "日<|endoftext|> "]))
                         for _ in range(rnd.choice([0, 1, 3, 30, 300]))) for _ in range(10)]
        plain = [np.array(e.ids, "<u4").tobytes() for e in units.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert units.encode(texts) == plain


def test_edited_counts_equal_counting_anew(spark, docs, empty):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding, rnd = token_counts.open_ranks(ranks, pattern), random.Random(1)
    for _ in range(200):
        signs = rnd.choice(["ab 'sd\n ", "a  \n\t'll9é. ", "   \n a"])
        text = "".join(rnd.choice(signs) for _ in range(rnd.choice([0, 3, 40, 2000])))
        tree = token_counts.CountTree(text, encoding)
        for _ in range(5):
            start, removed, put = rnd.randint(0, len(text)), rnd.randint(0, 9), "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 6)))
            tree.edit(start, removed, put)
            text = text[:start] + put + text[start + removed:]
            assert (tree.text(), tree.n_tokens, tree.n_chars) == (text, len(encoding.encode_ordinary(text)), len(text))
    edits = spark.createDataFrame(
        [(0, 2, 0, 3, "A"), (0, 1, 3, 0, " big"), (5, 1, 100_000, 5, "new"), (3, 1, None, None, "was empty"), (99, 1, 0, 0, "x"),
         (None, 1, 0, 0, "x")], "id long, number int, start long, removed long, put string")
    rows = {r.id: r for r in token_counts.count_edited(token_counts.with_edits(docs, edits), ranks, pattern).collect()}
    assert rows[0].edited_text == "A big cat sat on the mat and then it slept all day long" and rows[3].edited_text == "was empty"
    assert rows[5].edited_text == LONG[:100_000] + "new" + LONG[100_005:] and rows[5].encoded_again < 2000
    assert all(r.edited_tokens == len(encoding.encode_ordinary(r.edited_text)) for r in rows.values())
    assert all(r.n_tokens == len(encoding.encode_ordinary(t or "")) for k, t in enumerate(TEXTS) for r in [rows[k]])
    assert token_counts.count_edited(token_counts.with_edits(empty, edits), ranks, pattern).collect() == []


def test_n_best_equal_all_segmentations(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = pieces.open_pieces(path)

    def every(text):
        found = []

        def go(at, score, ids):
            if at == len(text):
                found.append((score, tuple(ids)))
            for end in range(at + 1, min(len(text), at + own.longest) + 1):
                if text[at:end] in own.pieces:
                    k, s = own.pieces[text[at:end]]
                    go(end, score + s, [*ids, k])
            if at < len(text) and text[at] not in own.pieces:
                raw = text[at].encode()
                go(at + 1, score + len(raw) * own.fallback, [*ids, *(own.byte_ids[b] for b in raw)])

        go(0, 0.0, [])
        return found

    for text in ["", "a", "the cat", "  x ", " ", "é▁b", "\n\nab", "a  b", "日 in.", "on, on"]:
        best, plain = next(own.n_best([text], 4)), every(" " + text if text else "")
        assert [s for s, _ in best] == sorted((s for s, _ in plain), reverse=True)[:4]
        coded = [(s, tuple(np.frombuffer(b, "<i4").tolist())) for s, b in best]
        assert len(set(coded)) == len(coded) and set(coded) <= set(plain)
    coded = pieces.encode(docs, path, n=2, keep=("doc_id", "text", "row"))
    back = pieces.decode(coded.selectExpr("doc_id", "text", "nbest[0].ids AS ids"), path)
    assert all((r.text or "") == r.decoded for r in back.collect()) and back.count() == docs.count()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = pieces.encode(docs.where("text LIKE 'the%'"), path, n=1).collect()[0].nbest[0].ids
    assert model.decode(list(plain)) in TEXTS
    assert pieces.encode(empty, path).collect() == []


def test_language(spark, folder, docs, empty):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    parts = table.randomSplit([0.7, 0.3], seed=4)
    model = language.fit(parts[0])
    found = language.predict(parts[1], model).join(parts[1], language.F.col("id") == language.F.col("doc_id"))
    share = found.selectExpr("avg(int(lang_pred = lang))").first()[0]
    assert share > 0.95
    rows = {r.id: r for r in language.predict(docs, model).collect()}
    assert all((rows[k].lang_pred, rows[k].score, rows[k].rejected) == ("und", 0.0, True) for k in (2, 3, 4, 10))
    assert all(0 <= r.score <= 1 and r.lang_pred in [*model.languages, "und"] for r in rows.values())
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and {2, 3, 4, 10}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền."]


def test_other_languages_and_random_letters_are_rejected(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    learned, held = table.randomSplit([0.7, 0.3], seed=4)
    model, rnd = language.fit(learned), random.Random(6)
    letters = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)) for n in (100, 300, 1000, 9000) for _ in range(20)]
    dumps = [" ".join(f"{rnd.getrandbits(32):08x}" for _ in range(n)) for n in (20, 100, 500) for _ in range(20)]
    assert model.predict(FOREIGN)[2].all()
    assert model.predict(letters)[2].mean() > 0.95 and model.predict(dumps)[2].mean() > 0.95
    clean = [r.text for r in held.where("text RLIKE '[A-Za-z]'").collect()]
    assert model.predict(clean)[2].mean() < 0.02
    assert model.predict([t[:40] for t in clean if len(t) > 40])[2].mean() < 0.05


def test_repeated_ids_teach_once(spark):
    rows = [(k, f"{TEXTS[0]} {k * 'so '}", "en") for k in range(8)] + [(k, f"{TEXTS[6]} {k * 'oui '}", "fr") for k in range(8)]
    again = rows + [rows[3]] * 300 + [rows[12]] * 40 + [(5, None, "fr")] * 30
    plain, repeated = (language.fit(spark.createDataFrame(r, "doc_id long, text string, lang string"), per_language=6) for r in (rows, again))
    assert (plain.idf == repeated.idf).all() and (plain.centroids == repeated.centroids).all() and (plain.radius == repeated.radius).all()


def test_checksum_of_ids():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\x02\0\0\0")
