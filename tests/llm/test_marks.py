"""Prefix tries, importance resampling and personal data against plain versions, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlog.llm import importance, personal_data, prefix_trie, tagger

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_nodes(paths):
    """paths: id -> sequence of (said, words)."""
    members = defaultdict(list)
    for conv, path in paths.items():
        for depth in range(len(path) + 1):
            members[tuple(path[:depth])].append(conv)

    def least(node):
        own = [c for c in members[node] if c is not None]
        return min(own) if own else None

    rows = Counter()
    for node, convs in members.items():
        below = [other for other in members if other[:len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)]
        ends = sorted((c for c in convs if len(paths[c]) == len(node)), key=lambda c: (c is None, c or 0))
        rows[least(node), len(node), least(node[:-1]) if node else None, len(convs),
             sum(len(m) == len(node) + 1 for m in below), len(leaves),
             sum((len(members[n]) - 1) * n[-1][1] for n in below if n),
             hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()] += 1
    return rows


@pytest.mark.parametrize("shard_turns", [1_000_000, 5])
def test_prefix_nodes(spark, shard_turns):
    rnd = random.Random(5)
    rows = []
    for conv in [*range(0, 64), 1000, None, -3]:
        if conv not in (20, 1001):
            for turn in range(rnd.randrange(0, 7)):
                rows.append((conv, turn, rnd.choice(["user", "user", None]), rnd.choice(["a b", "a  b c", "", None, "日 é\tx"])))
    rows += [(k, t, "user", "same start") for k in (70, 71, 72, 73) for t in range(30)] + [(74, None, "user", "x"), (74, 0, "", None)]
    rows += [(75, 1, "user", "twice"), (75, 1, "user", "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1)).withColumn(
        "node", F.lit("x"))
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        said = (role or "", text or "")
        own[conv].append((turn is not None, turn or 0, prefix_key(said), said))
    own = {c: [(said, len(WORD.findall(said[1]))) for *_, said in sorted(v)] for c, v in own.items()}
    paths = {}
    for conv, path in own.items():
        h = zlib.crc32(b"" if conv is None else str(conv).encode()) % 4
        base = own.get(conv - int(math.fmod(conv, 20)), []) if conv is not None else []
        paths[conv] = base[:h] + path[h:]
    found = prefix_trie.prefix_nodes(prefix_trie.rebuilt(prefix_trie.turn_paths(turns)), shard_turns)
    assert Counter(tuple(r) for r in found.collect()) == plain_nodes(paths)
    assert prefix_trie.prefix_nodes(prefix_trie.rebuilt(prefix_trie.turn_paths(turns.where("false")))).collect() == []


def prefix_key(said):
    import base64
    role, text = said
    return base64.b64encode(hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:15]).decode()


def test_double_array():
    rng = np.random.default_rng(0)
    paths = sorted({tuple(rng.integers(1, 9, rng.integers(0, 6)).tolist()) for _ in range(300)})
    trie = prefix_trie.DoubleArray([np.array(p, np.int64) for p in paths])
    slots = {(): 0}
    for path in paths:
        for depth in range(len(path)):
            slots[path[:depth + 1]] = int(trie.walk(np.array([slots[path[:depth]]]), np.array([path[depth]]))[0])
    assert len(set(slots.values())) == len(slots) and min(slots.values()) == 0
    for path in slots:
        for turn in range(1, 9):
            there = int(trie.walk(np.array([slots[path]]), np.array([turn]))[0])
            assert there == slots.get((*path, turn), -1)


def plain_draw(docs, target, percent=25, least=20):
    def features(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s, t = (Counter(b for _, text in rows for b in features(text)[1]) for rows in (docs, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    scored = []
    for ident, text in docs:
        n, own = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        scored.append((ident, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ranked = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2]))
    rows = Counter((*r, k + 1 if k < len(ranked) * percent // 100 else None) for k, r in enumerate(ranked))
    return rows + Counter((*r, None) for r in scored if r[1] < least)


def test_importance(spark, monkeypatch):
    monkeypatch.setattr(importance, "SPANS", 7)
    rnd = random.Random(4)
    words = ["the", "The", "naïve", "日本", "x2", "a-b", "q_r", "\x00", "&&", "İ"]
    docs = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for k in range(150)]
    docs += [(None, docs[3][1] + " the" * 30)] * 3 + [(7, "the " * 50)] * 4 + [(500, None), (501, ""), (502, " .\n-"), (503, "x2 " * 40000)]
    target = [(0, "the naïve the x2"), (1, None), (2, "日本 the")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("id", F.lit(0))
    goal = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resampled(frame, goal).select("id", "words", "features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in got.collect()) == plain_draw(docs, target)
    alone = importance.resampled(frame, goal.where("false")).select("id", "words", "features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in alone.collect()) == plain_draw(docs, [])
    assert importance.resampled(frame.where("false"), goal).collect() == []


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def plain_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                found.append((kind, m))
    return [(personal_data.KINDS.index(k), m.start(), m.end()) for k, m in found]


def test_base_spans():
    rnd = random.Random(6)
    parts = ["a", "Z9", "@", ".", "..", "b.c", "x@y.z", "-", " ", "+", "1", "255", "256", "0001", "1.2.3.4", "(", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "+1 (918) 555-3922", "é", "\n", "@b.c.@d.e", "0595765450607129", "+", "9" * 25, "%_"]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 12)))
        assert personal_data.base_spans(text) == plain_spans(text), text
    assert personal_data.base_spans("a" * 300_000 + "1" * 300_000 + ("." * 300_000)) == []


def test_tagger_gradients():
    rng = np.random.default_rng(3)
    model = tagger.Tagger.fresh(4, 4, rng)
    for name, array in zip(("inputs", "hidden", "outputs", "bias", "moves", "start"), model.arrays()):
        setattr(model, name, array.astype(np.float64))
    codes, gold = rng.integers(1, 130, (3, 7)).astype(np.uint8), np.array([[0, 1, 2, 2, 0, 3, 4], [2, 2, 0, 0, 1, 1, 2], [0, 0, 0, 3, 4, 4, 0]])
    _, slopes = model.loss(codes, gold)
    for array, slope in zip(model.arrays(), slopes):
        for at in np.argwhere(slope != 0)[::max(1, np.count_nonzero(slope) // 5)]:
            place, was, sides = tuple(at), array[tuple(at)], []
            for step in (1e-3, -1e-3):
                array[place] = was + step
                sides.append(model.loss(codes, gold)[0])
            array[place] = was
            assert abs((sides[0] - sides[1]) / 2e-3 - slope[place]) < 2e-3 * max(1, abs(slope[place]))
    # the decoded tags have the highest score of all
    codes = rng.integers(1, 130, (2, 4)).astype(np.uint8)
    best, _ = model.decode(codes)
    gold = np.array(np.meshgrid(*[range(9)] * 4)).reshape(4, -1).T
    for k in range(2):
        losses = [model.loss(codes[k:k + 1], g[None])[0] for g in gold[rng.integers(0, len(gold), 200)]]
        assert model.loss(codes[k:k + 1], best[k:k + 1].astype(int))[0] <= min(losses) + 1e-6


def test_reconciled():
    text = "call 001 918 555 3922 or mail a9 @ b.co now 12 12"
    a, b = text.index("001"), text.index(" or")
    mail = text.index("a9"), text.index(" now")
    cut = [(3, a, a + 9, 2.0, True), (3, a + 6, b, 3.0, True), (0, mail[0] - 1, mail[1], 5.0, False), (0, mail[0], mail[1], 1.0, False),
           (2, len(text) - 5, len(text), 9.0, False)]
    assert sorted(personal_data.reconciled(text, [], cut)) == [(0, *mail), (3, a, b)]
    assert personal_data.reconciled(text, [(2, a, b)], cut) == [(0, *mail)]
    assert personal_data.reconciled(text, [], []) == []


def test_personal_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    model = personal_data.fit(docs)
    tricky = [(1, None), (2, ""), (3, "no digits here"), (4, "x" * 8_000 + " ann.lee.42@mail4.example.com " + "y" * 2_000),
              (4, "ann.lee.42@mail4.example.com"), (None, "+1 (918) 555-3922"), (5, "9" * 1000), (6, "one two\n" * 2000 + "208.98.142.209 end")]
    table = spark.createDataFrame(tricky, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("id", F.lit(1))
    whole = personal_data.find(table.unionByName(docs.select("doc_id", "text", F.lit(1).alias("spans"), F.lit(1).alias("id"))), model)
    kept = Counter((r.id, tuple((personal_data.KINDS.index(s.kind), s.start, s.end) for s in r.spans if not s.learned)) for r in whole.collect())
    texts = tricky + [(r.doc_id, r.text) for r in docs.collect()]
    assert kept == Counter((k, tuple(sorted(plain_spans(t or "")))) for k, t in texts)
    # held-out data, written otherwise, in plain sentences of the documents
    rng = np.random.default_rng(77)
    plain = [t for _, t in texts if t and len(t) > 300 and not re.search("[0-9@]", t)]
    sources = [(0, "jan.doe.31@mail2.example.com"), (1, "10.20.30.40"), (2, "4111111111111111"), (3, "+1 (918) 555-3922")]
    made, wanted = [], []
    for k in range(240):
        kind, data = sources[k % 4]
        put, text = personal_data._otherwise(kind, data, rng), plain[k % len(plain)][:300]
        at = text.index(" ", 100 + k % 100) if " " in text[100 + k % 100:] else 100
        made.append((k, f"{text[:at]} {put} {text[at:]}"))
        wanted.append((personal_data.KINDS[kind], at + 1, at + 1 + len(put)))
    found = personal_data.find(spark.createDataFrame(made, "doc_id long, text string"), model).collect()
    hits = [any((s.kind, s.start, s.end) == wanted[r.id] for s in r.spans) for r in found]
    assert np.mean(hits) > 0.8
    # what is clean stays clean
    clean = [(k, t.replace("\n", " ")) for k, t in enumerate(plain)] + [(10_000 + k, f"in {1900 + k} there were {k * 7} of {k}.{k} parts") for k in range(99)]
    left = personal_data.find(spark.createDataFrame(clean, "doc_id long, text string"), model).where("size(spans) > 0").count()
    assert left <= 1
    hidden = personal_data.masked(table, model)
    assert hidden.columns == table.columns
    assert Counter(r.text for r in hidden.where("doc_id = 4").collect()) == Counter(["x" * 8_000 + " <email> " + "y" * 2_000, "<email>"])
    assert personal_data.find(table.where("false"), model).collect() == []
    bare = table.where("doc_id IN (1, 2, 3)")
    assert personal_data.fit(bare) is None and all(r.spans == [] for r in personal_data.find(bare, None).collect())
