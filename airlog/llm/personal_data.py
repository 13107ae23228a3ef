"""Personal data in texts: fixed patterns, and a character tagger that has learned from them and finds what is written otherwise.

The patterns' spans label a bounded sample of windows. Each labelled window is also shown with its span written in another way (an
at sign in brackets, dots spelled or bracketed, other separators, no plus sign, other digits), so the tagger has to learn what stands
around and inside such data. A text is cut into overlapping windows; every window that holds a digit or an at sign is tagged. Others
are not, as a span without either is none of the four kinds. The spans of all windows are reconciled over the whole text: pieces cut by a window's edge
are joined, and of the rest the set without overlaps that has the highest total score stays, beside the patterns' spans, which always stay.
A learned span must still hold what its kind needs (a card's checksum, an address's four parts up to 255, and so on).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlog.llm import tagger
from airlog.llm.common import portions, written

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and from one to the next; a span up to half a window lies whole in one.
WINDOW, STRIDE = 80, 40
#: Windows that are tagged together.
TOGETHER = 512

_AT = r"(?:@|[\[(]at[\])])"
_TRIGGER = re.compile(r"[0-9]|" + _AT)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, so looking behind changes nothing but the time for long runs
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def _is_card(text: str) -> bool:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19:
        return False
    total = sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (d > "4") for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, found from their at signs: a long run of letters before none costs its length once."""
    done, before = 0, text.find("@")
    low = 0
    while before >= 0:
        front = text[max(low, done):before]
        start = before - (len(front) - len(front.rstrip(_LOCAL)))
        host = _HOST.match(text, before + 1) if start < before else None
        if host:
            yield start, host.end()
            done = host.end()
        low = before + 1
        before = text.find("@", max(low, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, leftmost and without overlaps within a kind, failing ones left out."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern, holds in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return found


def plausible(kind: int, text: str) -> bool:
    """Whether a learned span, whose separators may be any, holds what its kind needs."""
    if kind == 0:
        plain = re.sub(r"\s+|[\[\]()]", "", re.sub(r"[\[(]dot[\])]", ".", re.sub(rf"\s*{_AT}\s*", "@", text)))
        return len(re.findall("@", plain)) == 1 and list(_emails(plain)) == [(0, len(plain))]
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and _is_ip(".".join(parts)) and not re.search(r"[^\W\d_]", re.sub(r"[\[(]dot[\])]", "", text))
    if re.search(r"[^\W\d_]", text):
        return False
    return _is_card(text) if kind == 2 else _is_phone(text) and not text.isdigit()


def _starts(text: str) -> np.ndarray:
    """Where the windows that hold a digit or an at sign begin."""
    at = np.fromiter((m.start() for m in _TRIGGER.finditer(text)), np.int64)
    if not len(at):
        return at
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    covering = (at // STRIDE)[:, None] - np.arange(WINDOW // STRIDE)
    return np.unique(covering.clip(0, last)) * STRIDE


def _window_codes(windows: list[str]) -> np.ndarray:
    codes = np.zeros((len(windows), WINDOW), np.uint8)
    for row, window in zip(codes, windows):
        row[:len(window)] = tagger.encode(window)
    return codes


def _tag_spans(tags: np.ndarray, spans: list[tuple[int, int, int]]) -> None:
    for kind, start, end in spans:
        tags[max(start, 0):max(end, 0)] = 2 + 2 * kind
        if 0 <= start < len(tags):
            tags[start] = 1 + 2 * kind


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in order of start, longest first, without those that overlap one before."""
    kept: list[tuple[int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if not kept or span[1] >= kept[-1][2]:
            kept.append(span)
    return kept


def _examples(text: str) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """Windows to learn from: (class, window, spans); the class is the kind of the span it was cut around, or -1 without a span."""
    spans = _apart(base_spans(text))
    ends = [s[2] for s in spans]

    def inside(start: int) -> list[tuple[int, int, int]]:
        some = []
        for k in range(bisect_right(ends, start), len(spans)):
            if spans[k][1] >= start + WINDOW:
                break
            some.append((spans[k][0], spans[k][1] - start, spans[k][2] - start))
        return some

    for kind, start, end in spans:
        if end - start <= WINDOW:
            room = WINDOW - (end - start)
            begin = max(0, min(start - xxhash.xxh32_intdigest(text[start:end + 40]) % (room + 1), len(text) - WINDOW))
            yield kind, text[begin:begin + WINDOW], inside(begin)
    for start in _starts(text).tolist():
        if not inside(start):
            yield -1, text[start:start + WINDOW], []


def _otherwise(kind: int, text: str, rng: np.random.Generator) -> str:
    """The same data written in another way, with other digits (a card's last one mended) and letters."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def other(word: str) -> str:
        return "".join(digits[rng.integers(10)] if c in digits else letters[rng.integers(26)] if c in letters else c for c in word)

    def one(*choices: str) -> str:
        return choices[rng.integers(len(choices))]

    if kind == 0:
        local, _, host = text.partition("@")
        dot = one(".", ".", "[.]", "(dot)")
        return other(local) + one("@", " @ ", "[at]", "(at)", " [at] ") + dot.join(map(other, host.split(".")))
    if kind == 1:
        parts = [str(rng.integers(256)) for _ in range(4)]
        return one(".", "[.]", "(.)", " . ").join(parts)
    if kind == 2:
        body = other(_digits(text))[:-1]
        full = next(body + d for d in digits if _is_card((body + d)))
        return one(" ", "-", ".", "/", "_", "  ", "").join(full[k:k + 4] for k in range(0, len(full), 4))
    body = other(_digits(text))
    shape = (f"{body[:-10]} ({body[-10:-7]}) {body[-7:-4]}-{body[-4:]}", f"({body[-10:-7]}) {body[-7:-4]}-{body[-4:]}",
             f"00{body[:-10]} {body[-10:-7]} {body[-7:-4]} {body[-4:]}", f"{body[-10:-7]}/{body[-7:-4]}-{body[-4:]}",
             f"+{body[:-10]}/{body[-10:-7]}/{body[-7:]}", f"+{body[:-10]} {body[-10:-7]} {body[-7:-4]} {body[-4:]}")
    return one(*shape).strip() if len(body) >= 10 else one("00", "+") + body


def labelled_windows(docs: DataFrame, per_class: int, text_col: str = "text") -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """At most per_class windows around spans of each kind and as many without any: those with the smallest hash of their text.

    Every window of every text takes part; equal windows are one. A partition passes on its smallest ones only, and only the sample,
    (kinds + 1) * per_class windows, comes to the driver.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, tuple]] = {k: {} for k in range(-1, len(KINDS))}
        for batch in batches:
            for some in portions(batch, 0):
                for text in some.column(0).to_pylist():
                    if text is None or not _TRIGGER.search(text):
                        continue
                    for kind, window, spans in _examples(text):
                        own = best[kind]
                        hashed = xxhash.xxh3_64_intdigest(window.encode("utf-8", "surrogatepass")) >> 1
                        own[hashed] = min((window, spans), own.get(hashed, (window, spans)))
                        if len(own) > 4 * per_class:
                            best[kind] = {h: own[h] for h in sorted(own)[:per_class]}
        rows = [(kind, h, *own[h]) for kind, own in best.items() for h in sorted(own)[:per_class]]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()),
            pa.array([[n for span in r[3] for n in span] for r in rows], pa.list_(pa.int32()))], names=["class", "hash", "window", "spans"])

    found = written(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        cut, "class int, hash long, window string, spans array<int>"), "windows")
    once = found.groupBy("class", "hash").agg(F.min(F.struct("window", "spans")).alias("seen")).select("class", "hash", "seen.*")
    sample = [row for kind in range(-1, len(KINDS)) for row in once.where(F.col("class") == kind).orderBy("hash").limit(per_class).collect()]
    return [(r["class"], r.window, [tuple(r.spans[k:k + 3]) for k in range(0, len(r.spans), 3)]) for r in sample]


def fit(docs: DataFrame, per_class: int = 400, ways: int = 3, steps: int = 300, seed: int = 0,
        text_col: str = "text") -> tagger.Tagger | None:
    """A tagger learned from the patterns' spans in a table of texts; None if there is no such span.

    The sample is bounded: per_class windows around spans of each kind and per_class without any. Each with a span is shown as it
    is and in `ways` other ways.
    """
    sample = labelled_windows(docs, per_class, text_col)
    if all(kind < 0 for kind, _, _ in sample):
        return None
    rng = np.random.default_rng(seed)
    windows, gold = [], []

    def show(window: str, spans: list[tuple[int, int, int]]) -> None:
        tags = np.zeros(WINDOW, np.int64)
        _tag_spans(tags, spans)
        windows.append(window[:WINDOW])
        gold.append(tags)

    for kind, window, spans in sample:
        show(window, spans)
        whole = [s for s in spans if s[1] >= 0 and s[2] <= len(window) and s[0] == kind]
        for _ in range(ways if whole else 0):
            text, moved, at = "", [], 0
            for k, start, end in spans:
                text += window[at:max(start, 0)]
                put = _otherwise(k, window[start:end], rng) if 0 <= start and end <= len(window) else window[max(start, 0):end]
                if start >= 0:
                    moved.append((k, len(text), len(text) + len(put)))
                else:
                    moved.append((k, -1, len(text) + len(put)))
                text, at = text + put, end
            show(text + window[max(at, 0):], moved)
    order = rng.permutation(len(windows))
    return tagger.train(_window_codes([windows[k] for k in order]), np.stack([gold[k] for k in order]), len(KINDS), steps=steps, seed=seed)


def _runs(tags: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, ...]:
    """The spans of tagged windows: window, start, end, kind, score."""
    kind = (tags.astype(np.int64) - 1) // 2
    inside = tags > 0
    fresh = inside.copy()
    fresh[:, 1:] &= (tags[:, 1:] % 2 == 1) | ~inside[:, :-1]
    rows, starts = np.nonzero(fresh)
    closes = inside.copy()
    closes[:, :-1] &= ~inside[:, 1:] | fresh[:, 1:]
    ends = np.nonzero(closes)[1] + 1
    sums = np.concatenate([np.zeros((len(tags), 1)), np.cumsum(np.where(inside, above, 0), axis=1, dtype=np.float64)], axis=1)
    return rows, starts, ends, kind[rows, starts], sums[rows, ends] - sums[rows, starts]


def reconciled(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """The learned spans that stay beside the patterns' spans of a whole text.

    found: kind, start, end, score, whether an edge of its window cuts it. A cut piece is joined with a piece of its kind that it
    overlaps, or goes if there is none, as another window shows it whole. Spaces at the ends of spans do not count. Spans that
    overlap a pattern's span or do not hold what their kind needs go; the others' best set without overlaps stays.
    """
    joined: list[list] = []
    for kind, start, end, score, cut in sorted(found):
        last = joined[-1] if joined else None
        if last and last[0] == kind and start < last[2] and (cut or last[4]):
            last[2], last[3], last[4] = max(last[2], end), max(last[3], score), cut if end >= last[2] else last[4]
        else:
            joined.append([kind, start, end, score, cut])
    known = sorted((a, b) for _, a, b in base)
    reach = np.maximum.accumulate([b for _, b in known]).tolist() if known else []
    spans: dict[tuple[int, int, int], float] = {}
    for kind, start, end, score, _ in joined:
        piece = text[start:end]
        start, end = start + len(piece) - len(piece.lstrip()), end - len(piece) + len(piece.rstrip())
        before = bisect_right(known, (end - 1, len(text) + 1)) if known else 0
        if start < end and not (before and reach[before - 1] > start) and plausible(kind, text[start:end]):
            spans[kind, start, end] = max(score, spans.get((kind, start, end), score))
    ordered = sorted((end, start, kind, score) for (kind, start, end), score in spans.items() if score > 0)
    ends, best, taken = [s[0] for s in ordered], [0.0], []
    for k, (end, start, _, score) in enumerate(ordered):
        before = bisect_right(ends, start, 0, k)
        taken.append((best[before] + score > best[-1], before))
        best.append(max(best[-1], best[before] + score))
    kept, k = [], len(ordered)
    while k:
        good, before = taken[k - 1]
        if good:
            kept.append((ordered[k - 1][2], ordered[k - 1][1], ordered[k - 1][0]))
        k = before if good else k - 1
    return kept


def tag_texts(texts: list[str], model: tagger.Tagger) -> list[list[tuple[int, int, int, float, bool]]]:
    """The spans that the tagger sees in the windows of each text: kind, start, end, score, whether a window's edge cuts it."""
    found: list[list] = [[] for _ in texts]
    waiting: list[tuple[int, int]] = []

    def tag() -> None:
        windows = [texts[k][at:at + WINDOW] for k, at in waiting]
        tags, above = model.decode(_window_codes(windows))
        for row, start, end, kind, score in zip(*(a.tolist() for a in _runs(tags, above))):
            k, at = waiting[row]
            size = len(windows[row])
            if start < size:
                end = min(end, size)
                cut = (start == 0 and at > 0) or (end == size and at + size < len(texts[k]))
                found[k].append((kind, at + start, at + end, score, cut))
        waiting.clear()

    for k, text in enumerate(texts):
        for at in _starts(text).tolist():
            waiting.append((k, at))
            if len(waiting) == TOGETHER:
                tag()
    if waiting:
        tag()
    return found


def find(docs: DataFrame, model: tagger.Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: spans is an array of (kind, start, end, learned) in code points, by kind as listed, then start.

    A null or empty text has none. Without a tagger only the patterns' spans are found. Repeated rows are repeated, an empty table
    stays empty, other columns are not read.
    """

    def spans_of(texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
        out: list[list] = [[] for _ in texts]
        rows = [k for k, text in enumerate(texts) if text and _TRIGGER.search(text)]
        base = [base_spans(texts[k]) for k in rows]
        seen = tag_texts([texts[k] for k in rows], model) if model and rows else [[] for _ in rows]
        for k, known, more in zip(rows, base, seen):
            added = reconciled(texts[k], known, more)
            out[k] = sorted([(*s, False) for s in known] + [(*s, True) for s in added])
        return out

    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("learned", pa.bool_())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, 1):
                spans = [[(KINDS[k], a, b, learned) for k, a, b, learned in own] for own in spans_of(some.column(1).to_pylist())]
                rows = [[dict(zip(("kind", "start", "end", "learned"), s)) for s in own] for own in spans]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, pa.list_(item))], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        found, f"id {kind}, spans array<struct<kind:string,start:long,end:long,learned:boolean>>")


def masked(docs: DataFrame, model: tagger.Tagger | None, text_col: str = "text",
           mark: Callable[[str], str] = "<{}>".format) -> DataFrame:
    """docs with every span in the text column replaced by a mark of its kind; overlapping spans are one, named by the first."""
    place = docs.columns.index(text_col)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, place):
                texts = some.column(place).to_pylist()
                rows = [k for k, text in enumerate(texts) if text and _TRIGGER.search(text)]
                seen = tag_texts([texts[k] for k in rows], model) if model and rows else [[] for _ in rows]
                for k, more in zip(rows, seen):
                    known = base_spans(texts[k])
                    out, at = [], 0
                    for kind, start, end in sorted(known + reconciled(texts[k], known, more), key=lambda s: (s[1], -s[2])):
                        if start >= at:
                            out += [texts[k][at:start], mark(KINDS[kind])]
                        at = max(at, end)
                    texts[k] = "".join(out) + texts[k][at:]
                yield some.set_column(place, some.schema.field(place), pa.array(texts, some.schema.field(place).type))

    return docs.mapInArrow(replaced, docs.schema)
