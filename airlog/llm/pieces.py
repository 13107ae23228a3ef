"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and decoding.

A text's lattice has a node between every two characters and an edge for each piece that fits; a segmentation's score is the sum
of its pieces' scores. Forward Viterbi gives each node the best score from the start. An A-star search backward from the end,
with these scores as heuristics that are exact, meets the segmentations in the order of their scores.

No piece has another character before a space, so the lattice of a text is a chain of the lattices of its units: a space, or
several, with what follows up to the next. Scores add up along the chain. A worker remembers units: their best pieces, score and
gap (how much the second best is worse). Units not met before go through Viterbi together, position by position. The n best of
a text change at most n - 1 units, and those with the smallest gaps suffice; the search runs in these, then over their choices.

The vocabulary's normalisation is taken as identity with a space put before the text, spaces written as U+2581. A character
without a piece becomes its UTF-8 bytes, scored below all pieces; U+2581 itself too, so decoding gives back every text.
The scores of a model made by pair merging are its merge order: the best segmentation by their sum is not always the one that
replaying the merges gives.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlog.llm.common import portions

#: Units that a worker remembers, searches that it remembers, and rows of a batch that it returns.
REMEMBERED, SEARCHES, ROWS = 300_000, 20_000, 256
_UNITS = re.compile(r" +[^ ]*")
_OPEN: dict[str, Pieces] = {}


def open_pieces(path: str) -> Pieces:
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        byte_ids: dict[int, int] = {}
        for k in range(count):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                byte_ids[int(piece[1:-1], 16)] = k
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes_of.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.pieces[text] = (k, model.get_score(k))
                self.bytes_of.append(text.encode())
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.byte_lengths = np.array([len(b) for b in self.bytes_of])
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no pieces for bytes")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.longest = max(map(len, self.pieces))
        self.fallback = min(score for _, score in self.pieces.values() if score > -1e8) - 10
        self._build_trie()
        #: Pairs of neighbours inside some piece: elsewhere a lattice falls into two.
        self.bridged = {piece[k:k + 2] for piece in self.pieces for k in range(len(piece) - 1)}
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.searched: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def _build_trie(self) -> None:
        children: dict[tuple[int, str], int] = {}
        piece_at, score_at = [-1], [0.0]
        for text, (k, score) in self.pieces.items():
            node = 0
            for c in text:
                if (node, c) not in children:
                    children[node, c] = len(piece_at)
                    piece_at.append(-1)
                    score_at.append(0.0)
                node = children[node, c]
            piece_at[node], score_at[node] = k, score
        self.piece_at, self.score_at = np.array(piece_at), np.array(score_at)
        keys = np.array([node << 21 | ord(c) for node, c in children])
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array(list(children.values()))[order]
        self.from_root = np.full(0x110000, -1, dtype=np.int64)
        for (node, c), to in children.items():
            if node == 0:
                self.from_root[ord(c)] = to

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(character, length, piece, score) of all edges; left: characters up to the end of each one's unit. Piece -1: bytes."""
        at, node = np.arange(len(codes)), self.from_root[codes]
        single = np.zeros(len(codes), dtype=bool)
        found = []
        for length in range(1, self.longest + 1):
            at, node = at[node >= 0], node[node >= 0]
            ends = self.piece_at[node] >= 0
            found.append((at[ends], np.full(ends.sum(), length), self.piece_at[node[ends]], self.score_at[node[ends]]))
            if length == 1:
                single[at[ends]] = True
            more = left[at] > length
            at, node = at[more], node[more]
            if not len(at):
                break
            key = node << 21 | codes[at + length].astype(np.int64)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            node = np.where(self.keys[place] == key, self.nodes[place], -1)
        bare = np.flatnonzero(~single)
        width = 1 + (codes[bare] >= 0x80) + (codes[bare] >= 0x800) + (codes[bare] >= 0x10000).astype(np.int64)
        found.append((bare, np.ones(len(bare), dtype=np.int64), np.full(len(bare), -1), width * self.fallback))
        return tuple(np.concatenate(column) for column in zip(*found))

    def learn(self, units: list[str]) -> dict[str, tuple[bytes, float, float]]:
        """Best ids, score and gap of each unit. A sign at the end that no piece joins to what is before it is looked up alone."""
        heads = {u: u[:-1] for u in units if u[-1] in ".,:;!?" and len(u) > 2 and u[-2:] not in self.bridged}
        wanted = {*(heads.get(u, u) for u in units), *(u[-1] for u in heads)}
        fresh = self.viterbi(sorted(wanted.difference(self.known), key=len))
        for unit, head in heads.items():
            (a, x, g), (b, y, h) = (fresh.get(part) or self.known[part] for part in (head, unit[-1]))
            fresh[unit] = (a + b, x + y, min(g, h))
        if len(self.known) < REMEMBERED:
            self.known.update(fresh)
        return fresh | {u: self.known[u] for u in units if u not in fresh}

    def viterbi(self, units: list[str]) -> dict[str, tuple[bytes, float, float]]:
        """The same for many units that are not empty, all at once."""
        if not units:
            return {}
        sizes = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(units)), sizes)
        first = np.cumsum(sizes) - sizes
        offset = np.arange(len(codes)) - first[owner]
        at, length, piece, score = self._edges(codes, sizes[owner] - offset)
        start = at + owner[at]  # nodes: a unit of n characters has n + 1
        end, step = start + length, offset[at] + length
        order = np.lexsort((-length, end, step))
        start, end, step, piece, score = start[order], end[order], step[order], piece[order], score[order]
        total = len(codes) + len(units)
        best, gap, into = np.full(total, -np.inf), np.full(total, np.inf), np.full(total, -1)
        best[first + np.arange(len(units))] = 0
        bounds = np.searchsorted(step, np.arange(1, sizes.max() + 2))
        for low, high in zip(bounds[:-1], bounds[1:]):
            value, to = best[start[low:high]] + score[low:high], end[low:high]
            groups = np.flatnonzero(np.diff(to, prepend=-1))
            top = np.maximum.reduceat(value, groups)
            counts = np.diff(np.append(groups, len(to)))
            hits = np.flatnonzero(value == np.repeat(top, counts))
            chosen = hits[np.searchsorted(hits, groups)]
            value[chosen] = -np.inf
            nodes = to[groups]
            best[nodes], into[nodes] = top, low + chosen
            gap[nodes] = top - np.maximum.reduceat(value, groups)
        ends = first + np.arange(len(units)) + sizes
        node, alive, margin = ends.copy(), np.arange(len(units)), np.full(len(units), np.inf)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        begin = first + np.arange(len(units))
        while len(alive):
            margin[alive] = np.minimum(margin[alive], gap[node[alive]])
            edge = into[node[alive]]
            taken.append((alive, edge))
            node[alive] = start[edge]
            alive = alive[node[alive] > begin[alive]]
        who, edge = (np.concatenate(column) for column in zip(*taken))
        order = np.lexsort((start[edge], who))
        ids, starts = piece[edge[order]], start[edge[order]]
        lasts = np.cumsum(np.bincount(who, minlength=len(units)))
        packed, scores, margins = ids.astype("<i4").tobytes(), best[ends].tolist(), margin.tolist()
        bare = np.unique(who[order][ids < 0]).tolist()
        begins = np.concatenate([[0], lasts[:-1]]).tolist()
        coded = [packed[4 * a:4 * b] for a, b in zip(begins, lasts.tolist())]
        for u in bare:
            own = slice(begins[u], int(lasts[u]))
            coded[u] = self._with_bytes([
                (int(k), units[u][int(s) - int(begin[u])]) for k, s in zip(ids[own], starts[own])])
        return dict(zip(units, zip(coded, scores, margins)))

    def _with_bytes(self, pieces: list[tuple[int, str]]) -> bytes:
        out: list[int] = []
        for k, char in pieces:
            out += [k] if k >= 0 else [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return np.array(out, dtype="<i4").tobytes()

    def search(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a unit: forward Viterbi, then A-star from the end."""
        if (unit, n) in self.searched:
            return self.searched[unit, n]
        size = len(unit)
        edges: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        best = [0.0] + [-np.inf] * size
        for end in range(1, size + 1):
            for begin in range(max(0, end - self.longest), end):
                found = self.pieces.get(unit[begin:end])
                if found:
                    edges[end].append((begin, *found))
            if not edges[end] or edges[end][-1][0] != end - 1:
                edges[end].append((end - 1, -1, len(unit[end - 1].encode("utf-8", "surrogatepass")) * self.fallback))
            best[end] = max(best[b] + s for b, _, s in edges[end])
        heap, made, results = [(-best[size], 0, size, 0.0, None)], 0, []
        while heap and len(results) < n:
            _, _, node, behind, path = heapq.heappop(heap)
            if node == 0:
                pieces = []
                while path:
                    pieces.append(path[0])
                    path = path[1]
                results.append((behind, self._with_bytes(pieces)))
                continue
            for begin, k, score in edges[node]:
                made -= 1  # later ones first among equals: a search that is deep stays deep
                total = behind + score
                heapq.heappush(heap, (-(best[begin] + total), made, begin, total, ((k, unit[begin]), path)))
        if len(self.searched) >= SEARCHES:
            self.searched.clear()
        self.searched[unit, n] = results
        return results

    def n_best(self, texts: list[str], n: int) -> Iterator[list[tuple[float, bytes]]]:
        """For each text its n best segmentations (all, if fewer): score, ids as little-endian 32-bit integers. '' has the empty one."""
        units = [[] if not t else [" " + p for p in t.split(" ")] if "  " not in t and t[0] != " " and t[-1] != " "
                 else _UNITS.findall(" " + t) for t in texts]
        get, rows, missing = self.known.get, [], set()
        for own in units:
            records = list(map(get, own))
            gone = [k for k, record in enumerate(records) if record is None]
            missing.update([own[k] for k in gone])
            rows.append((own, records, gone))
        fresh = self.learn(list(missing))
        for own, records, gone in rows:
            for k in gone:
                records[k] = fresh[own[k]]
            coded, scores, gaps = map(list, zip(*records)) if records else ([], [], [])
            best = sum(scores)
            results = [(best, b"".join(coded))]
            if n > 1 and own:
                places = range(len(own)) if len(own) < n else np.sort(np.argpartition(np.array(gaps), n - 2)[:n - 1]).tolist()
                # of segmentations with equal scores the search may meet another one first than Viterbi chose
                choices = []
                for p in places:
                    options = self.search(own[p], n)
                    others = [o for o in options if o[1] != coded[p]]
                    choices.append([(scores[p], coded[p]), *others][:n])
                combined: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
                for options in choices:
                    combined = heapq.nsmallest(n, (
                        (loss + options[0][0] - score, taken + (k,)) for loss, taken in combined
                        for k, (score, _) in enumerate(options)))
                for loss, taken in combined[1:]:
                    changed = coded.copy()
                    for p, k, options in zip(places, taken, choices):
                        if k:
                            changed[p] = options[k][1]
                    results.append((best - loss, b"".join(changed)))
            yield results

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of rows of ids: row k has the ids from offsets[k] to offsets[k + 1]."""
        lengths = self.byte_lengths[ids]
        ends = np.cumsum(lengths)
        spread = np.repeat(self.byte_starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        joined = self.all_bytes[spread].tobytes()
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]].tolist()
        return [joined[a + 1 if joined[a:a + 1] == b" " and a < b else a:b].decode("utf-8", "replace")
                for a, b in zip(bounds[:-1], bounds[1:])]


def encode(docs: DataFrame, model: str, n: int = 2, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row and nbest, its n best segmentations: array of (score, ids), best first.

    Null and empty texts have one segmentation, without ids. Of equal scores any order may result, the same in every run. Repeated
    rows are repeated; an empty table stays empty. model: path of the vocabulary, the same on every executor.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    nbest_type = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = open_pieces(model)
        for batch in batches:
            for some in portions(batch, len(keep)):
                rows = list(pieces.n_best(some.column(len(keep)).to_pylist(), n))
                flat = [one for row in rows for one in row]
                ids = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0] + [len(c) // 4 for _, c in flat]), pa.int32()),
                    pa.array(np.frombuffer(b"".join(c for _, c in flat), dtype="<i4")))
                best = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), ids], ["score", "ids"])
                nbest = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in rows]), pa.int32()), best)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:len(keep)], nbest.cast(nbest_type)], names=[*keep, "nbest"])

    return docs.select(*[docs[c] for c in keep], F.coalesce(docs[text_col].cast("string"), F.lit(""))).mapInArrow(
        encoded, schema + ", nbest array<struct<score: double, ids: array<int>>>")


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_name: str = "decoded") -> DataFrame:
    """All columns but ids_col, and the text that its ids stand for. Null ids: null. Ids of control pieces stand for nothing."""
    others = [f for f in rows.schema if f.name != ids_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = open_pieces(model)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                some = batch.slice(low, ROWS)
                ids = some.column(len(others))
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy())])
                texts = pieces.decode(ids.flatten().to_numpy(), offsets)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:len(others)], pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(False))],
                    names=[*(f.name for f in others), text_name])

    return rows.select(*[rows[f.name] for f in others], rows[ids_col]).mapInArrow(decoded, f"{schema}, `{text_name}` string")
