"""Static range asymmetric numeral coding of token ids with interleaved lanes, for one block at a time.

A frequency table gives every id that occurs a share of 2**SCALE slots. Ids are dealt to LANES coders in turn; a lane's state is
a number of 64 bits, and 32 of them move to the common stream of words when it would grow too large. Every CHECKPOINT steps the
states and the place in the stream are kept, so a decoder can begin there; lanes of one step are coded together.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE, LANES, CHECKPOINT = 19, 512, 256
_LOW = np.uint64(1 << 31)
_WORD, _SCALE = np.uint64(32), np.uint64(SCALE)
_WORD_MASK, _SLOT_MASK = np.uint64(0xFFFFFFFF), np.uint64((1 << SCALE) - 1)


@dataclass
class Table:
    """Frequencies of the ids of a section: ids ascending, their shares adding up to 2**SCALE."""

    ids: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """From the number of times each id occurs."""
        ids = np.flatnonzero(counts)
        if len(ids) > 1 << SCALE:
            raise ValueError(f"more than {1 << SCALE} different ids")
        shares = np.maximum(1, counts[ids].astype(np.float64) * (1 << SCALE) / max(1, counts.sum())).astype(np.int64)
        for k in np.argsort(-shares, kind="stable"):
            excess = int(shares.sum()) - (1 << SCALE)
            if excess == 0:
                break
            shares[k] -= min(excess, int(shares[k]) - 1)
        return cls(ids.astype(np.uint32), shares.astype(np.uint32))

    def to_bytes(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=np.uint32(0)).astype("<u4").tobytes() + self.shares.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), dtype="<u4")
        half = len(both) // 2
        return cls(np.cumsum(both[:half], dtype=np.uint32), both[half:])

    def starts(self) -> np.ndarray:
        return (np.cumsum(self.shares, dtype=np.uint64) - self.shares).astype(np.uint64)


def encode(blocks: list[np.ndarray], table: Table) -> list[tuple[bytes, bytes]]:
    """(checkpoints, payload) of each block; every block has one id or more. Blocks are coded side by side."""
    steps = np.array([-(-len(b) // LANES) for b in blocks])
    order = np.argsort(-steps, kind="stable")  # the blocks still to be coded at a step are the first ones
    at = np.zeros((steps.max(), len(blocks), LANES), dtype=np.int64)
    place_of = np.zeros(int(table.ids[-1]) + 1, dtype=np.int32)
    place_of[table.ids] = np.arange(len(table.ids))
    for k, b in enumerate(order):
        own = place_of[blocks[b]]
        own = np.concatenate([own, np.full(steps[b] * LANES - len(own), own[0])])
        at[:steps[b], k] = own.reshape(-1, LANES)
    shares, starts = table.shares.astype(np.uint64), table.starts()
    state = np.full((len(blocks), LANES), _LOW)
    words: list[list[np.ndarray]] = [[] for _ in blocks]
    kept: list[list[np.ndarray]] = [[] for _ in blocks]
    open_blocks = np.searchsorted(-steps[order], -np.arange(steps.max()), side="left")
    for step in range(steps.max() - 1, -1, -1):
        count = int(open_blocks[step])
        row, x = at[step, :count], state[:count]
        share = shares.take(row)
        full = (x >> np.uint64(63 - SCALE)) >= share
        low = (x[full] & _WORD_MASK).astype("<u4")
        ends = np.cumsum(np.count_nonzero(full, axis=1)).tolist()
        for k, (begin, end) in enumerate(zip([0, *ends], ends)):
            words[k].append(low[begin:end])
        x[:] = np.where(full, x >> _WORD, x)
        quotient = x // share
        x[:] = (quotient << _SCALE) + (x - quotient * share) + starts.take(row)
        if step % CHECKPOINT == 0:
            for k in range(count):
                kept[k].append(x[k].astype("<u8"))
    coded: list = [None] * len(blocks)
    for k, b in enumerate(order):
        own = words[k][::-1]
        places = np.concatenate([[0], np.cumsum([len(w) for w in own])])[:steps[b]:CHECKPOINT].astype("<u8")
        coded[b] = (b"".join(p.tobytes() + s.tobytes() for p, s in zip(places, kept[k][::-1])), b"".join(w.tobytes() for w in own))
    return coded


class Decoder:
    def __init__(self, table: Table):
        self.ids, self.shares, self.starts = table.ids, table.shares.astype(np.uint64), table.starts()
        small = np.uint16 if len(table.ids) <= 1 << 16 else np.uint32
        self.places = np.repeat(np.arange(len(table.ids), dtype=small), table.shares)

    def block(self, checkpoints: bytes, payload: bytes, count: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of a block of count ids, from its first checkpoint up to the last; what lies between is decoded side by side."""
        kept = np.frombuffer(checkpoints, dtype="<u8").reshape(-1, LANES + 1)[first:last]
        words = np.append(np.frombuffer(payload, dtype="<u4"), np.uint32(0))
        place, state = kept[:, 0].astype(np.int64), kept[:, 1:].astype(np.uint64)
        steps = np.minimum(CHECKPOINT, -(-count // LANES) - CHECKPOINT * np.arange(first, first + len(kept)))
        out = np.empty((len(kept), CHECKPOINT, LANES), dtype=self.places.dtype)
        for step in range(steps.max(initial=0)):
            parts = len(kept) if step < steps[-1] else len(kept) - 1  # only the block's last part can be shorter
            x = state[:parts]
            slot = x & _SLOT_MASK
            found = self.places[slot]
            out[:parts, step] = found
            x[:] = self.shares[found] * (x >> _SCALE) + slot - self.starts[found]
            low = x < _LOW
            taken = np.cumsum(low, axis=1)
            word = words[np.minimum(place[:parts, None] + taken - 1, len(words) - 1)]
            x[:] = np.where(low, (x << _WORD) | word, x)
            place[:parts] += taken[:, -1]
        flat = out.reshape(-1)
        return self.ids[flat[:min(len(flat), count - first * CHECKPOINT * LANES)]]
