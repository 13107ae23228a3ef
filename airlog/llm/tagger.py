"""A character tagger in numpy: a bidirectional LSTM whose outputs are the emissions of a linear-chain CRF over B, I and O tags.

Tag 0 is outside; 1 + 2k begins and 2 + 2k continues a span of kind k. A span may begin before its window, so a window may begin with
a continuation; otherwise a continuation follows only its own kind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Classes of characters: 0 fills a short window, 1 .. 128 are ASCII, then other letters and all else.
CLASSES = 131
_NEVER = -1e4


@cache
def _classes() -> np.ndarray:
    return np.array([c + 1 if c < 128 else 129 if chr(c).isalpha() else 130 for c in range(0x110000)], np.uint8)


def encode(text: str) -> np.ndarray:
    """The class of every character."""
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def _allowed(tags: int) -> np.ndarray:
    before, after = np.meshgrid(np.arange(tags), np.arange(tags), indexing="ij")
    inside = (after > 0) & (after % 2 == 0)
    return np.where(~inside | (before == after) | (before == after - 1), 0, _NEVER).astype(np.float32)


@dataclass
class Tagger:
    inputs: np.ndarray  # 2 x class, 4 x hidden: forward, then backward
    hidden: np.ndarray  # 2, hidden, 4 x hidden
    outputs: np.ndarray  # 2 x hidden, tags
    bias: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    @classmethod
    def fresh(cls, kinds: int, hidden: int, rng: np.random.Generator) -> Tagger:
        tags = 1 + 2 * kinds
        inputs = rng.normal(0, 0.3, (2 * CLASSES, 4 * hidden))
        inputs[:, hidden:2 * hidden] += 1  # forget little at first
        made = (inputs, rng.normal(0, hidden ** -0.5, (2, hidden, 4 * hidden)), rng.normal(0, 0.2, (2 * hidden, tags)),
                np.zeros(tags), np.zeros((tags, tags)), np.zeros(tags))
        return cls(*[a.astype(np.float32) for a in made])

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.outputs, self.bias, self.moves, self.start]

    def _run(self, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """Hidden states (time, 2, window, hidden), each direction in its own order, and what the way back needs."""
        n, length = codes.shape
        size = self.hidden.shape[1]
        order = np.stack([codes.astype(np.int32), codes[:, ::-1].astype(np.int32) + CLASSES])
        scale = np.repeat(np.float32([0.5, 0.5, 0.5, 1]), size)
        h = c = np.zeros((2, n, size), np.float32)
        states = np.empty((length, 2, n, size), np.float32)
        cells, gates = (np.empty((length, 2, n, k * size), np.float32) if keep else None for k in (1, 4))
        for t in range(length):
            z = np.tanh((self.inputs[order[:, :, t]] + h @ self.hidden) * scale)
            z[..., :3 * size] = z[..., :3 * size] * 0.5 + 0.5
            c = z[..., size:2 * size] * c + z[..., :size] * z[..., 3 * size:]
            h = z[..., 2 * size:3 * size] * np.tanh(c)
            states[t] = h
            if keep:
                cells[t], gates[t] = c, z
        return states, (order, cells, gates)

    def _emissions(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        return seen, seen @ self.outputs + self.bias

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window (window, time), and by how much each tag's emission is above that of being outside."""
        emissions = self._emissions(self._run(codes, False)[0])[1]
        length, n, tags = emissions.shape
        moves = self.moves + _allowed(tags)
        best, came = self.start + emissions[0], np.empty((length, n, tags), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + moves
            came[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + emissions[t]
        found, rows = np.empty((n, length), np.int8), np.arange(n)
        found[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            found[:, t - 1] = came[t, rows, found[:, t]]
        above = emissions - emissions[:, :, :1]
        return found, np.take_along_axis(above.transpose(1, 0, 2), found[:, :, None].astype(int), axis=2)[:, :, 0]

    def loss(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of the gold tags of some windows, and its gradients."""
        states, (order, cells, gates) = self._run(codes, True)
        seen, emissions = self._emissions(states)
        length, n, tags = emissions.shape
        size, rows = self.hidden.shape[1], np.arange(n)
        moves = self.moves + _allowed(tags)
        # forward and backward sums, each step scaled to one
        top = emissions.max(axis=2, keepdims=True)
        score, way = np.exp(emissions - top), np.exp(moves)
        ahead, behind, scales = np.empty_like(score), np.ones_like(score), np.empty((length, n, 1), np.float32)
        for t in range(length):
            now = (np.exp(self.start) if t == 0 else ahead[t - 1] @ way) * score[t]
            scales[t] = now.sum(axis=1, keepdims=True)
            ahead[t] = now / scales[t]
        for t in range(length - 2, -1, -1):
            behind[t] = (behind[t + 1] * score[t + 1] / scales[t + 1]) @ way.T
        chance = ahead * behind
        pairs = np.einsum("tnj,tnk->jk", ahead[:-1], behind[1:] * score[1:] / scales[1:]) * way
        steps = gold.T
        real = self.start[steps[0]].sum() + moves[steps[:-1], steps[1:]].sum() + np.take_along_axis(
            emissions, steps[:, :, None], axis=2).sum()
        value = float((np.log(scales) + top).sum() - real) / n

        push = chance.copy()
        push[np.arange(length)[:, None], rows, steps] -= 1
        push /= n
        seen_moves = np.zeros_like(moves)
        np.add.at(seen_moves, (steps[:-1], steps[1:]), 1)
        d_moves, d_start = (pairs - seen_moves) / n, push[0].sum(axis=0)
        d_seen = push @ self.outputs.T
        d_states = np.stack([d_seen[:, :, :size], d_seen[::-1, :, size:]], axis=1)
        d_hidden, d_gates = np.zeros_like(self.hidden), np.empty_like(gates)
        dh = dc = np.zeros((2, n, size), np.float32)
        for t in range(length - 1, -1, -1):
            i, f, o, g = (gates[t][..., k * size:(k + 1) * size] for k in range(4))
            flat = np.tanh(cells[t])
            dh = dh + d_states[t]
            dc = dc + dh * o * (1 - flat * flat)
            d = d_gates[t]
            d[..., :size] = dc * g * i * (1 - i)
            d[..., size:2 * size] = (dc * cells[t - 1] * f * (1 - f)) if t else 0
            d[..., 2 * size:3 * size] = dh * flat * o * (1 - o)
            d[..., 3 * size:] = dc * i * (1 - g * g)
            if t:
                d_hidden += states[t - 1].transpose(0, 2, 1) @ d
            dc, dh = dc * f, d @ self.hidden.transpose(0, 2, 1)
        d_inputs = np.zeros_like(self.inputs)
        np.add.at(d_inputs, order.transpose(2, 0, 1).ravel(), d_gates.reshape(-1, 4 * size))
        return value, [d_inputs, d_hidden, np.einsum("tnh,tnk->hk", seen, push), push.sum(axis=(0, 1)), d_moves, d_start]


def train(codes: np.ndarray, gold: np.ndarray, kinds: int, hidden: int = 16, steps: int = 240, batch: int = 48, rate: float = 0.02,
          seed: int = 0) -> Tagger:
    """Fit a tagger by Adam on windows (window, time) and their tags; the same windows in the same order give the same tagger."""
    rng = np.random.default_rng(seed)
    model = Tagger.fresh(kinds, hidden, rng)
    first, second = ([np.zeros_like(a) for a in model.arrays()] for _ in range(2))
    for step in range(steps):
        rows = rng.integers(0, len(codes), batch)
        _, slopes = model.loss(codes[rows], gold[rows])
        norm = float(np.sqrt(sum((s * s).sum() for s in slopes)))
        now = rate * 0.5 * (1 + np.cos(np.pi * step / steps)) * min(1.0, (step + 1) / 10)
        for array, slope, m, v in zip(model.arrays(), slopes, first, second):
            slope = slope * min(1.0, 5 / (norm + 1e-9))
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            array -= (now * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(np.float32)
    return model
