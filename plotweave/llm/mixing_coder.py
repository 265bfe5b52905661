"""Adaptive context-mixing range coder for blocks of token ids, the lanes of a block in step with one another.

Each block is coded on its own, from a fresh model, so blocks can be read in any order. A block is cut into
lanes, runs of its ids that are coded side by side as columns of numpy arrays; all of them share the model of
the block and teach it. Per id:

- order 2 and order 1: a slot per context (the last two ids, the last id) predicts the id that followed
  it, with a confidence. The prediction of the higher order wins if it has any confidence. Whether it is
  right is one yes/no decision; its probability mixes three adaptive estimates (by the confidence of
  order 2, by that of order 1, and by the last four decisions of the lane) with learned weights, on a logistic scale.
- order 0: a missed id is coded by the counts of the ids missed before; one whose share is too small for
  the table follows an escape as 16 plain bits.

Slots learn at each step (of lanes that share a slot the last one counts), counts, estimates and weights whenever
the ids since the last time are half of those before. All arithmetic is on whole numbers, so any machine decodes
what another has written. The range coder keeps 48 bits and puts out 16 at a time; carries are left in the words and
resolved at the end. The words of all lanes stand in the order in which a reader asks for them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

BLOCK_IDS = 1 << 20
MAX_ID = 1 << 16
# Ids that a lane has at least, and lanes of a block.
LANE_IDS, LANES = 256, 4096

_SLOTS = 1 << 17
_TOTAL_BITS, _FLAG_BITS = 16, 12
_TOTAL = 1 << _TOTAL_BITS
_LOW, _FULL = 1 << 32, 1 << 48
# Symbols of order 0 behind the ids: an escape, and none at all for an id that was predicted.
_ESCAPE, _NONE = MAX_ID, MAX_ID + 1
_REFRESH_IDS = 1 << 17

_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int64)


class _Model:
    """State of a block, shared by its lanes; `narrow(n)` keeps the first n lanes."""

    def __init__(self, lanes: int):
        # a slot holds its id and, in the lowest three bits, the confidence
        self.slots = [np.full(n, -8, np.int32) for n in (_SLOTS, MAX_ID)]
        self.prev, self.prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.past = np.zeros(lanes, np.int32)
        self.seen = [np.full(16, 4, np.int64) for _ in range(3)]
        self.hits = [np.full(16, 1, np.int64) for _ in range(3)]
        self.weight = [(1 << 16) * 2 // 5] * 3
        self.counts = np.zeros(MAX_ID, np.int64)
        self.came: list[np.ndarray] = []
        self.told: list[np.ndarray] = []
        self.since = self.before = 0
        self._mix()
        self._share()

    def narrow(self, n: int) -> None:
        self.prev, self.prev2, self.past = self.prev[:n], self.prev2[:n], self.past[:n]

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The predicted id (-1 for none) and the chance (of 4096) that it is right."""
        self.at = (((self.prev * 0x2C9277B5 + self.prev2 * 0x5F356495) >> 15) & (_SLOTS - 1), self.prev)
        self.held = [s.take(at, mode="clip") for s, at in zip(self.slots, self.at)]
        self.trust = [e & 7 for e in self.held]
        high = self.trust[0] > 0
        guess = np.where(high, self.held[0], self.held[1]) >> 3
        agree = guess == (self.held[1] >> 3)
        self.context = (self.past << 8) | (self.trust[1] << 5) | (high.view(np.int8) * np.int32(16)) | (self.trust[0] << 1) | agree
        return guess, self.chance.take(self.context, mode="clip")

    def learn(self, ids: np.ndarray, right: np.ndarray, symbol: np.ndarray) -> None:
        """Move all orders towards the id that came; `symbol` is what order 0 had to code."""
        fresh = ids.astype(np.int32) << 3 | 1
        for slots, at, held, trust in zip(self.slots, self.at, self.held, self.trust):
            same = (held ^ fresh).view(np.uint32) < 8
            slots[at] = np.where(same, held + (trust < 7), np.where(trust < 2, fresh, held - ((trust + 1) >> 1)))
        self.told.append((self.context << 1) | right)
        self.came.append(symbol)
        self.past[:] = ((self.past << 1) | right) & 15
        self.prev2[:] = self.prev
        self.prev[:] = ids
        self.since += len(ids)
        if self.since >= min(_REFRESH_IDS, max(LANE_IDS, self.before >> 1)):
            self._refresh()

    def _refresh(self) -> None:
        self.before, n, self.since = self.before + self.since, self.since, 0
        self.counts += np.bincount(np.concatenate(self.came), minlength=_NONE + 1)[:MAX_ID]
        told = np.bincount(np.concatenate(self.told), minlength=1 << 13).reshape(16, 16, 16, 2)
        self.came, self.told = [], []
        error = (told[..., 1] << 12) - told.sum(axis=3) * self.chance.reshape(16, 16, 16)
        for k, others in enumerate(((0, 1), (0, 2), (1, 2))):
            step = int((error.sum(axis=others) * self.input[k]).sum()) * 640 // n >> 16
            self.weight[k] = max(-(1 << 18), min(1 << 18, self.weight[k] + step))
            own = told.sum(axis=others)
            self.seen[k] += own.sum(axis=1)
            self.hits[k] += own[:, 1]
            full = self.seen[k] > 1 << 16
            self.seen[k] >>= full
            self.hits[k] >>= full
        self._mix()
        self._share()

    def _mix(self) -> None:
        """Chances by the contexts of all three estimates."""
        self.input = [_STRETCH[np.minimum((hits << 12) // seen, 4095)] for hits, seen in zip(self.hits, self.seen)]
        (a, b, c), w = self.input, self.weight
        dot = (a * w[0] + (b * w[1])[:, None] + (c * w[2])[:, None, None]) >> 16
        self.chance = _SQUASH[np.clip(dot, -2047, 2047) + 2047].ravel()

    def _share(self) -> None:
        """Lower bounds and widths of order 0."""
        n, kinds = int(self.counts.sum()), int(np.count_nonzero(self.counts))
        spare = max(1, _TOTAL * kinds // (n + kinds)) if n else _TOTAL
        share = self.counts * (_TOTAL - spare) // max(n, 1)
        past = np.cumsum(share)
        self.escape = int(past[-1])
        held = share > 0
        self.lower = np.concatenate([np.where(held, past - share, self.escape), [self.escape, 0]])
        self.width = np.concatenate([np.where(held, share, _TOTAL - self.escape), [_TOTAL - self.escape, _TOTAL]])
        self.share, self._symbols = share, None

    def symbols(self) -> np.ndarray:
        """The symbol of each place of order 0, for readers."""
        if self._symbols is None:
            own = np.flatnonzero(self.share)
            self._symbols = np.concatenate([np.repeat(own, self.share[own]), np.full(_TOTAL - self.escape, _ESCAPE)])
        return self._symbols


def _lanes(n: int) -> tuple[int, int, int]:
    """Lanes of a block of n ids, their steps, and how many of them have a last step."""
    lanes = min(LANES, max(1, n // LANE_IDS))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def encode_blocks(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """Payload of each block of at most `BLOCK_IDS` ids below `MAX_ID`."""
    return [_encode(b) if len(b) else b"" for b in blocks]


def _encode(block: np.ndarray) -> bytes:
    if block.max() >= MAX_ID or block.min() < 0:
        raise ValueError(f"ids must be below {MAX_ID}")
    n, steps, last = _lanes(len(block))
    ids = np.zeros((steps, n), np.uint16)
    ids[:, :last] = block[: last * steps].reshape(last, steps).T
    ids[: steps - 1, last:] = block[last * steps :].reshape(n - last, steps - 1).T
    # of three words an id has at most, most are never touched
    words = np.zeros((3 * steps + 8, n), np.uint32)
    flat, place = words.reshape(-1), np.arange(n)
    low, span = np.zeros(n, np.int64), np.full(n, _FULL, np.int64)
    put: list[np.ndarray] = []
    model = _Model(n)

    def shift(small):
        """Put out 16 bits where the range has become small."""
        while len(small):
            at, top = place[small], low[small]
            flat[at] = top >> 32
            put.append(at)
            place[small] = at + n
            low[small] = (top & 0xFFFFFFFF) << 16
            wide = span[small] << 16
            span[small] = wide
            small = small[wide < _LOW]

    for step in range(steps):
        active = n if step < steps - 1 else last
        if active < n:
            model.narrow(active)
        now, own_low, own_span = ids[step, :active].astype(np.int64), low[:active], span[:active]
        guess, p = model.predict()
        right = guess == now
        wrong = ~right
        part = own_span >> _FLAG_BITS
        yes = part * p
        symbol = np.where(right, _NONE, now)
        lower = model.lower.take(symbol, mode="clip")
        part = np.where(right, yes, (part << _FLAG_BITS) - yes) >> _TOTAL_BITS
        own_low += yes * wrong + part * lower
        own_span[:] = part * model.width.take(symbol, mode="clip")
        shift(np.flatnonzero(own_span < _LOW))
        plain = np.flatnonzero((lower >= model.escape) & wrong)
        if len(plain):
            part = span[plain] >> _TOTAL_BITS
            low[plain] += part * now[plain]
            span[plain] = part
            shift(plain[part < _LOW])
        model.learn(now, right, symbol)
    for k, bits in enumerate((32, 16, 0)):
        flat[place + k * n] = (low >> bits) & (0x1FFFF if bits == 32 else 0xFFFF)
    # only what was written is looked at, as the room is for the worst case
    words = words[: int(place.max()) // n + 3]
    while True:
        carry = words >> 16
        if not carry.any():
            break
        words &= 0xFFFF
        words[:-1] += carry[1:]
    # a reader holds three words of each lane and takes the next one whenever a word was put out
    order = np.concatenate([np.arange(3 * n), *(at + 3 * n for at in put)])
    return flat[order].astype("<u2").tobytes()


def decode_blocks(payloads: Sequence[bytes], sizes: Sequence[int]) -> list[np.ndarray]:
    """Ids of each block, given how many it has."""
    return [_decode(p, int(n)) if n else np.zeros(0, np.uint32) for p, n in zip(payloads, sizes)]


def _decode(payload: bytes, size: int) -> np.ndarray:
    n, steps, last = _lanes(size)
    words = np.frombuffer(payload, "<u2").astype(np.int64)
    code = (words[:n] << 32) | (words[n : 2 * n] << 16) | words[2 * n : 3 * n]
    taken = 3 * n
    span = np.full(n, _FULL, np.int64)
    ids = np.zeros((steps, n), np.uint16)
    model = _Model(n)

    def shift(small):
        nonlocal taken
        while len(small):
            code[small] = (code[small] << 16) | words[taken : taken + len(small)]
            taken += len(small)
            wide = span[small] << 16
            span[small] = wide
            small = small[wide < _LOW]

    for step in range(steps):
        active = n if step < steps - 1 else last
        if active < n:
            model.narrow(active)
        own_code, own_span = code[:active], span[:active]
        guess, p = model.predict()
        part = own_span >> _FLAG_BITS
        yes = part * p
        right = own_code < yes
        own_code -= yes * ~right
        part = np.where(right, yes, (part << _FLAG_BITS) - yes) >> _TOTAL_BITS
        # below 2^48 by below 2^36, with a quotient of at most 2^16: the division of floats rounds none of them up
        place = (own_code / part).astype(np.int64)
        symbol = np.where(right, _NONE, model.symbols().take(place, mode="clip"))
        own_code -= part * model.lower.take(symbol, mode="clip")
        own_span[:] = part * model.width.take(symbol, mode="clip")
        shift(np.flatnonzero(own_span < _LOW))
        now = np.where(right, guess, symbol)
        plain = np.flatnonzero(symbol == _ESCAPE)
        if len(plain):
            part = span[plain] >> _TOTAL_BITS
            value = (code[plain] / part).astype(np.int64)
            code[plain] -= part * value
            span[plain] = part
            shift(plain[part < _LOW])
            now[plain] = value
            symbol[plain] = value
        ids[step, :active] = now
        model.learn(now, right, symbol)
    out = np.empty(size, np.uint32)
    out[: last * steps].reshape(last, steps)[:] = ids[:, :last].T
    out[last * steps :].reshape(n - last, steps - 1)[:] = ids[: steps - 1, last:].T
    return out
