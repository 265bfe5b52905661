"""Whole texts of an Arrow batch as flat numpy arrays: words, lines and their hashes.

A word is a maximal run of anything but the six white-space characters of `[\\x20\\x09-\\x0D]`; those
are single bytes in UTF-8, so words can be cut on the bytes. No text is ever cut: a slice of a batch
holds whole texts, and a text longer than the slice size is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * _MIX_A
    h = (h ^ (h >> np.uint64(29))) * _MIX_B
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span. `data` has at least 8 bytes after the last span."""
    wide = np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=data, strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64) + _MIX_A)
    todo, at = np.arange(len(start)), start
    left = size
    while len(todo):
        part = wide[at] & _MASKS[np.minimum(left, 8)]
        if len(todo) == len(h):
            h = mix(h ^ part)
        else:
            h[todo] = mix(h[todo] ^ part)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


class Texts:
    """Some whole texts: bytes, text borders, words. Nulls are empty texts."""

    def __init__(self, data: np.ndarray, border: np.ndarray):
        self.border = border - border[0]
        size = int(self.border[-1])
        self.data = np.zeros(size + 16, np.uint8)
        self.data[:size] = data[border[0] : border[-1]]
        self.n = len(border) - 1
        self.size = size

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and end of all words, and the index of each text's first word (n + 1 values)."""
        inside = _IS_WORD[self.data[: self.size]]
        firsts, lasts = self.border[:-1], self.border[1:] - 1
        filled = lasts >= firsts
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[:1] = False
        before[firsts[filled]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[lasts[filled]] = False
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(start, self.border)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and end of all lines cut at \\n, and the index of each text's first line."""
        breaks = np.flatnonzero(self.data[: self.size] == 10)
        start = np.sort(np.concatenate([self.border[:-1], breaks + 1]), kind="stable")
        owner = np.searchsorted(breaks, self.border) + np.arange(self.n + 1)
        # a line ends before its break or with its text
        stop = np.sort(np.concatenate([self.border[1:], breaks]), kind="stable")
        return start, stop, owner

    def prefix(self, flags: np.ndarray) -> np.ndarray:
        """Running count of a flag per byte, starting with 0."""
        out = np.zeros(self.size + 1, np.int64)
        np.cumsum(flags[: self.size], out=out[1:])
        return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """`(first, past, texts)` for runs of whole texts of about `limit` bytes."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, content = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return
    border = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        past = int(np.searchsorted(border, border[first] + limit, side="right")) - 1
        past = min(max(past, first + 1), len(column))
        yield first, past, Texts(data, border[first : past + 1])
        first = past


def repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per value: whether it occurs again anywhere, and whether it occurred before."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = ranked[1:] == ranked[:-1]
    again, before = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[1:]] |= same
    before[order[1:]] = same
    again[order[:-1]] |= same
    return again, before


def occurrence(h: np.ndarray) -> np.ndarray:
    """How often each value occurred before, in the given order."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    head = np.ones(len(h), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    place = np.arange(len(h))
    out = np.empty(len(h), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(head, place, 0))
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values, given the index of each text's first value."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
