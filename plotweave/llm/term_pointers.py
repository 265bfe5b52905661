"""Terms of whole texts as sorted pointers into the bytes of an Arrow column.

A term is a maximal run of ASCII letters and of anything beyond ASCII; A to Z count as a to z. In UTF-8 all bytes
of such a run are letters or at least 0x80, so terms are found and compared as bytes. Pointers to their starts are
sorted by multikey quicksort with eight bytes as one character: all pointers are sorted by the first
eight bytes of their terms, and runs that are equal so far and go on are sorted by the next eight. The byte
order of UTF-8 is the order of code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plotweave.llm.textarrays import Texts

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_TERM = np.zeros(256, bool)
_IS_TERM[97:123] = True
_IS_TERM[128:] = True
# keeps the first n bytes of eight read as a big-endian number
_HEADS = np.array([0] + [(2**64 - 1) ^ ((1 << (64 - 8 * n)) - 1) for n in range(1, 9)], np.uint64)


class Terms:
    """The term pointers of some whole texts: byte start and end of each, and the text it is in."""

    def __init__(self, texts: Texts):
        self.data = _LOWER[texts.data]
        inside = _IS_TERM[self.data[: texts.size]]
        edge = np.zeros(texts.size + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0] = edge[-1] = True
        # a border between two texts ends a term as well
        edge[texts.border] = True
        cuts = np.flatnonzero(edge)
        letters = inside[cuts[:-1]] if texts.size else np.zeros(0, bool)
        self.start, self.end = cuts[:-1][letters], cuts[1:][letters]
        self.text = np.searchsorted(texts.border, self.start, side="right") - 1

    def _character(self, pointers: np.ndarray, depth: int) -> np.ndarray:
        """Bytes `8 depth` to `8 depth + 8` of terms as numbers in byte order, zero behind the end."""
        wide = np.ndarray((len(self.data) - 7,), np.dtype(">u8"), buffer=self.data, strides=(1,))
        at = self.start[pointers] + 8 * depth
        left = np.clip(self.end[pointers] - at, 0, 8)
        return wide[np.minimum(at, len(wide) - 1)].astype(np.uint64) & _HEADS[left]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pointers in the order of their terms, and for each the number of its run of equal terms."""
        n = len(self.start)
        order = np.arange(n)
        if n == 0:
            return order, order
        key = self._character(order, 0)
        order = np.argsort(key)
        key = key[order]
        heads = np.ones(n, bool)
        heads[1:] = key[1:] != key[:-1]
        todo, depth = np.arange(n), 1
        while True:
            # places whose run is equal so far, has company, and whose terms go on
            run = np.cumsum(heads)[todo]
            goes_on = (key & np.uint64(255)) != 0
            company = np.zeros(len(todo), bool)
            same = run[1:] == run[:-1]
            company[1:] |= same
            company[:-1] |= same
            chosen = goes_on & company
            todo, run = todo[chosen], run[chosen]
            if len(todo) == 0:
                return order, np.cumsum(heads) - 1
            key = self._character(order[todo], depth)
            inner = np.lexsort((key, run))
            order[todo] = order[todo][inner]
            key = key[inner]
            fresh = np.zeros(len(todo), bool)
            fresh[1:] = (key[1:] != key[:-1]) & (run[1:] == run[:-1])
            heads[todo] |= fresh
            depth += 1

    def spelled(self, pointers: np.ndarray) -> pa.Array:
        """The terms at some pointers as an Arrow column."""
        start, size = self.start[pointers], (self.end - self.start)[pointers]
        offsets = np.zeros(len(pointers) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(len(pointers), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[at])))


def counted(terms: Terms, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of equal terms and group of texts: a pointer, the group, occurrences and texts with the term.

    `group` numbers the group of each text.
    """
    order, run = terms.runs()
    if len(order) == 0:
        return order, order, order, order
    first = order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])]
    # texts renumbered so that those of a group stand together
    by_group = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)
    place[by_group] = np.arange(len(group))
    seen = np.sort(run * len(group) + place[terms.text[order]])
    new_text = np.r_[True, seen[1:] != seen[:-1]]
    heads = seen[new_text]
    run_of, group_of = heads // len(group), group[by_group][heads % len(group)]
    new = np.r_[True, (run_of[1:] != run_of[:-1]) | (group_of[1:] != group_of[:-1])]
    borders = np.r_[np.flatnonzero(new_text)[new], len(seen)]
    texts = np.diff(np.r_[np.flatnonzero(new), len(heads)])
    return first[run_of[new]], group_of[new], np.diff(borders), texts
