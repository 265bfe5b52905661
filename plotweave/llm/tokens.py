"""Ids of whole texts by a byte-level tokenizer of the tokenizers library.

The tokenizer cuts a text into pieces before it merges, and never merges across pieces. A cut always
lies before a single space that a non-space follows, so a text can be taken apart there and each
different piece is encoded by the library once per task. A text with doubled spaces is cut by a pattern,
and a text that holds the spelling of a special id goes to the library whole: both give the same ids.

`encode` looks pieces up one by one and suits few or short texts. `encode_column` takes an Arrow column of many:
Arrow splits it at the spaces and finds the words among those known; only new words, the first word of a text and the
odd texts of above pass through Python. New words are cut once more, behind a letter that no letter follows, where
no piece of the tokenizer's pattern goes on.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?= \S)")
_INNER_CUT = re.compile(r"(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])(?=[\x00-@\[-`{-\x7f])|(?= )")
_UNSAFE = re.compile(r" \s| \Z")
# Bound of the memory for pieces, per task.
MAX_PIECES = 200_000
# Where columns are encoded: all pieces, of which words take some 50 bytes each, and those that Python looks up.
MAX_WORDS, MAX_PARTS = 700_000, 300_000
# Words whose ids are put together at a time.
_GATHERED = 1 << 18


_coders: dict = {}


def encoder(path: str, specials_as_text: bool = False) -> "Encoder":
    """The encoder of this worker process: tasks that run in it one after another share what it knows."""
    key = (path, specials_as_text)
    if key not in _coders:
        _coders[key] = Encoder(path, specials_as_text)
    return _coders[key]


class Encoder:
    """Encodes and decodes lists of texts. `specials_as_text` spells special strings as plain text."""

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = specials_as_text
        self.size = self._library.get_vocab_size(with_added_tokens=True)
        added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._specials = [] if specials_as_text else added
        # bytes that each id stands for; the vocabulary spells every byte as one character
        self._bytes = np.zeros(self.size, np.int64)
        for token, k in self._library.get_vocab(with_added_tokens=False).items():
            self._bytes[k] = len(token)
        self._known: dict[str, int] = {}
        # words of columns and their piece numbers; a word that no cut may precede has -1
        self._words, self._word_piece = pa.array([], pa.string()), np.zeros(0, np.int32)
        self._forget()

    def _forget(self) -> None:
        """Keep the pieces that came more than once since the last time, at most half of the room."""
        kept: dict[str, int] = {}
        n = 0
        ids, border = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        if self._known or len(self._words):
            often = np.flatnonzero(self._used[: self._n] > 1)
            room = (MAX_WORDS if len(self._words) else MAX_PIECES) // 2
            often = np.sort(often[np.argsort(-self._used[often], kind="stable")[:room]])
            size = np.diff(self._border[: self._n + 1])[often]
            past = np.cumsum(size)
            place = np.arange(past[-1] if len(past) else 0) - np.repeat(past - size, size) + np.repeat(self._border[often], size)
            ids = np.concatenate([self._ids[place], ids])
            border = np.concatenate([[0], past, np.zeros(1 << 14, np.int64)])
            number = np.full(self._n, -1)
            number[often] = np.arange(len(often))
            kept = {p: int(number[k]) for p, k in self._known.items() if number[k] >= 0}
            stay = np.flatnonzero((self._word_piece >= 0) & (number[self._word_piece] >= 0))
            self._words, self._word_piece = self._words.take(pa.array(stay)), number[self._word_piece[stay]].astype(np.int32)
            n = len(often)
        self._known, self._ids, self._border, self._n = kept, ids, border, n
        self._used = np.zeros(len(border), np.int64)

    def _add(self, pieces: int, ids: np.ndarray, past: np.ndarray) -> None:
        """Append pieces whose ids stand one behind another; `past` is where each piece's ids end."""
        start = int(self._border[self._n])
        while start + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self._n + pieces + 1 > len(self._border):
            self._border = np.concatenate([self._border, np.zeros_like(self._border)])
            self._used = np.concatenate([self._used, np.zeros_like(self._used)])
        self._ids[start : start + len(ids)] = ids
        self._border[self._n + 1 : self._n + 1 + pieces] = start + past
        self._n += pieces

    def _learn(self, pieces: list[str], of_words: bool) -> None:
        """Encode pieces not seen before. Those that begin with a space and a non-space are written one
        behind another, encoded in one text, and told apart by the bytes that their ids stand for. Parts of words
        that begin with a space are known to be of that kind."""
        if of_words:
            alone, joined = [p for p in pieces if p[0] != " "], [p for p in pieces if p[0] == " "]
        else:
            alone, joined = [], []
            for p in pieces:
                safe = p[0] == " " and " " not in p[1:] and not p[1:2].isspace() and not any(x in p for x in self._specials)
                (joined if safe else alone).append(p)
        self._known.update(zip(alone + joined, range(self._n, self._n + len(pieces))))
        for lo in range(0, len(alone), 4096):
            lists = [e.ids for e in self._library.encode_batch_fast(alone[lo : lo + 4096], add_special_tokens=False)]
            past = np.cumsum([len(ids) for ids in lists])
            self._add(len(lists), np.fromiter(chain.from_iterable(lists), np.uint32, past[-1]), past)
        for lo in range(0, len(joined), 4096):
            part = joined[lo : lo + 4096]
            ids = np.array(self._library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            length = np.cumsum(self._bytes[ids])
            wanted = np.cumsum(list(map(len, map(str.encode, part))))
            past = np.searchsorted(length, wanted) + 1
            if not np.array_equal(length[past - 1], wanted):
                raise RuntimeError("a piece was merged across its border")
            self._add(len(part), ids, past)

    def _pieces(self, text: str) -> list[str]:
        if any(x in text for x in self._specials):
            return [text]
        if _UNSAFE.search(text):
            return [p for p in _CUT.split(text) if p]
        head, *rest = text.split(" ")
        return [head, *[" " + p for p in rest]] if head else [" " + p for p in rest]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the index of each text's first id (one more than texts)."""
        if self._n > MAX_PIECES:
            self._forget()
        cut = [self._pieces(t) if t else [] for t in texts]
        which = self._look_up([p for pieces in cut for p in pieces])
        self._used[: self._n] += np.bincount(which, minlength=self._n)
        start, size = self._border[which], self._border[which + 1] - self._border[which]
        past = np.cumsum(size)
        place = np.arange(past[-1] if len(past) else 0) - np.repeat(past - size, size) + np.repeat(start, size)
        pieces = np.cumsum([0, *map(len, cut)])
        return self._ids[place], np.concatenate([[0], past])[pieces]

    def _look_up(self, pieces: list[str], of_words: bool = False) -> np.ndarray:
        known = self._known
        fresh = dict.fromkeys(p for p in pieces if p not in known)
        if fresh:
            self._learn(list(fresh), of_words)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same as `encode`, for an Arrow column of strings; a null is an empty text."""
        if self._n > MAX_WORDS or len(self._known) > MAX_PARTS:
            self._forget()
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        border = split.offsets.to_numpy().astype(np.int64)
        words, heads = split.flatten(), border[:-1]
        odd = np.zeros(len(texts), bool)
        for special in self._specials:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        inner = np.ones(len(words), bool)
        inner[heads] = False
        inner[np.repeat(odd, np.diff(border))] = False
        which = self._word_pieces(words, inner)
        # an empty word, or one that begins with a space of another kind, stands behind a space that is no cut
        at = np.flatnonzero((which < 0) & inner)
        odd[np.searchsorted(border, at, side="right") - 1] = True
        plain = np.flatnonzero(~odd)
        first = words.take(pa.array(heads[plain])).to_pylist()
        named = [k for k, word in enumerate(first) if word]
        which[heads[plain]] = -1
        which[heads[plain[named]]] = self._look_up([first[k] for k in named])
        if odd.any():
            cut = {k: self._pieces(texts[k].as_py()) for k in np.flatnonzero(odd).tolist()}
            numbers = {k: self._look_up(pieces) for k, pieces in cut.items()}
            parts = [numbers[k] if odd[k] else which[border[k] : border[k + 1]] for k in range(len(texts))]
            which, border = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        self._used[: self._n] += np.bincount(which[which >= 0], minlength=self._n)
        return self._gather(which, border)

    def _word_pieces(self, words: pa.Array, inner: np.ndarray) -> np.ndarray:
        """Piece numbers of words behind a space, new ones learned where `inner` says so; -1 for those that have none."""
        place = pc.index_in(words, value_set=self._words).fill_null(-1).to_numpy()
        new = np.flatnonzero((place < 0) & inner)
        which = np.where(place >= 0, self._word_piece.take(place, mode="clip"), np.int32(-1)) if len(self._words) else np.full(len(words), -1, np.int32)
        if len(new):
            own = words.take(pa.array(new)).dictionary_encode()
            fresh = own.dictionary
            spelled = fresh.to_pylist()
            number = np.full(len(spelled), -1, np.int32)
            cuts = [k for k, word in enumerate(spelled) if word and not word[0].isspace()]
            parts = [p for p in _INNER_CUT.split("".join([" " + spelled[k] for k in cuts])) if p]
            numbers = self._look_up(parts, of_words=True)
            self._used[: self._n] += np.bincount(numbers, minlength=self._n)
            heads = np.flatnonzero([p[0] == " " for p in parts])
            ids, past = self._gather(numbers, np.append(heads, len(parts)))
            number[cuts] = np.arange(self._n, self._n + len(cuts))
            self._add(len(cuts), ids, past[1:])
            self._words = pa.concat_arrays([self._words, fresh])
            self._word_piece = np.concatenate([self._word_piece, number])
            which[new] = number[own.indices.to_numpy()]
        return which

    def _gather(self, which: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one behind another (none for -1), and those borders counted in ids."""
        size = np.append(np.diff(self._border[: self._n + 1]), 0).astype(np.int32)[which]
        past = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ids = np.empty(past[-1], np.uint32)
        for lo in range(0, len(which), _GATHERED):
            hi = min(lo + _GATHERED, len(which))
            place = np.repeat(self._border[which[lo:hi]] - past[lo:hi], size[lo:hi]) + np.arange(past[lo], past[hi])
            ids[past[lo] : past[hi]] = self._ids.take(place)
        return ids, past[border]

    def decode(self, lists) -> list[str]:
        return self._library.decode_batch([list(map(int, ids)) for ids in lists], skip_special_tokens=False)
