"""LM scoring (operator 3): stupid backoff from n-gram counts of the whole corpus.

A document's score is the mean over its words of log10 S(w | word before), where

    S = c(u w) / c(u)          if the pair occurs in another document,
        0.4 c(w) / N           else, if the word does,
        0.4 * 0.4 / (N + 1)    else.

All counts leave out the scored document itself, else every pair of a text would vouch for itself; N is
the words of all other documents. The first word of a text starts at the word level.

Counts are joined as tables of packed n-grams, not one row each. A map task takes its texts in parts of
some megabytes; a part's different n-grams with their counts are the rows of a small table that is cut
by hash into buckets, one message per part and bucket. A bucket adds up the counts of the equal n-grams
in its messages and answers each message with the totals, in the message's order. Answers meet the words
of their part (as places in a list of word hashes) by part, and the part's documents are scored. So a
frequent n-gram costs one entry per part, never one per occurrence: no key is hot, a task holds one
bucket or one part at a time, and there are as many buckets as the corpus needs.

The parts are made twice from the same scan, once for the messages and once for their words. `docs` must
therefore be a table scan, as in all queries here; answers carry a checksum of the n-grams they are for,
and a job whose rows changed between the passes fails instead of giving wrong scores.

Defined cases: a null or empty text has no words and a null score; rows without an id are scored like
any other; repeated rows are documents of their own (so copies vouch for one another); a corpus of one
document is scored on the floor; an empty table gives an empty result. Only the two columns are read.
Pairs and words are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plotweave.llm.textarrays import Texts, mix, slices, span_hashes
from plotweave.session import ship

BACKOFF = 0.4
WORD = r"[^\x20\x09-\x0D]+"
SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("score", pa.float64())])
# Bytes of text per part, and per bucket.
PART_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20

_MESSAGES = "part long, bucket long, data binary"
_U = np.uint64


def _counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different n-grams in order, and for each (n-gram, document) its count there."""
    order = np.lexsort((doc, h)) if len(h) else np.zeros(0, np.int64)
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    pair_h, pair_doc = h[at], doc[at]
    head = np.ones(len(pair_h), bool)
    head[1:] = pair_h[1:] != pair_h[:-1]
    return pair_h[head], np.cumsum(head) - 1, pair_doc, count


def _pack(values: np.ndarray) -> bytes:
    """Rising 64-bit values as differences, in the fewest whole bytes each."""
    steps = np.diff(values, prepend=_U(0))
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([wide]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, wide)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :wide] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on: the bytes that the largest needs, byte by byte, compressed."""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()
    packed = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
    return len(planes).to_bytes(8, "little") + bytes([wide]) + packed


def _from_small(data: bytes) -> np.ndarray:
    size, wide = int.from_bytes(data[:8], "little"), data[8]
    planes = pa.decompress(data[9:], size, codec="zstd", asbytes=True) if size else b""
    raw = np.frombuffer(planes, np.uint8).reshape(wide, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :wide] = raw.T
    return out.view("<i8").ravel()


def _join(*parts: bytes) -> bytes:
    sizes = np.array([len(p) for p in parts], "<u8").tobytes()
    return bytes([len(parts)]) + sizes + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    n = data[0]
    sizes = np.frombuffer(data, "<u8", n, 1).astype(np.int64)
    past = 1 + 8 * n + np.cumsum(sizes)
    return [data[p - s : p] for p, s in zip(past.tolist(), sizes.tolist())]


class _Part:
    """Texts of one part: the ids, the words of each text, and the word hashes in order."""

    def __init__(self):
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, ids: list, t: Texts) -> None:
        start, end, first = t.words()
        self.hashes.append(span_hashes(t.data, start, end) & ~_U(1))
        self.sizes.append(np.diff(first))
        self.ids += ids
        self.bytes += t.size


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Part]]:
    """Parts of a task's rows `(doc_id, text)` with their numbers."""
    # a task makes fewer parts than this by far
    number = TaskContext.get().partitionId() << 24
    part = _Part()
    for b in batches:
        ids = b.column(0).to_pylist()
        for first, past, t in slices(b.column(1)):
            part.add(ids[first:past], t)
            if part.bytes >= PART_BYTES:
                yield number, part
                number, part = number + 1, _Part()
    if part.ids:
        yield number, part


class _Grams:
    """N-grams of a part: words are even hashes, pairs odd ones, in one table."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.zeros(len(words), bool)
        inner[1:] = self.doc[1:] == self.doc[:-1]
        self.inner = np.flatnonzero(inner)
        self.pairs = mix(mix(words[self.inner - 1]) + words[self.inner]) | _U(1)
        grams = np.concatenate([words, self.pairs])
        self.known, self.at, self.owner, self.count = _counted(grams, np.concatenate([self.doc, self.doc[self.inner]]))

    def edges(self, buckets: int) -> list[int]:
        """Where each bucket's n-grams begin."""
        bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
        return [0, *np.searchsorted(self.known, bounds).tolist(), len(self.known)]


def _messages(part: _Part, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The part's n-grams and counts, per bucket."""
    grams = _Grams(np.concatenate(part.hashes), np.concatenate(part.sizes))
    total = np.bincount(grams.at, grams.count, len(grams.known)).astype(np.int64)
    edge = grams.edges(buckets)
    for bucket, (lo, hi) in enumerate(zip(edge, edge[1:])):
        if hi > lo:
            yield bucket, _join(_pack(grams.known[lo:hi]), _small(total[lo:hi]))


def _words(part: _Part) -> bytes:
    """The part's ids and words: places in a list of hashes, frequent words first."""
    known, place, count = np.unique(np.concatenate(part.hashes), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = pa.array(part.ids, pa.int64())
    return _join(
        _small(np.concatenate(part.sizes)), known[order].tobytes(), _small(rank[place]),
        _small(np.array([i is None for i in part.ids], np.int64)), ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
    )


def _answer(messages: list[bytes]) -> list[bytes]:
    """Totals of a bucket for each of its messages, in the message's order."""
    tables = [(_unpack(a), _from_small(b)) for a, b in map(_split, messages)]
    known, where = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
    total = np.bincount(where, np.concatenate([t[1] for t in tables]), len(known)).astype(np.int64)
    out, at = [], 0
    for grams, _ in tables:
        own = total[where[at : at + len(grams)]]
        at += len(grams)
        out.append(_join(_small(own), _small(np.array([zlib.crc32(grams.tobytes())]))))
    return out


def _scores(kept: bytes, answers: dict[int, bytes], words: int, buckets: int) -> pa.RecordBatch:
    """Scores of a part's documents."""
    sizes, hashes, rank, nulls, ids = _split(kept)
    n_words = _from_small(sizes)
    grams = _Grams(np.frombuffer(hashes, np.uint64)[_from_small(rank)], n_words)
    total = np.zeros(len(grams.known), np.int64)
    edge = grams.edges(buckets)
    for bucket, (lo, hi) in enumerate(zip(edge, edge[1:])):
        if hi > lo:
            if bucket not in answers:
                raise RuntimeError("a bucket did not answer")
            totals, check = map(_from_small, _split(answers[bucket]))
            if check[0] != zlib.crc32(grams.known[lo:hi].tobytes()):
                raise RuntimeError("the rows of a part changed between passes: score a table scan")
            total[lo:hi] = totals
    # entries are in order of (n-gram, document), so a document's own count is found by search
    width = len(n_words) + 1
    own = grams.at * width + grams.owner

    def others(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        at = np.searchsorted(grams.known, h)
        return total[at] - grams.count[np.searchsorted(own, at * width + doc)]

    doc = grams.doc
    single = others(grams.words, doc)
    both, base = np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64)
    both[grams.inner] = others(grams.pairs, doc[grams.inner])
    base[grams.inner] = single[grams.inner - 1]
    rest = words - n_words[doc]
    value = np.where(
        both > 0, both / np.maximum(base, 1),
        np.where(single > 0, BACKOFF * single / np.maximum(rest, 1), BACKOFF * BACKOFF / (rest + 1)),
    )
    mean = np.bincount(doc, np.log10(value), len(n_words)) / np.maximum(n_words, 1)
    backed = np.bincount(doc, both == 0, len(n_words)).astype(np.int64)
    doc_ids = pa.array(np.frombuffer(ids, "<i8"), mask=_from_small(nulls).astype(bool))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n_words), pa.array(backed), pa.array(mean, mask=n_words == 0)], ["doc_id", "n_words", "n_backoff", "score"])


def score_documents(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_words, n_backoff, score)` of every document; `n_backoff` words had no pair elsewhere."""
    spark = docs.sparkSession
    ship(spark)
    # one scan for the bytes, which set the buckets, and for N
    whole = docs.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(WORD)).cast("long"))).first()
    size, words = whole[0] or 0, whole[1] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in _parts(batches):
            for bucket, data in _messages(part, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([bucket]), pa.array([data], pa.binary())], ["part", "bucket", "data"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_words(part)], pa.binary())], ["part", "data"])

    def answer(table: pa.Table) -> pa.Table:
        return table.set_column(2, "data", pa.array(_answer(table["data"].to_pylist()), pa.binary()))

    def finish(answers: pa.Table, kept: pa.Table) -> pa.Table:
        got = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist()))
        return pa.Table.from_batches([_scores(d, got, words, buckets) for d in kept["data"].to_pylist()], SCORED)

    answered = rows.mapInArrow(count, _MESSAGES).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, _MESSAGES)
    kept = rows.mapInArrow(keep, "part long, data binary")
    by_part = answered.repartition(buckets, "part").groupBy("part").cogroup(kept.repartition(buckets, "part").groupBy("part"))
    return by_part.applyInArrow(finish, "doc_id long, n_words long, n_backoff long, score double")


def op3_ngram_score(spark, folder: str) -> DataFrame:
    """Scores of all documents by the counts of all documents."""
    scored = score_documents(spark.read.parquet(f"{folder}/documents.parquet"))
    return scored.withColumn("score", F.round("score", 6))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS doc, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, doc, len(w) AS n, w[k] AS v, CASE WHEN k > 1 THEN w[k - 1] END AS u FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM d)),
n1 AS (SELECT doc, v, count(*) AS own, sum(count(*)) OVER (PARTITION BY v) AS c FROM g GROUP BY doc, v),
n2 AS (SELECT doc, u, v, count(*) AS own, sum(count(*)) OVER (PARTITION BY u, v) AS c FROM g WHERE u IS NOT NULL GROUP BY doc, u, v),
t AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT g.doc, coalesce(n2.c - n2.own, 0) AS both_c, u.c - u.own AS u_c, v.c - v.own AS v_c, (SELECT n FROM t) - g.n AS rest
  FROM g JOIN n1 v ON v.doc = g.doc AND v.v = g.v LEFT JOIN n1 u ON u.doc = g.doc AND u.v = g.u
  LEFT JOIN n2 ON n2.doc = g.doc AND n2.u = g.u AND n2.v = g.v
), m AS (
  SELECT doc, count(*) AS n, sum(CASE WHEN both_c > 0 THEN 0 ELSE 1 END) AS b,
    sum(log10(CASE WHEN both_c > 0 THEN both_c / u_c WHEN v_c > 0 THEN 0.4e0 * v_c / rest ELSE 0.4e0 * 0.4e0 / (rest + 1) END)) AS x
  FROM s GROUP BY doc
)
SELECT doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(b, 0) AS BIGINT) AS n_backoff, round(x / n, 6) AS score
FROM d LEFT JOIN m USING (doc)
"""
