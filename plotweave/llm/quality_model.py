"""Quality classifier (operator 6): random-indexing word vectors, pooled per document, in a small network.

Every word has a sparse random index vector that follows from its hash, so no vocabulary is kept. The
vector of a word is the sum of the index vectors of the words around it (random indexing over a window),
learned on all documents into a table with one row per hash bin, plus its own
index vector and that of its shape (letters to a or A, digits to 0, other characters kept, runs
shortened), which lets words never seen before stand near words of their kind. A document is the mean of
its word vectors; a two-layer network, fitted in numpy, turns it into a probability, whose temperature is
set on rows kept out of the fit.

The vectors are sums over all texts, one row per bin and task; the network is fitted on at most
`MAX_FIT_ROWS` labelled ids; scoring is one narrow pass over all texts. There are as many bins as different words,
rounded up to a power of two, within `BINS`, so what is broadcast is bounded. Labels, language, source and id are
no inputs.

Defined cases: a null text is an empty one, whose mean is the zero vector, and is scored; a null id is
never held out; repeated rows are scored one by one; without labels of both kinds the score is the
share of label 1 (0.5 without any); an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plotweave.llm.sample import labelled_ids
from plotweave.llm.textarrays import Texts, mix, slices, span_hashes, sums
from plotweave.session import ship

# How many labelled documents the model is fitted on at most.
MAX_FIT_ROWS = 6_000
WIDTH = 64
# Least and most bins, as powers of two; bits of the sketch that counts different words.
BINS = (13, 14)
SKETCH = 18
WINDOW = 2
HIDDEN = 32

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")


def index_table(bins: int) -> np.ndarray:
    """Sparse random index vectors of all bins: eight entries of plus or minus one each."""
    random = np.random.default_rng(7)
    table = np.zeros((bins, WIDTH), np.float32)
    for _ in range(8):
        table[np.arange(bins), random.integers(0, WIDTH, bins)] += random.choice(np.float32([-1, 1]), bins)
    return table


def _bins(h: np.ndarray, bins: int) -> np.ndarray:
    return (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)


def bins_for(docs: DataFrame) -> int:
    """A power of two that follows the number of different words, by linear counting."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(1 << SKETCH, bool)
        for b in batches:
            for _, _, t in slices(b.column(0)):
                start, end, _ = t.words()
                met[(span_hashes(t.data, start, end) >> np.uint64(64 - SKETCH)).astype(np.int64)] = True
        part = np.packbits(met).view(np.int64)
        some = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(part[some])], ["at", "bits"])

    parts = docs.select(F.col("text")).mapInArrow(sketch, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    met = parts.agg(F.sum(F.bit_count("bits"))).first()[0] or 0
    words = -(1 << SKETCH) * np.log1p(-min(met, (1 << SKETCH) - 1) / (1 << SKETCH))
    return 1 << int(np.clip(np.ceil(np.log2(max(words, 1))), *BINS))


def bins_of(t: Texts, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash bins of all words and of their shapes, and the index of each text's first word."""
    start, end, first = t.words()
    words = _bins(span_hashes(t.data, start, end), bins)
    shape = _SHAPE[t.data[: t.size]]
    # the first byte of each run of equal shape bytes stays, so a run counts once
    head = np.ones(t.size, bool)
    head[1:] = shape[1:] != shape[:-1]
    head[start] = True
    packed = np.concatenate([shape[head], np.zeros(16, np.uint8)])
    at = t.prefix(head)
    return words, _bins(mix(span_hashes(packed, at[start], at[end])), bins), first


def _around(out: np.ndarray, words: np.ndarray, first: np.ndarray, index: np.ndarray) -> None:
    """Add the index vectors in the window of each word to the row of its bin."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bins = len(index)
    for gap in range(1, WINDOW + 1):
        together = np.flatnonzero(owner[gap:] == owner[:-gap])
        pairs, n = np.unique(words[together] * bins + words[together + gap], return_counts=True)
        a, b = pairs // bins, pairs % bins
        for part in np.array_split(np.arange(len(pairs)), len(pairs) // 100_000 + 1):
            weight = n[part, None].astype(np.float32)
            _add_rows(out, a[part], weight * index[b[part]])
            _add_rows(out, b[part], weight * index[a[part]])


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    if len(at):
        order = np.argsort(at, kind="stable")
        head = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][head]] += np.add.reduceat(rows[order], head, axis=0)


def pooled(t: Texts, table: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Mean vector of each text: two blocks, words and shapes, of `WIDTH` values each."""
    bins = len(table)
    words, kinds, first = bins_of(t, bins)
    n = np.maximum(np.diff(first), 1)[:, None]
    out = np.zeros((t.n, 2 * WIDTH), np.float32)
    some = np.flatnonzero(np.diff(first))
    for lo in range(0, len(some), 256):
        part = some[lo : lo + 256]
        a, b = first[part[0]], first[part[-1] + 1]
        owner = np.repeat(np.arange(len(part)), np.diff(first)[part])
        # texts are short against the bins: counts of the bins that occur, times their vectors
        for block, (found, vectors) in enumerate(((words, table), (kinds, shapes))):
            keys, count = np.unique(owner * bins + found[a:b], return_counts=True)
            rows = vectors[keys % bins] * count[:, None].astype(np.float32)
            head = np.flatnonzero(np.diff(keys // bins, prepend=-1))
            out[part, block * WIDTH : (block + 1) * WIDTH] = np.add.reduceat(rows, head, axis=0)
    return out / n


@dataclass
class Model:
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        w1, b1, w2, b2 = self.layers
        return np.maximum(z @ w1 + b1, 0) @ w2 + b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 5e-3, decay: float = 1e-3) -> list[np.ndarray]:
    """Two layers by Adam on small batches; both labels weigh the same in sum."""
    random = np.random.default_rng(11)
    layers = [random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(random.permutation(len(x)), max(1, len(x) // 128)):
            w1, b1, w2, b2 = layers
            hidden = np.maximum(x[rows] @ w1 + b1, 0)
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, w2) * (hidden > 0)
            slopes = [x[rows].T @ back + decay * w1, back.sum(0), hidden.T @ error + decay * w2, np.array([error.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on rows that the network was not fitted on."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """The model, from at most `max_rows` labelled ids that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    ids = labelled_ids(labels, "quality", max_rows, ~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id"), F.col("text")).join(ids, "doc_id").select("doc_id", "label", "text")
    bins = bins_for(docs)
    index = index_table(bins)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros((bins, WIDTH), np.float64), index_table(bins)
        for b in batches:
            for _, _, t in slices(b.column(0)):
                words, _, first = bins_of(t, bins)
                _around(total, words, first, own)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(total[some, k]) for k in range(WIDTH)]], ["bin", *[f"v{k}" for k in range(WIDTH)]])

    kinds = T.StructType([T.StructField("bin", T.IntegerType()), *[T.StructField(f"v{k}", T.DoubleType()) for k in range(WIDTH)]])
    # one row per bin at most, all values whole numbers: the sums agree in any order
    rows = docs.select(F.col("text")).mapInArrow(learn, kinds).groupBy("bin").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(WIDTH)]).collect()
    table = np.zeros((bins, WIDTH), np.float32)
    if rows:
        got = np.array([list(r) for r in rows], float)
        table[got[:, 0].astype(int)] = got[:, 1:]
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    table = (table + index / np.sqrt(8)).astype(np.float32)

    sent = spark.sparkContext.broadcast(table)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index_table(bins)
        for b in batches:
            for first, past, t in slices(b.column(2)):
                x = pooled(t, sent.value, own)
                yield pa.RecordBatch.from_arrays([b.column(0)[first:past], b.column(1)[first:past], pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    kinds = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("label", T.DoubleType()), T.StructField("x", T.ArrayType(T.FloatType()))])
    # an id may stand on very many rows: the one with the least values counts
    single = texts.mapInArrow(pool, kinds).groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("_row")).select("doc_id", "_row.x", "_row.label")
    got = single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, 2 * WIDTH)
    y = np.array([r["label"] for r in got], float)
    flat = [np.zeros((2 * WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(2 * WIDTH), np.ones(2 * WIDTH))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        flat[3][:] = np.log(share / (1 - share))
        return Model(table, mean, scale, flat, 1.0)
    z = (x - mean) / scale
    kept_back = np.arange(len(y)) % 5 == 4
    if len(set(y[kept_back])) < 2 or len(set(y[~kept_back])) < 2:
        kept_back = np.zeros(len(y), bool)
    layers = _train(z[~kept_back], y[~kept_back])
    model = Model(table, mean, scale, layers, 1.0)
    check = kept_back if kept_back.any() else ~kept_back
    model.temperature = _temperature(model.logits(x[check]), y[check])
    return model


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """`columns` of `docs` and the `score` that label 1 fits."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    read = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(columns)], F.col("text").alias("_text"))
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        index = index_table(len(own.table))
        for b in batches:
            for first, past, t in slices(b.column(width)):
                part = b.slice(first, past - first)
                chance = own.probability(pooled(t, own.table, index))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(chance.astype(float))], [*columns, "score"])

    return read.mapInArrow(run, T.StructType([*[docs.schema[c] for c in columns], T.StructField("score", T.DoubleType())]))


def op6_quality_model(spark, folder: str) -> DataFrame:
    """Quality of all documents by a model that never saw the held-out third of the labels."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = score(docs, model, ["doc_id"]).withColumn("score", F.round("score", 6))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
