"""Quality rules: boosted trees over document statistics (operator 2).

One pass over the bytes of each text gives its statistics; the trees are fitted on a bounded sample
of labelled documents and travel to the tasks as flat node arrays. Both passes are narrow: no text is
shuffled, and there is nothing that a hot source or a group of copies could unbalance.

Defined cases: a null text counts as an empty one (no words, so the base rule fails); rows without an
id are judged like any other; repeated rows are judged one by one; without any labels, or with one
label only, the trees are empty and the base rule alone decides; an empty table gives an empty result.
Only the columns named by the caller are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plotweave.llm.boosting import Forest, fit_forest
from plotweave.llm.memory import returns_memory
from plotweave.llm.sample import labelled_ids
from plotweave.llm.textarrays import Texts, mix, repeated, slices, span_hashes, sums
from plotweave.session import ship

# How many labelled documents the trees are fitted on at most.
MAX_FIT_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Feature and the direction in which it may move the chance of good quality (0: either).
FEATURES = {
    "log_words": 1,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": -1,
    "mark_share": -1,
    "other_share": 0,
    "words_per_line": 0,
    "unique_share": 1,
    "one_char_words": -1,
}

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LEAD = (np.arange(256) & 0xC0) != 0x80
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARK = np.isin(np.arange(256), list(b"!?\"'()[]{}=+_^~`@/\\;:"))
_OTHER = np.arange(256) >= 0xC0


def _per_text(t: Texts, flags: np.ndarray) -> np.ndarray:
    total = t.prefix(flags[t.data])
    return total[t.border[1:]] - total[t.border[:-1]]


def _owner(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def statistics(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts and the feature rows of some texts."""
    start, end, first = t.words()
    n_words = np.diff(first)
    lead = t.prefix(_LEAD[t.data])
    word_chars = sums(lead[end] - lead[start], first)
    n_symbols = _per_text(t, _SYMBOLS)

    # lines with a word that equal an earlier line of the same text
    l_start, l_end, l_first = t.lines()
    l_owner = _owner(l_first)
    filled = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    line = mix(span_hashes(t.data, l_start, l_end) + mix(l_owner.astype(np.uint64)))
    seen = np.zeros(len(line), bool)
    seen[filled] = repeated(line[filled])[1]
    n_dup_lines = sums(seen, l_first)

    # words in three-word windows that occur at least twice in the text
    word = span_hashes(t.data, start, end)
    w_owner = _owner(first)
    in_repeat = np.zeros(len(word), bool)
    if len(word) > 2:
        whole = w_owner[2:] == w_owner[:-2]
        at = np.flatnonzero(whole)
        window = mix(mix(mix(word[:-2][at]) + word[1:-1][at]) + word[2:][at])
        again = at[repeated(mix(window + mix(w_owner[at].astype(np.uint64))))[0]]
        for k in range(3):
            in_repeat[again + k] = True
    n_repeat = sums(in_repeat, first)
    fresh = ~repeated(mix(word + mix(w_owner.astype(np.uint64))))[1]

    base = dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)))
    chars = np.maximum(word_chars, 1)
    words = np.maximum(n_words, 1)
    lines = np.maximum(sums(filled, l_first), 1)
    x = np.stack(
        [
            np.log1p(n_words),
            word_chars / words,
            n_symbols / chars,
            n_dup_lines / lines,
            n_repeat / words,
            _per_text(t, _UPPER) / chars,
            _per_text(t, _DIGIT) / chars,
            _per_text(t, _MARK) / chars,
            _per_text(t, _OTHER) / chars,
            np.log1p(n_words / lines),
            sums(fresh, first) / words,
            sums((lead[end] - lead[start]) == 1, first) / words,
        ],
        axis=1,
    ).astype(float)
    return base, x


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Forest:
    """Trees for the chance that a document has label quality 1.

    Reads the texts of at most `max_rows` labelled ids; only their feature rows reach the driver.
    """
    ship(docs.sparkSession)
    ids = labelled_ids(labels, "quality", max_rows)
    texts = docs.select(F.col("doc_id"), F.col("text")).join(ids, "doc_id").select("doc_id", "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, past, t in slices(b.column(2)):
                x = statistics(t)[1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[first:past], b.column(1)[first:past], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"]
                )

    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("label", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    # an id may stand on very many rows: the one with the least values counts
    single = texts.mapInArrow(features, schema).groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("_row")).select("doc_id", "_row.x", "_row.label")
    rows = single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array([r["label"] for r in rows], float), list(FEATURES.values()))


def judge(docs: DataFrame, forest: Forest, columns: list[str], threshold: float = 0.5, only_kept: bool = False) -> DataFrame:
    """`columns` of `docs`, or with `only_kept` the same columns of the rows that pass.

    Otherwise the counts, `base_failed`, `quality` (the trees' chance) and `kept` are added.
    """
    ship(docs.sparkSession)
    read = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(columns)], F.col("text").alias("_text"))
    width = len(columns)

    @returns_memory
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, past, t in slices(b.column(width)):
                base, x = statistics(t)
                failed = base_failed(base)
                chance = forest.probability(x)
                kept = ~failed & (chance >= threshold)
                part = b.slice(first, past - first)
                if only_kept:
                    yield pa.RecordBatch.from_arrays(part.columns[:width], columns).filter(pa.array(kept))
                    continue
                more = [pa.array(base[c], pa.int64()) for c in BASE] + [pa.array(failed), pa.array(chance), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *more], [*columns, *BASE, "base_failed", "quality", "kept"])

    fields = [docs.schema[c] for c in columns]
    if not only_kept:
        fields += [T.StructField(c, T.LongType()) for c in BASE]
        fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return read.mapInArrow(score, T.StructType(fields))


def op2_quality_rules(spark, folder: str) -> DataFrame:
    """Verdicts for all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    forest = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return judge(docs, forest, ["doc_id"]).withColumn("quality", F.round("quality", 9))


def quality_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    forest = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return judge(docs, forest, docs.columns, only_kept=True)
