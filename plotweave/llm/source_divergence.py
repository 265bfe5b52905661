r"""Source divergence audit (operator 13): how the term frequencies of the sources of a language differ.

Each task sorts word-start pointers into the bytes of its Arrow batches (see `term_pointers`), slice by slice;
a run of equal terms yields its documents and its occurrences per language and source. The counts of a task's
slices are added up and leave it as one row per term, a list of counts by source, dealt by term. A term is kept by a language
in which at least `least` documents have it. No text is shuffled, and however frequent a term is, it is a few rows
per task.

With N the occurrences of kept terms in a group and V the kept terms of its language, a term with count c has
p = 1 + floor(10^9 (c + 5) / (N + 5 V)). The division is carried out in three steps by 1,000, so it is exact in
64 bits as long as N + 5 V is below 9 * 10^15. Sums of differences over all kept terms come from partial
sums: kept terms are dealt to shards of bounded size, in each a matrix of p by term and source gives the sums
per pair of sources, and these are added up. What is emitted grows with shards times pairs of sources, which is
the size of the result, never with terms times pairs.

Defined cases: null text, lang and source are ''; groups without any term take part (all counts 0); a language
that keeps no term has value 0 for each pair and no row of terms; repeated rows count each; texts of any length are
read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plotweave.llm.term_pointers import Terms, counted
from plotweave.llm.textarrays import slices
from plotweave.session import cut, parallelism, scratch_scope, settle, ship, small_batches

LEAST_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
SCALE = 1_000_000_000
# Bytes of text per sort, rows that a task gathers before it adds them up, documents per Arrow batch, and
# counts per shard.
SLICE = 4 << 20
GATHERED = 1 << 19
BATCH_ROWS = 2_000
SHARD_CELLS = 1 << 16
# Cells of the matrix of a shard that are worked on at once.
CELLS = 1 << 21
# Rows of a table per language and source that may be broadcast; beyond them a shuffle joins.
BROADCAST_ROWS = 100_000

_COUNTED = "lang string, term string, docs long, total long, of array<struct<source: string, n: long>>"
_ROWS = pa.schema([("group", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


class _Groups:
    """Numbers of the pairs of language and source that a task meets."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], int] = {}

    def numbers(self, lang: pa.Array, source: pa.Array) -> np.ndarray:
        langs, sources = lang.dictionary_encode(), source.dictionary_encode()
        wide = max(1, len(sources.dictionary))
        code = langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy()
        met, at = np.unique(code, return_inverse=True)
        pairs = [(langs.dictionary[int(c // wide)].as_py(), sources.dictionary[int(c % wide)].as_py()) for c in met]
        return np.array([self.known.setdefault(p, len(self.known)) for p in pairs], np.int64)[at]

    def listed(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """A row per language and term, with the counts of its sources as a list."""
        langs, sources = (pa.array([p[k] for p in self.known], pa.string()) for k in range(2))
        lang_codes = langs.dictionary_encode()
        group = rows["group"].to_numpy()
        lang = lang_codes.indices.to_numpy()[group].astype(np.int64)
        terms = rows["term"].combine_chunks().dictionary_encode()
        both = lang * max(1, len(terms.dictionary)) + terms.indices.to_numpy()
        order = np.argsort(both)
        both = both[order]
        border = np.r_[np.flatnonzero(np.r_[True, both[1:] != both[:-1]]), len(both)].astype(np.int32)
        n, docs = (rows[c].to_numpy()[order] for c in ("n", "docs"))
        cells = pa.StructArray.from_arrays([sources.take(pa.array(group[order])), pa.array(n)], ["source", "n"])
        head = border[:-1]
        out = pa.table({
            "lang": lang_codes.dictionary.take(pa.array(both[head] // max(1, len(terms.dictionary)))), "term": terms.dictionary.take(pa.array(both[head] % max(1, len(terms.dictionary)))),
            "docs": pa.array(np.add.reduceat(docs, head)), "total": pa.array(np.add.reduceat(n, head)), "of": pa.ListArray.from_arrays(pa.array(border), cells),
        })
        yield from out.to_batches(max_chunksize=1 << 14)


def _slice_counts(group: np.ndarray, text: pa.Array) -> Iterator[pa.Table]:
    for first, past, texts in slices(text, SLICE):
        known, own = np.unique(group[first:past], return_inverse=True)
        terms = Terms(texts)
        pointer, of, n, docs = counted(terms, own)
        yield pa.Table.from_arrays([pa.array(known[of], pa.int64()), terms.spelled(pointer), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_ROWS)


def _added(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(_ROWS.names)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups, gathered, rows = _Groups(), [], 0
    for batch in batches:
        lang, source, text = (pc.fill_null(batch.column(k), "") for k in range(3))
        for table in _slice_counts(groups.numbers(lang, source), text):
            gathered.append(table)
            rows += len(table)
            if rows > GATHERED:
                # goes on if adding up has made room, else hands on what there is
                gathered = [_added(gathered)]
                rows = len(gathered[0])
                if rows > GATHERED // 2:
                    yield from groups.listed(gathered[0])
                    gathered, rows = [], 0
    if rows:
        yield from groups.listed(_added(gathered))


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """`(lang, term, total, of)` of the terms that a language keeps; `of` holds `(source, n)`."""
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col("lang"), F.col("source"), F.col("text"))
    parts = read.mapInArrow(_count_terms, _COUNTED)
    # tasks have added up already, so a term is at most a few rows of each; everything else needs no further exchange
    dealt = parts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * parallelism(spark)), "lang", "term")
    own = Window.partitionBy("lang", "term")
    kept = dealt.withColumn("docs", F.sum("docs").over(own)).withColumn("total", F.sum("total").over(own)).filter(F.col("docs") >= least)
    cells = kept.select("lang", "term", "total", F.explode("of").alias("_of"))
    by_source = cells.groupBy("lang", "term", F.col("_of.source").alias("source")).agg(F.first("total").alias("total"), F.sum("_of.n").alias("n"))
    return by_source.groupBy("lang", "term").agg(F.first("total").alias("total"), F.collect_list(F.struct("source", "n")).alias("of"))


def source_groups(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per `(lang, source)` that occurs its `bottom` N + 5 V, and `(lang, lang_bottom, cells)` per language that
    keeps terms; `cells` counts pairs of a kept term and a source that has it."""
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    occurring = docs.select(text("lang"), text("source")).distinct()
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("n_lang"), F.sum(F.size("of")).alias("cells"))
    sums = terms.select("lang", F.explode("of").alias("_of")).groupBy("lang", F.col("_of.source").alias("source")).agg(F.sum("_of.n").alias("n_source"))
    kept = F.coalesce("terms", F.lit(0)) * SMOOTH
    groups = occurring.join(langs.select("lang", "terms"), "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", (F.coalesce("n_source", F.lit(0)) + kept).alias("bottom"))
    return groups, langs.select("lang", (F.col("n_lang") + SMOOTH * F.col("terms")).alias("lang_bottom"), "cells")


def _share(count: str, bottom: str) -> Column:
    """1 + floor(10^9 (count + 5) / bottom) in whole numbers, as a long division by thousands."""
    rest = f"({count} + {SMOOTH}L)"
    digits = f"({rest} div {bottom})"
    for _ in range(3):
        rest = f"(({rest} % {bottom}) * 1000L)"
        digits = f"({digits} * 1000L + {rest} div {bottom})"
    return F.expr(f"1L + {digits}")


def _shares(count: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """The same over arrays."""
    rest = count + SMOOTH
    out = rest // bottom
    for _ in range(3):
        rest = rest % bottom * 1000
        out = out * 1000 + rest // bottom
    return out + 1


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def top_terms(terms: DataFrame, groups: DataFrame, langs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The `top` kept terms that a source uses more than its language, by the difference of their shares."""
    cells = terms.select("lang", "term", "total", F.explode("of").alias("_of")).select("lang", "term", "total", "_of.source", "_of.n")
    known = cells.join(_sized(groups), ["lang", "source"]).join(_sized(langs), "lang")
    valued = known.select("lang", "source", F.col("term").alias("item"), (_share("n", "bottom") - _share("total", "lang_bottom")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _pair_sums(groups: pa.Table, terms: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms of a shard, for each pair of sources of its language."""
    # an order that is the same in every shard
    groups = groups.sort_by("source")
    names, n = groups["source"].combine_chunks(), len(groups)
    lang = groups["lang"][:1].to_pylist() or [""]
    total = np.zeros((n, n), np.int64)
    if len(terms) and n:
        bottom = groups["bottom"].to_numpy()
        none = _shares(np.zeros(n, np.int64), bottom)
        of = terms["of"].combine_chunks()
        cells = of.flatten()
        column = pc.index_in(cells.field("source"), value_set=names).to_numpy()
        shares = _shares(cells.field("n").to_numpy(), bottom[column])
        border = np.asarray(of.offsets) - of.offsets[0].as_py()
        row = np.repeat(np.arange(len(terms)), np.diff(border))
        step = max(1, CELLS // n)
        for first in range(0, len(terms), step):
            own = slice(border[first], border[min(first + step, len(terms))])
            p = np.tile(none, (min(step, len(terms) - first), 1))
            p[row[own] - first, column[own]] = shares[own]
            for k in range(n - 1):
                total[k, k + 1 :] += np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(axis=0)
    a, b = np.triu_indices(n, 1)
    return pa.table({"lang": pa.array(lang * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(total[a, b])})


def pair_divergence(terms: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """`(lang, source, item, value, rank)`: for each source all others of its language, the most unlike first."""
    shards = F.coalesce(F.ceil(F.col("cells") / SHARD_CELLS), F.lit(1)).cast("int")
    dealt = terms.join(_sized(langs.select("lang", shards.alias("_of_lang"))), "lang")
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("_of_lang")).cast("int").alias("shard"), "of")
    copied = groups.join(langs, "lang", "left").select("lang", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), "source", "bottom")
    parts = copied.groupBy("lang", "shard").cogroup(dealt.groupBy("lang", "shard")).applyInArrow(_pair_sums, "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rows = sums.select("lang", both.alias("_pair"), "value").select("lang", "_pair.source", "_pair.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of sources of a language, and the terms that set a source apart."""
    with scratch_scope(spark):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        with small_batches(spark, BATCH_ROWS):
            terms = cut(term_counts(docs), "terms")
        groups, langs = (cut(t, name) for t, name in zip(source_groups(docs, terms), ("groups", "langs")))
        pairs = pair_divergence(terms, groups, langs).withColumn("part", F.lit("pair"))
        words = top_terms(terms, groups, langs).withColumn("part", F.lit("term"))
        return settle(pairs.unionByName(words).select("lang", "source", "part", "item", "value", "rank"), "divergence")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT doc, lang, source, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT doc, lang, source, unnest(w) AS x FROM d)
), k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS terms, sum(total) AS n_lang FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, v.terms, v.n_lang,
    CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS HUGEINT) AS n_source
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (n_source + 5 * terms) AS p, 1 + 1000000000 * (total + 5) // (CAST(n_lang AS HUGEINT) + 5 * terms) AS q FROM m
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
"""
