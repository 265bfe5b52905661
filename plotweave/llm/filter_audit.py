r"""How filters interact (operator 12): what each removes after any set of others, from one id table per filter.

Each filter stores the ids of the rows that it fails. For any set of filters applied before, the survivors are
the rows left-anti-joined with the tables of that set, and what a further filter removes are the rows left-semi-joined
with its table, left-anti-joined with those of the set. The set of filters applied, not their order,
decides, so n filters need 2^n sets of survivors and n 2^(n-1) sets of removals; all orders follow by looking
these up.

All sets go through the same joins: a row is repeated once per set that is asked of it, and the anti-join with
a filter's table holds only for the repeats whose set has the filter. The rows are dealt by row number before
they are repeated, and every join is on that number, so the repeats are never shuffled and nothing can be
uneven. What leaves the joins is a few sums per part.

Defined cases of op12: a null text is empty; a null lang is the part ''; a row with a null id has no labels and fails
E if a row with an id has the same text; rows equal in id and text do not fail E by each other; an id with several
labels counts as good (toxic) if one of them says so; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotweave.llm.hot import join_groups
from plotweave.session import cut, parallelism, scratch_scope, settle

WORD = r"[^\x20\x09-\x0D]+"
# Rows per partition before they are repeated.
PART_ROWS = 1 << 19


def _bit(k: int) -> Column:
    return F.lit(1 << k)


def prefix_counts(rows: DataFrame, failing: Mapping[str, DataFrame], n_rows: int) -> DataFrame:
    """`(part, set, next, n, good, toxic)` of `rows` `(_row, part, good, toxic)` and a table of `_row` per filter.

    `set` holds a bit per filter applied. With `next` 0 the survivors are counted, else (one bit) the rows
    that this filter removes from them.
    """
    spark, names = rows.sparkSession, list(failing)
    asked = rows.withColumn("next", F.lit(0))
    for k, name in enumerate(names):
        asked = asked.unionByName(rows.join(failing[name], "_row", "left_semi").withColumn("next", _bit(k)))
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * parallelism(spark), -(-n_rows // PART_ROWS))
    sets = F.filter(F.array(*[F.lit(s) for s in range(1 << len(names))]), lambda s: s.bitwiseAND(F.col("next")) == 0)
    left = asked.repartition(dealt, "_row").withColumn("set", F.explode(sets))
    for k, name in enumerate(names):
        fails = failing[name].withColumnRenamed("_row", "_fails")
        # a table that is small enough may be broadcast by Spark at run time
        left = left.join(fails, (F.col("_row") == F.col("_fails")) & (F.col("set").bitwiseAND(_bit(k)) != 0), "left_anti")
    return left.groupBy("part", "set", "next").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def order_table(counts: DataFrame, names: list[str]) -> DataFrame:
    """A row per part, order of the filters and step, from the counts of all sets."""
    size = len(names)
    key = lambda s, f: s * (1 << size) + f
    known = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("set"), F.col("next")), F.struct("n", "good", "toxic")))).alias("_of"))
    at = lambda s, f, what: F.coalesce(F.try_element_at("_of", key(s, f).cast("int"))[what], F.lit(0)).cast("long")
    steps = []
    for order in permutations(range(size)):
        before = 0
        for step, k in enumerate(order):
            steps.append((("".join(names[i] for i in order)), step + 1, before, k))
            before |= 1 << k
    listed = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(b).alias("b"), F.lit(k).alias("k")) for o, s, b, k in steps])
    # each set before a filter stands at the start of |set|! (rest)! orders
    value = lambda k: sum((at(F.lit(s), F.lit(1 << k), "n") * (factorial(s.bit_count()) * factorial(size - 1 - s.bit_count())) for s in range(1 << size) if not s >> k & 1), F.lit(0))
    shares = known.withColumn("_value", F.array(*[value(k) for k in range(size)]))
    rows = shares.select("part", "_of", "_value", F.explode(listed).alias("_at"))
    before, own, every = F.col("_at.b"), F.expr("shiftleft(1, _at.k)"), (1 << size) - 1
    removed = at(before, own, "n")
    return rows.select(
        "part", F.col("_at.o").alias("filter_order"), F.col("_at.s").alias("step"),
        at(before.bitwiseOR(own), F.lit(0), "n").alias("kept"), removed.alias("removed"), (at(F.lit(0), own, "n") - removed).alias("redundant"),
        at(F.lit(every) - own, own, "n").alias("unique_fails"), at(before, own, "good").alias("good_lost"), at(before, own, "toxic").alias("toxic_lost"),
        F.get("_value", F.col("_at.k")).cast("long").alias("shapley"),
    )


def _judged(docs: DataFrame) -> DataFrame:
    """`(_row, doc_id, part, digest, A, B, C, D)` per document, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select(F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    count, different = F.size("w"), F.size(F.array_distinct("w"))
    return cut(raw.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (count < 200).alias("A"), (100 * different.cast("long") < 50 * count).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 3 * F.length("text")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"),
    ), "judged")


def _copies(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows whose text a smaller id has as well."""
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).filter("_n > 1")
    known = join_groups(rows.select("_row", "doc_id", "digest"), cut(texts, "texts"), "digest", "_n", n_rows)
    return known.filter(F.coalesce(F.col("doc_id") > F.col("_least"), F.col("_least").isNotNull())).select("_row")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`(_row, part, good, toxic)`; rows without an id are not dealt by it."""
    says = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0)))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    flag = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    named = rows.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left").select("_row", "part", flag("good"), flag("toxic"))
    return named.unionByName(rows.filter(F.col("doc_id").isNull()).select("_row", "part", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters in all 120 orders, per language."""
    with scratch_scope(spark):
        rows = _judged(spark.read.parquet(f"{folder}/documents.parquet"))
        n_rows = rows.count()
        failing = {name: cut(rows.filter(F.col(name)).select("_row"), f"fails-{name}") for name in "ABCD"}
        failing["E"] = cut(_copies(rows, n_rows), "fails-E")
        marked = cut(_labelled(rows, spark.read.parquet(f"{folder}/labels.parquet")), "marked")
        counts = cut(prefix_counts(marked, failing, n_rows), "prefixes")
        return settle(order_table(counts, list(failing)), "filter-orders")


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), min(t.doc_id) OVER (PARTITION BY x) IS NOT NULL) THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1 : step - 1]), 0) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & CAST(before + own AS INT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INT) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INT) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
