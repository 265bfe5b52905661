"""Mixing sources to target weights by a time-varying curriculum (operator 1), in DataFrame functions only.

Each source gets a target number of words by its weight (capped, the excess reshared). Its weight schedule
over training time, integrated, is its cumulative demand for words. The documents of a source stand in a
fixed random order and are read through again once they are used up, so a copy covers a range of the
source's cumulative words; inverting the demand at the middle of that range gives the copy its training
position between 0 and 1. A copy whose middle lies beyond the target is not taken, so the words taken
differ from the target by at most half a document. Sorting by position by ranges gives the order.

Running sums never put a source into one task: the random order is cut into hash ranges of some hundred
documents; sums inside the ranges, over the ranges of a block, and over blocks are joined. The only values
that reach the driver are a few sums. Only narrow rows are shuffled, until the order itself is asked for.

Defined cases: a null text has 0 words; a null source is a source of its own, the last one; a null id is
an id like any other; repeated rows each take part (rows that tie in the random order are equal in all
that counts); a document without words has a position but takes none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotweave.operators.ranks import numbered
from plotweave.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
# Knots (time, level) of the weight schedule, repeating over the sources as the weights do. Only the shape
# counts: each schedule is scaled so that its integral over time is the source's target.
SCHEDULES = (
    ((0.0, 1.5), (0.6, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.6, 1.0), (1.0, 1.5)),
)
# Documents per hash range, and ranges per block.
RANGE_ROWS = 512
BLOCK_RANGES = 1024


def _source_key(source: Column) -> Column:
    """Text that orders sources by code point with null last, and joins null with null."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _pick(values: Sequence, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """`(_source, source_size, docs, rank, target)` of a table `(_source, size)`.

    A target is `level * weight`, at most `limit` times the source; the level is raised until the
    targets use up `share` times all words. Each step closes at least one more source or is the last.
    """
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = cut(numbered(sources, ["_source"], "rank"), "sources")
    cap, weight = F.col("source_size") * float(limit), _pick([float(w) for w in weights], F.col("rank"))
    wanted = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while wanted:
        closed = cap <= F.lit(level) * weight
        row = sources.agg(F.coalesce(F.sum(F.when(closed, cap)), F.lit(0.0)).alias("c"), F.coalesce(F.sum(F.when(~closed, weight)), F.lit(0.0)).alias("w")).first()
        if not row["w"]:
            level = float("inf")
            break
        after = (wanted - row["c"]) / row["w"]
        if after <= level:
            break
        level = after
    target = cap if level == float("inf") else F.least(cap, F.lit(level) * weight)
    return sources.withColumn("target", target)


def _invert(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """Time at which a schedule's integral reaches `share` of its whole."""
    whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))
    out, done = None, 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        area = (t1 - t0) * (a + b) / 2
        rest = F.greatest(share * whole - F.lit(done), F.lit(0.0))
        # a x + (b - a) x^2 / 2h = rest, in the form that is stable for equal levels
        time = F.lit(t0) + 2 * rest / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * (b - a) / (t1 - t0) * rest, F.lit(0.0))))
        inside = share * whole <= F.lit(done + area)
        out = F.when(inside, time) if out is None else out.when(inside, time)
        done += area
    return F.least(out.otherwise(F.lit(knots[-1][0])), F.lit(1.0))


def random_order(seed: str) -> Column:
    """The key of a document's place in its source. The text has its part in it, so that rows of one id, or of
    none, do not stand together."""
    content = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))


def curriculum(docs: DataFrame, columns: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
               schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, seed: str = "mix") -> DataFrame:
    """`(doc_id, digest, size, source_size, target, positions)` per row of `docs`.

    `positions` holds the training position of each copy that the mix takes, possibly none.
    """
    order = random_order(seed)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    sized = docs.select(F.col("doc_id"), _source_key(F.col("source")).alias("_source"), size.alias("size"), digest.alias("digest"), order.alias("_order"))
    sized = cut(sized, "sized")
    targets = source_targets(sized, weights, share, limit)
    most = targets.agg(F.max("docs")).first()[0] or 0
    ranges = max(1, -(-most // RANGE_ROWS))
    place = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    dealt = sized.withColumn("_range", F.floor(place * ranges / 2**32).cast("long"))

    inside = Window.partitionBy("_source", "_range").orderBy("_order", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = dealt.groupBy("_source", "_range").agg(F.sum("size").alias("_words")).withColumn("_block", F.floor(F.col("_range") / BLOCK_RANGES))
    over = Window.partitionBy("_source", "_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("_source", "_block").agg(F.sum("_words").alias("_words"))
    along = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_source", "_block", F.coalesce(F.sum("_words").over(along), F.lit(0)).alias("_blocks"))
    starts = sums.withColumn("_ranges", F.coalesce(F.sum("_words").over(over), F.lit(0))).join(blocks, ["_source", "_block"])
    known = starts.join(targets, "_source").select("_source", "_range", (F.col("_ranges") + F.col("_blocks")).alias("_start"), "source_size", "target", "rank")
    rows = rows.join(known, ["_source", "_range"])

    first = F.col("_start") + F.col("_inside")
    middles = F.array(*[F.lit(k) * F.col("source_size") + first + F.col("size") / 2 for k in range(int(limit))])
    rows = rows.withColumn("_middles", F.filter(middles, lambda m: m <= F.col("target")))
    position = None
    for k, knots in enumerate(schedules):
        part = F.transform("_middles", lambda m: _invert(knots, F.when(F.col("target") > 0, m / F.col("target")).otherwise(F.lit(0.0))))
        position = F.when(F.col("rank") % len(schedules) == k, part) if position is None else position.when(F.col("rank") % len(schedules) == k, part)
    return rows.select("doc_id", "digest", "size", "source_size", "target", position.alias("positions"))


def _copies(docs: DataFrame) -> DataFrame:
    """A row `(_doc, _position)` per copy that the mix takes, range-sorted by position."""
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # rows that agree in id and text are told apart by number on both sides
    nth = lambda *by: F.row_number().over(Window.partitionBy("_id", "_digest").orderBy(*by))
    plan = curriculum(docs).select(key.alias("_id"), F.col("digest").alias("_digest"), "positions")
    plan = plan.withColumn("_nth", nth("positions"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key.alias("_id"), digest.alias("_digest"))
    whole = whole.withColumn("_nth", nth("_doc.source"))
    copies = whole.join(plan, ["_id", "_digest", "_nth"]).select("_doc", F.explode("positions").alias("_position"), "_id")
    return copies.sort("_position", "_id").select("_doc", "_position")


def training_order(docs: DataFrame) -> DataFrame:
    """The mix itself: `docs` with a row per copy and its `position` (in place of a column of that
    name), sorted by position."""
    kept = [F.col("_doc")[c].alias(c) for c in docs.columns if c != "position"]
    return _copies(docs).select(*kept, F.col("_position").alias("position"))


def mix_order(plan: DataFrame, row: str = "_row") -> DataFrame:
    """`(row, position, place)` of each copy that a plan takes: the copies range-sorted by position, numbered from 0.

    The order is written without the texts; `row` names the rows of the plan and tells ties apart.
    """
    return numbered(plan.select(row, F.explode("positions").alias("position")), ["position", row], "place")


def op1_source_mix(spark, folder: str) -> DataFrame:
    """What the mix takes of each document, and where its first copy stands, read back from the order of the mix."""
    plan = curriculum(spark.read.parquet(f"{folder}/documents.parquet"))
    plan = cut(plan.withColumn("_row", F.monotonically_increasing_id()), "plan")
    found = mix_order(plan).groupBy("_row").agg(F.count("*").alias("_copies"), F.min_by("position", "place").alias("_first"))
    taken = F.col("size") * F.coalesce("_copies", F.lit(0))
    return plan.join(found, "_row", "left").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.round("_first", 9).alias("first_position"))


def mixing_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the mix, a row per copy taken, in training order."""
    return _copies(docs).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def _curve_sql(knots: Sequence[tuple[float, float]]) -> str:
    whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))
    parts, done = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        rest = f"greatest(share * {whole!r}e0 - {done!r}e0, 0e0)"
        bend = 2 * (b - a) / (t1 - t0)
        time = f"{t0!r}e0 + 2 * {rest} / ({a!r}e0 + sqrt(greatest({a * a!r}e0 + {bend!r}e0 * {rest}, 0e0)))"
        done += (t1 - t0) * (a + b) / 2
        parts.append(f"WHEN share * {whole!r}e0 <= {done!r}e0 THEN least({time}, 1e0)")
    return f"CASE {' '.join(parts)} ELSE 1e0 END"


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS k, coalesce(xx.n, 0) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o
  FROM (SELECT doc_id, source, text, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents) xx
), s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY k) - 1 AS r FROM d GROUP BY k
), w AS (
  SELECT *, CAST([5, 2, 1][CAST(r % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2e0 * source_size AS cap FROM s
), f AS (
  SELECT *, cap / weight AS turn, (1.5e0 * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w
), t AS (
  SELECT w.k, source_size, r, least(cap, weight * (SELECT coalesce(arg_min(lvl, turn), 'inf'::DOUBLE) FROM f WHERE cap > lvl * weight)) AS target FROM w
), c AS (
  SELECT doc_id, size, source_size, target, r,
    coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2e0 AS middle
  FROM d JOIN t ON d.k = t.k
), p AS (
  SELECT *, CASE WHEN target > 0 THEN middle / target ELSE 0e0 END AS share FROM c
)
SELECT doc_id, size, source_size, target,
  CAST(size * ((CASE WHEN middle <= target THEN 1 ELSE 0 END) + (CASE WHEN middle + source_size <= target THEN 1 ELSE 0 END)) AS BIGINT) AS taken,
  CASE WHEN middle <= target THEN round(CASE r % 3 WHEN 0 THEN {_curve_sql(SCHEDULES[0])} WHEN 1 THEN {_curve_sql(SCHEDULES[1])} ELSE {_curve_sql(SCHEDULES[2])} END, 9) END AS first_position
FROM p
"""
