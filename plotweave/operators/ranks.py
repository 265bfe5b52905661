"""Global row numbers and exact medians on range-sorted data, without a collecting task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotweave.session import cut


def _placed(df: DataFrame, order: Sequence[str], weight: Column, label: str) -> tuple[DataFrame, DataFrame]:
    """`df` range-sorted and written, with `_part` and `_at`, and what lies before each partition.

    The table is written once; the only thing that reaches the driver is a sum per partition.
    """
    seq = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumns({"_part": F.shiftright(seq, 33), "_at": seq.bitwiseAND((1 << 33) - 1)})
    placed = cut(placed, label)
    before, total = [], 0
    for r in sorted(placed.groupBy("_part").agg(F.sum(weight).alias("n")).collect(), key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r["n"]
    return placed, df.sparkSession.createDataFrame(before or [(0, 0)], "_part long, _before long")


def numbered(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """Add the 0-based position in the given order: the place inside a range-sorted partition plus the
    rows of the partitions before it."""
    placed, offsets = _placed(df, order, F.lit(1), "numbered")
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return out.select(*df.columns, name)


def exact_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """`(group, median)` with interpolation, also for groups too large for one task.

    Rows with equal group and value are counted first, map-side, so neither a large group nor a value
    that very many rows share comes together in one task. A running count over the range-sorted distinct
    values then tells which of them hold the middle ranks.
    """
    distinct = df.select(group, value).filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    placed, offsets = _placed(distinct, [group, value], F.col("_n"), "counted")
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    rows = placed.join(F.broadcast(offsets), "_part").withColumn("_first", first).select(group, value, "_n", "_first")
    spans = rows.groupBy(group).agg(F.min("_first").alias("_start"), F.sum("_n").alias("_total"))
    rank, middle = F.col("_first") - F.col("_start"), (F.col("_total") - 1) / 2
    holds = lambda r: ((rank <= r) & (r < rank + F.col("_n"))).cast("int")
    central = rows.join(spans, group).withColumn("_w", holds(F.floor(middle)) + holds(F.ceil(middle))).filter("_w > 0")
    return central.groupBy(group).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("median"))
