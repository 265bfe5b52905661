"""Array-of-double columns: element-wise sums, softmax, argmax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`.

    An expression repeated inside one column is computed each time it occurs; a lambda
    variable is not.
    """
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    """Row softmax of an array column."""
    weights = lambda l: bind(F.array_max(l), lambda top: F.transform(l, lambda v: F.exp(v - top)))
    shares = lambda w: bind(F.aggregate(w, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(w, lambda v: v / total))
    return bind(bind(logits, weights), shares)


def argmax(values: Column) -> Column:
    """Index of the first largest element; NULL if the array is NULL or holds only NULLs."""
    return bind(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def element_sums(values: Column, size: int, weight: Column | None = None) -> list[Column]:
    """One `sum` per element; keeps the aggregation map-side combined and in codegen."""
    return [F.sum(values[i] if weight is None else values[i] * weight) for i in range(size)]


def group_sum(df: DataFrame, keys: Sequence[str], values: str, size: int, weight: Column | None = None) -> DataFrame:
    """Element-wise (weighted) sum of an array column per key, as `(keys, values)`."""
    sums = element_sums(F.col(values), size, weight)
    wide = df.groupBy(*keys).agg(*[s.alias(f"_v{i}") for i, s in enumerate(sums)])
    return wide.select(*keys, F.array(*[F.col(f"_v{i}") for i in range(size)]).alias(values))


def group_avg(df: DataFrame, keys: Sequence[str], values: str, size: int) -> DataFrame:
    """Element-wise mean per key; rows whose array is NULL do not count."""
    wide = df.groupBy(*keys).agg(*[F.avg(F.col(values)[i]).alias(f"_v{i}") for i in range(size)])
    array = F.array(*[F.col(f"_v{i}") for i in range(size)])
    return wide.select(*keys, F.when(F.col("_v0").isNotNull(), array).alias(values))


def array_width(df: DataFrame, column: str) -> int:
    """Length of the arrays in a column whose rows all have the same length."""
    row = df.select(F.size(column).alias("n")).filter(F.col("n") >= 0).first()
    if row is None:
        raise ValueError(f"no rows to take the width of {column} from")
    return int(row["n"])


def fourier(c: Sequence[Column], bands: int = 4) -> Column:
    """`[c, sin(2^i c), cos(2^i c)]` for i below `bands`; coordinates stay together per band."""
    parts = list(c)
    for i in range(bands):
        parts += [F.sin(F.lit(2.0**i) * v) for v in c]
        parts += [F.cos(F.lit(2.0**i) * v) for v in c]
    return F.array(*parts)
