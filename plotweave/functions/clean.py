"""Column helpers for cleaning and label preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "Inconnu"
NO_PLAN = "HP"


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def rename_if_absent(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename `old` to `new` unless `new` already exists."""
    if old in df.columns and new not in df.columns:
        return df.withColumnRenamed(old, new)
    return df


def column_or(df: DataFrame, name: str, default) -> Column:
    """The column, or a literal where the source lacks it."""
    return F.col(name) if name in df.columns else F.lit(default)


def lenient_number(c: Column) -> Column:
    """Text to double; what is no number becomes NULL. Java's `12d` and `12f` are no numbers."""
    text = c.cast("string")
    return F.when(~F.coalesce(text.rlike(r"(?i)[0-9.][df]\s*$"), F.lit(False)), text.try_cast("double"))


def strict_number(c: Column) -> Column:
    """Text to double that raises on bad input, also where the session is not in ANSI mode."""
    parsed = c.cast("string").try_cast("double")
    return F.when(
        c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("not a number: "), c.cast("string"))).cast("double")
    ).otherwise(parsed)


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def pad_code(c: Column, width: int = 2) -> Column:
    """Zero-pad an area code. Letters are kept, so `2A` works; a longer code is not cut."""
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def plan_labels(df: DataFrame, label: str = "LIBELLE", zone_type: str = "TYPEZONE") -> DataFrame:
    """Fill missing planning labels and keep the two-letter family of the zone label."""
    return df.withColumn(label, F.substring(F.coalesce(F.col(label), F.lit(NO_PLAN)), 1, 2)).withColumn(
        zone_type, F.coalesce(F.col(zone_type), F.lit(NO_PLAN))
    )


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the smallest by the given order, then by all other columns, so that ties
    do not depend on arrival (maps cannot be ordered and do not count).

    The least row combines map-side, so a hot key costs one row per task. Only where maps ride along is a row
    kept beside its rank.
    """
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    ordered = [c for c in rest if c not in order and "map<" not in df.schema[c].dataType.simpleString()]
    rank = F.struct(*[F.col(c) for c in (*order, *ordered)] or [F.lit(0)])
    whole = len({*order, *ordered}) == len(rest)
    least = F.min(rank) if whole else F.min_by(F.struct(*[F.col(c) for c in rest]), rank)
    picked = df.groupBy(key).agg(least.alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def split_ids(df: DataFrame, column: str, separator: str = "/") -> DataFrame:
    """One row per id where a cell holds several, as in `a/b`."""
    return df.withColumn(column, F.explode(F.split(F.col(column), separator)))


def decade(year: Column, first: int = 1800, last: int = 2030) -> Column:
    """Left edge of the right-closed decade (1800,1810] ... (2020,2030]; NULL outside."""
    edge = (F.ceil(year / 10.0) * 10 - 10).cast("int")
    return F.when((year > first) & (year <= last), edge)


def decade_label(year: Column) -> Column:
    edge = decade(year)
    return F.coalesce(F.concat(F.lit("dec_"), edge.cast("string")), F.lit(UNKNOWN))
