"""A bounded sample of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_ids(labels: DataFrame, label: str, limit: int, keep: Column | None = None) -> DataFrame:
    """`(doc_id, label)` of at most `limit` labelled ids in hash order, ready to be broadcast.

    The limit bounds what is fitted on and what is broadcast; it never touches what is scored.
    Rows without an id or a label are left out; of an id with two labels the smaller one counts.
    """
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if keep is not None:
        rows = rows.filter(keep)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    return F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
