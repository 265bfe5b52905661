"""Hard communities and their propagation to addresses and parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotweave.functions.clean import split_ids
from plotweave.functions.vectors import argmax, group_avg


def hard_communities(memberships: DataFrame, probs: str = "probs") -> DataFrame:
    """Add `community`, the first largest membership."""
    return memberships.withColumn("community", argmax(F.col(probs)))


def community_table(memberships: DataFrame, probs: str = "probs") -> DataFrame:
    """`(id_bat, community)` with one row per single id; rows without an id are `unk_<node>`."""
    named = hard_communities(memberships, probs)
    known = F.col("rnb_id").cast("string")
    if "node_id" in memberships.columns:
        known = F.coalesce(known, F.concat(F.lit("unk_"), F.col("node_id").cast("string")))
    return split_ids(named.select(known.alias("id_bat"), "community"), "id_bat")


def probability_columns(df: DataFrame, width: int, probs: str = "probs") -> DataFrame:
    """Array to one column `proba_k` per cluster."""
    others = [c for c in df.columns if c != probs]
    return df.select(*others, *[F.col(probs)[k].alias(f"proba_{k}") for k in range(width)])


def community_sizes(labels: DataFrame, community: str = "community") -> DataFrame:
    return labels.groupBy(community).agg(F.count("*").alias("n"))


def community_summary(labels: DataFrame, community: str = "community") -> DataFrame:
    """One row: clusters in use, and the least, median and largest number of members."""
    sizes = community_sizes(labels, community)
    return sizes.agg(F.count("*").alias("clusters"), F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"))


def membership_usage(memberships: DataFrame, width: int, probs: str = "probs") -> DataFrame:
    """Mean membership per cluster as `(k, usage)`."""
    wide = memberships.agg(*[F.avg(F.col(probs)[k]).alias(f"u{k}") for k in range(width)])
    return wide.select(F.posexplode(F.array(*[F.col(f"u{k}") for k in range(width)])).alias("k", "usage"))


def propagate_addresses(links: DataFrame, memberships: DataFrame, width: int, probs: str = "probs") -> DataFrame:
    """`(ban_id, probs, cluster)`: mean of the linked buildings; no match gives NULL.

    Ids of the form `a/b` are split on both sides first.
    """
    known = split_ids(memberships.select("rnb_id", probs), "rnb_id")
    joined = split_ids(links.select("rnb_id", "ban_id"), "rnb_id").join(known, "rnb_id", "left")
    return group_avg(joined, ["ban_id"], probs, width).withColumn("cluster", argmax(F.col(probs)))


def propagate_parcels(
    links: DataFrame, memberships: DataFrame, width: int, probs: str = "probs", compat: bool = False
) -> DataFrame:
    """`(parcelle_id, probs, cluster)`: cover-weighted mean of the linked buildings.

    Without a `cover_ratio` column the mean is unweighted. A parcel whose matched links weigh
    nothing gets NULL. `compat=True` divides by the weight of all links, matched or not, and
    puts a parcel without an answer into cluster 0.
    """
    known = split_ids(memberships.select("rnb_id", probs), "rnb_id")
    weighted = "cover_ratio" in links.columns
    split = split_ids(links.select("rnb_id", "parcelle_id", *(["cover_ratio"] if weighted else [])), "rnb_id")
    joined = split.join(known, "rnb_id", "left")
    if not weighted:
        return group_avg(joined, ["parcelle_id"], probs, width).withColumn("cluster", argmax(F.col(probs)))
    w = F.coalesce(F.col("cover_ratio").cast("double"), F.lit(0.0))
    counted = w if compat else F.when(F.col(probs).isNotNull(), w).otherwise(0.0)
    sums = [F.sum(F.col(probs)[k] * w) for k in range(width)]
    sums = [(F.coalesce(s, F.lit(0.0)) if compat else s).alias(f"_s{k}") for k, s in enumerate(sums)]
    grouped = joined.groupBy("parcelle_id").agg(F.sum(counted).alias("_w"), *sums)
    total = F.nullif(F.col("_w"), F.lit(0.0))
    usable = total.isNotNull() & F.col("_s0").isNotNull()
    mean = F.when(usable, F.array(*[F.col(f"_s{k}") / total for k in range(width)]))
    cluster = F.coalesce(argmax(F.col(probs)), F.lit(0)) if compat else argmax(F.col(probs))
    return grouped.select("parcelle_id", mean.alias(probs)).withColumn("cluster", cluster)
