"""Geospatial roles built from the generic benchmark tables, as lazily planned DataFrames.

The tables carry no geometry, so positions and outlines are arithmetic on keys. Everything
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotweave.functions import measure


class Tables:
    """The benchmark tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def bricks(self) -> DataFrame:
        """Brick layout of 20 x 10 parcels, odd rows shifted by half a brick (T-junctions)."""
        row = F.floor(F.col("p_partkey") / 40.0).cast("long")
        return self.part.select(
            F.col("p_partkey").alias("parcel"),
            ((F.col("p_partkey") % 40) * 20.0 + (row % 2) * 10.0).alias("x0"),
            (row * 10.0).alias("y0"),
        )

    def parcels(self) -> DataFrame:
        x0, y0 = F.col("x0"), F.col("y0")
        return self.bricks().select("parcel", measure.rectangle(x0, y0, x0 + 20.0, y0 + 10.0).alias("polygons"))

    def zones(self) -> DataFrame:
        """Planning zones of 100 x 50 with gaps between the columns, covering the parcels."""
        k = F.col("p_partkey")
        x0, y0 = (k % 8) * 110.0, F.floor(k / 8.0) * 50.0
        return self.part.select(
            k.alias("zone"),
            F.col("p_type").alias("LIBELLE"),
            F.col("p_brand").alias("TYPEZONE"),
            measure.rectangle(x0, y0, x0 + 100.0, y0 + 50.0).alias("polygons"),
        )

    def buildings(self) -> DataFrame:
        """w x h outlines; every fourth lacks the upper right quarter."""
        k = F.col("o_orderkey")
        base = self.orders.select(
            k.alias("building"),
            F.when(k % 50 == 0, F.concat(F.lit("B"), k, F.lit("/C"), k)).otherwise(F.concat(F.lit("B"), k)).alias("rnb_id"),
            (5 + (k * 7919) % 790).cast("double").alias("x0"),
            (5 + (k * 104729) % 490).cast("double").alias("y0"),
            (4 + k % 7).cast("double").alias("w"),
            (3 + k % 5).cast("double").alias("h"),
            (k % 4 == 0).alias("notch"),
            ((k % 9) * 2.5).cast("double").alias("hauteur"),
            F.when(k % 10 == 0, F.lit(None)).when(k % 17 == 0, "abc").otherwise((1790 + k % 240).cast("string")).alias("annee"),
            F.when(k % 8 != 0, F.col("o_orderpriority")).alias("usage"),
            (k % 6).cast("string").alias("nb_log"),
        )
        x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
        xm, ym = F.col("x0") + F.col("w") / 2, F.col("y0") + F.col("h") / 2
        notched = measure.polygon_of([(x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1), (x0, y0)])
        return base.withColumn("polygons", F.when(F.col("notch"), notched).otherwise(measure.rectangle(x0, y0, x1, y1)))

    def addresses(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(
            k.alias("addr"),
            (2.20 + ((k * 37) % 1000) / 10000.0).alias("lon"),
            (48.85 + ((k * 91) % 1000) / 10000.0).alias("lat"),
        )

    def parcel_links(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("building"), F.col("l_partkey").alias("parcel"), (F.col("l_discount") * 10.0).alias("cover_ratio")
        )

    def address_links(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("building"), F.col("o_custkey").alias("addr"))

    def points(self) -> DataFrame:
        return self.embeddings.select(
            F.col("vec_id").alias("id"),
            F.col("embedding")[0].cast("double").alias("x"),
            F.col("embedding")[1].cast("double").alias("y"),
        )

    def links_xy(self) -> DataFrame:
        """Several addresses per pivot: supplier -> order, weighted by quantity."""
        return self.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("pivot"), F.col("l_quantity").alias("w"))

    def links_yz(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("pivot"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("w"))


def wave_logits(key: Column, width: int) -> Column:
    """Deterministic logits for memberships: cos(0.37 (k+1) key)."""
    return F.array(*[F.cos(F.lit(0.37 * (k + 1)) * key) for k in range(width)])
