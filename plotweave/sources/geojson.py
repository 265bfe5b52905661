"""GeoJSON feature collections, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plotweave.functions.repair import clean_polygon
from plotweave.functions.project import LONLAT_SRID, reproject

_FEATURE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ]
)
_COLLECTION = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])
_RING = "array<array<array<double>>>"


def polygons_of(geometry: Column) -> Column:
    """Polygon or MultiPolygon with raw coordinate text to the nested geometry type."""
    single = F.array(F.from_json(geometry["coordinates"], _RING))
    multi = F.from_json(geometry["coordinates"], f"array<{_RING}>")
    raw = F.when(geometry["type"] == "Polygon", single).when(geometry["type"] == "MultiPolygon", multi)
    vertex = lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))
    return F.transform(raw, lambda p: F.transform(p, lambda r: F.transform(r, vertex)))


def read_geojson(spark: SparkSession, path: str, srid: int = LONLAT_SRID, clean: bool = True, partitions: int | None = None) -> DataFrame:
    """`(id, properties map, polygons)` of all features below `path`, on the grid.

    One JSON document is one record to Spark; many files are read in parallel, and the features
    can be spread out before any geometry work.
    """
    features = spark.read.schema(_COLLECTION).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    if partitions:
        features = features.repartition(partitions)
    polygons = reproject(polygons_of(F.col("f.geometry")), srid)
    fid = F.coalesce(F.col("f.id"), F.col("f.properties")["id"])
    return features.select(fid.alias("id"), F.col("f.properties").alias("properties"), (clean_polygon(polygons) if clean else polygons).alias("polygons"))
