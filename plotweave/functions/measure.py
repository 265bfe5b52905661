"""Geometry measures as JVM column expressions.

A geometry column is `polygons: array<polygon>`, a polygon an array of rings (outer first),
a ring a closed array of `struct<x double, y double>`. Every sum runs relative to a vertex
of the geometry, as projected coordinates are far from the origin and would cancel.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYGONS = T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"),
                    F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def polygon_of(*rings: list[tuple]) -> Column:
    """A one-polygon geometry from rings of (x, y) columns or numbers."""
    return F.array(F.array(*[F.array(*[point(x, y) for x, y in ring]) for ring in rings]))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return polygon_of([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


def _segments(ring: Column) -> Column:
    """Array of (start, end) vertex pairs."""
    n = F.size(ring)
    return F.arrays_zip(
        F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b")
    )


def _fold(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, v: acc + term(v))


def ring_moment(ring: Column) -> Column:
    """Signed doubled area, and first moments relative to the first vertex of the ring."""
    o = ring[0]
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, s: Column) -> Column:
        ax, ay = s["a"]["x"] - o["x"], s["a"]["y"] - o["y"]
        bx, by = s["b"]["x"] - o["x"], s["b"]["y"] - o["y"]
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a2"] + cross).alias("a2"), (acc["mx"] + (ax + bx) * cross).alias("mx"), (acc["my"] + (ay + by) * cross).alias("my")
        )

    return F.aggregate(_segments(ring), zero, step)


def ring_area(ring: Column) -> Column:
    """Unsigned area enclosed by one ring."""
    o = ring[0]
    doubled = _fold(
        _segments(ring),
        lambda s: (s["a"]["x"] - o["x"]) * (s["b"]["y"] - o["y"]) - (s["b"]["x"] - o["x"]) * (s["a"]["y"] - o["y"]),
    )
    return F.abs(doubled) / 2.0


def ring_length(ring: Column) -> Column:
    return _fold(
        _segments(ring),
        lambda s: F.sqrt(
            (s["b"]["x"] - s["a"]["x"]) * (s["b"]["x"] - s["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (s["b"]["y"] - s["a"]["y"])
        ),
    )


def polygon_area(polygon: Column) -> Column:
    """Outer ring minus holes."""
    holes = F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0)))
    return F.when(F.size(polygon) > 0, ring_area(polygon[0])).otherwise(0.0) - _fold(holes, ring_area)


def area(polygons: Column) -> Column:
    return _fold(polygons, polygon_area)


def perimeter(polygons: Column) -> Column:
    """Total length of all rings, holes included."""
    return _fold(polygons, lambda p: _fold(p, ring_length))


def largest_part(polygons: Column) -> Column:
    """The part with the largest area; the first one wins ties."""
    areas = F.transform(polygons, polygon_area)
    return F.when(F.size(polygons) > 0, F.element_at(polygons, F.array_position(areas, F.array_max(areas)).cast("int")))


def bounds(polygons: Column) -> Column:
    """`struct<x0, y0, x1, y1>` of all vertices."""
    vertices = F.flatten(F.flatten(polygons))
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")
    )
