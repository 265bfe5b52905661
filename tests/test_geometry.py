import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.functions import measure
from plotweave.functions.geoarrays import Flat, flatten, from_wkb, nest_lists, polygons_of_wkb, to_wkb, wkb_of_polygons
from plotweave.functions.measure import POLYGONS
from plotweave.functions.planar import hull, measures, touching
from plotweave.functions.shapes import centroid, with_shape_features
from plotweave.functions.repair import clean_polygon
from plotweave.operators import spatial

ring = lambda *pts: [tuple(map(float, p)) for p in (*pts, pts[0])]
box = lambda x0, y0, x1, y1: [ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
SQUARE = [box(0, 0, 1, 1)]
L_SHAPE = [[ring((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))]]
HOLED = [[box(0, 0, 4, 4)[0], ring((1, 1), (1, 3), (3, 3), (3, 1))]]
PARTS = [box(0, 0, 1, 1), box(5, 5, 7, 8)]
LINE = [[ring((0, 0), (1, 0), (2, 0))]]
FAR = 6.8e6


def frame(spark, geoms):
    rows = [(i, [[[(x, y) for x, y in r] for r in p] for p in g]) for i, g in enumerate(geoms)]
    return spark.createDataFrame(rows, "id long, p string").drop("p") if not rows else spark.createDataFrame(
        [(i, g) for i, g in rows], "id long, polygons array<array<array<struct<x:double,y:double>>>>"
    )


def arrays(geoms):
    return nest_lists([[[np.array(r, float) for r in p] for p in g] for g in geoms])


def touch(a, b):
    ok, shared = touching(flatten(arrays([a, b])), np.array([0]), np.array([1]))
    back, shared_back = touching(flatten(arrays([a, b])), np.array([1]), np.array([0]))
    assert ok[0] == back[0] and (not ok[0] or shared[0] == pytest.approx(shared_back[0]))
    return bool(ok[0]), float(shared[0]) if ok[0] else None


def test_area_perimeter_centroid_agree_in_both_engines(spark):
    geoms = [SQUARE, L_SHAPE, HOLED, PARTS, LINE]
    moved = [[[[(x + FAR, y + FAR) for x, y in r] for r in p] for p in g] for g in geoms]
    df = frame(spark, moved)
    got = df.select("id", measure.area(F.col("polygons")).alias("a"), measure.perimeter(F.col("polygons")).alias("p"), centroid("polygons").alias("c")).orderBy("id").collect()
    assert [r["a"] for r in got] == pytest.approx([1, 3, 12, 7, 0])
    assert [r["p"] for r in got] == pytest.approx([4, 8, 24, 14, 4])
    m = measures(flatten(arrays(moved)))
    assert m[:, 0] == pytest.approx([1, 3, 12, 7, 0]) and m[:, 1] == pytest.approx([4, 8, 24, 14, 4])
    assert [(r["c"]["x"] - FAR, r["c"]["y"] - FAR) for r in got[:4]] == [pytest.approx(c, abs=1e-6) for c in [(0.5, 0.5), (5 / 6, 5 / 6), (2, 2), (36.5 / 7, 39.5 / 7)]]


def test_largest_part_and_bounds(spark):
    row = frame(spark, [PARTS]).select(measure.largest_part(F.col("polygons")).alias("l"), measure.bounds(F.col("polygons")).alias("b")).first()
    assert row["l"][0][0]["x"] == 5.0
    assert tuple(row["b"]) == (0.0, 0.0, 7.0, 8.0)


def test_clean_polygon_closes_orients_and_drops(spark):
    messy = [[[(0.0, 0.0), (0.0, 1.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)], [(0.1, 0.1), (0.2, 0.2), (0.1, 0.1)]]]
    got = frame(spark, [messy]).select(clean_polygon(F.col("polygons")).alias("p")).first()["p"]
    assert len(got) == 1 and len(got[0]) == 1
    pts = [(v["x"], v["y"]) for v in got[0][0]]
    assert pts[0] == pts[-1] and len(pts) == 5
    assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:])) > 0


def test_wkb_round_trip_and_foreign_forms(spark):
    df = frame(spark, [SQUARE, HOLED, PARTS])
    back = df.select("id", "polygons", from_wkb(to_wkb("polygons")).alias("q"))
    assert back.filter("polygons <> q").count() == 0
    import struct

    z = struct.pack(">BII", 0, 1003, 1) + struct.pack(">I", 4) + b"".join(struct.pack(">ddd", *p, 9.0) for p in [(0, 0), (1, 0), (1, 1), (0, 0)])
    assert polygons_of_wkb(z)[0][0].tolist() == [[0, 0], [1, 0], [1, 1], [0, 0]]
    with_srid = struct.pack("<BII", 1, 0x20000003, 2154) + wkb_of_polygons([[np.array(SQUARE[0][0])]])[5:]
    assert polygons_of_wkb(with_srid)[0][0].shape == (5, 2)
    assert polygons_of_wkb(struct.pack("<BIdd", 1, 1, 3.0, 4.0)) == []


def test_shape_features(spark):
    turned = [[[(x * math.cos(0.7) - y * math.sin(0.7), x * math.sin(0.7) + y * math.cos(0.7)) for x, y in r] for r in p] for p in [box(0, 0, 8, 2)]]
    got = with_shape_features(frame(spark, [SQUARE, turned, LINE, PARTS])).orderBy("id").collect()
    assert got[0]["elongation"] == pytest.approx(0, abs=1e-5) and got[0]["compactness"] == pytest.approx(math.pi / 4, abs=1e-5)
    assert got[1]["elongation"] == pytest.approx(0.75, abs=1e-5) and got[1]["convexity"] == pytest.approx(1, abs=1e-5)
    assert got[2]["elongation"] == 0.0 and got[2]["area"] == 0.0
    assert got[3]["elongation"] == pytest.approx(1 - 2 / 3, abs=1e-5)


def test_touch_cases():
    assert touch(SQUARE, [box(1, 0.5, 2, 1.5)]) == (True, pytest.approx(0.5))
    assert touch(SQUARE, [box(1, 1, 2, 2)]) == (True, 0.0)
    assert touch(SQUARE, [box(0.5, 0.5, 2, 2)])[0] is False
    assert touch(SQUARE, SQUARE)[0] is False
    assert touch(SQUARE, [box(3, 3, 4, 4)])[0] is False
    # inside, touching the boundary from within
    assert touch([box(0, 0, 4, 4)], [box(0, 1, 2, 2)])[0] is False
    assert touch([box(0, 0, 4, 4)], [[ring((2, 2), (4, 3), (3, 3.5))]])[0] is False
    # fills the hole exactly
    assert touch(HOLED, [box(1, 1, 3, 3)]) == (True, pytest.approx(8))
    # crosses through two vertices without a proper edge crossing
    diamond = [[ring((0, -1), (1, 0), (0, 1), (-1, 0))]]
    assert touch(diamond, [[ring((-1, 0), (1, 0), (3, 5), (-3, 5))]])[0] is False
    assert touch(diamond, [[ring((1, 0), (3, 5), (5, -5))]]) == (True, 0.0)


def test_touch_join_with_copies_and_tiny_blocks(spark):
    cells = [(i, [box(i % 6, i // 6, i % 6 + 1, i // 6 + 1)]) for i in range(36)]
    copies = [(100 + i, [box(0, 0, 1, 1)]) for i in range(20)]
    df = spark.createDataFrame([(i, [[[(float(x), float(y)) for x, y in r] for r in p] for p in g]) for i, g in cells + copies], f"id long, polygons {POLYGONS.simpleString()}")
    got = {(r["a"], r["b"]): r["shared"] for r in spatial.touch_pairs(df, target=5, cap=4).collect()}
    where = {i: (i % 6, i // 6) for i, _ in cells} | {i: (0, 0) for i, _ in copies}
    want = {}
    for a in where:
        for b in where:
            dx, dy = abs(where[a][0] - where[b][0]), abs(where[a][1] - where[b][1])
            if a < b and max(dx, dy) == 1:
                want[a, b] = float(dx + dy == 1)
    assert got == pytest.approx(want)
    both = spatial.touch_edges(df, double_count=True).filter("src = 0 and dst = 1").first()
    assert both["w"] == pytest.approx(2.0)


def test_zone_of_points_takes_lowest_and_splits_hot_tiles(spark):
    rng = np.random.default_rng(3)
    pts = [(i, *map(float, rng.uniform(0, 10, 2))) for i in range(200)] + [(1000 + i, 5.5, 5.5) for i in range(150)]
    zones = [(7, box(0, 0, 6, 6)), (3, box(5, 5, 9, 9)), (9, box(5, 5, 6, 6)), (11, box(20, 20, 30, 30))]
    zdf = spark.createDataFrame([(z, [[[tuple(map(float, v)) for v in r] for r in g]]) for z, g in zones], f"zone long, polygons {POLYGONS.simpleString()}")
    pdf = spark.createDataFrame(pts, "id long, x double, y double")
    for options in ({}, {"target": 20, "cap": 10}):
        got = {r["id"]: r["zone"] for r in spatial.zone_of_points(pdf, zdf, **options).collect()}
        want = {}
        for i, x, y in pts:
            hits = [z for z, g in zones if g[0][0][0] < x < g[0][2][0] and g[0][0][1] < y < g[0][2][1]]
            if hits:
                want[i] = min(hits)
        assert got == want


def test_reprojection_origin_and_explicit_system(spark):
    from plotweave.functions.project import lambert93, reproject

    x, y = lambert93(F.lit(3.0), F.lit(46.5))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((700000.0, 6600000.0), abs=1e-6)
    with pytest.raises(ValueError):
        reproject(F.col("polygons"), 27572)
