"""Named queries for sources and sinks (written and read back), node vectors, heads and one fit step."""

from __future__ import annotations

import io
import math
import zipfile
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotweave.functions import clean, measure
from plotweave.functions.repair import clean_polygon, make_valid
from plotweave.functions.shapes import centroid
from plotweave.operators import features, fusion, graph as g, knn, learn, links, overlay, propagate, spatial, zoning
from plotweave.operators.encode import Encoder, Linear, apply_linear, attention_pass, relation_sum
from plotweave.operators.fit import Heads, Settings, build_blocks, evaluate, memberships
from plotweave.plans import pipeline, raw, sweep
from plotweave.functions.vectors import argmax, softmax
from plotweave.plans.fixtures import Tables, wave_logits
from plotweave.plans.queries import (
    ATTENTION, BETA, K_X, K_Y, K_Z, SHAPE, feature_rows, key_embedding, order_links, parcel_link_ids, partial_soft, query, rounded, soft_buildings,
)
from plotweave.session import cut, scratch_path, spread
from plotweave.sources import geojson, tables as store

# --- sources and sinks ---------------------------------------------------------------------


@query
def csv_by_name(t: Tables) -> DataFrame:
    """Gzipped text in two column orders, read by name."""
    path = scratch_path(t.spark, "csv")
    people = t.customer.withColumn("note", F.concat(F.lit('a;"b'), F.col("c_custkey"), F.lit('"\nc')))
    for half, order in enumerate((("c_name", "note", "c_custkey", "c_acctbal"), ("c_acctbal", "c_custkey", "note", "c_name"))):
        part = people.filter(F.col("c_custkey") % 2 == half).select(*order)
        part.write.option("header", "true").option("sep", ";").option("escape", '"').option("compression", "gzip").csv(f"{path}/half={half}")
    return store.read_delimited(t.spark, f"{path}/*", "c_custkey long, c_acctbal double, c_name string, note string")


def _zip_group(table: pa.Table) -> pa.Table:
    lines = ["c_name;c_nationkey;c_custkey", *(f'"{n}";{k};{c}' for n, k, c in zip(*(table[x].to_pylist() for x in ("c_name", "c_nationkey", "c_custkey"))))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("rows.csv", "\n".join(lines) + "\n")
    return pa.table({"path": [f"{table['c_nationkey'][0]}.zip"], "content": pa.array([out.getvalue()], pa.binary())})


@query
def zip_by_name(t: Tables) -> DataFrame:
    """One zip file of customers per nation and key range, read by column name."""
    keyed = t.customer.select("c_name", "c_nationkey", "c_custkey", F.floor(F.col("c_custkey") / 1000).alias("part"))
    files = keyed.groupBy("c_nationkey", "part").applyInArrow(_zip_group, "path string, content binary")
    return store.unzip(files, "c_custkey long, c_name string, c_nationkey int")


@query
def geojson_features(t: Tables) -> DataFrame:
    """Parcels as feature collections in several files, read back and measured."""
    path = scratch_path(t.spark, "geojson")
    corner = lambda dx, dy: F.concat(F.lit("["), (F.col("x0") + dx).cast("string"), F.lit(","), (F.col("y0") + dy).cast("string"), F.lit("]"))
    ring = F.concat(F.lit("[["), F.concat_ws(",", *[corner(*d) for d in ((0, 0), (20, 0), (20, 10), (0, 10), (0, 0))]), F.lit("]]"))
    coordinates = F.when(F.col("parcel") % 3 == 0, F.concat(F.lit("["), ring, F.lit("]"))).otherwise(ring)
    kind = F.when(F.col("parcel") % 3 == 0, "MultiPolygon").otherwise("Polygon")
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"id":"P'), F.col("parcel").cast("string"), F.lit('"},"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}")
    )
    rows = t.bricks().select(F.floor(F.col("parcel") / 250).alias("file"), feature.alias("f"))
    text = rows.groupBy("file").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",\n", F.collect_list("f")), F.lit("]}")).alias("value"))
    text.write.partitionBy("file").text(path)
    found = geojson.read_geojson(t.spark, f"{path}/*", srid=2154, partitions=4)
    return found.select("id", rounded(measure.area(F.col("polygons"))).alias("area"), F.size("polygons").alias("parts"))


@query
def labels_roundtrip(t: Tables) -> DataFrame:
    """Community table as text and back, ids staying text, then joined to the buildings by id."""
    path = scratch_path(t.spark, "labels")
    store.write_labels(propagate.community_table(soft_buildings(t)), path)
    return t.buildings().select(F.explode(F.split("rnb_id", "/")).alias("id_bat")).join(store.read_labels(t.spark, path), "id_bat")


@query
def discover_files(t: Tables) -> DataFrame:
    """Areas of a per-area table by the names of its files."""
    path = scratch_path(t.spark, "found") + "/raw"
    target = store.layer_root(path, "intrants")
    store.write_by_area(t.customer.select(clean.pad_code(F.col("c_nationkey")).alias("dep"), "c_custkey"), target)
    found = store.find_files(t.spark, target, ".parquet").filter("length > 0")
    return found.select(F.regexp_extract("path", "/intrants/dep=([^/]*)/", 1).alias("dep")).distinct()


@query
def replace_table(t: Tables) -> DataFrame:
    """A stored table replaced by a query."""
    path = scratch_path(t.spark, "table")
    name = f"plotweave_{path.rsplit('-', 1)[-1]}"
    store.replace_table(t.region, name, path)
    store.replace_table(t.nation.select("n_nationkey", F.upper("n_name").alias("n_name")), name, path)
    return t.spark.table(name)


@query
def graph_package(t: Tables) -> DataFrame:
    """Graph with its node indices, written and read back."""
    path = scratch_path(t.spark, "package")
    ids = lambda df, key: df.select(F.col(key).alias("id"), F.array(F.lit(1.0)).alias("features"))
    nodes = {g.ADDRESS: ids(t.customer, "c_custkey"), g.BUILDING: ids(t.orders, "o_orderkey"), g.PARCEL: ids(t.part, "p_partkey")}
    edges = {
        g.ACCESS: t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")),
        g.BELONGS: t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_discount").alias("w")),
    }
    index = g.node_index(t.orders.select(F.concat(F.lit("B"), F.col("o_orderkey").cast("string")).alias("rnb_id")), "rnb_id")
    store.write_graph(g.Graph(nodes, edges).check(), path, {g.BUILDING: index})
    back = store.read_graph(t.spark, path, list(nodes), list(edges))
    named = store.read_index(t.spark, path, g.BUILDING).agg(F.count("*").alias("n")).select(F.lit("index").alias("kind"), F.lit(g.BUILDING).alias("name"), "n")
    return g.graph_stats(back).union(named)


@query
def results_tables(t: Tables) -> DataFrame:
    """Result tables of a run, written and read back: rows and summed clusters of each."""
    path = scratch_path(t.spark, "results")
    soft = partial_soft(t).withColumn("node_id", F.lit(0).cast("long"))
    b = t.buildings().select("building", "rnb_id")
    own = t.address_links().join(b, "building").select(F.col("addr").alias("ban_id"), "rnb_id")
    inputs = pipeline.Inputs(t.buildings(), t.parcels(), t.addresses(), own, parcel_link_ids(t))
    pipeline.write_results(pipeline.export_tables(inputs, soft, K_Y), path)
    back = pipeline.read_results(t.spark, path)
    one = lambda name, df, c: df.agg(F.count("*").alias("n"), F.sum(c).alias("total")).select(F.lit(name).alias("name"), "n", "total")
    return one("communities", back.communities, "community").union(one("parcels", back.parcels, "cluster")).union(one("addresses", back.addresses, "cluster"))


# --- preparation ---------------------------------------------------------------------------


@query
def placed_addresses(t: Tables) -> DataFrame:
    """Address text files to grid coordinates, through the strict number reader."""
    return fusion.place_addresses(raw.ban(t)).select("ban_id", rounded(F.col("x"), 3).alias("x"), rounded(F.col("y"), 3).alias("y"))


@query
def sparse_columns(t: Tables) -> DataFrame:
    """Buildings whose source lacks heights, years, dwellings and usage."""
    rows = features.building_columns(feature_rows(t).select("id", "polygons"))
    return rows.select(F.col("id").alias("building"), rounded(F.col("area")).alias("area"), F.coalesce("height", F.lit(-1.0)).alias("height"), "volume", "nb_logements", "usage", "decennie")


@query
def plots_without_ratio(t: Tables) -> DataFrame:
    """Plot lists in which some entries state no ratio, some none that is a number, some no id."""
    text = F.concat(
        F.lit("[{'id': 'P"), F.col("l_partkey").cast("string"), F.lit("'"),
        F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, ", 'bdg_cover_ratio': None").when(F.col("l_linenumber") == 3, ", 'bdg_cover_ratio': 'x'").otherwise(", 'bdg_cover_ratio': 0.5"),
        F.lit("}, {'bdg_cover_ratio': 1.0}]"),
    )
    return links.parcel_links(t.lineitem.select(F.concat(F.lit("B"), F.col("l_orderkey").cast("string")).alias("rnb_id"), text.alias("plots")))


@query
def unknown_ids(t: Tables) -> DataFrame:
    """Labels of buildings of which some have no id and some have two."""
    rows = soft_buildings(t).withColumnRenamed("id", "node_id").withColumn("rnb_id", F.when(F.col("node_id") % 7 != 0, F.col("rnb_id")))
    return propagate.community_table(rows)


@query
def propagate_parcels_plain(t: Tables) -> DataFrame:
    """Links without ratios: the plain mean."""
    own = propagate.propagate_parcels(parcel_link_ids(t).drop("cover_ratio"), partial_soft(t), K_Y)
    return propagate.probability_columns(own, K_Y).select("parcelle_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), *[rounded(F.col(f"proba_{k}")).alias(f"proba_{k}") for k in range(K_Y)])


@query
def building_probabilities(t: Tables) -> DataFrame:
    """One column per cluster for every building."""
    wide = propagate.probability_columns(soft_buildings(t).select("rnb_id", "probs"), K_Y)
    return wide.select("rnb_id", *[rounded(F.col(f"proba_{k}")).alias(f"proba_{k}") for k in range(K_Y)])


@query
def community_summary(t: Tables) -> DataFrame:
    return propagate.community_summary(propagate.hard_communities(soft_buildings(t)))


# --- geometry ------------------------------------------------------------------------------


@query
def boundary_union(t: Tables) -> DataFrame:
    """Buildings in the union of regions that overlap, one of them listed twice."""
    k = F.col("r_regionkey")
    box = measure.rectangle(100.3 + k * 60.0, 100.3 + k * 40.0, 250.3 + k * 60.0, 200.3 + k * 40.0)
    regions = t.region.select(k.alias("zone"), box.alias("polygons"))
    centres = t.buildings().select(F.col("building").alias("id"), centroid(F.col("polygons")).alias("c")).select("id", "c.x", "c.y")
    inside = spatial.zone_of_points(centres, regions.union(regions.filter(k == 2)))
    return inside.select(F.col("id").alias("building"))


def outline_regions(t: Tables) -> DataFrame:
    """An L that comes twice, a square with a hole, and two rectangles that overlap."""
    number = lambda v: F.lit(float(v))
    ring = lambda *points: F.array(*[F.struct(number(x).alias("x"), number(y).alias("y")) for x, y in (*points, points[0])])
    box = lambda x0, y0, x1, y1: ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    ell = ring((150.25, 150.25), (350.25, 150.25), (350.25, 200.25), (200.25, 200.25), (200.25, 300.25), (150.25, 300.25))
    shapes = [F.array(F.array(s)) for s in (ell, box(550.5, 300.5, 650.5, 350.5), box(600.5, 320.5, 700.5, 400.5), F.reverse(ell))]
    holed = F.array(F.array(box(400.5, 200.5, 500.5, 300.5), box(430.5, 230.5, 460.5, 270.5)))
    k = F.col("r_regionkey")
    picked = F.when(k == 0, shapes[0]).when(k == 1, holed).when(k == 2, shapes[1]).when(k == 3, shapes[2]).otherwise(shapes[3])
    return t.region.select(k, picked.alias("polygons"))


@query
def clip_to_outline(t: Tables) -> DataFrame:
    """Buildings cut by the union of areas that are not convex, have a hole, overlap or come twice."""
    cut_out = overlay.clip(t.buildings().select("building", "polygons"), outline_regions(t))
    return cut_out.select("building", rounded(measure.area(F.col("polygons"))).alias("area"))


def plan_blocks(t: Tables) -> DataFrame:
    """Rectangles with whole corners in seven groups, many of which overlap, touch or lie on one another."""
    k = F.col("p_partkey")
    x0, y0 = (k * 37 % 211).cast("double"), (k * 53 % 157).cast("double")
    return t.part.select((k % 7).alias("grp"), measure.rectangle(x0, y0, x0 + 1 + k % 9, y0 + 1 + k % 5).alias("polygons"))


@query
def union_outlines(t: Tables) -> DataFrame:
    """Area and length of the union of each group, from its edges and again from the geometry put together."""
    rings, sums = overlay.dissolve(plan_blocks(t), "grp", side=64.0)
    shapes = overlay.union_polygons(rings).select("grp", F.col("polygons").alias("p"))
    both = sums.join(shapes, "grp")
    return both.select(
        F.col("grp"), rounded(F.col("area")).alias("area"), rounded(F.col("perimeter")).alias("perimeter"),
        rounded(measure.area(F.col("p"))).alias("shape_area"), rounded(measure.perimeter(F.col("p"))).alias("shape_perimeter"),
    )


REACH = 40.0


@query
def zone_outlines(t: Tables) -> DataFrame:
    """Community zones as polygons 40 m around buildings that stand apart: their rings, and means per ring."""
    k = F.col("building")
    x0, y0 = (k % 1000) * 128.0, F.floor(k / 1000) * 128.0
    spaced = t.buildings().select(
        k.cast("string").alias("rnb_id"), argmax(softmax(wave_logits(k, K_Y))).alias("community"), measure.rectangle(x0, y0, x0 + F.col("w"), y0 + F.col("h")).alias("polygons")
    )
    labels = spaced.select(F.col("rnb_id").alias("id_bat"), "community")
    rings, sums = zoning.zone_outlines(spaced.drop("community"), labels, REACH)
    parts = rings.groupBy("grp").agg(F.count("*").alias("rings"), F.sum("area").alias("ring_area"))
    mean = lambda c: rounded(F.col(c) / F.col("rings"), 1).alias(c)
    return sums.join(parts, "grp").select(F.col("grp").alias("community"), "rings", mean("area"), mean("ring_area"), mean("perimeter"))


@query
def valid_outlines(t: Tables) -> DataFrame:
    """Outlines that cross themselves, have a spike, a hole outside or two parts that overlap: made valid."""
    k, x, y, w, h = (F.col(c) for c in ("building", "x0", "y0", "w", "h"))
    ring = lambda *points: F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in (*points, points[0])])
    box = lambda x0, y0, x1, y1: ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    crossed = F.array(F.array(ring((x, y), (x + w, y + h), (x + w, y), (x, y + h))))
    spiked = F.array(F.array(ring((x, y), (x + w, y), (x + w, y + h), (x + w / 2, y + h), (x + w / 2, y + h + 9), (x + w / 2, y + h), (x, y + h))))
    outside = F.array(F.array(box(x, y, x + w, y + h), box(x + w + 1, y, x + w + 2, y + 1)))
    double = F.array(F.array(box(x, y, x + w, y + h)), F.array(box(x + w / 2, y, x + 2 * w, y + h)))
    kind = k % 4
    broken = F.when(kind == 0, crossed).when(kind == 1, spiked).when(kind == 2, outside).otherwise(double)
    rows = spread(t.buildings()).select("building", make_valid(broken).alias("p"))
    return rows.select("building", F.size("p").cast("long").alias("parts"), rounded(measure.area(F.col("p"))).alias("area"), rounded(measure.perimeter(F.col("p"))).alias("perimeter"))


@query
def repaired_parts(t: Tables) -> DataFrame:
    """Untidy two-part outlines (repeated corners, wrong turns, open rings): cleaned, largest part taken."""
    x, y, w = F.col("x0"), F.col("y0"), F.col("w")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    big = F.array(point(x, y), point(x, y), point(x, y + w), point(x + w, y + w), point(x + w, y))
    small = F.array(point(x + 100, y), point(x + 102, y), point(x + 102, y + 1), point(x + 100, y + 1), point(x + 100, y))
    line = F.array(point(x, y), point(x + 1, y), point(x, y))
    rows = t.buildings().select("building", clean_polygon(F.array(F.array(small), F.array(big), F.array(line))).alias("p"))
    part = F.array(measure.largest_part(F.col("p")))
    return rows.select("building", F.size("p").cast("long").alias("parts"), F.size(part[0][0]).cast("long").alias("corners"), rounded(measure.area(part)).alias("area"), rounded(measure.perimeter(part)).alias("perimeter"))


@query
def knn_buildings(t: Tables) -> DataFrame:
    """The eight nearest buildings of every building."""
    return knn.knn_edges(t.buildings().select(F.col("building").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"))).select("src", "dst")


# --- node vectors --------------------------------------------------------------------------


def _slots(vectors: DataFrame, digits: int) -> DataFrame:
    long = vectors.select("id", F.posexplode("features").alias("slot", "value"))
    return long.select("id", F.col("slot").cast("long").alias("slot"), F.round("value", digits).alias("value"))


@query
def building_vectors(t: Tables) -> DataFrame:
    density = knn.knn_density(t.buildings().select(F.col("building").alias("id"), "x0", "y0"), x="x0", y="y0")
    return _slots(features.building_vectors(feature_rows(t), density), 4)


@query
def parcel_vectors(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("id"), F.col("p_type").alias("LIBELLE"), F.col("p_brand").alias("TYPEZONE"), measure.rectangle(k * 0.0, k * 0.0, 3.0 + k % 11, 2.0 + k % 7).alias("polygons"))
    return _slots(features.parcel_vectors(rows), 4)


@query
def address_vectors(t: Tables) -> DataFrame:
    placed = fusion.place_addresses(raw.ban(t).withColumn("key", F.expr("cast(substring(id, 2) as long)")))
    return _slots(features.address_vectors(cut(placed.select("key", "x", "y"), "placed"), "key"), 4)


# --- encoder, heads, fit -------------------------------------------------------------------

# Fixed small weights of a second relation and of the output, shared with the SQL counterpart.
ATTENTION_2 = replace(ATTENTION, left=np.array([[0.25, 0.5], [-0.75, 0.5]]), score=np.array([-0.5, 1.0]))
OUTPUT = Linear(np.array([[1.0, -2.0], [0.5, 0.25]]), np.array([0.1, -0.1]))


@query
def encoder_layer(t: Tables) -> DataFrame:
    """Two relations into the orders, summed, cut at zero, then the linear output."""
    parts = t.part.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1999.0).alias("features"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey") / 25.0, F.col("s_acctbal") / 10000.0).alias("features"))
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice") / 100000.0, F.lit(1.0)).alias("features"))
    edges = lambda c: t.lineitem.select(F.col(c).alias("src"), F.col("l_orderkey").alias("dst"), F.array("l_discount").alias("attr"))
    summed = relation_sum([attention_pass(parts, orders, edges("l_partkey"), ATTENTION), attention_pass(suppliers, orders, edges("l_suppkey"), ATTENTION_2)], 2)
    out = summed.select("id", apply_linear(F.col("features"), OUTPUT).alias("o"))
    return out.select("id", *[rounded(F.col("o")[i], 5).alias(f"o{i}") for i in range(2)])


# Gradient by the output that the query below starts from.
PULL = (1.0, 2.0)
LINES, SUPPLIES = ("part", "line", "order"), ("supplier", "line", "order")


@query
def encoder_gradient(t: Tables) -> DataFrame:
    """Gradient of the sum of o0 + 2 o1 over all orders by every weight of the layer above, by the backward passes."""
    nodes = {
        "part": t.part.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1999.0).alias("features")),
        "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey") / 25.0, F.col("s_acctbal") / 10000.0).alias("features")),
        "order": t.orders.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice") / 100000.0, F.lit(1.0)).alias("features")),
    }
    edges = lambda c: t.lineitem.select(F.col(c).alias("src"), F.col("l_orderkey").alias("dst"), F.col("l_discount").alias("w"))
    graph = g.Graph(nodes, {LINES: edges("l_partkey"), SUPPLIES: edges("l_suppkey")})
    encoder = Encoder([{LINES: ATTENTION, SUPPLIES: ATTENTION_2}], {"order": OUTPUT})
    blocks = learn.build_edge_blocks(graph)
    layers, _ = learn.forward(blocks, encoder, learn.node_table(graph, blocks.kinds))
    pull = layers[-1].outputs.select("kind", "id", F.array(*map(F.lit, PULL)).alias("g"))
    grads = learn.backward(blocks, encoder, layers, pull)
    label = lambda key: f"{key[1] if key[0] == 'out' else key[1][0]}.{key[2]}"
    rows = [(label(key), k, float(v)) for key, value in grads.items() for k, v in enumerate(value.ravel())]
    return t.spark.createDataFrame(rows, "weight string, pos int, value double").withColumn("value", rounded(F.col("value"), 4) + 0.0)


def fixed_heads() -> Heads:
    """Heads and gates by formula, shared with the SQL counterpart."""
    heads = Heads({}, {})
    for s, (side, n) in enumerate(zip("XYZ", SHAPE)):
        heads.weight[side] = np.array([[math.cos(k + 2 * i + s) for i in range(8)] for k in range(n)])
        heads.gate[side] = np.array([0.3 * (k + 1) - 0.5 for k in range(n)])
    return heads


@query
def head_memberships(t: Tables) -> DataFrame:
    rows = memberships(key_embedding(t.orders, "o_orderkey"), fixed_heads(), "Y")
    return rows.select("id", F.posexplode("probs").alias("k", "p")).select("id", "k", rounded(F.col("p")).alias("p"))


STEP = Settings(clusters=SHAPE, lambda_collapse=0.3, entropy_weight=0.2, lam_g=0.05)


@query
def fit_step(t: Tables) -> DataFrame:
    """Loss and modularity of the fit at fixed heads; the terms are scaled up by the norm."""
    h = {"X": key_embedding(t.supplier, "s_suppkey"), "Y": key_embedding(t.orders, "o_orderkey"), "Z": key_embedding(t.part, "p_partkey")}
    blocks = build_blocks(t.links_xy(), t.links_yz(), h)
    e = evaluate(blocks, [(fixed_heads(), STEP, BETA, 1.5)])[0]
    blocks.release()
    row = (float(e.loss), e.q_obs * blocks.mnorm, e.q_exp * blocks.mnorm**3, *map(float, e.usage["Y"]))
    names = ["loss", "q_obs_m", "q_exp_m3", *[f"usage_{k}" for k in range(K_Y)]]
    return t.spark.createDataFrame([row], ", ".join(f"{n} double" for n in names)).select(*[rounded(F.col(n), 5).alias(n) for n in names])


@query
def anneal_schedule(t: Tables) -> DataFrame:
    """Levels of sharpness and resolution, and pruning epochs, of drawn trials."""
    trials = sweep.trial_space(t.supplier.select(F.col("s_suppkey").alias("trial")), sweep.SPACE_V1, sweep.FIXED_V1)
    plan = sweep.schedule_table(trials, 60)
    return plan.select("trial", "epoch", rounded(F.col("beta")).alias("beta"), rounded(F.col("gamma")).alias("gamma"), "prunes")
