"""Named queries over the benchmark tables, one or more per operator.

Every query reads whole tables. Doubles are rounded where two engines may differ in the last
digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotweave.functions import clean, measure
from plotweave.functions.geoarrays import from_wkb, to_wkb
from plotweave.functions.project import GRID_SRID, lambert93
from plotweave.functions.shapes import SHAPE_COLUMNS, with_shape_features
from plotweave.functions.vectors import argmax, fourier, softmax
from plotweave.operators import features, fusion, graph as g, knn, links, overlay, propagate, spatial, tripartite as tri, zoning
from plotweave.operators.encode import Attention, attention_pass
from plotweave.operators.fit import Settings, build_blocks, fit, history_table, memberships
from plotweave.plans import pipeline, raw, sweep
from plotweave.plans.fixtures import Tables, wave_logits
from plotweave.session import cut, scratch_path, size_shuffles, tune
from plotweave.sources import pages as html, tables as store

K_X, K_Y, K_Z = 4, 5, 3
SHAPE = (K_X, K_Y, K_Z)
BETA = 2.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Tables(size_shuffles(tune(spark), folder), folder))

    QUERIES[fn.__name__] = run
    return fn


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def soft(df: DataFrame, key: str, width: int) -> DataFrame:
    """Deterministic memberships `(id, probs)` of a key."""
    return df.select(F.col(key).alias("id"), softmax(wave_logits(F.col(key), width)).alias("probs"))


def soft_buildings(t: Tables) -> DataFrame:
    k = F.col("building")
    return t.buildings().select(k.alias("id"), "rnb_id", softmax(wave_logits(k, K_Y)).alias("probs"))


# --- sources, links, fusion ----------------------------------------------------------------


@query
def page_links(t: Tables) -> DataFrame:
    return html.page_links(t.pages)


def _area_code(number: Column) -> Column:
    """Areas 20 and 21 are the two halves of Corsica."""
    return F.when(number == 20, "2A").when(number == 21, "2B").otherwise(number.cast("string"))


def archive_pages(t: Tables) -> DataFrame:
    """Index pages with one archive link each, derived from the parts."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    href = F.concat(
        F.lit("/files/BDTOPO_3-"), (F.col("p_size") % 10).cast("string"), F.lit("_TOUSTHEMES_GPKG_LAMB93_D"),
        F.lpad(_area_code(F.col("p_partkey") % 97), 3, "0"), F.lit("_2025-"), two(F.col("p_size") % 12 + 1), F.lit("-15.7z"),
    )
    page = F.concat(F.lit('<p><!-- <a href="/old.7z"> --><a class="x" href="'), href, F.lit('">archive</a></p>'))
    return t.part.select(F.lit("https://data.example.org/topo").alias("url"), page.alias("html"))


@query
def page_links_pick(t: Tables) -> DataFrame:
    areas = t.nation.select(_area_code(F.col("n_nationkey")).alias("dep"))
    return html.pick_by_area(html.archive_links(archive_pages(t), "2025-09"), areas)


@query
def ingest_missing(t: Tables) -> DataFrame:
    requested = t.customer.select(F.col("c_nationkey").cast("string").alias("dep"))
    present = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").cast("string").alias("dep"))
    return store.missing_areas(requested, present)


@query
def manifest(t: Tables) -> DataFrame:
    dep = lambda c: clean.pad_code(F.col(c)).alias("dep")
    by_nation = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return store.manifest(
        {"bat": by_nation.select(dep("c_nationkey")), "ban": t.customer.select(dep("c_nationkey")), "parcelles": t.supplier.select(dep("s_nationkey"))}
    )


@query
def links_ban(t: Tables) -> DataFrame:
    return links.address_links(raw.rnb(t))


@query
def links_parcel(t: Tables) -> DataFrame:
    return links.parcel_links(raw.rnb(t)).withColumn("cover_ratio", rounded(F.col("cover_ratio")))


@query
def links_bdnb(t: Tables) -> DataFrame:
    return links.construction_links(raw.rnb(t))


@query
def building_fusion(t: Tables) -> DataFrame:
    fused = fusion.fuse_buildings(raw.building_layer(t), links.construction_links(raw.rnb(t)), raw.constructions(t), raw.groups(t))
    return fused.select("rnb_id", "batiment_construction_id", "batiment_groupe_id", *fusion.GROUP_COLUMNS)


@query
def parcel_zone_join(t: Tables) -> DataFrame:
    return spatial.zone_attributes(t.parcels(), t.zones(), "parcel", "zone", ["LIBELLE"]).select("parcel", F.coalesce("zone", F.lit(-1)).alias("zone"))


@query
def parcel_plu_labels(t: Tables) -> DataFrame:
    labelled = fusion.label_parcels(t.parcels(), t.zones())
    return labelled.select("parcel", F.col("LIBELLE").alias("libelle"), F.col("TYPEZONE").alias("typezone"))


@query
def area_table_roundtrip(t: Tables) -> DataFrame:
    """Per-area write, skip of areas already present, read back."""
    path = scratch_path(t.spark, "areas")
    people = t.customer.select(clean.pad_code(F.col("c_nationkey")).alias("dep"), "c_custkey", "c_acctbal")
    store.write_by_area(people.filter(F.col("dep") < "10"), path)
    store.ingest_missing(people.withColumn("c_acctbal", F.col("c_acctbal") + 1.0), path)
    back = t.spark.read.option("basePath", path).schema("c_custkey long, c_acctbal double, dep string").parquet(path)
    return back.groupBy("dep").agg(F.count("*").alias("n"), rounded(F.sum("c_acctbal"), 2).alias("total"))


# --- scalar preparation --------------------------------------------------------------------


@query
def decade_bins(t: Tables) -> DataFrame:
    year = clean.lenient_number(F.col("annee"))
    b = t.buildings()
    filled = F.coalesce(year, b.select(F.median(year)).scalar())
    return b.select("building", clean.decade_label(filled).alias("decennie"))


def feature_rows(t: Tables) -> DataFrame:
    return t.buildings().select(
        F.col("building").alias("id"), "hauteur", "polygons", F.col("annee").alias("ffo_bat_annee_construction"),
        F.col("usage").alias("bdtopo_bat_l_usage_1"), F.col("nb_log").alias("ffo_bat_nb_log"),
    )


@query
def scaled_features(t: Tables) -> DataFrame:
    names = ["area", "height", "volume", "year", "nb_logements"]
    rows = cut(features.building_columns(feature_rows(t)).select("id", *names), "scaled")
    z = features.scaled(rows, names)
    return rows.select(F.col("id").alias("building"), *[rounded(z[n]).alias(n) for n in names])


def hot_slots(c: Column, name: str) -> list[Column]:
    return [argmax(c).alias(f"{name}_slot"), F.aggregate(c, F.lit(0.0), lambda a, v: a + v).cast("long").alias(f"{name}_ones"), F.size(c).alias(f"{name}_width")]


@query
def onehot_building(t: Tables) -> DataFrame:
    rows = cut(features.building_columns(feature_rows(t)).select("id", "usage", "decennie"), "onehot")
    usage = features.one_hot(F.col("usage"), features.categories(rows, "usage"))
    decade = features.one_hot(F.col("decennie"), features.DECADE_LABELS)
    return rows.select(F.col("id").alias("building"), *hot_slots(usage, "usage"), *hot_slots(decade, "decade"))


@query
def onehot_parcel(t: Tables) -> DataFrame:
    rows = clean.plan_labels(t.part.select(F.col("p_partkey").alias("parcel"), F.col("p_type").alias("LIBELLE"), F.col("p_brand").alias("TYPEZONE")))
    hots = [(features.one_hot(F.col(c), features.categories(rows, c)), c.lower()) for c in ("LIBELLE", "TYPEZONE")]
    return rows.select("parcel", *[s for c, n in hots for s in hot_slots(c, n)])


@query
def fourier_features(t: Tables) -> DataFrame:
    rows = t.addresses()
    z = features.scaled(rows, ["lon", "lat"])
    f = rows.select("addr", fourier([z["lon"], z["lat"]]).alias("f"))
    return f.select("addr", *[rounded(F.col("f")[i]).alias(f"f{i}") for i in range(18)])


# --- geometry ------------------------------------------------------------------------------


@query
def geo_roundtrip(t: Tables) -> DataFrame:
    """Outlines to WKB and back, then area and perimeter in the JVM."""
    back = t.buildings().select("building", from_wkb(to_wkb(F.col("polygons"))).alias("p"))
    return back.select("building", rounded(measure.area(F.col("p"))).alias("area"), rounded(measure.perimeter(F.col("p"))).alias("perimeter"))


@query
def geo_table_roundtrip(t: Tables) -> DataFrame:
    """Parcels as a per-area geometry table, written and read back."""
    path = scratch_path(t.spark, "geo")
    store.write_geo_by_area(t.parcels().withColumn("dep", clean.pad_code(F.col("parcel") % 7)), path)
    back = with_shape_features(store.read_geo_table(t.spark, path, GRID_SRID))
    return back.groupBy(clean.pad_code(F.col("dep")).alias("dep")).agg(F.count("*").alias("n"), rounded(F.sum("area")).alias("area"))


@query
def lambert93_points(t: Tables) -> DataFrame:
    x, y = lambert93(F.col("lon"), F.col("lat"))
    return t.addresses().select("addr", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


@query
def shape_features(t: Tables) -> DataFrame:
    m = with_shape_features(t.buildings())
    return m.select("building", *[rounded(F.col(c)).alias(c) for c in ("area", *SHAPE_COLUMNS)])


@query
def parcel_touch(t: Tables) -> DataFrame:
    return spatial.touch_edges(t.parcels(), id_col="parcel").select("src", "dst", rounded(F.col("w")).alias("shared"))


@query
def edges_parcel_parcel_double(t: Tables) -> DataFrame:
    """Both directions of the symmetric pairs summed, which doubles each shared length."""
    one = spatial.touch_edges(t.parcels(), id_col="parcel")
    return g.undirected(one).select("src", "dst", rounded(F.col("w")).alias("w"))


@query
def knn_density(t: Tables) -> DataFrame:
    return knn.knn_density(t.points()).select("id", rounded(F.col("local_density"), 5).alias("local_density"))


@query
def knn_edges(t: Tables) -> DataFrame:
    return knn.knn_edges(t.points()).select("src", "dst")


@query
def clip_to_boundary(t: Tables) -> DataFrame:
    k = F.col("r_regionkey")
    regions = t.region.select(k, measure.rectangle(k * 0 + 100.5, k * 0 + 100.5, 500.0 + k * 100.0, 300.0 + k * 100.0).alias("polygons"))
    cut_out = overlay.clip(t.buildings().select("building", "polygons"), regions.filter(F.col("r_regionkey") == 1))
    return cut_out.select("building", rounded(measure.area(F.col("polygons"))).alias("area"))


def labelled_buildings(t: Tables) -> DataFrame:
    k = F.col("building")
    return t.buildings().select(k, argmax(softmax(wave_logits(k, K_Y))).alias("community"), "polygons")


@query
def zoning_cells(t: Tables) -> DataFrame:
    b = labelled_buildings(t)
    top = zoning.background_community(b).scalar()
    cells = zoning.zone_cells(b.filter(F.col("community") != top))
    return cells.groupBy("community").agg(F.count("*").alias("n_cells"), F.sum("cx").alias("sum_cx"), F.sum("cy").alias("sum_cy"))


@query
def community_zones(t: Tables) -> DataFrame:
    b = labelled_buildings(t)
    # a smaller reach than a street block, so that zones stay apart
    return zoning.community_zones(
        b.select(F.col("building").alias("rnb_id"), "polygons"), b.select(F.col("building").alias("id_bat"), "community"), 2.0, 2.0
    )


# --- graph ---------------------------------------------------------------------------------


def node_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = lambda df, key, letter, name: df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias(name))
    return (
        g.node_index(named(t.orders, "o_orderkey", "B", "rnb_id"), "rnb_id"),
        g.node_index(named(t.part, "p_partkey", "P", "parcelle_id"), "parcelle_id"),
        g.node_index(named(t.customer, "c_custkey", "A", "ban_id"), "ban_id"),
    )


@query
def node_index(t: Tables) -> DataFrame:
    return node_tables(t)[0]


@query
def edges_building_parcel(t: Tables) -> DataFrame:
    b, p, _ = node_tables(t)
    return g.building_parcel_edges(links.parcel_links(raw.rnb(t)), b, p).withColumn("w", rounded(F.col("w")))


@query
def edges_address_building(t: Tables) -> DataFrame:
    b, _, a = node_tables(t)
    return g.address_building_edges(links.address_links(raw.rnb(t)), a, b)


@query
def edge_weight_pick(t: Tables) -> DataFrame:
    e = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array("l_discount", "l_quantity").alias("a"), F.array(F.lit(0.0), "l_quantity", "l_tax").alias("b")
    )
    one = g.pick_weight(e, "a").withColumnRenamed("w", "w_first")
    return g.pick_weight(one, "b").select("l_orderkey", "l_linenumber", "l_partkey", "w_first", rounded(F.col("w")).alias("w_sum"))


def order_links(t: Tables) -> DataFrame:
    """Few buildings per parcel: an order on the plot of its customer."""
    return t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))


def terrace(t: Tables) -> DataFrame:
    """Plots in one row, each touching the next."""
    k = F.col("c_custkey")
    ahead = t.customer.select(k.alias("src"), (k + 1).alias("dst")).join(t.customer.select(k.alias("dst")), "dst").select("src", "dst")
    return g.undirected(ahead.withColumn("w", F.col("src") % 7 + 1.0))


@query
def dual_projection(t: Tables) -> DataFrame:
    return g.dual_projection(order_links(t), terrace(t))


@query
def dual_strength(t: Tables) -> DataFrame:
    """Row sums of the dual projection over all lines, factor by factor."""
    own = t.parcel_links().select(F.col("building").alias("src"), F.col("parcel").alias("dst"))
    out = g.dual_apply(own, spatial.touch_edges(t.parcels(), id_col="parcel"))
    return out.select(F.col("id").alias("building"), rounded(F.col("value")).alias("strength"))


@query
def edge_integrity(t: Tables) -> DataFrame:
    e = t.parcel_links().select(F.col("building").alias("src"), F.col("parcel").alias("dst"), (F.col("cover_ratio") - 0.05).alias("w"))
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    rich = t.part.filter("p_retailprice >= 1000")
    return g.edge_integrity(e, ids(t.orders, "o_orderkey"), ids(rich, "p_partkey"), "-".join(g.BELONGS))


@query
def graph_stats(t: Tables) -> DataFrame:
    nodes = {g.ADDRESS: t.customer, g.BUILDING: t.orders, g.PARCEL: t.part}
    return g.graph_stats(g.Graph(nodes, {g.ACCESS: t.address_links(), g.BELONGS: t.parcel_links()}))


# --- memberships and propagation -----------------------------------------------------------


@query
def soft_membership(t: Tables) -> DataFrame:
    rows = soft(t.orders, "o_orderkey", K_Y).select("id", F.posexplode("probs").alias("k", "p"))
    return rows.select("id", "k", rounded(F.col("p")).alias("p"))


@query
def hard_communities(t: Tables) -> DataFrame:
    return propagate.hard_communities(soft_buildings(t)).select("id", "community")


@query
def community_sizes(t: Tables) -> DataFrame:
    return propagate.community_sizes(propagate.hard_communities(soft_buildings(t)))


@query
def background_cluster(t: Tables) -> DataFrame:
    return zoning.background_community(propagate.hard_communities(soft_buildings(t)))


@query
def community_explode(t: Tables) -> DataFrame:
    return propagate.community_table(soft_buildings(t).withColumnRenamed("id", "node_id"))


@query
def membership_usage(t: Tables) -> DataFrame:
    return propagate.membership_usage(soft_buildings(t), K_Y).withColumn("usage", rounded(F.col("usage")))


@query
def prune_mask(t: Tables) -> DataFrame:
    usage = propagate.membership_usage(soft(t.customer, "c_custkey", K_Y), K_Y)
    return tri.prune_mask(usage, min_usage=0.2).withColumn("usage", rounded(F.col("usage")))


def _probabilities(df: DataFrame, key: str) -> DataFrame:
    wide = propagate.probability_columns(df, K_Y)
    return wide.select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"), *[rounded(F.col(f"proba_{k}")).alias(f"proba_{k}") for k in range(K_Y)])


def partial_soft(t: Tables) -> DataFrame:
    """Memberships of the buildings, with every eleventh building unknown."""
    return soft_buildings(t).filter(F.col("id") % 11 != 0).select("rnb_id", "probs")


@query
def propagate_addresses(t: Tables) -> DataFrame:
    b = t.buildings().select("building", "rnb_id")
    own = t.address_links().join(b, "building").select(F.col("addr").alias("ban_id"), "rnb_id")
    return _probabilities(propagate.propagate_addresses(own, partial_soft(t), K_Y), "ban_id")


def parcel_link_ids(t: Tables) -> DataFrame:
    b = t.buildings().select("building", "rnb_id")
    return t.parcel_links().join(b, "building").select(F.col("parcel").alias("parcelle_id"), "rnb_id", "cover_ratio")


@query
def propagate_parcels(t: Tables) -> DataFrame:
    return _probabilities(propagate.propagate_parcels(parcel_link_ids(t), partial_soft(t), K_Y), "parcelle_id")


@query
def propagate_parcels_compat(t: Tables) -> DataFrame:
    """The mean divided by the weight of all links, matched or not."""
    return _probabilities(propagate.propagate_parcels(parcel_link_ids(t), partial_soft(t), K_Y, compat=True), "parcelle_id")


# --- tripartite modularity -----------------------------------------------------------------


@query
def pivot_degrees(t: Tables) -> DataFrame:
    return tri.pivot_degrees(t.links_xy(), t.links_yz()).select(F.col("pivot").alias("building"), rounded(F.col("dx")).alias("dx"), rounded(F.col("dz")).alias("dz"))


@query
def antihub_weights(t: Tables) -> DataFrame:
    w = tri.antihub_weights(tri.pivot_degrees(t.links_xy(), t.links_yz()))
    return w.select(F.col("pivot").alias("building"), F.round(F.col("omega") * 1e6, 6).alias("omega_ppm"))


def pivots(t: Tables) -> DataFrame:
    sx, sy, sz = soft(t.supplier, "s_suppkey", K_X), soft(t.orders, "o_orderkey", K_Y), soft(t.part, "p_partkey", K_Z)
    return tri.pivot_table(t.links_xy(), t.links_yz(), sx, sy, sz, SHAPE)


@query
def cross_tables(t: Tables) -> DataFrame:
    return tri.cross_tables(pivots(t), SHAPE).withColumn("value", rounded(F.col("value")))


@query
def tripartite_modularity(t: Tables) -> DataFrame:
    """Observed and expected terms, scaled up by the norm so that rounding keeps them."""
    mnorm = float(tri.norm(tri.pivot_degrees(t.links_xy(), t.links_yz())).first()[0])
    s = tri.modularity(cut(pivots(t), "pivots"), mnorm, SHAPE, BETA)
    return t.spark.createDataFrame([(round(mnorm, 3), s.q_obs * mnorm, s.q_exp * mnorm**3)], "mnorm double, q_obs double, q_exp double").select(
        "mnorm", rounded(F.col("q_obs")).alias("q_obs_m"), rounded(F.col("q_exp")).alias("q_exp_m3")
    )


@query
def collapse_penalty(t: Tables) -> DataFrame:
    return tri.collapse_penalty(soft_buildings(t), K_Y).select(rounded(F.col("penalty"), 8).alias("penalty"))


@query
def membership_entropy(t: Tables) -> DataFrame:
    return tri.membership_entropy(soft_buildings(t)).select(rounded(F.col("neg_entropy"), 8).alias("neg_entropy"))


# Fixed small weights of the attention query, shared with its SQL counterpart.
ATTENTION = Attention(
    left=np.array([[0.5, -0.25], [0.75, 1.0]]),
    left_bias=np.array([0.1, -0.2]),
    right=np.array([[1.0, 0.5], [-0.5, 0.25]]),
    right_bias=np.array([0.0, 0.3]),
    edge=np.array([[2.0], [-1.0]]),
    score=np.array([1.5, -0.5]),
    bias=np.array([0.05, -0.05]),
)


@query
def attention(t: Tables) -> DataFrame:
    src = t.part.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1999.0).alias("features"))
    dst = t.orders.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice") / 100000.0, F.lit(1.0)).alias("features"))
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"), F.array("l_discount").alias("attr"))
    out = attention_pass(src, dst, e, ATTENTION)
    return out.select("id", *[rounded(F.col("h")[i]).alias(f"h{i}") for i in range(2)])


def key_embedding(df: DataFrame, key: str, dim: int = 8) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.array(*[F.cos(F.lit(0.1 * (i + 1)) * F.col(key)) for i in range(dim)]).alias("features"))


def line_blocks(t: Tables):
    h = {"X": key_embedding(t.supplier, "s_suppkey"), "Y": key_embedding(t.orders, "o_orderkey"), "Z": key_embedding(t.part, "p_partkey")}
    return build_blocks(t.links_xy(), t.links_yz(), h), h


FIT = Settings(
    clusters=(8, 8, 8), epochs=4, lr=0.05, beta=(2.0, 4.0, 2), gamma=(1.0, 2.0, 2), prune_every=2, prune_delay_epoch=2, min_usage=0.05, entropy_weight=0.1
)


@query
def fit_communities(t: Tables) -> DataFrame:
    blocks, h = line_blocks(t)
    result = fit(blocks, FIT)
    blocks.release()
    return propagate.hard_communities(memberships(h["Y"], result.best, "Y")).select("id", "community")


@query
def fit_history(t: Tables) -> DataFrame:
    """Loss, modularity, cluster counts and the annealing levels per epoch."""
    blocks, _ = line_blocks(t)
    result = fit(blocks, FIT)
    blocks.release()
    return history_table(t.spark, [result])


# --- sweep ---------------------------------------------------------------------------------


@query
def trial_space(t: Tables) -> DataFrame:
    """Both search spaces, one trial per customer."""
    trials = t.customer.select(F.col("c_custkey").alias("trial"))
    one = sweep.trial_space(trials, sweep.SPACE_V1)
    two = sweep.trial_space(trials, {f"v2_{k}": v for k, v in sweep.SPACE_V2.items()})
    both = one.join(two, "trial")
    doubles = [f.name for f in both.schema.fields if f.dataType.simpleString() == "double"]
    return both.select(*[rounded(F.col(c), 8).alias(c) if c in doubles else F.col(c) for c in both.columns])


@query
def trial_score(t: Tables) -> DataFrame:
    q, n = F.col("c_acctbal") / 10000.0, F.col("c_custkey") % 70
    q = F.when(F.col("c_custkey") % 13 != 0, q)
    return t.customer.select(
        F.col("c_custkey").alias("trial"), *[rounded(sweep.score(q, n, v), 6).alias(f"score_v{v}") for v in (1, 2)]
    )


def event_history(t: Tables) -> DataFrame:
    value = F.col("value") * (1 + F.col("user_id") % 5)
    return t.events.select(F.col("user_id").alias("trial"), (F.col("event_id") % 40).alias("step"), value.alias("value"))


@query
def trial_prune(t: Tables) -> DataFrame:
    return sweep.median_stops(event_history(t), warmup=20)


@query
def best_trial(t: Tables) -> DataFrame:
    scored = t.customer.select(
        F.col("c_custkey").alias("trial"), F.col("c_nationkey").alias("clusters"), rounded(sweep.score(F.col("c_acctbal"), F.col("c_custkey") % 70, 1)).alias("score")
    )
    return sweep.best_trial(scored)


# --- end to end ----------------------------------------------------------------------------


def inputs_of(t: Tables) -> pipeline.Inputs:
    """Raw sources in which a building stands on one or two touching parcels."""
    return pipeline.build_inputs(
        raw.rnb(t, local=True), raw.building_layer(t), raw.constructions(t), raw.groups(t), raw.parcel_layer(t), t.zones(), raw.ban(t)
    )


@query
def pipeline_graph(t: Tables) -> DataFrame:
    """Edges and summed weights of the five relations, and the nodes, as built from the raw sources."""
    graph = pipeline.build_graph(inputs_of(t)).graph
    weight = lambda df: F.sum("w") if "w" in df.columns else F.lit(0.0)
    rows = [df.agg(F.count("*").alias("n"), F.lit(0.0).alias("w")).select(F.lit(kind).alias("name"), "n", "w") for kind, df in graph.nodes.items()]
    rows += [df.agg(F.count("*").alias("n"), rounded(weight(df), 4).alias("w")).select(F.lit("-".join(k)).alias("name"), "n", "w") for k, df in graph.edges.items()]
    return reduce(DataFrame.union, rows)


@query
def pipeline_parcels(t: Tables) -> DataFrame:
    """Raw sources to parcel clusters: join, build the graph with all five relations, encode, fit, propagate."""
    found = inputs_of(t)
    built = pipeline.build_graph(found)
    settings = Settings(clusters=(8, 8, 8), epochs=3, lr=0.01)
    probs, _ = pipeline.fit_communities(built, settings, width=16, hidden=16)
    return pipeline.export_tables(found, probs, 8).parcels.select("parcelle_id", "cluster")
