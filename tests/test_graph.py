import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.functions.measure import POLYGONS
from plotweave.operators import components as cc, graph as g, propagate, ranks, zoning


def test_node_index_is_dense_and_ordered(spark):
    ids = [f"k{i:05d}" for i in np.random.default_rng(0).permutation(3000)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:50] + [None]], "key string").repartition(7)
    got = {r["key"]: r["node_id"] for r in g.node_index(df, "key").collect()}
    assert got == {k: i for i, k in enumerate(sorted(ids))}


def test_exact_median(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500))] + [(9, 4.0)]
    got = {r["g"]: r["median"] for r in ranks.exact_median(spark.createDataFrame(rows, "g long, v double"), "g", "v").collect()}
    assert got == {k: float(np.median([v for q, v in rows if q == k])) for k in {q for q, _ in rows}}


def test_dual_projection_and_factored_form(spark):
    rng = np.random.default_rng(2)
    n_b, n_p = 12, 7
    link = [(int(b), int(p)) for b, p in zip(rng.integers(0, n_b, 40), rng.integers(0, n_p, 40))]
    pp = {}
    for _ in range(8):
        a, b = map(int, rng.choice(n_p, 2, replace=False))
        pp[a, b] = pp[b, a] = float(rng.integers(0, 5))
    m = np.zeros((n_b, n_p))
    for b, p in link:
        m[b, p] += 1
    a_pp, structure = np.eye(n_p), np.eye(n_p)
    for (a, b), w in pp.items():
        a_pp[a, b], structure[a, b] = w, 1
    full, present = m @ a_pp @ m.T, m @ structure @ m.T > 0
    links = spark.createDataFrame(link, "src long, dst long")
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pp.items()], "src long, dst long, w double")
    got = {(r["src"], r["dst"]): r["w"] for r in g.dual_projection(links, edges).collect()}
    assert got == pytest.approx({(i, j): full[i, j] for i in range(n_b) for j in range(n_b) if i != j and present[i, j]})
    off = full - np.diag(np.diag(full))
    used = sorted({b for b, _ in link})
    assert {r["id"]: r["value"] for r in g.dual_apply(links, edges).collect()} == pytest.approx({b: off[b].sum() for b in used})
    x = rng.normal(size=n_b)
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, value double")
    assert {r["id"]: r["value"] for r in g.dual_apply(links, edges, values).collect()} == pytest.approx({b: (off @ x)[b] for b in used})


def test_integrity_and_required_parts(spark):
    edges = spark.createDataFrame([(1, 1, 1.0), (1, 9, 1.0), (8, 1, -1.0)], "src long, dst long, w double")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    row = g.edge_integrity(edges, ids, ids, "r").first()
    assert tuple(row) == ("r", 3, 1, 1, 1)
    with pytest.raises(KeyError):
        g.Graph({g.BUILDING: ids}).check()
    with pytest.raises(KeyError):
        g.Graph({k: ids for k in (g.ADDRESS, g.BUILDING, g.PARCEL)}).check()


def test_pick_weight(spark):
    df = spark.createDataFrame([([0.0, 2.0, 3.0],), ([0.0, 1.0, 1.0],)], "attr array<double>")
    assert sorted(r["w"] for r in g.pick_weight(df).collect()) == [2.0, 5.0]
    df = spark.createDataFrame([([4.0, 2.0],), ([0.0, 1.0],)], "attr array<double>")
    assert sorted(r["w"] for r in g.pick_weight(df).collect()) == [0.0, 4.0]


def test_components_of_a_long_path_and_a_hub(spark):
    order = np.random.default_rng(4).permutation(60)
    path = [(int(a), int(b)) for a, b in zip(order, order[1:])]
    hub = [(1000, 1000 + i) for i in range(1, 80)]
    got = {r["node"]: r["root"] for r in cc.components(spark.createDataFrame(path + hub, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{1000 + i: 1000 for i in range(80)}}


def test_zones_match_a_flood_fill(spark):
    rng = np.random.default_rng(8)
    # small blocks of 128 cells are crossed by spreading the cells over several of them
    cells = {(int(c), int(x), int(y)) for c, x, y in zip(rng.integers(0, 2, 900), rng.integers(-40, 40, 900) * 2 // 2, rng.integers(100, 160, 900))}
    cells |= {(0, x, 128) for x in range(-300, 300)}
    got = sorted((r["community"], r["n_cells"], r["zone"]) for r in zoning.zones(spark.createDataFrame(sorted(cells), "community long, cx long, cy long"), 10.0).collect())
    left, want = set(cells), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            c, x, y = stack.pop()
            part.add((c, x, y))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    n = (c, x + dx, y + dy)
                    if n in left:
                        left.remove(n)
                        stack.append(n)
        first = min(p[1:] for p in part)
        want.append((next(iter(part))[0], len(part), f"{next(iter(part))[0]}_{first[0]}_{first[1]}"))
    assert got == sorted(want)


def test_community_zones_leave_out_the_largest(spark):
    square = lambda x: [[[(x, 0.0), (x + 5, 0.0), (x + 5, 5.0), (x, 5.0), (x, 0.0)]]]
    rows = [("a", square(0.0)), ("b", square(50.0)), ("c", square(500.0)), ("d", square(900.0)), ("e", square(905.0))]
    b = spark.createDataFrame(rows, f"rnb_id string, polygons {POLYGONS.simpleString()}")
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2)], "id_bat string, community int")
    got = zoning.community_zones(b, labels).collect()
    assert len(got) == 1 and got[0]["community"] == 2 and got[0]["area"] == got[0]["n_cells"] * 100.0
    # both buildings form one zone of about (10+80) x (5+80)
    assert 6000 < got[0]["area"] < 7650


def test_propagation_splits_ids_and_keeps_unmatched_null(spark):
    soft = spark.createDataFrame([("B1/C1", [0.9, 0.1]), ("B2", [0.2, 0.8])], "rnb_id string, probs array<double>")
    links = spark.createDataFrame([("C1", "p", 1.0), ("B2", "p", 3.0), ("ghost", "p", 4.0), ("ghost", "q", 1.0), ("B2", "r", 0.0)], "rnb_id string, parcelle_id string, cover_ratio double")
    got = {r["parcelle_id"]: r for r in propagate.propagate_parcels(links, soft, 2).collect()}
    assert got["p"]["probs"] == pytest.approx([1.5 / 4, 2.5 / 4]) and got["p"]["cluster"] == 1
    assert got["q"]["cluster"] is None and got["r"]["cluster"] is None
    compat = {r["parcelle_id"]: r for r in propagate.propagate_parcels(links, soft, 2, compat=True).collect()}
    assert compat["p"]["probs"] == pytest.approx([1.5 / 8, 2.5 / 8]) and compat["q"]["cluster"] == 0
    plain = {r["parcelle_id"]: r for r in propagate.propagate_parcels(links.drop("cover_ratio"), soft, 2).collect()}
    assert plain["p"]["probs"] == pytest.approx([0.55, 0.45])
    addr = spark.createDataFrame([("B1", "a"), ("B2", "a"), ("ghost", "z")], "rnb_id string, ban_id string")
    out = {r["ban_id"]: r for r in propagate.propagate_addresses(addr, soft, 2).collect()}
    assert out["a"]["probs"] == pytest.approx([0.55, 0.45]) and out["a"]["cluster"] == 0 and out["z"]["cluster"] is None
    table = propagate.community_table(soft.withColumn("node_id", F.lit(1)))
    assert {r["id_bat"] for r in table.collect()} == {"B1", "C1", "B2"}


def test_dual_pairs_of_one_parcel_are_not_summed(spark):
    links = [(b, b % 5) for b in range(40)] + [(b, b % 5 + 1) for b in range(0, 40, 4)] + [(1, 1), (7, 2)]
    touch = [(p, p + 1, 0.5 + p) for p in range(5)] + [(3, 3, 9.0)]
    touch += [(q, p, w) for p, q, w in touch if p != q]
    want = {}
    for a, p in links:
        for p1, q, w in [*touch, *[(k, k, 1.0) for k in range(6)]]:
            if p1 == p and (p1 != q or w == 1.0):
                for b, p2 in links:
                    if p2 == q and a != b:
                        want[a, b] = want.get((a, b), 0.0) + w
    out = g.dual_projection(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame(touch, "src long, dst long, w double"))
    rows = out.collect()
    assert len(rows) == len(want) and {(r["src"], r["dst"]): r["w"] for r in rows} == pytest.approx(want)
    # the pairs that meet through one parcel come straight from the join
    assert out._jdf.queryExecution().analyzed().toString().startswith("Union")


def test_strength_meets_a_touching_pair_from_one_side(spark):
    links = [(b, p) for b in range(6) for p in range(b, 40, 3)] + [(2, 5), (2, 5), (None, 4), (3, None)]
    touch = [(p, q, 1.0 + p % 3) for p in range(40) for q in (p - 2, p - 1, p + 1, p + 2, p) if 0 <= q < 44] + [(1, 0, None), (7, 3, 2.5)]
    a, b = spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame(touch, "src long, dst long, w double")
    values = spark.createDataFrame([(k, float(k) if k != 4 else None) for k in range(5)], "id long, value double")
    w = {}
    for p, q, v in touch:
        w[p, q] = w.get((p, q), 0.0) + (v or 0.0)
    for given, x in ((None, dict.fromkeys([*range(6), None], 1.0)), (values, {1: 1.0, 2: 2.0, 3: 3.0})):
        want = {}
        for i, p in links:
            for j, q in links:
                if p is not None and q is not None:
                    # a building that has no id is none of the others
                    own = i == j and i is not None
                    want[i] = want.get(i, 0.0) + (0.0 if own else ((p == q) + (w.get((p, q), 0.0) if p != q else 0.0)) * x.get(j, 0.0))
        out = g.dual_apply(a, b, given)
        assert {r["id"]: r["value"] for r in out.collect()} == pytest.approx(want)
    # each touching pair meets the links from its lower side only, and that is joined once
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "least(src" in plan and "greatest(src" in plan


def test_pairs_with_a_building_of_one_parcel_are_not_shuffled(spark):
    links = spark.createDataFrame([(b, b % 7) for b in range(70)] + [(b, b % 7 + 1) for b in range(0, 70, 5)], "src long, dst long")
    touch = spark.createDataFrame([(p, q, 1.0) for p in range(8) for q in (p - 1, p + 1) if 0 <= q < 8], "src long, dst long, w double")
    out = g.dual_projection(links, touch)
    assert len({(r["src"], r["dst"]) for r in out.collect()}) == out.count()
    # what is summed, the last part, has buildings of several parcels on both sides
    union = out._jdf.queryExecution().analyzed()
    summed = union.children().apply(union.children().size() - 1)
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, summed).collectAsList()
    assert rows.size() and all(r.getLong(0) % 5 == 0 and r.getLong(1) % 5 == 0 for r in rows)


def test_the_least_row_is_shuffled_once(spark):
    from plotweave.functions.clean import first_per_key

    rows = [(1, "b", 2, [3]), (1, "a", 5, [1]), (1, "a", 5, None), (2, None, 1, [2]), (None, "z", 0, [0])]
    df = spark.createDataFrame(rows, "k long, s string, n long, l array<long>")
    plain = first_per_key(df, "k", "n")
    assert sorted(map(tuple, plain.collect()), key=str) == sorted([(1, "b", 2, [3]), (2, None, 1, [2]), (None, "z", 0, [0])], key=str)
    assert "min_by" not in plain._jdf.queryExecution().analyzed().toString()
    mapped = first_per_key(df.selectExpr("*", "map(s, n) as m").filter("s is not null"), "k")
    assert {r["k"]: r["m"] for r in mapped.collect()} == {1: {"a": 5}, None: {"z": 0}}
