"""SQL counterparts of the queries in `roundtrips`."""

from __future__ import annotations

import math

import numpy as np

from plotweave.plans import roundtrips as rt, sweep
from plotweave.plans.oracles import ADDRESS, BETA, BUILDING, CROSS, DECADE, DEGREE, HARD_Y, K_X, K_Y, K_Z, MEASURED, SOFT_Y, XY, YZ, wide

ORACLES: dict[str, str] = {}

ORACLES["csv_by_name"] = """select c_custkey, c_acctbal, c_name, concat('a;"b', c_custkey, '"', chr(10), 'c') as note from customer"""
ORACLES["zip_by_name"] = "select c_custkey, c_name, c_nationkey from customer"
ORACLES["geojson_features"] = "select concat('P', p_partkey) as id, 200e0 as area, 1 as parts from part"
ORACLES["discover_files"] = "select distinct lpad(cast(c_nationkey as varchar), 2, '0') as dep from customer"
ORACLES["replace_table"] = "select n_nationkey, upper(n_name) as n_name from nation"
ORACLES["graph_package"] = """select 'node' as kind, 'address' as name, count(*) as n from customer union all select 'node', 'building', count(*) from orders
union all select 'node', 'parcel', count(*) from part union all select 'edge', 'address-access-building', count(*) from orders
union all select 'edge', 'building-belongs-parcel', count(*) from lineitem union all select 'index', 'building', count(*) from orders"""

_IDS = "ids as (select building, unnest(string_split(rnb_id, '/')) as id_bat from v_building)"
ORACLES["labels_roundtrip"] = f"with {BUILDING}, {SOFT_Y}, {HARD_Y}, {_IDS} select id_bat, community from ids join hy on id = building"
ORACLES["unknown_ids"] = f"""with {BUILDING}, {SOFT_Y}, {HARD_Y}, {_IDS} select id_bat, community from ids join hy on id = building where building % 7 <> 0
union all select concat('unk_', building), community from v_building join hy on id = building where building % 7 = 0"""
ORACLES["building_probabilities"] = f"""with {BUILDING}, {SOFT_Y} select rnb_id, {', '.join(f'round(max(case when k = {k} then p end), 6) as proba_{k}' for k in range(K_Y))}
from v_building join sy on id = building group by rnb_id"""
ORACLES["community_summary"] = f"""with {SOFT_Y}, {HARD_Y}, s as (select community, count(*) as n from hy group by community)
select count(*) as clusters, min(n) as least, cast(median(n) as double) as middle, max(n) as most from s"""

# memberships of the buildings but every eleventh, by single id, and the links by single id
_KNOWN = f"""{BUILDING}, {SOFT_Y}, {_IDS}, known as (select id_bat, k, p from ids join sy on id = building where building % 11 <> 0)"""


def _mean(links: str, key: str, weight: str) -> str:
    """Long means (key, k, p) over links (key, building, w), NULL where nothing matches."""
    return f"""l as ({links}), s as (select l.{key}, ids.id_bat, l.w from l join ids using (building)),
 kk as (select unnest(range({K_Y})) as k), g as (select distinct {key} from l),
 m as (select s.{key}, k, sum(p*{weight})/nullif(sum({weight}), 0) as p from s join known using (id_bat) group by 1, 2),
 v as (select g.{key}, kk.k, m.p from g cross join kk left join m on m.{key} = g.{key} and m.k = kk.k)"""


_PLAIN = _mean("select l_partkey as parcelle_id, l_orderkey as building, l_discount*10e0 as w from lineitem", "parcelle_id", "1e0")
_COVER = _mean("select l_partkey as parcelle_id, l_orderkey as building, l_discount*10e0 as w from lineitem", "parcelle_id", "w")
_ADDRESS = _mean("select o_custkey as ban_id, o_orderkey as building, 1e0 as w from orders", "ban_id", "w")
ORACLES["propagate_parcels_plain"] = f"with {_KNOWN}, {_PLAIN} {wide('parcelle_id', 'v', K_Y)}"


def _total(name: str, key: str, body: str) -> str:
    return f"""select '{name}' as name, count(*) as n, cast(sum(cluster) as bigint) as total from (with {_KNOWN}, {body}
 select {key}, max(case when r = 1 and p is not null then k end) as cluster from (select *, row_number() over (partition by {key} order by p desc nulls last, k) as r from v) q group by {key}) t"""


ORACLES["results_tables"] = f"""select 'communities' as name, count(*) as n, cast(sum(community) as bigint) as total
from (with {BUILDING}, {SOFT_Y}, {HARD_Y}, {_IDS} select community from ids join hy on id = building where building % 11 <> 0) c
union all {_total('parcels', 'parcelle_id', _COVER)} union all {_total('addresses', 'ban_id', _ADDRESS)}"""

# --- preparation ---------------------------------------------------------------------------

GRID = f"""{ADDRESS}, g as (select addr, radians(lon) as lam, radians(lat) as phi from v_address),
 r as (select addr, 0.7256077650532695e0*(lam - radians(3e0)) as th, 11754255.426096004e0*pow(tan(pi()/4 - phi/2)
   /pow((1 - 0.08181919104281579e0*sin(phi))/(1 + 0.08181919104281579e0*sin(phi)), 0.08181919104281579e0/2), 0.7256077650532695e0) as rho from g),
 grid as (select addr, 700000e0 + rho*sin(th) as x, 6600000e0 + 6055612.049875985e0 - rho*cos(th) as y from r)"""
ORACLES["placed_addresses"] = f"with {GRID} select concat('A', addr) as ban_id, round(x, 3) as x, round(y, 3) as y from grid"
ORACLES["sparse_columns"] = f"""with {BUILDING} select building, round(w*h - case when notch then (w/2)*(h/2) else 0e0 end, 6) as area,
 -1e0 as height, 0e0 as volume, 0e0 as nb_logements, 'Inconnu' as usage, 'Inconnu' as decennie from v_building"""
ORACLES["plots_without_ratio"] = """select concat('B', l_orderkey) as rnb_id, concat('P', l_partkey) as parcelle_id,
 case when l_linenumber <= 3 then 0e0 else 0.5e0 end as cover_ratio from lineitem"""

# --- geometry ------------------------------------------------------------------------------

_CENTRE = f"""{BUILDING}, c as (select building, case when notch then (w*h*(x0 + w/2) - (w/2)*(h/2)*(x0 + 3*w/4))/(w*h - w*h/4) else x0 + w/2 end as cx,
 case when notch then (w*h*(y0 + h/2) - (w/2)*(h/2)*(y0 + 3*h/4))/(w*h - w*h/4) else y0 + h/2 end as cy from v_building)"""
ORACLES["boundary_union"] = f"""with {_CENTRE} select distinct building from c join region on cx between 100.3e0 + r_regionkey*60e0 and 250.3e0 + r_regionkey*60e0
 and cy between 100.3e0 + r_regionkey*40e0 and 200.3e0 + r_regionkey*40e0"""
ORACLES["repaired_parts"] = f"""with {BUILDING} select building, cast(2 as bigint) as parts, cast(5 as bigint) as corners, round(w*w, 6) as area, round(4*w, 6) as perimeter from v_building"""

# disjoint rectangles that make up the areas of the query
_AREAS = ((150.25, 150.25, 350.25, 200.25), (150.25, 200.25, 200.25, 300.25), (400.5, 200.5, 430.5, 300.5), (460.5, 200.5, 500.5, 300.5), (430.5, 200.5, 460.5, 230.5),
          (430.5, 270.5, 460.5, 300.5), (550.5, 300.5, 650.5, 350.5), (650.5, 320.5, 700.5, 400.5), (600.5, 350.5, 650.5, 400.5))
_common = lambda b, r: f"greatest(least({b[2]}, {r[2]!r}e0) - greatest({b[0]}, {r[0]!r}e0), 0)*greatest(least({b[3]}, {r[3]!r}e0) - greatest({b[1]}, {r[1]!r}e0), 0)"
_whole, _gone = (" + ".join(_common(b, r) for r in _AREAS) for b in (("x0", "y0", "x0+w", "y0+h"), ("x0+w/2", "y0+h/2", "x0+w", "y0+h")))
ORACLES["clip_to_outline"] = f"""with {BUILDING}, c as (select building, {_whole} - case when notch then {_gone} else 0e0 end as area from v_building)
select building, round(area, 6) as area from c where area > 1e-9"""

ORACLES["union_outlines"] = """with b as (select p_partkey % 7 as grp, p_partkey*37 % 211 as x0, p_partkey*53 % 157 as y0, 1 + p_partkey % 9 as w, 1 + p_partkey % 5 as h from part),
 c as (select grp, x0 + unnest(range(w)) as x, y0, h from b), u as (select distinct grp, x, y0 + unnest(range(h)) as y from c),
 n as (select u.grp, u.x, u.y, (a.grp is null)::int + (b2.grp is null)::int + (d.grp is null)::int + (e.grp is null)::int as open from u
   left join u a on a.grp = u.grp and a.x = u.x - 1 and a.y = u.y left join u b2 on b2.grp = u.grp and b2.x = u.x + 1 and b2.y = u.y
   left join u d on d.grp = u.grp and d.x = u.x and d.y = u.y - 1 left join u e on e.grp = u.grp and e.x = u.x and e.y = u.y + 1)
select cast(grp as bigint) as grp, count(*)*1e0 as area, sum(open)*1e0 as perimeter, count(*)*1e0 as shape_area, sum(open)*1e0 as shape_perimeter from n group by grp"""

# a corner is sixteen chords: half their sine in area, twice that of half the angle in length, per unit
_arc_area, _arc_length = 32 * math.sin(math.pi / 32), 128 * math.sin(math.pi / 64)
ORACLES["zone_outlines"] = f"""with {BUILDING}, {SOFT_Y}, {HARD_Y}, top as (select community from (select community, count(*) as n from hy group by community) q order by n desc, community limit 1),
 z as (select community, w*h + 2*(w + h)*{rt.REACH!r}e0 + {rt.REACH**2 * _arc_area!r}e0 as a, 2*(w + h) + {rt.REACH * _arc_length!r}e0 as p
   from v_building join hy on id = building where community <> (select community from top))
select cast(community as bigint) as community, count(*) as rings, round(avg(a), 1) as area, round(avg(a), 1) as ring_area, round(avg(p), 1) as perimeter from z group by community"""

ORACLES["valid_outlines"] = f"""with {BUILDING} select building, cast(case building % 4 when 0 then 2 when 2 then 2 else 1 end as bigint) as parts,
 round(case building % 4 when 0 then w*h/2 when 1 then w*h when 2 then w*h + 1 else 2*w*h end, 6) as area,
 round(case building % 4 when 0 then 2*h + 2*sqrt(w*w + h*h) when 1 then 2*(w + h) when 2 then 2*(w + h) + 4 else 2*(2*w + h) end, 6) as perimeter from v_building"""

NEAR_BUILDINGS = f"""{BUILDING}, reach as (select 8*sqrt(790e0*490e0/count(*)) as d from v_building),
 cells as (select building as id, x0 as x, y0 as y, cast(floor(x0/(select d from reach)) as bigint) as gx, cast(floor(y0/(select d from reach)) as bigint) as gy from v_building),
 moves as (select dx, dy from (select unnest([-1, 0, 1]) as dx) a cross join (select unnest([-1, 0, 1]) as dy) b),
 near as (select a.id as dst, b.id as src, sqrt((a.x - b.x)*(a.x - b.x) + (a.y - b.y)*(a.y - b.y)) as d
   from (select cells.*, gx + dx as hx, gy + dy as hy from cells cross join moves) a join cells b on b.gx = a.hx and b.gy = a.hy where a.id <> b.id),
 ranked as (select *, row_number() over (partition by dst order by d, src) as r from near where d <= (select d from reach))"""
ORACLES["knn_buildings"] = f"with {NEAR_BUILDINGS} select src, dst from ranked where r <= 8"

# --- node vectors --------------------------------------------------------------------------


def _score(column: str, table: str) -> str:
    return f"coalesce(({column} - (select avg({column}) from {table}))/coalesce(nullif((select stddev_pop({column}) from {table}), 0), 1), 0)"


def _shapes(area: str, perimeter: str, hull: str, short: str, long: str) -> dict[str, str]:
    return {
        "compactness": f"4*pi()*({area})/(pow({perimeter}, 2) + 1e-6)",
        "convexity": f"({area})/(({hull}) + 1e-6)",
        "elongation": f"1 - ({short})/(({long}) + 1e-6)",
        "fractality": f"2*ln(({perimeter}) + 1e-6)/ln(({area}) + 1e-6)",
    }


def _hot(column: str, values: str) -> str:
    return f"list_transform({values}, lambda v: case when v = {column} then 1e0 else 0e0 end)"


def _long(vectors: str, digits: int) -> str:
    return f"select id, unnest(range(len(f))) as slot, round(unnest(f), {digits}) as value from ({vectors}) q"


_area = "w*h - case when notch then (w/2)*(h/2) else 0e0 end"
_building_shapes = _shapes(_area, "2*(w+h)", "w*h - case when notch then (w/2)*(h/2)/2 else 0e0 end", "least(w, h)", "greatest(w, h)")
_shape_list = lambda table: ", ".join(_score(c, table) for c in rt.features.SHAPE_COLUMNS)
_decades = "[" + ", ".join(f"'{d}'" for d in rt.features.DECADE_LABELS) + "]"
ORACLES["building_vectors"] = f"""with {NEAR_BUILDINGS.replace(BUILDING + ',', MEASURED + ',')},
 dense as (select dst as building, 1/(avg(d) + 1e-6) as local_density from ranked where r <= 16 group by dst),
 raw as (select n.*, dense.local_density, {', '.join(f'{e} as {c}' for c, e in _building_shapes.items())}, coalesce(usage, 'Inconnu') as use, {DECADE} as decennie
   from v_num n join dense using (building) join (select building, w, h, notch, usage, year as yr from v_year) y using (building)),
 uses as (select list(use order by use) as v from (select distinct use from raw) q)
{_long(f'''select building as id, list_concat([{', '.join(_score(c, 'raw') for c in ('area', 'height', 'volume', 'year', 'nb_logements', 'local_density'))}],
 {_hot('use', '(select v from uses)')}, {_hot('decennie', _decades)}, [{_shape_list('raw')}]) as f from raw''', 4)}"""

_parcel_shapes = _shapes("w*h", "2*(w+h)", "w*h", "least(w, h)", "greatest(w, h)")
ORACLES["parcel_vectors"] = f"""with b as (select p_partkey as id, 3e0 + p_partkey % 11 as w, 2e0 + p_partkey % 7 as h, p_type as l, p_brand as t from part),
 raw as (select *, w*h as area, {', '.join(f'{e} as {c}' for c, e in _parcel_shapes.items())} from b),
 ls as (select list(l order by l) as v from (select distinct l from raw) q), ts as (select list(t order by t) as v from (select distinct t from raw) q)
{_long(f'''select id, list_concat([{_score('area', 'raw')}], {_hot('l', '(select v from ls)')}, {_hot('t', '(select v from ts)')}, [{_shape_list('raw')}]) as f from raw''', 4)}"""

_waves = ", ".join(f"{f}({2.0**k!r}e0*{c})" for k in range(4) for f in ("sin", "cos") for c in ("zx", "zy"))
ORACLES["address_vectors"] = f"""with {GRID}, z as (select addr as id, {_score('x', 'grid')} as zx, {_score('y', 'grid')} as zy from grid)
{_long(f'select id, [zx, zy, {_waves}] as f from z', 4)}"""

# --- encoder, heads, fit -------------------------------------------------------------------


def _attention(name: str, weights, source: str) -> str:
    """Mean rows (dst, m0, m1) of one relation into the orders; `source` gives dst, x0, x1, r0x, a."""
    n = lambda v: f"({float(v)!r}e0)"
    left = [f"{n(weights.left[k][0])}*x0 + {n(weights.left[k][1])}*x1 + {n(weights.left_bias[k])}" for k in range(2)]
    right = [f"{n(weights.right[k][0])}*o + {n(weights.right[k][1])} + {n(weights.right_bias[k])}" for k in range(2)]
    return f"""{name}_n as (select dst, {left[0]} as l0, {left[1]} as l1, {right[0]} as r0, {right[1]} as r1, a from ({source}) q),
 {name}_t as (select *, l0 + r0 + {n(weights.edge[0][0])}*a as t0, l1 + r1 + {n(weights.edge[1][0])}*a as t1 from {name}_n),
 {name}_e as (select dst, l0, l1, exp({n(weights.score[0])}*case when t0 > 0 then t0 else 0.2e0*t0 end + {n(weights.score[1])}*case when t1 > 0 then t1 else 0.2e0*t1 end) as u from {name}_t),
 {name} as (select o_orderkey as id, coalesce(sum(u*l0)/sum(u), 0) + {n(weights.bias[0])} as m0, coalesce(sum(u*l1)/sum(u), 0) + {n(weights.bias[1])} as m1
   from orders left join {name}_e on dst = o_orderkey group by o_orderkey)"""


_lines = lambda key, table, own, x0, x1: f"select l_orderkey as dst, {x0} as x0, {x1} as x1, o_totalprice/100000e0 as o, l_discount as a from lineitem join {table} on {key} = {own} join orders on l_orderkey = o_orderkey"
_out = [f"round({float(rt.OUTPUT.weight[k][0])!r}e0*h0 + ({float(rt.OUTPUT.weight[k][1])!r}e0)*h1 + ({float(rt.OUTPUT.bias[k])!r}e0), 5) as o{k}" for k in range(2)]
ORACLES["encoder_layer"] = f"""with {_attention('pa', rt.ATTENTION, _lines('l_partkey', 'part', 'p_partkey', 'p_size/50e0', 'p_retailprice/1999e0'))},
 {_attention('su', rt.ATTENTION_2, _lines('l_suppkey', 'supplier', 's_suppkey', 's_nationkey/25e0', 's_acctbal/10000e0'))},
 h as (select pa.id, greatest(pa.m0 + su.m0, 0) as h0, greatest(pa.m1 + su.m1, 0) as h1 from pa join su using (id))
select id, {', '.join(_out)} from h"""


def _gradient(name: str, weights, source: str) -> str:
    """Gradients by the weights of one relation, as `{name}_g (weight, pos, value)`; `h` has the sums cut at zero."""
    n = lambda v: f"({float(v)!r}e0)"
    side = lambda m, b, k, x: f"{n(m[k][0])}*{x[0]} + {n(m[k][1])}*{x[1]} + {n(b[k])}"
    lines = ", ".join([f"{side(weights.left, weights.left_bias, k, ('x0', 'x1'))} as l{k}" for k in range(2)] + [f"{side(weights.right, weights.right_bias, k, ('o', '1'))} as r{k}" for k in range(2)])
    total = ", ".join(f"l{k} + r{k} + {n(weights.edge[k][0])}*a as t{k}" for k in range(2))
    active = ", ".join(f"case when t{k} > 0 then t{k} else 0.2e0*t{k} end as y{k}" for k in range(2))
    d_total = ", ".join(f"ds*{n(weights.score[k])}*case when t{k} > 0 then 1 else 0.2e0 end as d{k}" for k in range(2))
    named = [(f"left.{2 * k + i}", f"(al*q{k} + d{k})*x{i}") for k in range(2) for i in range(2)] + [(f"left_bias.{k}", f"al*q{k} + d{k}") for k in range(2)]
    named += [(f"right.{2 * k + i}", f"d{k}*{x}") for k in range(2) for i, x in enumerate(("o", "1"))] + [(f"right_bias.{k}", f"d{k}") for k in range(2)]
    named += [(f"edge.{k}", f"d{k}*a") for k in range(2)] + [(f"score.{k}", f"ds*y{k}") for k in range(2)]
    rows = " union all ".join(f"select '{name}.{w.split('.')[0]}' as weight, {w.split('.')[1]} as pos, sum({v}) as value from {name}_d" for w, v in named)
    return f"""{name}_l as (select *, {lines} from ({source}) q), {name}_t as (select *, {total} from {name}_l), {name}_y as (select *, {active} from {name}_t),
 {name}_u as (select *, exp({n(weights.score[0])}*y0 + {n(weights.score[1])}*y1) as u from {name}_y),
 {name}_a as (select *, u/sum(u) over (partition by dst) as al, sum(u*l0) over (partition by dst)/sum(u) over (partition by dst) as m0, sum(u*l1) over (partition by dst)/sum(u) over (partition by dst) as m1 from {name}_u),
 {name}_s as (select *, al*(q0*l0 + q1*l1 - q0*m0 - q1*m1) as ds from {name}_a join h on h.id = dst), {name}_d as (select *, {d_total} from {name}_s),
 {name}_g as ({rows} union all select '{name}.bias', 0, sum(q0) from h union all select '{name}.bias', 1, sum(q1) from h)"""


_of_parts = _lines('l_partkey', 'part', 'p_partkey', 'p_size/50e0', 'p_retailprice/1999e0')
_of_suppliers = _lines('l_suppkey', 'supplier', 's_suppkey', 's_nationkey/25e0', 's_acctbal/10000e0')
_pulled = [f"case when h{k} > 0 then {sum(rt.PULL[c] * float(rt.OUTPUT.weight[c][k]) for c in range(2))!r}e0 else 0e0 end as q{k}" for k in range(2)]
_linear = " union all ".join(
    [f"select 'order.weight' as weight, {2 * c + k} as pos, {rt.PULL[c]!r}e0*sum(h{k}) as value from h" for c in range(2) for k in range(2)] + [f"select 'order.bias', {c}, {rt.PULL[c]!r}e0*count(*) from h" for c in range(2)]
)
ORACLES["encoder_gradient"] = f"""with {_attention('pa', rt.ATTENTION, _of_parts)}, {_attention('su', rt.ATTENTION_2, _of_suppliers)},
 z as (select pa.id, greatest(pa.m0 + su.m0, 0) as h0, greatest(pa.m1 + su.m1, 0) as h1 from pa join su using (id)), h as (select *, {', '.join(_pulled)} from z),
 {_gradient('part', rt.ATTENTION, _of_parts)}, {_gradient('supplier', rt.ATTENTION_2, _of_suppliers)}
select weight, cast(pos as int) as pos, round(value, 4) + 0e0 as value from (select * from part_g union all select * from supplier_g union all {_linear}) q"""


def _headed(name: str, table: str, key: str, width: int, s: int) -> str:
    """Memberships (id, k, p) under the fixed heads."""
    dot = " + ".join(f"cos(k + {2 * i + s}e0)*cos({0.1 * (i + 1)!r}e0*{key})" for i in range(8))
    return f"""{name}_z as (select {key} as id, k, exp(ln(greatest(1/(1 + exp(-(0.3e0*(k + 1) - 0.5e0))), 1e-8)) + {dot}) as e from {table} cross join (select unnest(range({width})) as k) ks),
 {name} as (select id, k, e/sum(e) over (partition by id) as p from {name}_z)"""


ORACLES["head_memberships"] = f"with {_headed('sy', 'orders', 'o_orderkey', K_Y, 1)} select id, cast(k as int) as k, round(p, 6) as p from sy"

_AGGREGATES = CROSS[CROSS.index(" om as (") :]
_STEP = rt.STEP


def _terms(name: str, table: str, width: int) -> str:
    """Penalty terms of one side."""
    return f"""{_STEP.lambda_collapse!r}e0*({math.sqrt(width)!r}e0/(select count(*) from {table})*(select sqrt(sum(c*c)) from (select sum(p) as c from {name} group by k) q) - 1)
 + {_STEP.entropy_weight!r}e0*(select sum(p*ln(p + 1e-9)) from {name})/(select count(*) from {table})
 + {_STEP.lam_g!r}e0*(select sum(1/(1 + exp(-(0.3e0*(k + 1) - 0.5e0)))) from (select unnest(range({width})) as k) q)"""


_usage = ", ".join(f"(select round(sum(p)/(select count(*) from orders), 5) from sy where k = {k}) as usage_{k}" for k in range(K_Y))
ORACLES["fit_step"] = f"""with {DEGREE}, {_headed('sx', 'supplier', 's_suppkey', K_X, 0)}, {_headed('sy', 'orders', 'o_orderkey', K_Y, 1)}, {_headed('sz', 'part', 'p_partkey', K_Z, 2)},
{_AGGREGATES}, mn as (select sum(dx*dz) + 1e-9 as mnorm from v_deg),
 x as (select l, m, e/mnorm as e, exp({BETA}e0*e/mnorm) as u from exy, mn), al as (select l, m, e, u/sum(u) over (partition by m) as a from x),
 y as (select m, n, e/mnorm as e, exp({BETA}e0*e/mnorm) as u from eyz, mn), ga as (select m, n, e, u/sum(u) over (partition by m) as g from y),
 lm as (select piv, m, sum(v*a) as v from ay join al using (l) group by 1, 2), rm as (select piv, m, sum(v*g) as v from cy join ga using (n) group by 1, 2),
 obs as (select sum(lm.v*s.p*rm.v) as q from lm join rm using (piv, m) join sy s on s.id = lm.piv and s.k = m),
 ax as (select l, sum(e) as v from al group by l), am as (select m, sum(e) as v from al group by m), az as (select n, sum(e) as v from ga group by n),
 tl as (select m, sum(a*ax.v) as v from al join ax using (l) group by m), tr as (select m, sum(g*az.v) as v from ga join az using (n) group by m),
 ex as (select sum(tl.v*am.v*tr.v) as q from tl join am using (m) join tr using (m))
select round(-(obs.q/mnorm - 1.5e0*ex.q/mnorm) + {_terms('sx', 'supplier', K_X)} + {_terms('sy', 'orders', K_Y)} + {_terms('sz', 'part', K_Z)}, 5) as loss,
 round(obs.q, 5) as q_obs_m, round(ex.q/mnorm*pow(mnorm, 3), 5) as q_exp_m3, {_usage} from mn, obs, ex"""


def _drawn(name: str) -> str:
    d = list(sweep.SPACE_V1).index(name)
    values = sweep.SPACE_V1[name][1]
    start, step = (42 * 0.6180339887498949) % 1.0, sweep.RATIO ** -(d + 1)
    raw = f"({start!r}e0 + (s_suppkey + 1)*{step!r}e0)"
    return f"([{', '.join(map(str, values))}])[cast(floor(({raw} - floor({raw}))*{len(values)}) as int) + 1]"


ORACLES["anneal_schedule"] = f"""with recursive d as (select s_suppkey as trial, {_drawn('beta_max')}*1e0 as bm, {_drawn('gamma_max')}*1e0 as gm, {_drawn('anneal_step')} as st,
   {_drawn('prune_delay_epoch')} as pd, {_drawn('prune_every')} as pe from supplier),
 e as (select trial, 1 as epoch, 2e0 as beta, 1e0 as gamma, bm, gm, st, pd, pe from d
   union all select trial, epoch + 1, case when epoch % st = 0 then least(bm, beta + 0.3e0) else beta end, case when epoch % st = 0 then least(gm, gamma*1.1e0) else gamma end, bm, gm, st, pd, pe
   from e where epoch < 60)
select trial, epoch, round(beta, 6) as beta, round(gamma, 6) as gamma, epoch % pe = 0 and epoch >= pd as prunes from e"""
