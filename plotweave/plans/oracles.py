"""SQL that states the result of each query independently, for a single-node engine."""

from __future__ import annotations

import math

from plotweave.plans import sweep

K_X, K_Y, K_Z = 4, 5, 3
BETA = 2.0

BUILDING = """v_building as (select o_orderkey as building,
  case when o_orderkey % 50 = 0 then concat('B', o_orderkey, '/C', o_orderkey) else concat('B', o_orderkey) end as rnb_id,
  cast(5 + (o_orderkey*7919) % 790 as double) as x0, cast(5 + (o_orderkey*104729) % 490 as double) as y0,
  cast(4 + o_orderkey % 7 as double) as w, cast(3 + o_orderkey % 5 as double) as h, o_orderkey % 4 = 0 as notch,
  cast((o_orderkey % 9)*2.5 as double) as hauteur,
  case when o_orderkey % 10 = 0 then null when o_orderkey % 17 = 0 then 'abc' else cast(1790 + o_orderkey % 240 as varchar) end as annee,
  case when o_orderkey % 8 = 0 then null else o_orderpriority end as usage,
  cast(o_orderkey % 6 as double) as nb_log from orders)"""

PARCEL = """v_parcel as (select p_partkey as parcel, cast(floor(p_partkey/40.0) as bigint) as pr,
  (p_partkey % 40)*20e0 + (cast(floor(p_partkey/40.0) as bigint) % 2)*10e0 as x0, floor(p_partkey/40.0)*10e0 as y0 from part)"""

ZONE = """v_zone as (select p_partkey as zone, (p_partkey % 8)*110e0 as zx0, (p_partkey % 8)*110e0 + 100e0 as zx1,
  floor(p_partkey/8.0)*50e0 as zy0, floor(p_partkey/8.0)*50e0 + 50e0 as zy1, p_type as libelle, p_brand as typezone from part)"""

ZONED = f"""{PARCEL}, {ZONE}, v_zoned as (select p.parcel, min(z.zone) as zone from v_parcel p left join v_zone z
  on p.x0 + 10 >= z.zx0 and p.x0 + 10 < z.zx1 and p.y0 + 5 >= z.zy0 and p.y0 + 5 < z.zy1 group by p.parcel)"""

ADDRESS = """v_address as (select c_custkey as addr, 2.20e0 + ((c_custkey*37) % 1000)/10000e0 as lon,
  48.85e0 + ((c_custkey*91) % 1000)/10000e0 as lat from customer)"""

XY = "v_xy as (select l_suppkey as src, l_orderkey as piv, l_quantity as w from lineitem)"
YZ = "v_yz as (select l_orderkey as piv, l_partkey as dst, l_quantity as w from lineitem)"
DEGREE = f"""{XY}, {YZ}, v_deg as (select x.piv, x.dx, z.dz from
  (select piv, sum(w) as dx from v_xy group by piv) x join (select piv, sum(w) as dz from v_yz group by piv) z on x.piv = z.piv
  where x.dx > 0 and z.dz > 0)"""

POINT = "v_point as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings)"


def soft(name: str, table: str, key: str, width: int) -> str:
    """Long memberships (id, k, p): softmax over k of cos(0.37 (k+1) key)."""
    return f"""{name}_e as (select {key} as id, k, exp(cos((0.37e0*(k+1))*{key})) as e from {table} cross join (select unnest(range({width})) as k) ks),
  {name} as (select id, k, e/sum(e) over (partition by id) as p from {name}_e)"""


def hard(name: str, source: str) -> str:
    return f"""{name} as (select id, cast(k as int) as community from (select id, k, row_number() over (partition by id order by p desc, k) as r from {source}) q where r = 1)"""


def wide(key: str, source: str, width: int) -> str:
    """Long probabilities to columns with the cluster."""
    cols = ", ".join(f"round(max(case when k = {k} then p end), 6) as proba_{k}" for k in range(width))
    return f"""select {key}, coalesce(cast(max(case when r = 1 and p is not null then k end) as int), -1) as cluster, {cols} from
  (select *, row_number() over (partition by {key} order by p desc nulls last, k) as r from {source}) q group by {key}"""


SOFT_Y = soft("sy", "orders", "o_orderkey", K_Y)
HARD_Y = hard("hy", "sy")

ORACLES: dict[str, str] = {}

# --- sources, links, fusion ----------------------------------------------------------------

ORACLES["page_links"] = r"""
with t as (select url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>', ' ', 'g') as html from pages),
 h as (select url, replace(trim(unnest(regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"'']*)["'']', 1))), '&amp;', '&') as href from t)
select distinct case when starts_with(href, 'http') then href
  when starts_with(href, '//') then concat(regexp_extract(url, '^(https?:)', 1), href)
  when starts_with(href, '/') then concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), href)
  when starts_with(href, '#') or starts_with(href, '?') then concat(regexp_replace(url, '[?#].*$', ''), href)
  when regexp_replace(url, '[?#].*$', '') = regexp_extract(url, '^(https?://[^/?#]+)', 1) then concat(regexp_replace(url, '[?#].*$', ''), '/', regexp_replace(href, '^(\./)+', ''))
  else concat(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', ''), regexp_replace(href, '^(\./)+', '')) end as url from h"""

ORACLES["page_links_pick"] = """
with l as (select concat('https://data.example.org/files/BDTOPO_3-', p_size % 10, '_TOUSTHEMES_GPKG_LAMB93_D', tag,
  '_2025-', lpad(cast(p_size % 12 + 1 as varchar), 2, '0'), '-15.7z') as url, tag, p_size % 12 + 1 as month
  from (select *, case p_partkey % 97 when 20 then '02A' when 21 then '02B' else lpad(cast(p_partkey % 97 as varchar), 3, '0') end as tag from part)),
 a as (select case n_nationkey when 20 then '2A' when 21 then '2B' else cast(n_nationkey as varchar) end as dep from nation)
select dep, min(url) as url from a join l on tag = lpad(dep, 3, '0') where month = 9 group by dep"""

ORACLES["ingest_missing"] = """
select distinct lpad(cast(c_nationkey as varchar), 2, '0') as dep from customer
where c_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)"""

ORACLES["manifest"] = """
with k as (select c_nationkey as n from customer union select s_nationkey from supplier)
select lpad(cast(n as varchar), 2, '0') as dep,
  cast((select count(*) from orders join customer on o_custkey = c_custkey where c_nationkey = n) as bigint) as n_bat,
  cast((select count(*) from customer where c_nationkey = n) as bigint) as n_ban,
  cast((select count(*) from supplier where s_nationkey = n) as bigint) as n_parcelles from k"""

ORACLES["links_ban"] = "select distinct concat('B', o_orderkey) as rnb_id, concat('A', o_custkey) as ban_id from orders"
ORACLES["links_parcel"] = """select concat('B', l_orderkey) as rnb_id, concat('P', l_partkey) as parcelle_id, round(l_discount*10e0, 6) as cover_ratio
from lineitem join orders on l_orderkey = o_orderkey"""
ORACLES["links_bdnb"] = """select distinct concat('B', l_orderkey) as rnb_id, concat('C', l_suppkey) as batiment_construction_id
from lineitem join orders on l_orderkey = o_orderkey"""

ORACLES["building_fusion"] = """
with l as (select distinct l_orderkey, l_suppkey from lineitem)
select concat('B', o_orderkey) as rnb_id, case when l_suppkey is not null then concat('C', l_suppkey) end as batiment_construction_id,
  case when s_suppkey is not null then concat('G', s_nationkey) end as batiment_groupe_id,
  case when n_nationkey is not null then cast(1850 + n_nationkey*6 as varchar) end as ffo_bat_annee_construction, n_name as bdtopo_bat_l_usage_1,
  cast(n_nationkey % 7 as varchar) as ffo_bat_nb_log, cast(n_regionkey as varchar) as code_commune_insee
from orders left join l on o_orderkey = l_orderkey left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey"""

ORACLES["parcel_zone_join"] = f"with {ZONED} select parcel, coalesce(zone, -1) as zone from v_zoned"
ORACLES["parcel_plu_labels"] = f"""with {ZONED} select parcel, coalesce(substr(libelle, 1, 2), 'HP') as libelle, coalesce(typezone, 'HP') as typezone
from v_zoned left join v_zone using (zone)"""

ORACLES["area_table_roundtrip"] = """
select lpad(cast(c_nationkey as varchar), 2, '0') as dep, cast(count(*) as bigint) as n,
  round(sum(c_acctbal + case when c_nationkey < 10 then 0e0 else 1e0 end), 2) as total from customer group by c_nationkey"""

# --- scalar preparation --------------------------------------------------------------------

YEARS = f"""{BUILDING}, v_year as (select *, coalesce(try_cast(annee as double), (select median(try_cast(annee as double)) from v_building)) as year from v_building)"""
DECADE = "case when year > 1800 and year <= 2030 then concat('dec_', cast(ceil(year/10)*10 - 10 as int)) else 'Inconnu' end"

ORACLES["decade_bins"] = f"with {YEARS} select building, {DECADE} as decennie from v_year"

MEASURED = f"""{YEARS}, v_num as (select building, a as area, nullif(hauteur, 0) as height, coalesce(a*nullif(hauteur, 0), 0) as volume, year, nb_log as nb_logements
  from (select *, w*h - case when notch then (w/2)*(h/2) else 0e0 end as a from v_year) q)"""
_scaled = ", ".join(
    f"round(coalesce(({c} - (select avg({c}) from v_num))/(select stddev_pop({c}) from v_num), 0), 6) as {c}"
    for c in ("area", "height", "volume", "year", "nb_logements")
)
ORACLES["scaled_features"] = f"with {MEASURED} select building, {_scaled} from v_num"

ORACLES["onehot_building"] = f"""
with {YEARS}, v_cat as (select building, coalesce(usage, 'Inconnu') as usage, {DECADE} as decennie from v_year),
 u as (select usage, row_number() over (order by usage) - 1 as slot, count(*) over () as n from (select distinct usage from v_cat) q)
select building, cast(u.slot as int) as usage_slot, cast(1 as bigint) as usage_ones, cast(u.n as int) as usage_width,
  cast(case when decennie = 'Inconnu' then 23 else (cast(substr(decennie, 5) as int) - 1800)/10 end as int) as decade_slot,
  cast(1 as bigint) as decade_ones, cast(24 as int) as decade_width from v_cat join u using (usage)"""

ORACLES["onehot_parcel"] = """
with c as (select p_partkey as parcel, substr(p_type, 1, 2) as l, p_brand as z from part),
 a as (select l, row_number() over (order by l) - 1 as slot, count(*) over () as n from (select distinct l from c) q),
 b as (select z, row_number() over (order by z) - 1 as slot, count(*) over () as n from (select distinct z from c) q)
select parcel, cast(a.slot as int) as libelle_slot, cast(1 as bigint) as libelle_ones, cast(a.n as int) as libelle_width,
  cast(b.slot as int) as typezone_slot, cast(1 as bigint) as typezone_ones, cast(b.n as int) as typezone_width from c join a using (l) join b using (z)"""

_bands = ["zx as f0", "zy as f1"]
for _i in range(4):
    for _j, _f in enumerate(("sin", "cos")):
        _bands += [f"{_f}({2.0**_i}e0*{c}) as f{2 + 4 * _i + 2 * _j + n}" for n, c in enumerate(("zx", "zy"))]
_bands = ", ".join(f"round({b.split(' as ')[0]}, 6) as {b.split(' as ')[1]}" for b in _bands)
ORACLES["fourier_features"] = f"""
with {ADDRESS}, z as (select addr, (lon - (select avg(lon) from v_address))/(select stddev_pop(lon) from v_address) as zx,
  (lat - (select avg(lat) from v_address))/(select stddev_pop(lat) from v_address) as zy from v_address) select addr, {_bands} from z"""

# --- geometry ------------------------------------------------------------------------------

ORACLES["geo_roundtrip"] = f"""with {BUILDING} select building, round(w*h - case when notch then (w/2)*(h/2) else 0e0 end, 6) as area,
  round(2*(w+h), 6) as perimeter from v_building"""
ORACLES["geo_table_roundtrip"] = """select lpad(cast(p_partkey % 7 as varchar), 2, '0') as dep, cast(count(*) as bigint) as n, round(count(*)*200e0, 6) as area
from part group by p_partkey % 7"""

ORACLES["lambert93_points"] = f"""
with {ADDRESS}, g as (select addr, radians(lon) as lam, radians(lat) as phi from v_address),
 r as (select addr, 0.7256077650532695e0*(lam - radians(3e0)) as th, 11754255.426096004e0*pow(tan(pi()/4 - phi/2)
   /pow((1 - 0.08181919104281579e0*sin(phi))/(1 + 0.08181919104281579e0*sin(phi)), 0.08181919104281579e0/2), 0.7256077650532695e0) as rho from g)
select addr, round(700000e0 + rho*sin(th), 3) as x, round(6600000e0 + 6055612.049875985e0 - rho*cos(th), 3) as y from r"""

ORACLES["shape_features"] = f"""
with {BUILDING}, m as (select building, w*h - case when notch then (w/2)*(h/2) else 0e0 end as a, 2*(w+h) as p,
  w*h - case when notch then (w/2)*(h/2)/2 else 0e0 end as hull, least(w, h) as s, greatest(w, h) as l from v_building)
select building, round(a, 6) as area, round(4*pi()*a/(p*p + 1e-6), 6) as compactness, round(a/(hull + 1e-6), 6) as convexity,
  round(1 - s/(l + 1e-6), 6) as elongation, round(2*ln(p + 1e-6)/ln(a + 1e-6), 6) as fractality from m"""

TOUCH = f"""{PARCEL}, d as (select a.parcel as src, b.parcel as dst, least(a.x0+20, b.x0+20) - greatest(a.x0, b.x0) as ox,
  least(a.y0+10, b.y0+10) - greatest(a.y0, b.y0) as oy from v_parcel a join v_parcel b on b.pr between a.pr - 1 and a.pr + 1 and a.parcel <> b.parcel),
  v_touch as (select src, dst, cast(case when ox = 0 then oy else ox end as double) as shared from d where (ox = 0 and oy >= 0) or (oy = 0 and ox >= 0))"""
ORACLES["parcel_touch"] = f"with {TOUCH} select src, dst, shared from v_touch"
ORACLES["edges_parcel_parcel_double"] = f"with {TOUCH} select src, dst, 2*shared as w from v_touch"

NEAR = f"""{POINT}, p as (select a.id as dst, b.id as src, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) as d from v_point a join v_point b on a.id <> b.id),
  n as (select *, row_number() over (partition by dst order by d, src) as r from p)"""
ORACLES["knn_density"] = f"with {NEAR} select dst as id, round(1/(avg(d) + 1e-6), 5) as local_density from n where r <= 16 group by dst"
ORACLES["knn_edges"] = f"with {NEAR} select src, dst from n where r <= 8"

_overlap = lambda x0, y0, x1, y1: f"greatest(least({x1}, 600e0) - greatest({x0}, 100.5e0), 0)*greatest(least({y1}, 400e0) - greatest({y0}, 100.5e0), 0)"
ORACLES["clip_to_boundary"] = f"""with {BUILDING}, c as (select building, {_overlap('x0', 'y0', 'x0+w', 'y0+h')}
  - case when notch then {_overlap('x0+w/2', 'y0+h/2', 'x0+w', 'y0+h')} else 0e0 end as area from v_building)
select building, round(area, 6) as area from c where area > 0"""

_dist = lambda x0, y0, x1, y1: f"pow(greatest({x0} - px, 0, px - ({x1})), 2) + pow(greatest({y0} - py, 0, py - ({y1})), 2)"
CELLS = f"""{BUILDING}, {SOFT_Y}, {HARD_Y}, sizes as (select community, count(*) as n from hy group by community),
 top as (select community from sizes order by n desc, community limit 1),
 b as (select v_building.*, community from v_building join hy on id = building where community <> (select community from top)),
 cx as (select b.*, unnest(range(cast(floor((x0-40)/10) as bigint) - 1, cast(floor((x0+w+40)/10) as bigint) + 2)) as cx from b),
 cy as (select cx.*, unnest(range(cast(floor((y0-40)/10) as bigint) - 1, cast(floor((y0+h+40)/10) as bigint) + 2)) as cy from cx),
 c as (select *, (cx+0.5)*10e0 as px, (cy+0.5)*10e0 as py from cy),
 v_cells as (select distinct community, cx, cy from c where case when notch
   then least({_dist('x0', 'y0', 'x0+w', 'y0+h/2')}, {_dist('x0', 'y0', 'x0+w/2', 'y0+h')}) else {_dist('x0', 'y0', 'x0+w', 'y0+h')} end <= 1600)"""
ORACLES["zoning_cells"] = f"""with {CELLS} select cast(community as bigint) as community, cast(count(*) as bigint) as n_cells, cast(sum(cx) as bigint) as sum_cx,
  cast(sum(cy) as bigint) as sum_cy from v_cells group by community"""

# --- graph ---------------------------------------------------------------------------------

IDX = """bi as (select id as rnb_id, k, row_number() over (order by id) - 1 as node from (select concat('B', o_orderkey) as id, o_orderkey as k from orders) q),
 pi as (select id as parcelle_id, k, row_number() over (order by id) - 1 as node from (select concat('P', p_partkey) as id, p_partkey as k from part) q),
 ai as (select id as ban_id, k, row_number() over (order by id) - 1 as node from (select concat('A', c_custkey) as id, c_custkey as k from customer) q)"""
ORACLES["node_index"] = f"with {IDX} select rnb_id, cast(node as bigint) as node_id from bi"
ORACLES["edges_building_parcel"] = f"""with {IDX} select cast(bi.node as bigint) as src, cast(pi.node as bigint) as dst, round(l_discount*10e0, 6) as w
from lineitem join bi on bi.k = l_orderkey join pi on pi.k = l_partkey"""
ORACLES["edges_address_building"] = f"""with {IDX} select cast(ai.node as bigint) as src, cast(bi.node as bigint) as dst, 1e0 as w
from orders join bi on bi.k = o_orderkey join ai on ai.k = o_custkey"""

ORACLES["edge_weight_pick"] = """select l_orderkey, l_linenumber, l_partkey,
  case when (select sum(abs(l_discount)) from lineitem) = 0 then l_discount + l_quantity else l_discount end as w_first, round(l_quantity + l_tax, 6) as w_sum from lineitem"""

TERRACE = """pp as (select a.c_custkey as p, b.c_custkey as q, least(a.c_custkey, b.c_custkey) % 7 + 1e0 as w
  from customer a join customer b on abs(a.c_custkey - b.c_custkey) = 1 union all select c_custkey, c_custkey, 1e0 from customer)"""
ORACLES["dual_projection"] = f"""with {TERRACE} select a.o_orderkey as src, b.o_orderkey as dst, sum(w) as w
from orders a join pp on a.o_custkey = p join orders b on b.o_custkey = q where a.o_orderkey <> b.o_orderkey group by 1, 2"""

ORACLES["dual_strength"] = f"""with {TOUCH}, pp as (select src as p, dst as q, shared as w from v_touch union all select parcel, parcel, 1e0 from v_parcel),
 m as (select l_orderkey as b, l_partkey as p, cast(count(*) as double) as n from lineitem join part on l_partkey = p_partkey group by 1, 2),
 total as (select p, sum(n) as s from m group by p),
 full_sum as (select m.b, sum(m.n*pp.w*t.s) as v from m join pp on m.p = pp.p join total t on t.p = pp.q group by m.b),
 diag as (select m.b, sum(m.n*pp.w*o.n) as v from m join pp on m.p = pp.p join m o on o.b = m.b and o.p = pp.q group by m.b)
select f.b as building, round(f.v - coalesce(d.v, 0), 6) as strength from full_sum f left join diag d on f.b = d.b"""

ORACLES["edge_integrity"] = """select 'building-belongs-parcel' as relation, cast(count(*) as bigint) as n_edges,
  cast(count(*) filter (where o_orderkey is null) as bigint) as unknown_src,
  cast(count(*) filter (where p_partkey is null) as bigint) as unknown_dst,
  cast(count(*) filter (where l_discount*10e0 - 0.05e0 < 0) as bigint) as bad_weight
from lineitem left join orders on l_orderkey = o_orderkey left join (select * from part where p_retailprice >= 1000) r on l_partkey = p_partkey"""

ORACLES["graph_stats"] = """select 'node' as kind, 'address' as name, cast(count(*) as bigint) as n from customer union all
select 'node', 'building', count(*) from orders union all select 'node', 'parcel', count(*) from part union all
select 'edge', 'address-access-building', count(*) from orders union all select 'edge', 'building-belongs-parcel', count(*) from lineitem"""

# --- memberships and propagation -----------------------------------------------------------

ORACLES["soft_membership"] = f"with {SOFT_Y} select id, cast(k as int) as k, round(p, 6) as p from sy"
ORACLES["hard_communities"] = f"with {SOFT_Y}, {HARD_Y} select id, community from hy"
ORACLES["community_sizes"] = f"with {SOFT_Y}, {HARD_Y} select community, cast(count(*) as bigint) as n from hy group by community"
ORACLES["background_cluster"] = f"with {SOFT_Y}, {HARD_Y} select community from hy group by community order by count(*) desc, community limit 1"
ORACLES["community_explode"] = f"""with {BUILDING}, {SOFT_Y}, {HARD_Y}
select unnest(string_split(rnb_id, '/')) as id_bat, community from v_building join hy on id = building"""
ORACLES["membership_usage"] = f"with {SOFT_Y} select cast(k as int) as k, round(avg(p), 6) as usage from sy group by k"
ORACLES["prune_mask"] = f"""with {soft('sn', 'customer', 'c_custkey', K_Y)}, u as (select k, avg(p) as usage from sn group by k),
 r as (select *, row_number() over (order by usage desc, k) as r, (select count(*) from u where usage > 0.2) as passed from u)
select cast(k as int) as k, round(usage, 6) as usage, usage > 0.2 or (passed < 2 and r <= 2) as keep from r"""

SPLIT = f"""{BUILDING}, {SOFT_Y}, b as (select building, unnest(string_split(rnb_id, '/')) as bid from v_building),
 known as (select bid, k, p from b join sy on id = building where building % 11 <> 0)"""
ORACLES["propagate_addresses"] = f"""with {SPLIT}, l as (select o_custkey as ban_id, bid from orders join b on building = o_orderkey),
 ks as (select unnest(range({K_Y})) as k),
 m as (select ban_id, ks.k, avg(p) as p from l cross join ks left join known on known.bid = l.bid and known.k = ks.k group by ban_id, ks.k)
{wide('ban_id', 'm', K_Y)}"""
PARCEL_LINKS = "l as (select l_partkey as parcelle_id, bid, l_discount*10e0 as w from lineitem join b on building = l_orderkey)"
ORACLES["propagate_parcels"] = f"""with {SPLIT}, {PARCEL_LINKS}, ks as (select unnest(range({K_Y})) as k),
 m as (select parcelle_id, ks.k, sum(p*w)/nullif(sum(case when p is not null then w end), 0) as p
   from l cross join ks left join known on known.bid = l.bid and known.k = ks.k group by parcelle_id, ks.k)
{wide('parcelle_id', 'm', K_Y)}"""
ORACLES["propagate_parcels_compat"] = f"""with {SPLIT}, {PARCEL_LINKS}, ks as (select unnest(range({K_Y})) as k),
 m as (select parcelle_id, ks.k, coalesce(sum(p*w), 0)/nullif(sum(w), 0) as p
   from l cross join ks left join known on known.bid = l.bid and known.k = ks.k group by parcelle_id, ks.k)
select parcelle_id, greatest(cluster, 0) as cluster, {', '.join(f'proba_{k}' for k in range(K_Y))} from ({wide('parcelle_id', 'm', K_Y)}) q"""

# --- tripartite modularity -----------------------------------------------------------------

ORACLES["pivot_degrees"] = f"with {DEGREE} select piv as building, round(dx, 6) as dx, round(dz, 6) as dz from v_deg"
ORACLES["antihub_weights"] = f"with {DEGREE} select piv as building, round(1e6/(dx*dz + 1e-9), 6) as omega_ppm from v_deg"

CROSS = f"""{DEGREE}, {soft('sx', 'supplier', 's_suppkey', K_X)}, {SOFT_Y}, {soft('sz', 'part', 'p_partkey', K_Z)},
 om as (select piv, 1/(dx*dz + 1e-9) as omega from v_deg),
 ay as (select x.piv, s.k as l, max(omega)*sum(w*p) as v from v_xy x join sx s on s.id = x.src join om on om.piv = x.piv group by 1, 2),
 cy as (select z.piv, s.k as n, max(omega)*sum(w*p) as v from v_yz z join sz s on s.id = z.dst join om on om.piv = z.piv group by 1, 2),
 exy as (select l, s.k as m, sum(v*p) as e from ay join sy s on s.id = ay.piv group by 1, 2),
 eyz as (select s.k as m, n, sum(v*p) as e from cy join sy s on s.id = cy.piv group by 1, 2)"""
ORACLES["cross_tables"] = f"""with {CROSS} select 'XY' as side, cast(l as int) as row, cast(m as int) as col, round(e, 6) as value from exy
union all select 'YZ', cast(m as int), cast(n as int), round(e, 6) from eyz"""
ORACLES["tripartite_modularity"] = f"""with {CROSS}, mn as (select sum(dx*dz) + 1e-9 as mnorm from v_deg),
 x as (select l, m, e/mnorm as e, exp({BETA}e0*e/mnorm) as u from exy, mn), al as (select l, m, e, u/sum(u) over (partition by m) as a from x),
 y as (select m, n, e/mnorm as e, exp({BETA}e0*e/mnorm) as u from eyz, mn), ga as (select m, n, e, u/sum(u) over (partition by m) as g from y),
 lm as (select piv, m, sum(v*a) as v from ay join al using (l) group by 1, 2), rm as (select piv, m, sum(v*g) as v from cy join ga using (n) group by 1, 2),
 obs as (select sum(lm.v*s.p*rm.v) as q from lm join rm using (piv, m) join sy s on s.id = lm.piv and s.k = m),
 ax as (select l, sum(e) as v from al group by l), am as (select m, sum(e) as v from al group by m), az as (select n, sum(e) as v from ga group by n),
 tl as (select m, sum(a*ax.v) as v from al join ax using (l) group by m), tr as (select m, sum(g*az.v) as v from ga join az using (n) group by m),
 ex as (select sum(tl.v*am.v*tr.v) as q from tl join am using (m) join tr using (m))
select round(mnorm, 3) as mnorm, round(obs.q, 6) as q_obs_m, round(ex.q/mnorm*pow(mnorm, 3), 6) as q_exp_m3 from mn, obs, ex"""

ORACLES["collapse_penalty"] = f"""with {SOFT_Y}, c as (select k, sum(p) as s from sy group by k)
select round({math.sqrt(K_Y)!r}e0/(select count(*) from orders)*sqrt(sum(s*s)) - 1, 8) as penalty from c"""
ORACLES["membership_entropy"] = f"with {SOFT_Y} select round(sum(p*ln(p + 1e-9))/(select count(*) from orders), 8) as neg_entropy from sy"

ORACLES["attention"] = """
with n as (select l_orderkey as dst, 0.5e0*x0 - 0.25e0*x1 + 0.1e0 as l0, 0.75e0*x0 + x1 - 0.2e0 as l1, o_totalprice/100000e0 + 0.5e0 as r0,
   -0.5e0*(o_totalprice/100000e0) + 0.25e0 + 0.3e0 as r1, l_discount as a
   from lineitem join (select p_partkey, p_size/50e0 as x0, p_retailprice/1999e0 as x1 from part) p on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
 t as (select *, l0 + r0 + 2*a as t0, l1 + r1 - a as t1 from n),
 e as (select dst, l0, l1, exp(1.5e0*case when t0 > 0 then t0 else 0.2e0*t0 end - 0.5e0*case when t1 > 0 then t1 else 0.2e0*t1 end) as u from t),
 s as (select dst, sum(u*l0)/sum(u) as m0, sum(u*l1)/sum(u) as m1 from e group by dst)
select o_orderkey as id, round(coalesce(m0, 0) + 0.05e0, 6) as h0, round(coalesce(m1, 0) - 0.05e0, 6) as h1 from orders left join s on dst = o_orderkey"""

# --- sweep ---------------------------------------------------------------------------------


def _draw(dimension: int) -> str:
    start, step = (42 * 0.6180339887498949) % 1.0, sweep.RATIO ** -(dimension + 1)
    raw = f"({start!r}e0 + (c_custkey + 1)*{step!r}e0)"
    return f"({raw} - floor({raw}))"


def _parameter(name: str, d: int, kind: str, *bounds) -> str:
    if kind == "choice":
        values = bounds[0]
        arms = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
        sql = f"case cast(floor({_draw(d)}*{len(values)}) as int) {arms} end"
        return f"cast({sql} as {'double' if isinstance(values[0], float) else 'int'}) as {name}"
    if kind == "log":
        return f"round({bounds[0]!r}*pow(cast({bounds[1] / bounds[0]!r} as double), {_draw(d)}), 8) as {name}"
    return f"round({bounds[0]!r} + {bounds[1] - bounds[0]!r}*{_draw(d)}, 8) as {name}"


_columns = [_parameter(n, d, *spec) for d, (n, spec) in enumerate(sweep.SPACE_V1.items())]
_columns += [_parameter(f"v2_{n}", d, *spec) for d, (n, spec) in enumerate(sweep.SPACE_V2.items())]
ORACLES["trial_space"] = f"select c_custkey as trial, {', '.join(_columns)} from customer"

ORACLES["trial_score"] = """
with t as (select c_custkey as trial, c_custkey % 70 as n, case when c_custkey % 13 <> 0 then c_acctbal/10000e0 end as q from customer)
select trial, round(coalesce(case when n < 5 or n > 60 then q - 1000 else q end, -1e6), 6) as score_v1,
  round(coalesce(case when n < 5 then q - 500 when n < 10 then q - 100 else q end, -1e6), 6) as score_v2 from t"""

ORACLES["trial_prune"] = """
with p as (select user_id as trial, event_id % 40 as step, max(value*(1 + user_id % 5)) as value from events group by 1, 2),
 m as (select step, median(value) as median from p group by step),
 b as (select trial, step, max(value) over (partition by trial order by step) as best from p)
select trial, min(step) as stop from b join m using (step) where step > 20 and trial >= 5 and best < median group by trial"""

ORACLES["best_trial"] = """
select c_custkey as trial, c_nationkey as clusters, score from (select *, round(case when c_custkey % 70 < 5 or c_custkey % 70 > 60 then c_acctbal - 1000 else c_acctbal end, 6)
  as score from customer) q order by score desc, c_custkey limit 1"""

# --- end to end ----------------------------------------------------------------------------

ORACLES["pipeline_graph"] = f"""with {TOUCH}, np as (select count(*) as n from part),
 own as (select o_orderkey as b, o_orderkey % (select n from np) as p, case when o_orderkey % 3 = 0 and o_orderkey % (select n from np) + 1 < (select n from np) then 0.5e0 else 1e0 end as r from orders
   union all select o_orderkey, o_orderkey % (select n from np) + 1, 0.25e0 from orders where o_orderkey % 3 = 0 and o_orderkey % (select n from np) + 1 < (select n from np)),
 hop as (select src as p, dst as q, shared as w from v_touch union all select parcel, parcel, 1e0 from v_parcel),
 pairs as (select x.b as src, y.b as dst, sum(hop.w) as w from own x join hop on hop.p = x.p join own y on y.p = hop.q where x.b <> y.b group by x.b, y.b)
select 'address' as name, (select count(*) from customer) as n, 0e0 as w union all select 'building', (select count(*) from orders), 0e0
union all select 'parcel', (select n from np), 0e0
union all select 'address-access-building', count(*), cast(count(*) as double) from orders
union all select 'building-belongs-parcel', count(*), round(sum(r), 4) from own
union all select 'parcel-spatial-parcel', count(*), round(sum(shared), 4) from v_touch
union all select 'address-spatial-address', 8*count(*), 0e0 from customer
union all select 'building-spatial-building', count(*), round(sum(w), 4) from pairs"""
