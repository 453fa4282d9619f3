"""Registered queries over the supplied tables, and DuckDB SQL for the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geo, tags, text
from wayloom.operators import address, graph, routing, search, spatial
from wayloom.plans import api, etl
from wayloom.sources import tables
from wayloom.sources.fixtures import load, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_fixtures(sql)
        return f

    return add


def _case(column: str, table: dict, default: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v!r}" for k, v in table.items()) + f" else {default} end"


_MODE = "case when highway in ('motorway', 'motorway_link') then 1 when highway in ('footway', 'pedestrian', 'steps') then 8 when highway in ('cycleway', 'path') then 12 when highway = 'track' then 15 else 3 end"
_SPEED = _case("highway", tags.SPEED, "30e0")
_ACCEPTED = "(" + ", ".join(f"'{h}'" for h in tags.SPEED) + ")"
_ONEWAY = "highway in ('motorway', 'motorway_link') or coalesce(junction = 'roundabout', false) or coalesce(oneway in ('yes', '1', 'true', '-1', 'reverse'), false)"
_REV = "coalesce(oneway in ('-1', 'reverse'), false)"
_HAV = lambda a, b, c, d: f"2e0 * 6371000e0 * atan2(sqrt(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2)), sqrt(1e0 - (power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"

#: Common table expressions of the road graph.
_GRAPH = f"""
ways as (select *, {_ONEWAY} as is_oneway, {_REV} as is_reversed, {_MODE} as mode, {_SPEED} as speed_kmh from fx_ways where highway in {_ACCEPTED}),
pairs as (select way_id, pos, node_id as a, lead(node_id) over (partition by way_id order by pos) as b from fx_way_nodes),
seg as (select w.*, pos, case when is_reversed then b else a end as u, case when is_reversed then a else b end as v from pairs join ways w using (way_id) where b is not null and a <> b),
one as (select s.*, x.lat as lat_u, x.lon as lon_u, y.lat as lat_v, y.lon as lon_v, {_HAV('x.lat', 'x.lon', 'y.lat', 'y.lon')} as metres from seg s join fx_nodes x on s.u = x.osm_id join fx_nodes y on s.v = y.osm_id),
edges as (select way_id, pos, highway, mode, metres, metres * 3.6e0 / speed_kmh as seconds, u as src, v as dst, lat_u as lat_src, lon_u as lon_src, lat_v as lat_dst, lon_v as lon_dst from one
 union all select way_id, pos, highway, mode, metres, metres * 3.6e0 / speed_kmh, v, u, lat_v, lon_v, lat_u, lon_u from one where not is_oneway)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.road_edges(load(spark, sf_dir, "fx_ways"), load(spark, sf_dir, "fx_way_nodes"), load(spark, sf_dir, "fx_nodes"))


# ---- tags and graph


@query(f"with p as (select highway, {_MODE} as mode, {_SPEED} as speed_kmh from fx_ways) select highway, mode, speed_kmh, count(*) as n_ways from p group by 1, 2, 3")
def highway_profile(spark, sf_dir):
    """Mode and speed of every highway value."""
    hw = F.col("highway")
    return load(spark, sf_dir, "fx_ways").select("highway", tags.mode_mask(hw).alias("mode"), tags.speed_kmh(hw).alias("speed_kmh")).groupBy("highway", "mode", "speed_kmh").agg(F.count("*").alias("n_ways"))


@query(f"with w as (select way_id, highway, {_ONEWAY} as is_oneway, {_REV} as is_reversed, {_MODE} as mode, {_SPEED} as speed_kmh from fx_ways where highway in {_ACCEPTED}) select * from w")
def accepted_ways(spark, sf_dir):
    """Accepted ways and their direction."""
    return graph.accepted_ways(load(spark, sf_dir, "fx_ways")).select("way_id", "highway", "is_oneway", "is_reversed", "mode", "speed_kmh")


@query("with p as (select way_id, pos, node_id as a, lead(node_id) over (partition by way_id order by pos) as b from fx_way_nodes) select * from p where b is not null and a <> b")
def way_segments(spark, sf_dir):
    """Consecutive pairs of ways."""
    return graph.way_segments(load(spark, sf_dir, "fx_way_nodes"))


@query(f"with {_GRAPH} select way_id, pos, highway, mode, src, dst, round(metres, 3) as metres, round(seconds, 3) as seconds from edges")
def road_edges(spark, sf_dir):
    """The directed road graph."""
    return _edges(spark, sf_dir).select("way_id", "pos", "highway", "mode", "src", "dst", F.round("metres", 3).alias("metres"), F.round("seconds", 3).alias("seconds"))


@query(f"with {_GRAPH} select highway, count(*) as n_edges, round(sum(metres) / 1000, 1) as km, round(avg(seconds), 2) as avg_seconds from edges group by 1")
def edge_stats_by_highway(spark, sf_dir):
    """A2: edges by highway value."""
    return _edges(spark, sf_dir).groupBy("highway").agg(F.count("*").alias("n_edges"), F.round(F.sum("metres") / 1000, 1).alias("km"), F.round(F.avg("seconds"), 2).alias("avg_seconds"))


@query(f"with {_GRAPH}, e as (select src as node, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges), d as (select node, sum(o) as out_degree, sum(i) as in_degree from e group by 1) select node, cast(out_degree as bigint) as out_degree, cast(in_degree as bigint) as in_degree, cast(coalesce(sum(out_degree) over (order by node rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from d")
def node_degree_csr(spark, sf_dir):
    """A3: degrees and offsets of the adjacency."""
    return graph.degrees(_edges(spark, sf_dir))


@query(f"with {_GRAPH}, e as (select src as node, mode from edges union select dst, mode from edges), m as (select * from (values ('car', 1), ('motorbike', 2), ('bicycle', 4), ('pedestrian', 8)) t(name, bit)) select name as mode, count(distinct node) as active_nodes from e, m where mode & bit <> 0 group by 1")
def active_nodes_by_mode(spark, sf_dir):
    """Nodes with an edge of each mode."""
    return graph.active_nodes(_edges(spark, sf_dir))


@query("with u as (select distinct node_id from fx_way_nodes) select osm_id, round(lat, 6) as lat, round(lon, 6) as lon from fx_nodes where osm_id in (select node_id from u)")
def needed_nodes(spark, sf_dir):
    """Nodes that ways use."""
    return graph.needed_nodes(load(spark, sf_dir, "fx_nodes"), load(spark, sf_dir, "fx_way_nodes")).select("osm_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_LABEL = " ".join(f"when lat between {a} and {b} and lon between {c} and {d} then '{n}'" for n, (a, b, c, d) in tags.BOXES.items())
_NORM = lambda x: f"regexp_replace(regexp_replace(translate({x}, '{text.NORM_FROM}', '{text.NORM_TO}'), '[ \\t]+', ' ', 'g'), '^ | $', '', 'g')"
#: Tags of nodes and names of ways, for the places.
_TAGGED = """select osm_id, lat, lon, case when osm_id % 3 = 0 then name end as name, case when osm_id % 6 = 0 then upper(name) end as name_vi, case when osm_id % 4 = 1 then 'cafe' end as amenity, case when osm_id % 5 = 1 then 'books' end as shop, case when osm_id % 7 = 1 then 'hotel' end as tourism from fx_nodes"""
_NAMED_WAYS = """select way_id, highway, case when way_id % 4 = 0 then 'Đường số ' || cast(way_id as string) end as name, case when way_id % 8 = 0 then 'Phố ' || cast(way_id as string) end as name_vi from fx_ways"""


def _sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    out = sql
    for n in names:
        out = out.replace(n, f"{{{n}}}")
    return spark.sql(out, **{n: load(spark, sf_dir, n) for n in names})


_PLACES = f"""
t as ({_TAGGED}), w as ({_NAMED_WAYS}),
l as (select *, case {_LABEL} end as label from t),
n as (select osm_id, coalesce(label, name, '') as name, coalesce(label, name_vi, '') as name_vi, coalesce(amenity, 'shop:' || shop, 'tourism:' || tourism, 'place') as type, lat, lon, coalesce(label, name, '') <> '' or amenity is not null or shop is not null or tourism is not null as keep from l),
s as (select way_id as osm_id, name, coalesce(name_vi, '') as name_vi, 'street:' || highway as type, 0e0 as lat, 0e0 as lon from w where name <> '' and highway in {_ACCEPTED}),
a as (select osm_id, name, name_vi, type, lat, lon from n where keep and (name <> '' or name_vi <> '') union all select * from s)"""


@query(f"with {_PLACES} select osm_id, name, name_vi, {_NORM("case when name_vi = '' then name else name_vi end")} as name_norm, type, round(lat, 6) as lat, round(lon, 6) as lon from a")
def places(spark, sf_dir):
    """Places from nodes and streets."""
    nodes, ways = _sql(spark, sf_dir, _TAGGED, "fx_nodes"), _sql(spark, sf_dir, _NAMED_WAYS, "fx_ways")
    both = search.storable(search.node_places(nodes).unionByName(search.street_places(ways)))
    return both.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query(f"with l as (select case {_LABEL} end as label from fx_nodes) select label, count(*) as n_nodes from l group by 1")
def sovereign_labels(spark, sf_dir):
    """Nodes in the labelled boxes."""
    return load(spark, sf_dir, "fx_nodes").select(tags.box_label(F.col("lat"), F.col("lon")).alias("label")).groupBy("label").agg(F.count("*").alias("n_nodes"))


# ---- geometry

_NEXT = "select a.osm_id, a.lat, a.lon, b.lat as lat2, b.lon as lon2 from fx_nodes a join fx_nodes b on b.osm_id = a.osm_id + 1"


def _next_nodes(spark, sf_dir):
    n = load(spark, sf_dir, "fx_nodes")
    return n.join(n.select((F.col("osm_id") - 1).alias("osm_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "osm_id")


@query(f"with p as ({_NEXT}) select osm_id, round({_HAV('lat', 'lon', 'lat2', 'lon2')}, 3) as metres from p")
def haversine_pairs(spark, sf_dir):
    """M1: great-circle distance of consecutive nodes."""
    return _next_nodes(spark, sf_dir).select("osm_id", F.round(geo.haversine(*map(F.col, ("lat", "lon", "lat2", "lon2"))), 3).alias("metres"))


@query(f"with p as ({_NEXT}) select osm_id, round(6371000e0 * sqrt(power(radians(lon2 - lon) * cos(radians((lat + lat2) / 2)), 2) + power(radians(lat2 - lat), 2)) - {_HAV('lat', 'lon', 'lat2', 'lon2')}, 3) as error_m from p")
def equirect_error(spark, sf_dir):
    """M2: flat distance less great-circle distance."""
    c = list(map(F.col, ("lat", "lon", "lat2", "lon2")))
    return _next_nodes(spark, sf_dir).select("osm_id", F.round(geo.equirectangular(*c) - geo.haversine(*c), 3).alias("error_m"))


@query("with q as (select cast(round(lat * 1e5, 0) as int) as qlat, cast(round(lon * 1e5, 0) as int) as qlon from fx_points) select qlat, qlon, count(*) as n_points from q group by 1, 2")
def quantized_points(spark, sf_dir):
    """Positions asked for, quantised."""
    return load(spark, sf_dir, "fx_points").groupBy(geo.quantize(F.col("lat")).alias("qlat"), geo.quantize(F.col("lon")).alias("qlon")).agg(F.count("*").alias("n_points"))


_STR = f"""with {_GRAPH}, n as (select count(*) as n from edges), g as (select cast(ceil(n / 16e0) as bigint) as chunks from n), h as (select chunks, cast(ceil(sqrt(chunks)) as bigint) as grid from g),
k as (select cast(ceil(chunks / cast(grid as double)) as bigint) * 16 as strip_size from h),
r as (select *, row_number() over (order by lat_src + lat_dst, src, dst, way_id, pos) - 1 as rk from edges),
s as (select r.*, cast(floor(rk / cast(strip_size as double)) as int) as strip from r, k),
t as (select *, cast(floor((row_number() over (partition by strip order by lon_src + lon_dst, src, dst, way_id, pos) - 1) / 16e0) as int) as tile from s)"""


@query(f"{_STR} select way_id, pos, src, dst, strip, tile from t")
def str_tiles(spark, sf_dir):
    """Sort-tile-recursive leaves."""
    return spatial.str_tiles(_edges(spark, sf_dir)).select("way_id", "pos", "src", "dst", "strip", "tile")


@query(f"{_STR} select strip, tile, count(*) as n_edges, round(min(least(lat_src, lat_dst)), 6) as lat_min, round(max(greatest(lat_src, lat_dst)), 6) as lat_max, round(min(least(lon_src, lon_dst)), 6) as lon_min, round(max(greatest(lon_src, lon_dst)), 6) as lon_max from t group by 1, 2")
def tile_bboxes(spark, sf_dir):
    """A4: boxes of the leaves."""
    return spatial.tile_boxes(spatial.str_tiles(_edges(spark, sf_dir))).select("strip", "tile", "n_edges", *[F.round(c, 6).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")])


def _nearest_sql(points: str) -> str:
    """CTE s: the nearest of all segments to every row (point_id, lat, lon) of ``points``."""
    t = "case when power(lat_dst - lat_src, 2) + power(lon_dst - lon_src, 2) < 1e-18 then 0e0 else greatest(0e0, least(1e0, ((q.lat - lat_src) * (lat_dst - lat_src) + (q.lon - lon_src) * (lon_dst - lon_src)) / ((lat_dst - lat_src) * (lat_dst - lat_src) + (lon_dst - lon_src) * (lon_dst - lon_src)))) end"
    metres = _HAV("lat", "lon", "(lat_src + t * (lat_dst - lat_src))", "(lon_src + t * (lon_dst - lon_src))")
    return f"""seg1 as (select distinct src, dst, lat_src, lon_src, lat_dst, lon_dst from edges),
one1 as (select * from seg1 a where src < dst or not exists (select 1 from seg1 b where b.src = a.dst and b.dst = a.src)),
near as (select q.point_id, q.lat, q.lon, src, dst, lat_src, lon_src, lat_dst, lon_dst, {t} as t from {points} q, one1),
s as (select point_id, min(struct_pack(mm := round({metres}, 3), src := src, dst := dst, t := t, plat := lat_src + t * (lat_dst - lat_src), plon := lon_src + t * (lon_dst - lon_src))) as s from near group by 1)"""


#: The nearest segment within a block of 3 x 3 tiles where it is nearer than the block's edge can be, and of all segments for the other points.
_SNAP = f"""with {_GRAPH}, e as (select distinct src, dst, lat_src, lon_src, lat_dst, lon_dst from edges),
zz as (select 9e0 / sqrt(count(*)) as z from e),
e1 as (select *, unnest(range(cast(floor(least(lat_src, lat_dst) / (select z from zz)) as bigint), cast(floor(greatest(lat_src, lat_dst) / (select z from zz)) as bigint) + 1)) as ty from e),
e2 as (select *, case when lat_dst = lat_src then lon_src else lon_src + (lon_dst - lon_src) * (greatest(least(lat_src, lat_dst), least(greatest(lat_src, lat_dst), ty * (select z from zz))) - lat_src) / (lat_dst - lat_src) end as xa, case when lat_dst = lat_src then lon_dst else lon_src + (lon_dst - lon_src) * (greatest(least(lat_src, lat_dst), least(greatest(lat_src, lat_dst), (ty + 1) * (select z from zz))) - lat_src) / (lat_dst - lat_src) end as xb from e1),
e3 as (select *, unnest(range(cast(floor((least(xa, xb) - 1e-9) / (select z from zz)) as bigint), cast(floor((greatest(xa, xb) + 1e-9) / (select z from zz)) as bigint) + 1)) as tx from e2),
q as (select point_id, lat, lon, cast(floor(lat / (select z from zz)) as bigint) + dy.i as ty, cast(floor(lon / (select z from zz)) as bigint) + dx.i as tx from fx_points, (select unnest([-1, 0, 1]) as i) dy, (select unnest([-1, 0, 1]) as i) dx),
p as (select distinct point_id, q.lat, q.lon, src, dst, lat_src, lon_src, lat_dst, lon_dst, case when power(lat_dst - lat_src, 2) + power(lon_dst - lon_src, 2) < 1e-18 then 0e0 else greatest(0e0, least(1e0, ((q.lat - lat_src) * (lat_dst - lat_src) + (q.lon - lon_src) * (lon_dst - lon_src)) / ((lat_dst - lat_src) * (lat_dst - lat_src) + (lon_dst - lon_src) * (lon_dst - lon_src)))) end as t from q join e3 using (ty, tx)),
g0 as (select point_id, min(struct_pack(mm := round({_HAV('lat', 'lon', '(lat_src + t * (lat_dst - lat_src))', '(lon_src + t * (lon_dst - lon_src))')}, 3), src := src, dst := dst, t := t, plat := lat_src + t * (lat_dst - lat_src), plon := lon_src + t * (lon_dst - lon_src))) as s from p group by 1),
g as (select * from g0 where g0.s.mm < 1e5 * (select z from zz)),
rest as (select point_id, lat, lon from fx_points where point_id not in (select point_id from g)),
{_nearest_sql('rest').replace('s as (select point_id, min', 'far as (select point_id, min')},
s as (select * from g union all select * from far)"""


@query(f"{_SNAP} select point_id, s.src as edge_u, s.dst as edge_v, round(s.t, 3) as t, round(s.plat, 5) as proj_lat, round(s.plon, 5) as proj_lon, s.mm as dist_m from s")
def snap_grid(spark, sf_dir):
    """Nearest segment of every point."""
    s = spatial.snap(load(spark, sf_dir, "fx_points"), _edges(spark, sf_dir), nodes=load(spark, sf_dir, "fx_nodes"))
    return s.select("point_id", "edge_u", "edge_v", F.round("t", 3).alias("t"), F.round("proj_lat", 5).alias("proj_lat"), F.round("proj_lon", 5).alias("proj_lon"), F.round("dist_m", 3).alias("dist_m"))


@query(f"{_SNAP} select point_id, s.src as edge_u, s.dst as edge_v, round(s.t, 3) as t, round(s.plat, 5) as proj_lat, round(s.plon, 5) as proj_lon, s.mm as dist_m from s")
def snap_stored(spark, sf_dir):
    """Nearest segment of every point, from tiles that were stored and read again."""
    folder = f"{tables.shared_folder(spark)}/wayloom-index-{uuid.uuid4().hex}"
    nodes = load(spark, sf_dir, "fx_nodes")
    kind, index = ("tiles", spatial.snap_index(_edges(spark, sf_dir))) if (blocks := spatial.snap_blocks(_edges(spark, sf_dir), nodes)) is None else ("blocks", blocks)
    tables.write(nodes, folder, "nodes")
    tables.write(index, folder, kind)
    tables.drop_at_exit(spark, folder)
    s = spatial.snap(load(spark, sf_dir, "fx_points"), None, index=tables.read(spark, folder, kind), nodes=tables.read(spark, folder, "nodes"))
    return s.select("point_id", "edge_u", "edge_v", F.round("t", 3).alias("t"), F.round("proj_lat", 5).alias("proj_lat"), F.round("proj_lon", 5).alias("proj_lon"), F.round("dist_m", 3).alias("dist_m"))


_PICK = "k as (select point_id, s.src as u, s.dst as v, s.plat, s.plon, s.mm, power(s.plat - x.lat, 2) + power(s.plon - x.lon, 2) as du, power(s.plat - y.lat, 2) + power(s.plon - y.lon, 2) as dv from s join fx_nodes x on x.osm_id = s.src join fx_nodes y on y.osm_id = s.dst)"


@query(f"{_SNAP}, {_PICK} select point_id, case when du <= dv then u else v end as node from k")
def picked_nodes(spark, sf_dir):
    """The road node of every point, through quantised positions."""
    return spatial.pick_node(spatial.snap_quantized(load(spark, sf_dir, "fx_points"), _edges(spark, sf_dir), load(spark, sf_dir, "fx_nodes")), load(spark, sf_dir, "fx_nodes")).select("point_id", "node")


_BOX = " union all ".join(f"select osm_id, '{n}' as label, power(lat - greatest({a}, least(lat, {b})), 2) + power(lon - greatest({c}, least(lon, {d})), 2) as d from fx_nodes" for n, (a, b, c, d) in tags.BOXES.items())


@query(f"select osm_id, label, round(d, 6) as sq_degrees from ({_BOX}) b")
def box_distances(spark, sf_dir):
    """Squared degrees from every node to the labelled boxes."""
    n = load(spark, sf_dir, "fx_nodes")
    boxes = F.array(*[F.struct(F.lit(k).alias("label"), F.round(geo.box_distance_sq(F.col("lat"), F.col("lon"), *map(F.lit, v)), 6).alias("sq_degrees")) for k, v in tags.BOXES.items()])
    return n.select("osm_id", F.inline(boxes))


# ---- text and addresses


@query(f"select doc_id, {_NORM('text')} as norm from documents")
def normalize_text(spark, sf_dir):
    """Normalised documents, whole texts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.normalize(F.col("text")).alias("norm"))


_COORD = "'^\\s*([+-]?\\d+\\.?\\d*)\\s*[,\\s]\\s*([+-]?\\d+\\.?\\d*)\\s*$'"
_ADDR = f"""
a0 as (select id, regexp_replace(address, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') as s from fx_addresses),
a1 as (select *, try_cast(nullif(regexp_extract(s, {_COORD}, 1), '') as double) as x, try_cast(nullif(regexp_extract(s, {_COORD}, 2), '') as double) as y,
 list_filter(list_transform(string_split(s, ','), lambda p: regexp_replace(p, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda p: p <> '') as parts from a0),
a2 as (select *, case when x between 7 and 24 and y between 100 and 115 then x when y between 7 and 24 and x between 100 and 115 then y end as lat,
 case when x between 7 and 24 and y between 100 and 115 then y when y between 7 and 24 and x between 100 and 115 then x end as lon, {_NORM("coalesce(parts[1], s)")} as main from a1),
a3 as (select *, try_cast(nullif(regexp_extract(main, '^(?:so |s\\. )?([0-9]+)([a-z]?)(?: |$)', 1), '') as int) as number from a2),
a4 as (select *, case when number is null then '' else regexp_extract(main, '^(?:so |s\\. )?([0-9]+)([a-z]?)(?: |$)', 2) end as suffix,
 case when number is null then main else ltrim(regexp_replace(main, '^(?:so |s\\. )?([0-9]+)([a-z]?)(?: |$)', '')) end as rest from a3),
a5 as (select *, case when regexp_matches(rest, '^(ngo|hem|ngach|lo)\\s+([0-9]+[a-z]?)\\s+(.+)$') then trim(regexp_extract(rest, '^(ngo|hem|ngach|lo)\\s+([0-9]+[a-z]?)\\s+(.+)$', 3)) else trim(rest) end as street0 from a4),
seg as (select id, unnest(parts[2:]) as p, unnest(range(2, len(parts) + 1)) as j from a5 where len(parts) > 1),
segn as (select id, j, {_NORM('p')} as p from seg),
cl as (select id, j, case {' '.join(f"when p = '{a}' then 'city'" for a in text.CITIES)} {' '.join(f"when starts_with(p, '{a}') and trim(substring(p, {len(a) + 1})) <> '' then '{l}'" for a, l in text.ADMIN.items())} end as level,
 case {' '.join(f"when p = '{a}' then '{c}'" for a, c in text.CITIES.items())} {' '.join(f"when starts_with(p, '{a}') and trim(substring(p, {len(a) + 1})) <> '' then trim(substring(p, {len(a) + 1}))" for a in text.ADMIN)} end as v from segn),
cl2 as (select id, level, case when level = 'city' then {_case('v', text.CITIES, 'v')} else v end as v, j from cl where level is not null),
adm as (select id, arg_max(v, j) filter (where level = 'ward') as ward, arg_max(v, j) filter (where level = 'district') as district, arg_max(v, j) filter (where level = 'city') as city from cl2 group by 1),
tail as (select id, case {' '.join(f"when ends_with(main, '{a}') then '{text.CITIES[a]}'" for a in sorted(text.CITIES, key=lambda a: (len(a), a), reverse=True))} end as tcity,
 case {' '.join(f"when ends_with(main, '{a}') then trim(substring(main, 1, length(main) - {len(a)}))" for a in sorted(text.CITIES, key=lambda a: (len(a), a), reverse=True))} end as tstreet from a5 where len(parts) = 1)"""


@query(f"with {_ADDR} select id, round(lat, 6) as lat, round(lon, 6) as lon from a2 where lat is not null")
def parse_coords(spark, sf_dir):
    """Addresses that are coordinates."""
    a = load(spark, sf_dir, "fx_addresses").select("id", text.coordinates(text.trim(F.col("address"))).alias("c"))
    return a.where("c is not null").select("id", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query(f"with {_ADDR} select id, coalesce(number, -1) as number, suffix, rest from a4")
def parse_house_number(spark, sf_dir):
    """Leading house numbers of the first segment."""
    a = load(spark, sf_dir, "fx_addresses").withColumn("s", text.trim(F.col("address")))
    main = text.normalize(F.coalesce(F.try_element_at(text.segments(F.col("s")), F.lit(1)), F.col("s")))
    return a.select("id", text.house_number(main).alias("h")).select("id", F.coalesce("h.number", F.lit(-1)).alias("number"), "h.suffix", "h.rest")


@query(f"with {_ADDR} select id, j, p, (select level from cl where cl.id = segn.id and cl.j = segn.j) as level, (select v from cl2 where cl2.id = segn.id and cl2.j = segn.j) as \"value\" from segn")
def parse_admin(spark, sf_dir):
    """Administrative segments."""
    a = load(spark, sf_dir, "fx_addresses").select("id", F.posexplode(text.segments(text.trim(F.col("address")))).alias("j", "p")).where("j > 0")
    return a.select("id", (F.col("j") + 1).cast("long").alias("j"), text.normalize(F.col("p")).alias("p")).withColumn("a", text.admin_part(F.col("p"))).select("id", "j", "p", "a.level", "a.value")


@query(f"with {_ADDR} select id, lat is not null as is_coord, coalesce(round(lat, 6), 0) as coord_lat, coalesce(round(lon, 6), 0) as coord_lon, case when lat is not null then -1 else coalesce(number, -1) end as house_number, case when lat is not null then '' else suffix end as house_suffix, case when lat is not null then '' else coalesce(tstreet, street0) end as street, case when lat is not null then '' else coalesce(ward, '') end as ward, case when lat is not null then '' else coalesce(district, '') end as district, case when lat is not null then '' else coalesce(city, tcity, '') end as city, lat is null and number is not null and coalesce(tstreet, street0) <> '' as can_interpolate from a5 left join adm using (id) left join tail using (id)")
def parse_address(spark, sf_dir):
    """Whole addresses."""
    a = load(spark, sf_dir, "fx_addresses").select("id", text.parse_address(F.col("address")).alias("a")).select("id", "a.*", text.can_interpolate(F.col("a")).alias("can_interpolate"))
    return a.withColumns({"coord_lat": F.round("coord_lat", 6), "coord_lon": F.round("coord_lon", 6)})


@query(f"select id, case {' '.join(f"when starts_with(s, '{w} ') and length(s) > {len(w) + 1} then substring(s, {len(w) + 2})" for w in text.ROAD_WORDS)} else s end as street from (select id, {_NORM("street")} as s from fx_ranges)")
def strip_road_word(spark, sf_dir):
    """Streets without the word for their kind."""
    return load(spark, sf_dir, "fx_ranges").select("id", text.without_road_word(text.normalize(F.col("street"))).alias("street"))


@query(f"select id, {_NORM('street')} as street_norm, num_start, num_end, interp_type from fx_ranges where num_start < num_end")
def addr_ranges(spark, sf_dir):
    """Stored house-number ranges."""
    return address.valid_ranges(load(spark, sf_dir, "fx_ranges")).select("id", "street_norm", "num_start", "num_end", "interp_type")


_ASK = "select c_custkey as req_id, 'pho so ' || cast(c_custkey % 101 as string) as street_norm, cast(1 + c_custkey % 260 as int) as number, case c_custkey % 4 when 0 then 'even' when 1 then 'odd' else 'all' end as interp_type from customer"


@query(f"with q as ({_ASK}), r as (select *, {_NORM('street')} as street_norm from fx_ranges where num_start < num_end), b as (select req_id, number, r.*, row_number() over (partition by req_id order by abs(num_start + num_end - 2 * number), r.id) as k from q join r on q.street_norm = r.street_norm and number between num_start and num_end and (q.interp_type = 'all' or q.interp_type = r.interp_type)) select q.req_id, coalesce(round(lat_start + (b.number - num_start) / cast(num_end - num_start as double) * (lat_end - lat_start), 9), 0) as lat, coalesce(round(lon_start + (b.number - num_start) / cast(num_end - num_start as double) * (lon_end - lon_start), 9), 0) as lon from q left join b on q.req_id = b.req_id and k = 1")
def interpolate_address(spark, sf_dir):
    """Coordinates of house numbers."""
    asked = spark.sql(_ASK.replace("from customer", "from {c}"), c=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return address.interpolate(asked, address.valid_ranges(load(spark, sf_dir, "fx_ranges"))).select("req_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


_SECONDS = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 7, 1) as seconds from lineitem"


@query(f"with s as ({_SECONDS}), m as (select *, cast(floor(seconds / 60) as bigint) as m, cast(floor(seconds % 60 + 0.5e0) as bigint) as r from s) select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when seconds < 60 then cast(cast(floor(seconds + 0.5e0) as bigint) as varchar) || ' seconds' when m < 60 then m || ' minutes' || case when r > 0 then ' ' || r || ' seconds' else '' end else (m // 60) || ' hours ' || (m % 60) || ' minutes' end as spelled from m")
def format_time(spark, sf_dir):
    """Durations in words."""
    seconds = geo.rounded(F.col("l_extendedprice") / 7, 1)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.format_time(seconds).alias("spelled"))


# ---- search

_TOK = lambda x: f"regexp_extract_all(translate(lower({x}), '{text.FOLD_FROM}', '{text.FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+')"
_POST = f"""
pl as (select *, {_NORM("case when name_vi = '' then name else name_vi end")} as name_norm from fx_places),
tk as (select id, unnest(list_concat({_TOK('name')}, {_TOK('name_norm')}, {_TOK('type')})) as term from pl),
post as (select term, id as place_id, count(*) as tf from tk group by 1, 2),
len as (select place_id, sum(tf) as dl from post group by 1),
whole as (select count(*) as n_docs, avg(dl) as avg_len from len)"""
#: What users ask for: (text, latitude, longitude).
_ASKED = (("the", 21.0, 105.8), ("the an", 21.0, 105.8), ("de la", 20.7, 106.1), ("Of the", 21.2, 105.5), ("café", 21.0, 105.8), ("und die", 20.9, 105.9), ("hotel er", 21.4, 105.4), ("th th", 21.0, 105.8), ("zzzz", 21.0, 105.8), ("  ,. ", 21.0, 105.8), ("books ion", 21.1, 106.0), ("él", 20.6, 105.6))
_QUERY_ROWS = ", ".join(f"({i}, '{q}', {a}, {b})" for i, (q, a, b) in enumerate(_ASKED))


_VALUES = f"select cast(query_id as bigint) as query_id, q, cast(user_lat as double) as user_lat, cast(user_lon as double) as user_lon from (values {_QUERY_ROWS}) t(query_id, q, user_lat, user_lon)"


def _hits(queries: str, near: bool) -> str:
    """CTE rk: all places that match each query, ranked."""
    damp = " / (1 + power(lat - user_lat, 2) + power(lon - user_lon, 2))" if near else ""
    return f"""{_POST},
qs as ({queries}),
qt as (select query_id, unnest({_TOK(_NORM('q'))}) as tok, unnest(range(len({_TOK(_NORM('q'))}))) as pos from qs),
f as (select query_id, pos, place_id, sum(tf) as f from qt join post on starts_with(term, tok) group by 1, 2, 3),
df as (select query_id, pos, count(*) as df from f group by 1, 2),
sc as (select query_id, place_id, sum(case when ln((n_docs - df + 0.5e0) / (df + 0.5e0)) > 0 then ln((n_docs - df + 0.5e0) / (df + 0.5e0)) else 1e-6 end * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * dl / avg_len))) as score, count(*) as n from f join df using (query_id, pos) join len using (place_id), whole group by 1, 2),
hit as (select query_id, place_id, name, type, lat, lon, score{damp} as score from sc join pl on pl.id = place_id join qs using (query_id) where n = (select count(*) from qt where qt.query_id = sc.query_id)),
rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, place_id) as rank from hit)"""


def _bm25(near: bool) -> str:
    return f"with {_hits(_VALUES, near)} select query_id, cast(rank as int) as rank, place_id, name, type, round(lat, 6) as lat, round(lon, 6) as lon, round(score, 6) as score from rk where rank <= 10"


def _places(spark, sf_dir):
    p = load(spark, sf_dir, "fx_places")
    return p.withColumn("name_norm", text.normalize(F.when(F.col("name_vi") == "", F.col("name")).otherwise(F.col("name_vi"))))


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("int").alias("rank"), "place_id", "name", "type", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("score", 6).alias("score"))


def _queries(spark, near: bool):
    rows = spark.createDataFrame([(i, *q) for i, q in enumerate(_ASKED)], "query_id long, q string, user_lat double, user_lon double")
    return rows if near else rows.select("query_id", "q")


@query(f"with {_POST} select n_docs, round(avg_len, 6) as avg_len, (select count(distinct term) from post) as n_terms from whole")
def postings_stats(spark, sf_dir):
    """Statistics of the postings."""
    return search.corpus_stats(search.postings(_places(spark, sf_dir))).select("n_docs", F.round("avg_len", 6).alias("avg_len"), "n_terms")


@query(_bm25(False))
def search_bm25(spark, sf_dir):
    """Prefix search ranked by BM25."""
    return _found(search.search(_places(spark, sf_dir), _queries(spark, False)))


@query(_bm25(True))
def search_bm25_near(spark, sf_dir):
    """F1 with a position."""
    return _found(search.search(_places(spark, sf_dir), _queries(spark, True)))


@query(_bm25(False).replace("rank <= 10", "rank <= 1").replace("select query_id, cast(rank as int) as rank, place_id, name, type,", "select (select trim(lower(q)) from qs where qs.query_id = rk.query_id) as \"key\", place_id, name,").replace(", round(score, 6) as score from rk", " from rk"))
def geocode_top1(spark, sf_dir):
    """The best place of each name."""
    return api.geocode(_queries(spark, False), _places(spark, sf_dir), F.col("q"), False).select("key", "place_id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# ---- routing

_CHEAP = lambda mode: f"e as (select src as u, dst as v, min(seconds) as w, arg_min(metres, seconds) as m from edges where mode & {mode} <> 0 group by 1, 2)"


def _sssp_sql(mode: int) -> str:
    return f"""with recursive {_GRAPH}, {_CHEAP(mode)},
r(node, d) using key (node) as (select cast(0 as bigint), 0e0 union select e.v, min(r.d + e.w) from r join e on r.node = e.u left join recurring.r x on x.node = e.v where x.d is null or r.d + e.w < x.d group by e.v)
select cast(0 as bigint) as source, node, round(d, 3) as seconds from r"""


def _sssp(mode: int):
    def run(spark, sf_dir):
        out = routing.distances(graph.cheapest(_edges(spark, sf_dir), mode), spark.range(1).select(F.col("id").alias("source")))
        return out.select("source", "node", F.round("seconds", 3).alias("seconds"))

    return run


for _name, _bit in tags.MODES.items():
    _f = _sssp(_bit)
    _f.__name__, _f.__doc__ = f"sssp_{_name}", "G7, J7, A5: seconds from node 0."
    query(_sssp_sql(_bit))(_f)


@query(_sssp_sql(1))
def sssp_relaxed(spark, sf_dir):
    """The same by joins to the fixpoint, as beyond the broadcast bound."""
    out = routing.relax(routing.cut(graph.cheapest(_edges(spark, sf_dir), 1)), spark.range(1).select(F.col("id").alias("source")))
    return out.select("source", "node", F.round("seconds", 3).alias("seconds"))


def _node_pairs(spark, sf_dir):
    return load(spark, sf_dir, "fx_nodes").select(F.col("osm_id").alias("req_id"), F.lit(0).cast("long").alias("source"), F.col("osm_id").alias("target"))


@query(f"""with recursive {_GRAPH}, {_CHEAP(2)},
r(node, d, m) using key (node) as (select cast(0 as bigint), 0e0, 0e0 union select e.v, min(r.d + e.w), arg_min(r.m + e.m, r.d + e.w) from r join e on r.node = e.u left join recurring.r x on x.node = e.v where x.d is null or r.d + e.w < x.d group by e.v)
select osm_id as req_id, cast(0 as bigint) as source, osm_id as target, node is not null as valid, round(d, 2) as seconds, round(m, 2) as distance_m from fx_nodes left join r on node = osm_id""")
def route_tree(spark, sf_dir):
    """Motorbike routes from node 0 to every node, with their length."""
    nodes = load(spark, sf_dir, "fx_nodes")
    found = routing.with_coordinates(routing.paths(graph.cheapest(_edges(spark, sf_dir), 2), _node_pairs(spark, sf_dir)), nodes)
    return found.select("req_id", "source", "target", "valid", F.round("seconds", 2).alias("seconds"), F.round("distance_m", 2).alias("distance_m"))


def _routes_sql(od: str) -> str:
    """CTEs od (req_id, mode, s, t, ...) as given, and r: the shortest way by (mode, s, node), with its length and nodes."""
    return f"""ch as (select bit, src as u, dst as v, min(seconds) as w, arg_min(metres, seconds) as m from edges, (values (1), (2), (4), (8)) b(bit) where mode & bit <> 0 group by 1, 2, 3),
od as ({od}),
r(mode, s, node, d, m, p) using key (mode, s, node) as (select distinct mode, s, s, 0e0, 0e0, cast(s as varchar) from od union
 select r.mode, r.s, e.v, min(r.d + e.w), arg_min(r.m + e.m, r.d + e.w), arg_min(r.p || ' ' || e.v, r.d + e.w) from r join ch e on r.node = e.u and r.mode = e.bit left join recurring.r x on x.mode = r.mode and x.s = r.s and x.node = e.v where x.d is null or r.d + e.w < x.d group by 1, 2, 3)"""


def _od_sql(mode: int) -> str:
    return f"""with recursive {_GRAPH}, {_routes_sql(f'select req_id, {mode} as mode, source as s, target as t from fx_requests')}
select req_id, od.s as source, t as target, node is not null as valid, coalesce(round(d, 2), -1) as seconds, coalesce(p, '') as path from od left join r on r.s = od.s and r.node = t"""


def _routed(found: DataFrame) -> DataFrame:
    return found.select("req_id", "source", "target", "valid", F.round("seconds", 2).alias("seconds"), F.array_join("path_nodes", " ").alias("path")).fillna(-1, ["seconds"]).fillna("", ["path"])


@query(_od_sql(2))
def od_route_path(spark, sf_dir):
    """Motorbike routes and their nodes, each from an origin of its own."""
    return _routed(routing.paths(graph.cheapest(_edges(spark, sf_dir), 2), load(spark, sf_dir, "fx_requests")))


@query(_od_sql(4))
def od_distance(spark, sf_dir):
    """Bicycle routes by upward searches that meet in a hierarchy of one round over all nodes, its shortcuts unpacked."""
    return _routed(routing.paths(graph.cheapest(_edges(spark, sf_dir), 4), load(spark, sf_dir, "fx_requests"), lambda roads: routing.contract_cheapest(roads, 1, None)))


@query(f"with {_GRAPH}, {_CHEAP(4)} select i.v as via, i.u as u, o.v as w, round(i.w + o.w, 3) as seconds from e i join e o on i.v = o.u where i.u <> o.v")
def shortcut_candidates(spark, sf_dir):
    """Pairs of bicycle edges that meet in a node."""
    return graph.shortcut_candidates(_edges(spark, sf_dir), 4).withColumn("seconds", F.round("seconds", 3))


@query(f"""with {_GRAPH}, {_CHEAP(4)}, c as (select i.v as via, i.u as u, o.v as w, i.w + o.w as s from e i join e o on i.v = o.u where i.u <> o.v),
k as (select c.* from c left join e on e.u = c.u and e.v = c.w where (e.w is null or e.w > c.s) and not exists (select 1 from c c2 where c2.u = c.u and c2.w = c.w and c2.via <> c.via and c2.s <= c.s)),
n as (select node, count(*) as n_edges from (select u as node from e union all select v from e) group by 1), m as (select via as node, count(*) as n_shortcuts from k group by 1)
select node, coalesce(n_shortcuts, 0) as n_shortcuts, n_edges, coalesce(n_shortcuts, 0) - n_edges as priority from n left join m using (node)""")
def contraction_priority(spark, sf_dir):
    """Priority of every node before any contraction, for bicycles."""
    return graph.contraction_priority(_edges(spark, sf_dir), 4)


def _coords_sql(trips: str) -> str:
    """CTE routes of trips (req_id, lat_a, lon_a, lat_b, lon_b, mode): nearest of all segments, picked nodes, shortest way."""
    ends = f"select req_id * 2 as point_id, lat_a as lat, lon_a as lon from {trips} union all select req_id * 2 + 1, lat_b, lon_b from {trips}"
    od = f"select t.req_id, t.mode, a.node as s, b.node as t, a.mm as ma, b.mm as mb, a.plat as alat, a.plon as alon, b.plat as blat, b.plon as blon from {trips} t join pk a on a.point_id = t.req_id * 2 join pk b on b.point_id = t.req_id * 2 + 1"
    return f"""pts as ({ends}), {_nearest_sql('pts')}, {_PICK}, pk as (select *, case when du <= dv then u else v end as node from k), {_routes_sql(od)},
routes as (select req_id, od.mode, node is not null as valid, od.s as source, od.t as target, round(ma, 1) as snap_a_m, round(mb, 1) as snap_b_m, round(alat, 5) as from_lat, round(alon, 5) as from_lon, round(blat, 5) as to_lat, round(blon, 5) as to_lon,
 round(m, 2) as distance_m, round(m / 1000, 3) as distance_km, round(d, 2) as time_s, round(d / 60, 2) as time_min, p as path from od left join r on r.mode = od.mode and r.s = od.s and r.node = od.t)"""


def _told(routes: DataFrame, *more: str) -> DataFrame:
    at = [geo.rounded(F.col(f"{c}.{x}"), 5).alias(f"{n}_{x}") for c, n in (("snap_from", "from"), ("snap_to", "to")) for x in ("lat", "lon")]
    flat = routes.select("req_id", *more, "mode", "valid", "source", "target", "snap_a_m", "snap_b_m", *at, "distance_m", "distance_km", "time_s", "time_min", F.array_join("path_nodes", " ").alias("path"))
    return flat.fillna(-1, _NUMBERS).fillna("", [*more, "path"])


_NUMBERS = "source target snap_a_m snap_b_m from_lat from_lon to_lat to_lon distance_m distance_km time_s time_min".split()


@query(f"with recursive {_GRAPH}, {_coords_sql('fx_trips')} select req_id, mode, valid, {', '.join(f'coalesce({c}, -1) as {c}' for c in _NUMBERS)}, coalesce(path, '') as path from routes")
def route_coords(spark, sf_dir):
    """Routes between coordinates."""
    return _told(api.route_coords(load(spark, sf_dir, "fx_trips"), _edges(spark, sf_dir), load(spark, sf_dir, "fx_nodes")))


_ASKED_PLACES = "select row_number() over (order by key) as query_id, key as q from (select distinct trim(lower(from_poi)) as key from fx_visits union select distinct trim(lower(to_poi)) from fx_visits)"
_RESOLVED = """first as (select q, name, lat, lon from rk join qs using (query_id) where rank = 1),
resolved as (select v.req_id, v.mode, a.name as from_place, b.name as to_place, a.lat as lat_a, a.lon as lon_a, b.lat as lat_b, b.lon as lon_b from fx_visits v left join first a on a.q = trim(lower(from_poi)) left join first b on b.q = trim(lower(to_poi))),
known as (select * from resolved where from_place is not null and to_place is not null)"""


@query(f"""with recursive {_GRAPH}, {_hits(_ASKED_PLACES, False)}, {_RESOLVED}, {_coords_sql('known')}
select v.req_id, coalesce(v.from_place, '') as from_place, coalesce(v.to_place, '') as to_place, v.mode, coalesce(valid, false) as valid, {', '.join(f"coalesce(routes.{c}, -1) as {c}" for c in _NUMBERS)}, coalesce(routes.path, '') as path from resolved v left join routes using (req_id)""")
def route_poi(spark, sf_dir):
    """Routes between named places."""
    return _told(api.route_poi(load(spark, sf_dir, "fx_visits"), _places(spark, sf_dir), _edges(spark, sf_dir), load(spark, sf_dir, "fx_nodes")), "from_place", "to_place")


# ---- the offline pipeline


def _raw(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Ways (way_id, node_ids, tags) and nodes (osm_id, lat, lon, tags) as a map file gives them."""
    tag = lambda **kinds: F.map_filter(F.create_map(*[x for k, c in kinds.items() for x in (F.lit(k.replace("__", ":")), F.col(c))]), lambda _, v: v.isNotNull())
    ids = load(spark, sf_dir, "fx_way_nodes").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("node_ids"))
    ways = load(spark, sf_dir, "fx_raw_ways").join(ids, "way_id").select("way_id", "node_ids", tag(highway="highway", oneway="oneway", junction="junction", addr__interpolation="interp_type", addr__street="street").alias("tags"))
    return ways, load(spark, sf_dir, "fx_raw_nodes").select("osm_id", "lat", "lon", tag(addr__housenumber="house_number").alias("tags"))


def _built(spark, sf_dir) -> tuple[dict[str, DataFrame], dict[str, int]]:
    folder = f"{tables.shared_folder(spark)}/wayloom-etl-{uuid.uuid4().hex}"
    tables.drop_at_exit(spark, folder)
    return etl.build(spark, *_raw(spark, sf_dir), folder)


_SPLIT = """sizes as (select way_id, count(*) as n, min_by(node_id, pos) as n_start, max_by(node_id, pos) as n_end from fx_way_nodes group by 1),
raw as (select w.*, n, n_start, n_end, interp_type is not null and n >= 2 as is_range from fx_raw_ways w join sizes using (way_id))"""
_BUILT = f"with {_SPLIT}, fx_roads as (select way_id, highway, oneway, junction from raw where not is_range), {_GRAPH.replace('fx_ways', 'fx_roads')}"
_ENDS = f"""num as (select osm_id, lat, lon, try_cast(nullif(regexp_extract(house_number, '^\\s*(\\d+)', 1), '') as int) as num from fx_raw_nodes),
ends as (select way_id as id, coalesce(street, '') as street, interp_type, x.num as a, y.num as b, x.lat as lat_a, x.lon as lon_a, y.lat as lat_b, y.lon as lon_b from raw join num x on x.osm_id = n_start join num y on y.osm_id = n_end where is_range and x.num is not null and y.num is not null)"""
_RANGES = f"{_SPLIT}, {_ENDS}, ranges as (select * from ends where street <> '' and a <> b)"


@query(f"{_BUILT} select src, dst, mode, highway, way_id, pos, round(metres, 3) as metres, round(seconds, 3) as weight from edges")
def stored_edges(spark, sf_dir):
    """Edges of raw ways and nodes, as stored and read again."""
    return _built(spark, sf_dir)[0]["edges"].select("src", "dst", "mode", "highway", "way_id", (F.col("pos") + 1).alias("pos"), F.round("metres", 3).alias("metres"), F.round("weight", 3).alias("weight"))


@query(f"{_BUILT} select round(lat, 6) as lat, round(lon, 6) as lon, count(*) as n from fx_nodes where osm_id in (select node_id from fx_way_nodes join ways using (way_id)) group by 1, 2")
def stored_coordinates(spark, sf_dir):
    """Positions of the stored nodes, nothing else of them is read."""
    folder = f"{tables.shared_folder(spark)}/wayloom-nodes-{uuid.uuid4().hex}"
    tables.drop_at_exit(spark, folder)
    ways, nodes = _raw(spark, sf_dir)
    good = etl.split_ways(ways)[0].where(tags.accepted(F.col("highway")))
    tables.write(graph.needed_nodes(nodes.select("osm_id", "lat", "lon"), good.select(F.explode("node_ids").alias("node_id"))), folder, "nodes")
    return tables.coordinates(spark, folder).groupBy(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).agg(F.count("*").alias("n"))


@query(f"with {_RANGES} select id, {_NORM('street')} as street_norm, least(a, b) as num_start, greatest(a, b) as num_end, interp_type, round(case when a > b then lat_b else lat_a end, 6) as lat_start, round(case when a > b then lon_a else lon_b end, 6) as lon_end from ranges")
def resolved_ranges(spark, sf_dir):
    """House-number ranges from interpolation ways and their end nodes."""
    ways, nodes = _raw(spark, sf_dir)
    ends = nodes.select("osm_id", "lat", "lon", F.col("tags")["addr:housenumber"].alias("house_number"))
    got = address.resolve_ranges(etl.split_ways(ways)[1], ends)
    return got.select("id", "street_norm", "num_start", "num_end", "interp_type", F.round("lat_start", 6).alias("lat_start"), F.round("lon_end", 6).alias("lon_end"))


@query(f"""{_BUILT}, {_ENDS}, ranges as (select * from ends where street <> '' and a <> b),
labels as (select osm_id, case {_LABEL} end as label from fx_nodes)
select 'nodes_inserted' as counter, count(*) as n from fx_nodes where osm_id in (select node_id from fx_way_nodes join ways using (way_id)) union all select 'edges_inserted', count(*) from edges
union all select 'places_inserted', count(label) from labels union all select 'places_skipped', 0
union all select 'addr_ranges_inserted', count(*) from ranges union all select 'ranges_resolved', count(*) from ends union all select 'ranges_skipped', (select count(*) from raw where is_range) - (select count(*) from ranges)""")
def etl_counters(spark, sf_dir):
    """Rows inserted, skipped and resolved by the offline pipeline."""
    counters = {k: v for k, v in _built(spark, sf_dir)[1].items() if k != "tiles_inserted"}
    return spark.createDataFrame(list(counters.items()), "counter string, n long")
