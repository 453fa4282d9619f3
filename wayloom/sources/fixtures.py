"""Projections of the supplied tables into a road network, places, address ranges and points.

The text is SQL that Spark and DuckDB both run, so the same projection feeds a query and its
oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayloom.functions.tags import SPEED

_HIGHWAYS = " ".join(f"when {i} then '{h}'" for i, h in enumerate((*SPEED, "construction")))

NODES = """select p_partkey as osm_id,
 case when p_partkey % 50 = 7 then 15.5e0 + (p_partkey % 13) * 1e-1 when p_partkey % 50 = 9 then 8e0 + (p_partkey % 11) * 2e-1 else 20.5e0 + ((p_partkey * 7919) % 10007) / 10007e0 end as lat,
 case when p_partkey % 50 = 7 then 111.2e0 + (p_partkey % 7) * 2e-1 when p_partkey % 50 = 9 then 111.5e0 + (p_partkey % 19) * 3e-1 else 105.3e0 + ((p_partkey * 104729) % 10009) / 10009e0 end as lon,
 p_name as name from part"""
WAYS = f"""select o_orderkey as way_id, case cast(o_orderkey % 21 as int) {_HIGHWAYS} end as highway,
 case o_orderkey % 7 when 0 then 'yes' when 1 then '-1' when 2 then 'no' when 3 then 'true' when 4 then 'reverse' end as oneway,
 case when o_orderkey % 11 = 0 then 'roundabout' end as junction from orders"""
WAY_NODES = """select l_orderkey as way_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as pos, l_partkey as node_id from lineitem"""
POINTS = """select event_id as point_id, user_id, ts, 20.5e0 + ((event_id * 6151) % 9973) / 9973e0 as lat, 105.3e0 + ((event_id * 3571) % 9967) / 9967e0 as lon from events"""
RANGES = """select o_orderkey as id, 'Phố Số ' || cast(o_custkey % 97 as string) as street, cast(1 + (o_orderkey * 3) % 200 as int) as num_start, cast(1 + (o_orderkey * 3) % 200 + (o_orderkey % 60) as int) as num_end,
 21e0 + (o_orderkey % 101) * 1e-3 as lat_start, 105.8e0 + (o_orderkey % 103) * 1e-3 as lon_start, 21e0 + (o_orderkey % 107) * 1e-3 as lat_end, 105.8e0 + (o_orderkey % 109) * 1e-3 as lon_end,
 case o_orderkey % 3 when 0 then 'all' when 1 then 'even' else 'odd' end as interp_type from orders"""
PLACES = """select doc_id as id, doc_id as osm_id, coalesce(text, '') as name, case when doc_id % 2 = 0 then coalesce(text, '') else '' end as name_vi,
 case doc_id % 4 when 0 then 'cafe' when 1 then 'shop:books' when 2 then 'tourism:hotel' else 'place' end as type, 20.5e0 + ((doc_id * 4409) % 9949) / 9949e0 as lat, 105.3e0 + ((doc_id * 2237) % 9941) / 9941e0 as lon from documents"""
#: Address strings of several forms, one for each customer.
ADDRESSES = """select c_custkey as id, case c_custkey % 8 when 0 then cast(c_custkey % 300 as string) || ' Phố Số ' || cast(c_custkey % 97 as string)
 when 1 then 'Số ' || cast(c_custkey % 300 as string) || 'B Ngõ ' || cast(c_custkey % 60 as string) || ' Đường Láng, P. Láng Thượng, Q. Đống Đa, HN'
 when 2 then cast(c_custkey % 300 as string) || 'a  Đường Láng ha noi' when 3 then 'cafe đường láng tphcm' when 4 then '21.0' || cast(c_custkey % 90 as string) || ', 105.8' || cast(c_custkey % 70 as string)
 when 5 then '105.8' || cast(c_custkey % 70 as string) || ' 21.0' || cast(c_custkey % 90 as string) when 6 then 'Trường THPT Chu Văn An, TP. HCM, quang ninh' else c_name || ', Xã Ba Vì,, Huyện Ba Vì , tỉnh ' || c_mktsegment end as address from customer"""
#: Requests for routes: between nodes, one for each supplier; between positions and between names, one for each nation.
REQUESTS = """select s_suppkey as req_id, (s_suppkey * 17) % (select max(s_suppkey) * 20 from supplier) as source, (s_suppkey * 31 + 7) % (select max(s_suppkey) * 20 from supplier) as target from supplier"""
TRIPS = """select cast(n_nationkey as bigint) as req_id, 20.5e0 + ((n_nationkey * 6151 + 77) % 9973) / 9973e0 as lat_a, 105.3e0 + ((n_nationkey * 3571 + 31) % 9967) / 9967e0 as lon_a,
 20.5e0 + ((n_nationkey * 4409 + 500) % 9949) / 9949e0 as lat_b, 105.3e0 + ((n_nationkey * 2237 + 900) % 9941) / 9941e0 as lon_b, case n_nationkey % 4 when 0 then 1 when 1 then 2 when 2 then 4 else 8 end as mode from nation"""
VISITS = """select cast(n_nationkey as bigint) as req_id, case n_nationkey % 5 when 0 then 'the an' when 1 then 'De la' when 2 then ' books ion ' when 3 then 'zzzz' else 'hotel er' end as from_poi,
 case n_nationkey % 4 when 0 then 'und die' when 1 then 'The' when 2 then 'cafe' else 'la' end as to_poi, case n_nationkey % 4 when 0 then 1 when 1 then 2 when 2 then 4 else 8 end as mode from nation"""
#: Raw ways and nodes as a map file has them, but with one column for each tag.
RAW_WAYS = f"""select o_orderkey as way_id, case when o_orderkey % 13 = 5 and o_orderkey % 2 = 0 then null else case cast(o_orderkey % 21 as int) {_HIGHWAYS} end end as highway,
 case o_orderkey % 7 when 0 then 'yes' when 1 then '-1' when 2 then 'no' when 3 then 'true' when 4 then 'reverse' end as oneway, case when o_orderkey % 11 = 0 then 'roundabout' end as junction,
 case when o_orderkey % 13 = 5 then case o_orderkey % 3 when 0 then 'all' when 1 then 'even' else 'odd' end end as interp_type, case when o_orderkey % 13 = 5 and o_orderkey % 5 <> 0 then 'Phố Số ' || cast(o_custkey % 97 as string) end as street from orders"""
RAW_NODES = f"""select osm_id, lat, lon, case when osm_id % 9 <> 0 then cast(osm_id % 300 as string) || case when osm_id % 10 = 0 then 'B' else '' end end as house_number from ({NODES})"""
TABLES = {"fx_nodes": (NODES, "part"), "fx_ways": (WAYS, "orders"), "fx_way_nodes": (WAY_NODES, "lineitem"), "fx_points": (POINTS, "events"), "fx_ranges": (RANGES, "orders"), "fx_places": (PLACES, "documents"), "fx_addresses": (ADDRESSES, "customer"), "fx_requests": (REQUESTS, "supplier"), "fx_trips": (TRIPS, "nation"), "fx_visits": (VISITS, "nation"), "fx_raw_ways": (RAW_WAYS, "orders"), "fx_raw_nodes": (RAW_NODES, "part")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection over the Parquet tables of ``sf_dir``."""
    sql, table = TABLES[name]
    return spark.sql(sql.replace(f" from {table}", " from {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_fixtures(sql: str) -> str:
    """DuckDB SQL with the projections it names as common table expressions."""
    used = [n for n in TABLES if n in sql]
    ctes = ",\n".join(f"{n} as ({TABLES[n][0]})" for n in used)
    body = sql.strip()
    if not used:
        return body
    return f"with {'recursive ' if 'recursive' in body else ''}{ctes},\n{body[4:].lstrip().removeprefix('recursive ')}" if body.startswith("with") else f"with {ctes}\n{body}"
