"""The offline pipeline: raw ways and nodes to stored tables, one Parquet write per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import tags
from wayloom.operators import address, graph, routing, search, spatial
from wayloom.sources import tables


def split_ways(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roads, interpolation ways) of ways with node_ids and tags.

    A way tagged as interpolation with two nodes or more is no road, even if it has a highway value.
    """
    kind = F.col("tags")["addr:interpolation"]
    is_range = kind.isNotNull() & (F.size("node_ids") >= 2)
    tag = lambda c: F.col("tags")[c]
    roads = ways.where(~F.coalesce(is_range, F.lit(False))).select("way_id", "node_ids", tag("highway").alias("highway"), tag("oneway").alias("oneway"), tag("junction").alias("junction"), tag("name").alias("name"), tag("name:vi").alias("name_vi"))
    ranges = ways.where(is_range).select("way_id", "node_ids", F.coalesce(tag("addr:street"), F.lit("")).alias("street"), kind.alias("interp_type"))
    return roads, ranges


def build(spark: SparkSession, ways: DataFrame, nodes: DataFrame, folder: str, hierarchy_mode: int = 0) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Writes nodes, edges, tiles, places and addr_ranges (and ranks and shortcuts of a mode) under ``folder``.

    Returns the tables as read again, and counters: rows inserted into each, places without a name and
    interpolation ways that were skipped, and ranges whose two ends were resolved.
    """
    raw = tables.cut(ways)  # every table asks them again
    roads, ranges = split_ways(raw)
    good = roads.where(tags.accepted(F.col("highway")))
    way_nodes = good.select(F.explode("node_ids").alias("node_id"))
    tag = lambda c: F.col("tags")[c]
    tagged = nodes.select("osm_id", "lat", "lon", tag("name").alias("name"), tag("name:vi").alias("name_vi"), tag("amenity").alias("amenity"), tag("shop").alias("shop"), tag("tourism").alias("tourism"), tag("addr:housenumber").alias("house_number"))
    used = graph.needed_nodes(tagged.select("osm_id", "lat", "lon"), way_nodes)
    edges = tables.cut(graph.road_edges_of_lists(good, tagged.select("osm_id", "lat", "lon")))
    found = tables.cut(search.node_places(tagged).unionByName(search.street_places(good)))
    ends = tables.cut(address.resolved_ends(ranges, tagged.select("osm_id", "lat", "lon", "house_number")))
    rows = {
        "nodes": used, "edges": edges.withColumn("weight", F.col("seconds")), "tiles": spatial.snap_index(edges),
        "places": search.storable(found).withColumn("id", F.xxhash64("type", "osm_id", "name")), "addr_ranges": address.ascending_ranges(ends),
    }
    if hierarchy_mode:
        ranks, full = routing.contract(edges, hierarchy_mode)
        rows |= {"ranks": ranks, "shortcuts": full.where("mid_node is not null").select("src", "dst", F.col("seconds").alias("weight"), F.lit(hierarchy_mode).alias("mode"), "mid_node")}
    n_ranges, counters = ranges.count(), {}
    for n, df in rows.items():
        counters[f"{n}_inserted"] = tables.write(df, folder, n)
        if n in (last := {"nodes": raw, "edges": edges}):  # no later table reads it
            tables.drop(last[n])
    counters["places_skipped"] = found.count() - counters["places_inserted"]
    counters["ranges_resolved"] = ends.count()
    counters["ranges_skipped"] = n_ranges - counters["addr_ranges_inserted"]
    return {n: tables.read(spark, folder, n) for n in rows}, counters
