"""From ways and nodes to a directed, weighted, mode-aware road graph, and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geo, tags


def accepted_ways(ways: DataFrame) -> DataFrame:
    """Ways of a known highway value with is_oneway, is_reversed, mode and speed_kmh."""
    return ways.where(tags.accepted(F.col("highway"))).withColumns({
        "is_oneway": tags.is_oneway(F.col("highway"), F.col("oneway"), F.col("junction")),
        "is_reversed": tags.is_reversed(F.col("oneway")),
        "mode": tags.mode_mask(F.col("highway")),
        "speed_kmh": tags.speed_kmh(F.col("highway")),
    })


def way_segments(way_nodes: DataFrame) -> DataFrame:
    """Consecutive node pairs of each way: way_id, pos, a, b; self-loops dropped."""
    by = Window.partitionBy("way_id").orderBy("pos")
    return way_nodes.select("way_id", "pos", F.col("node_id").alias("a"), F.lead("node_id").over(by).alias("b")).where("b is not null and a <> b")


def road_edges(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges with metres, seconds and mode; parallel edges stay, dangling ones go.

    The ways are joined before the window on the same key, so both use one exchange; each end
    then finds its node by an equi-join, without a shuffle of the segments up to ``NODE_BOUND`` nodes.
    """
    good = accepted_ways(ways).select("way_id", *_WAY)
    return _directed(way_segments(way_nodes).join(good, "way_id"), nodes)


def road_edges_of_lists(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """:func:`road_edges` of ways with ``node_ids``: neighbours in a list need neither a window nor a join."""
    n = F.greatest(F.size("node_ids") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("node_ids", F.lit(1), n).alias("a"), F.slice("node_ids", F.lit(2), n).alias("b"))
    seg = accepted_ways(ways).select("way_id", *_WAY, F.posexplode(pairs).alias("pos", "e")).select("way_id", *_WAY, "pos", "e.a", "e.b")
    return _directed(seg.where("b is not null and a <> b"), nodes)


#: Nodes that may be broadcast for the ends of segments, under 100 bytes each: then no segment is shuffled to find them.
NODE_BOUND = 2_000_000
_WAY = ("highway", "is_oneway", "is_reversed", "mode", "speed_kmh")


def _directed(seg: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments (way_id, pos, a, b and what is known of the way) with the positions of both ends, in the directions that the way allows."""
    seg = seg.withColumns({"u": F.when(F.col("is_reversed"), F.col("b")).otherwise(F.col("a")), "v": F.when(F.col("is_reversed"), F.col("a")).otherwise(F.col("b"))})
    end = lambda c: nodes.select(F.col("osm_id").alias(c), F.col("lat").alias(f"lat_{c}"), F.col("lon").alias(f"lon_{c}"))
    few = nodes.limit(NODE_BOUND + 1).count() <= NODE_BOUND
    held = lambda c: F.broadcast(end(c)) if few else end(c)
    seg = seg.join(held("u"), "u").join(held("v"), "v")
    seg = seg.withColumn("metres", geo.haversine(F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v")))
    seg = seg.withColumn("seconds", geo.travel_seconds(F.col("metres"), F.col("speed_kmh")))
    # one pass makes both directions
    there = F.struct(*[F.col(a).alias(b) for a, b in (("u", "src"), ("v", "dst"), ("lat_u", "lat_src"), ("lon_u", "lon_src"), ("lat_v", "lat_dst"), ("lon_v", "lon_dst"))])
    back = F.struct(*[F.col(a).alias(b) for a, b in (("v", "src"), ("u", "dst"), ("lat_v", "lat_src"), ("lon_v", "lon_src"), ("lat_u", "lat_dst"), ("lon_u", "lon_dst"))])
    both = F.when(F.col("is_oneway"), F.array(there)).otherwise(F.array(there, back))
    return seg.select("way_id", "pos", "highway", "mode", "metres", "seconds", F.inline(both))


def cheapest(edges: DataFrame, mode: int) -> DataFrame:
    """The cheapest of parallel edges that a mode may use: src, dst, seconds."""
    return edges.where(tags.allows(F.col("mode"), mode)).groupBy("src", "dst").agg(F.min("seconds").alias("seconds"))


def needed_nodes(nodes: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """Nodes that some way uses."""
    return nodes.join(way_nodes.select(F.col("node_id").alias("osm_id")), "osm_id", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, and the offset of its first edge in order of src."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    out = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return running_offset(out, "node", "out_degree", "offset")


def running_offset(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all smaller keys. Ranges of keys are summed by themselves and then shifted, so no task sees all rows."""
    from wayloom.sources.tables import cut

    parts = cut(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row for each partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))


def active_nodes(edges: DataFrame) -> DataFrame:
    """How many nodes have an edge of each mode."""
    modes = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("bit")) for n, m in tags.MODES.items()])
    ends = edges.select("mode", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.select("node", F.explode(F.filter(modes, lambda m: F.col("mode").bitwiseAND(m["bit"]) != 0)).alias("m")).groupBy(F.col("m.name").alias("mode")).agg(F.count_distinct("node").alias("active_nodes"))


def shortcut_candidates(edges: DataFrame, mode: int | None, vias: DataFrame | None = None) -> DataFrame:
    """For each node (or those of ``vias``), paths u -> via -> w of two edges with u <> w: cheapest cost of each.

    ``mode`` None: ``edges`` are the cheapest ones already.
    """
    e = edges if mode is None else cheapest(edges, mode)
    i, o = e.select(F.col("src").alias("u"), F.col("dst").alias("via"), F.col("seconds").alias("s1")), e.select(F.col("src").alias("via"), F.col("dst").alias("w"), F.col("seconds").alias("s2"))
    if vias is not None:
        i = i.join(vias, "via", "left_semi")
    return i.join(o, "via").where("u <> w").select("via", "u", "w", (F.col("s1") + F.col("s2")).alias("seconds"))


def needed_shortcuts(edges: DataFrame, mode: int | None, vias: DataFrame | None = None) -> DataFrame:
    """Candidates without a witness of one or two other edges that is as cheap; a missed witness costs a shortcut, never a distance."""
    e = edges if mode is None else cheapest(edges, mode)
    c = shortcut_candidates(edges, mode, vias)
    direct = e.select(F.col("src").alias("u"), F.col("dst").alias("w"), F.col("seconds").alias("direct"))
    two = c
    if vias is not None:  # witnesses may go through any node
        ends = c.select("u", "w").distinct()
        there = ends.join(e.select(F.col("src").alias("u"), F.col("dst").alias("via"), F.col("seconds").alias("s1")), "u").where("via <> w")
        two = there.join(e.select(F.col("src").alias("via"), F.col("dst").alias("w"), F.col("seconds").alias("s2")), ["via", "w"]).select("via", "u", "w", (F.col("s1") + F.col("s2")).alias("seconds"))
    best = two.groupBy("u", "w").agg(F.array_sort(F.collect_set(F.struct("seconds", "via"))).alias("two"))
    best = best.select("u", "w", F.slice("two", 1, 2).alias("two"))
    other = F.filter("two", lambda t: (t["via"] != F.col("via")) & (t["seconds"] <= F.col("seconds")))
    return c.join(direct, ["u", "w"], "left").join(best, ["u", "w"]).where((F.col("direct").isNull() | (F.col("direct") > F.col("seconds"))) & (F.size(other) == 0)).select("via", "u", "w", "seconds")


def contraction_priority(edges: DataFrame, mode: int) -> DataFrame:
    """node, shortcuts, edges and priority of every node before any contraction."""
    e = cheapest(edges, mode)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n_edges"))
    made = needed_shortcuts(edges, mode).groupBy(F.col("via").alias("node")).agg(F.count("*").alias("n_shortcuts"))
    return ends.join(made, "node", "left").select("node", F.coalesce("n_shortcuts", F.lit(0).cast("long")).alias("n_shortcuts"), "n_edges", (F.coalesce("n_shortcuts", F.lit(0).cast("long")) - F.col("n_edges")).alias("priority"))
