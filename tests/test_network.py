import heapq
import math
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom import catalog
from wayloom.functions import text
from wayloom.operators import address, graph, routing, search, spatial
from wayloom.plans import api, etl
from wayloom.sources import pbf, tables
from wayloom.sources.fixtures import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    return tables.cut(catalog._edges(spark, SF))


def dijkstra(rows, source):
    out = {}
    for u, v, w in rows:
        out.setdefault(u, []).append((v, w))
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d <= best[u]:
            for v, w in out.get(u, ()):
                if d + w < best.get(v, math.inf):
                    best[v] = d + w
                    heapq.heappush(heap, (d + w, v))
    return best


@pytest.mark.parametrize("mode", [1, 4])
def test_paths_are_shortest(spark, edges, mode, monkeypatch):
    e = graph.cheapest(edges, mode)
    rows = [(r.src, r.dst, r.seconds) for r in e.collect()]
    cost, best = {(u, v): w for u, v, w in rows}, dijkstra(rows, 3)
    pairs = spark.createDataFrame([(i, 3, t) for i, t in enumerate((3, 9, 60, 121, 10**9))], "req_id long, source long, target long")
    held = {r.req_id: r for r in routing.paths(e, pairs).collect()}
    monkeypatch.setattr(routing, "EDGE_BOUND", 0)  # the way without a broadcast
    walked = {r.req_id: r for r in routing.paths(e, pairs).collect()}
    for found in (held, walked):
        assert found[0].valid and found[0].path_nodes == [3] and not found[4].valid
        for r in list(found.values())[:4]:
            if r.target in best and r.target != 3:
                assert r.path_nodes[0] == 3 and r.path_nodes[-1] == r.target
                assert sum(cost[p] for p in zip(r.path_nodes, r.path_nodes[1:], strict=False)) == pytest.approx(best[r.target], rel=1e-9)


def test_hierarchy_keeps_distances(spark, edges):
    rows = [(r.src, r.dst, r.seconds) for r in graph.cheapest(edges, 4).collect()]
    ranks, full = routing.contract(edges, 4, 2, None)
    pairs = spark.createDataFrame([(s, t) for s in (3, 8) for t in (9, 60, 121, 150)], "source long, target long")
    for r in routing.hierarchy_distance(ranks, full, pairs).collect():
        assert r.seconds == pytest.approx(dijkstra(rows, r.source)[r.target], rel=1e-9)
    short = full.where("mid_node is not null").limit(5).collect()
    assert short
    own = {(u, v): w for u, v, w in rows}
    paths = routing.unpack(spark.createDataFrame([(i, [x.src, x.dst]) for i, x in enumerate(short)], "req_id long, path_nodes array<long>"), full)
    for r in paths.collect():
        assert sum(own[p] for p in zip(r.path_nodes, r.path_nodes[1:], strict=False)) == pytest.approx(short[r.req_id].seconds, rel=1e-9)


def test_streets_are_contracted_to_the_end(spark, monkeypatch):
    """A grid of streets with one-way and missing roads: most nodes leave the core, and routes stay the shortest."""
    import random

    r, n = random.Random(3), 10
    rows = {}
    for y in range(n):
        for x in range(n):
            for b in ((y, x + 1), (y + 1, x)):
                if b[0] < n and b[1] < n and r.random() < 0.9:
                    u, v, w = y * n + x, b[0] * n + b[1], float(r.randrange(1, 90))
                    rows[u, v] = w
                    if r.random() < 0.8:
                        rows[v, u] = w + r.randrange(3)
    e = spark.createDataFrame([(u, v, w) for (u, v), w in rows.items()], "src long, dst long, seconds double")
    ranks, full = routing.contract_cheapest(e)
    assert ranks.where(F.col("rank") == ranks.agg(F.max("rank")).first()[0]).count() < 0.2 * n * n
    assert not full.where("mid_node is not null").isEmpty()
    asked = [(i, r.randrange(n * n), r.randrange(n * n)) for i in range(60)] + [(60, None, 3), (61, 3, 10**9)]
    pairs = spark.createDataFrame(asked, "req_id long, source long, target long")
    held = {x.req_id: x for x in routing.paths(e, pairs, (ranks, full)).collect()}
    monkeypatch.setattr(routing, "EDGE_BOUND", 0)
    some = pairs.where("req_id < 6 or req_id > 59")
    joined = {x.req_id: x for x in routing.paths(e, some, (ranks, full)).collect()}
    best = {s: dijkstra([(u, v, w) for (u, v), w in rows.items()], s) for _, s, _ in asked if s is not None}
    assert len(held) == 62 and len(joined) == 8
    for found in (held, joined):
        for x in found.values():
            want = best.get(x.source, {}).get(x.target)
            assert x.valid == (want is not None)
            if x.valid:
                assert x.seconds == pytest.approx(want) and (x.path_nodes[0], x.path_nodes[-1]) == (x.source, x.target)
                assert sum(rows[p] for p in zip(x.path_nodes, x.path_nodes[1:], strict=False)) == pytest.approx(want)


def test_snap_is_the_nearest(spark, edges):
    points = load(spark, SF, "fx_points").limit(25)
    got = {r.point_id: r.dist_m for r in spatial.snap(points, edges).collect()}
    rows = edges.select("lat_src", "lon_src", "lat_dst", "lon_dst").distinct().collect()
    for p in points.collect():
        best = math.inf
        for a, b, c, d in rows:
            size = (c - a) ** 2 + (d - b) ** 2
            t = 0.0 if size < 1e-18 else max(0.0, min(1.0, ((p.lat - a) * (c - a) + (p.lon - b) * (d - b)) / size))
            y, x = math.radians(a + t * (c - a) - p.lat), math.radians(b + t * (d - b) - p.lon)
            h = math.sin(y / 2) ** 2 + math.cos(math.radians(p.lat)) * math.cos(math.radians(a + t * (c - a))) * math.sin(x / 2) ** 2
            best = min(best, 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))
        assert got[p.point_id] == pytest.approx(best, abs=2e-3)
    assert spatial.snap(points, edges.limit(0)).count() == 0


def test_snap_far_points_and_stored_tiles(spark, edges, tmp_path):
    """Far, clustered and missing positions find the nearest of all segments, at any tile size, and from stored tiles."""
    own = [(0, 48.0, 2.0), (1, 21.0, 105.8), (2, -33.0, -70.0), (3, 21.0001, 105.8001), (4, 16.0, 111.0), (5, 30.0, 105.9), (6, None, 2.0)]
    points = spark.createDataFrame(own, "point_id long, lat double, lon double")
    rows = edges.select("lat_src", "lon_src", "lat_dst", "lon_dst").distinct().collect()
    want = {}
    for i, lat, lon in own[:-1]:
        best = math.inf
        for a, b, c, d in rows:
            size = (c - a) ** 2 + (d - b) ** 2
            t = 0.0 if size < 1e-18 else max(0.0, min(1.0, ((lat - a) * (c - a) + (lon - b) * (d - b)) / size))
            y, x = math.radians(a + t * (c - a) - lat), math.radians(b + t * (d - b) - lon)
            h = math.sin(y / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(a + t * (c - a))) * math.sin(x / 2) ** 2
            best = min(best, 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))
        want[i] = pytest.approx(best, abs=2e-3)
    spatial.snap_index(edges).write.parquet(str(tmp_path / "tiles"))
    index = spark.read.parquet(str(tmp_path / "tiles"))
    for got in (spatial.snap(points, edges), spatial.snap(points, edges, 0.02), spatial.snap(points, None, index=index)):
        assert {r.point_id: r.dist_m for r in got.collect()} == want


def test_bm25_equals_sqlite(spark):
    places = catalog._places(spark, SF)
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table p using fts5(name, name_norm, type, tokenize='unicode61')")
    db.executemany("insert into p(rowid, name, name_norm, type) values (?, ?, ?, ?)", [(r.id + 1, r.name, r.name_norm, r.type) for r in places.collect()])
    asked = ["the", "the an", "th th", "de la", "zzzz"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    got = {}
    for r in search.search(places, queries, 10**6).collect():
        got.setdefault(r.query_id, {})[r.place_id] = r.score
    for i, q in enumerate(asked):
        want = {r[0] - 1: -r[1] for r in db.execute("select rowid, bm25(p) from p where p match ?", (" ".join(f"{t}*" for t in q.split()),))}
        assert got.get(i, {}).keys() == want.keys()
        assert all(got[i][k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_routes_of_requests(spark, edges):
    nodes = load(spark, SF, "fx_nodes")
    trips = spark.createDataFrame([(0, 20.61, 105.41, 21.33, 106.21, 1), (1, 20.61, 105.41, 20.61, 105.41, 2)], "req_id long, lat_a double, lon_a double, lat_b double, lon_b double, mode int")
    out = {r.req_id: r for r in api.route_coords(trips, edges, nodes).collect()}
    assert out[0].valid and out[0].time_s > 0 and len(out[0].path_coords) == len(out[0].path_nodes)
    assert out[1].valid and out[1].distance_m == 0 and len(out[1].path_nodes) == 1
    assert api.route_coords(trips.limit(0), edges, nodes).count() == 0


def test_snap_metres_are_rounded_by_millimetres(spark):
    degrees = math.degrees(12.3496 / 6_371_000.0)  # 12.350 m, which makes 12.4; the metres themselves would make 12.3
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.01)], "osm_id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, 15, 60.0, 0.0, 0.0, 0.0, 0.01)], "src long, dst long, mode int, seconds double, lat_src double, lon_src double, lat_dst double, lon_dst double")
    asked = spark.createDataFrame([(0, degrees, 0.002, degrees, 0.008, 1)], "req_id long, lat_a double, lon_a double, lat_b double, lon_b double, mode int")
    r = api.route_coords(asked, edges, nodes).first()
    assert (r.valid, r.snap_a_m, r.snap_b_m, r.time_min) == (True, 12.4, 12.4, 1.0)


def test_ranges(spark):
    ways = spark.createDataFrame([(1, [10, 11, 12], "Phố A", "all"), (2, [12, 10], "Phố B", "odd"), (3, [10, 99], "X", "all"), (4, [10], "Y", "all")], "way_id long, node_ids array<long>, street string, interp_type string")
    nodes = spark.createDataFrame([(10, 21.0, 105.0, "1"), (12, 21.2, 105.4, "21B")], "osm_id long, lat double, lon double, house_number string")
    ranges = address.resolve_ranges(ways, nodes)
    assert {(r.id, r.street_norm, r.num_start, r.num_end, r.lat_start) for r in ranges.collect()} == {(1, "pho a", 1, 21, 21.0), (2, "pho b", 1, 21, 21.0)}
    asked = spark.createDataFrame([(1, "pho a", 11), (2, "pho a", 22), (3, "nowhere", 1)], "req_id long, street_norm string, number int")
    got = {r.req_id: (round(r.lat, 6), round(r.lon, 6)) for r in address.interpolate(asked, ranges).collect()}
    assert got == {1: (21.1, 105.2), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(n, value):
    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def zig(n):
    return (n << 1) ^ (n >> 63)


def test_map_file_to_tables(spark, tmp_path):
    words = [b"", b"highway", b"residential", b"name", b"Pho A", b"amenity", b"cafe"]
    table = field(1, b"".join(field(1, w) for w in words))
    pack = lambda xs: b"".join(varint(x) for x in xs)
    dense = field(2, field(1, pack([zig(1), zig(1), zig(1)])) + field(8, pack([zig(210000000), zig(1000), zig(1000)])) + field(9, pack([zig(1058000000), zig(0), zig(1000)])) + field(10, pack([5, 6, 0, 0, 0])))
    way = field(3, field(1, 7) + field(2, pack([1, 3])) + field(3, pack([2, 4])) + field(8, pack([zig(1), zig(1), zig(1)])))
    block = table + field(2, dense) + field(2, way)
    blob = field(2, len(block)) + field(3, zlib.compress(block))
    head = field(1, b"OSMData") + field(3, len(blob))
    path = tmp_path / "map.osm.pbf"
    path.write_bytes(struct.pack(">I", len(head)) + head + blob)
    tables.ship(spark)
    spark.dataSource.register(pbf.OsmPbf)
    read = lambda kind: spark.read.format("osm_pbf").option("path", str(path)).option("kind", kind).load()
    assert [(r.osm_id, r.lat, r.tags) for r in read("nodes").collect()][0] == (1, 21.0, {"amenity": "cafe"})
    out, counters = etl.build(spark, read("ways"), read("nodes"), str(tmp_path / "out"), 1)
    assert counters["edges_inserted"] == 4 and counters["places_inserted"] == 1 and counters["places_skipped"] == 1 and counters["ranges_resolved"] == 0
    assert out["ranks"].count() == 3 and out["tiles"].count() > 0 and tables.coordinates(spark, str(tmp_path / "out")).columns == ["lat", "lon"]
    assert out["edges"].count() == 4 and out["nodes"].count() == 3
    assert {r.type for r in out["places"].collect()} == {"street:residential"}
    out["nodes"].write.parquet(str(tmp_path / "bad/edges"))
    with pytest.raises(ValueError):
        tables.read(spark, str(tmp_path / "bad"), "edges")


def test_ways_are_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = [(w, [w % 7, w % 5 + 7, w % 3 + 12, w % 3 + 12, w % 7], {"highway": "primary", "name": f"Đường {w}"} | ({"oneway": "-1"} if w % 4 == 0 else {}) | ({"addr:interpolation": "all"} if w % 9 == 0 else {})) for w in range(40)]
    rdd = spark.sparkContext.parallelize(rows, 2).map(lambda r: (seen.add(1), r)[1])
    ways = spark.createDataFrame(rdd, "way_id long, node_ids array<long>, tags map<string,string>")
    nodes = spark.createDataFrame([(i, 21.0 + i / 100, 105.8 + i * i / 1000, {"addr:housenumber": str(i)}) for i in range(15)], "osm_id long, lat double, lon double, tags map<string,string>")
    out, counters = etl.build(spark, ways, nodes, str(tmp_path / "out"))
    assert seen.value == len(rows)
    roads = etl.split_ways(spark.createDataFrame(rows, ways.schema))[0]
    want = graph.road_edges(roads, roads.select("way_id", F.posexplode("node_ids").alias("pos", "node_id")), nodes)
    columns = ("way_id", "pos", "src", "dst", "mode", "highway", "metres")
    assert counters["edges_inserted"] > 0 and sorted(out["edges"].select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_search_ignores_punctuation(spark):
    places = spark.createDataFrame([(1, "Phố A", "", "cafe", 1.0, 2.0)], "id long, name string, name_vi string, type string, lat double, lon double").withColumn("name_norm", text.normalize(F.col("name")))
    asked = spark.createDataFrame([(1, "pho."), (2, "!!"), (3, "phô")], "query_id long, q string")
    assert {r.query_id for r in search.search(places, asked).collect()} == {1, 3}


def test_stream(spark, tmp_path, edges):
    from wayloom.streaming.snapping import snap_stream

    load(spark, SF, "fx_points").limit(5).select("point_id", "lat", "lon").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("point_id long, lat double, lon double").parquet(str(tmp_path / "in"))
    q = snap_stream(stream, edges, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def joined_rows(df):
    """Most rows that a join of a collected query put out."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_numbers_asked_often_are_answered_once(spark):
    ranges = spark.range(2000).selectExpr("9 - id % 10 as id", "'pho a' as street_norm", "cast(id % 2 as int) as num_start", "21 as num_end", "21d + 9 - id % 10 as lat_start", "105d as lon_start", "23d as lat_end", "106d as lon_end", "if(id % 2 = 0, 'even', 'all') as interp_type")
    asked = spark.range(3000).selectExpr("id as req_id", "'pho a' as street_norm", "11 as number", "case id % 4 when 0 then 'even' when 1 then 'odd' when 2 then 'all' end as interp_type")
    out = address.interpolate(asked, ranges)
    got = {(r.req_id % 4, round(r.lat, 6), round(r.lon, 6)) for r in out.collect()}
    assert got == {(0, 22.52381, 105.52381), (1, 0.0, 0.0), (2, 22.0, 105.5), (3, 0.0, 0.0)}
    assert joined_rows(out) <= 3000


def test_few_origins_need_no_hierarchy(spark, monkeypatch):
    def never(*_):
        raise AssertionError("contracted")

    monkeypatch.setattr(routing, "contract_cheapest", never)
    roads = [(1, 2, 1.0), (2, -3, 1.0), (1, -3, 5.0), (-3, 4, 1.0), (7, 7, 1.0), (8, 9, 2.0)]
    edges = spark.createDataFrame(roads, "src long, dst long, seconds double")
    asked = [(1, 1, 4), (2, 1, 1), (3, 1, 8), (4, 7, 7), (5, None, 1), (6, 1, None), (7, 8, 9), (8, 99, 99), (9, -3, 4)]
    got = {r.req_id: (r.valid, r.seconds, r.path_nodes) for r in routing.paths(edges, spark.createDataFrame(asked, "req_id long, source long, target long")).collect()}
    no = (False, None, None)
    assert got == {1: (True, 3.0, [1, 2, -3, 4]), 2: (True, 0.0, [1]), 3: no, 4: no, 5: no, 6: no, 7: (True, 2.0, [8, 9]), 8: no, 9: (True, 1.0, [-3, 4])}


def test_large_networks_are_taken_apart(spark, monkeypatch):
    """beyond the broadcast bound components are searched by themselves, and only what no task can hold is contracted."""
    import random

    r = random.Random(5)
    arcs = {(100 * k + a, 100 * k + b): r.randint(1, 50) for k in range(4) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(100 + 60 * (k == 3)))}
    edges = spark.createDataFrame([(a, b, float(w)) for (a, b), w in arcs.items()], "src long, dst long, seconds double")
    asked = [(i, 100 * r.randrange(4) + r.randrange(42), 100 * r.randrange(4) + r.randrange(42)) for i in range(300)] + [(300 + i, i % 40 + 300, i * 7 % 40 + 300) for i in range(60)] + [(900, None, 1), (901, 1, None), (902, None, None), (903, 1, 1)]
    pairs = spark.createDataFrame(asked, "req_id long, source long, target long")
    net = routing.Network(*(np.array(x) for x in zip(*[(a, b, float(w)) for (a, b), w in arcs.items() if a != b], strict=True)))
    contracted = []

    def told(roads, *more):
        contracted.append({x.src // 100 for x in roads.collect()})
        return contract(roads, *more)

    contract = routing.contract_cheapest
    monkeypatch.setattr(routing, "contract_cheapest", told)
    monkeypatch.setattr(routing, "EDGE_BOUND", len(net.dst) - 1)
    monkeypatch.setattr(routing, "GROUP_REQUESTS", 20)
    for most, by_joins in ((1000, []), (110, [{3}])):
        contracted.clear()
        monkeypatch.setattr(routing, "GROUP_EDGES", most)
        got = {x.req_id: x for x in routing.paths(edges, pairs).collect()}
        assert contracted == by_joins and len(got) == len(asked)
        for i, s, t in asked:
            at, to = (None if n is None else net.index(n) for n in (s, t))
            best = None if at is None or to is None else net.settle(at)[0].get(to)
            assert (got[i].source, got[i].target, got[i].valid, got[i].seconds) == (s, t, best is not None, best)
            if best is not None:
                way = got[i].path_nodes
                assert way[0] == s and way[-1] == t and sum(arcs[a, b] for a, b in zip(way[:-1], way[1:], strict=True)) == best


def test_segments_are_not_shuffled_to_their_nodes(spark, monkeypatch):
    """few nodes are broadcast to the segments; many are joined, with the same edges."""
    def made():
        out = graph.road_edges(load(spark, SF, "fx_ways"), load(spark, SF, "fx_way_nodes"), load(spark, SF, "fx_nodes"))
        rows = sorted(tuple(r) for r in out.collect())
        return rows, out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin")

    held, joins = made()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert made()[1] >= 2 and joins >= 2
        monkeypatch.setattr(graph, "NODE_BOUND", 10)
        joined, joins = made()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins == 0 and joined == held


def test_routes_from_few_origins_are_searched_in_what_they_reach(spark, monkeypatch):
    """of a network beyond the broadcast bound only what the origins reach is searched, in memory, and a position is snapped once."""

    def never(*_):
        raise AssertionError("relaxed by joins")

    asked, snap = [], spatial.snap
    monkeypatch.setattr(spatial, "snap", lambda points, edges: asked.append(points.count()) or snap(points, edges))
    monkeypatch.setattr(routing, "relax", never)
    monkeypatch.setattr(routing, "EDGE_BOUND", 40)
    at = {n: (21.0 + n % 10 * 0.01, 105.0 + n // 10) for n in [*range(4), *range(10, 15), *range(20, 60)]}
    roads = [(n, n + 1, m, 60.0 + m) for n in at for m in (1, 3) if n + 1 in at and n % 10 < 9]
    edges = spark.createDataFrame([(u, v, m, s, *at[u], *at[v]) for u, v, m, s in roads], "src long, dst long, mode int, seconds double, lat_src double, lon_src double, lat_dst double, lon_dst double")
    nodes = spark.createDataFrame([(n, *p) for n, p in at.items()], "osm_id long, lat double, lon double")
    trips = [(1, 0, 3, 1), (2, 0, 3, 2), (3, 3, 0, 1), (4, 10, 14, 2), (5, 0, 14, 1), (6, 10, 14, 8)]
    out = api.route_coords(spark.createDataFrame([(k, *at[a], *at[b], m) for k, a, b, m in trips], "req_id long, lat_a double, lon_a double, lat_b double, lon_b double, mode int"), edges, nodes)
    got = {r.req_id: (r.valid, r.source, r.target, r.time_s, r.path_nodes) for r in out.collect()}
    assert edges.count() > 40 and asked == [4]
    assert got == {1: (True, 0, 3, 183.0, [0, 1, 2, 3]), 2: (True, 0, 3, 189.0, [0, 1, 2, 3]), 3: (False, 3, 0, None, None), 4: (True, 10, 14, 252.0, [10, 11, 12, 13, 14]), 5: (False, 0, 14, None, None), 6: (False, 10, 14, None, None)}


def test_reach_of_origins(spark, monkeypatch):
    """what is left out can't be on a route; everything stays where too much is reached."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 2), (5, 6), (6, 5), (7, 5)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 3), (None, 6)], "source long, target long")
    got = lambda: sorted(map(tuple, routing.within_reach(edges, pairs).collect()))
    every = sorted(map(tuple, edges.collect()))
    assert got() == every
    monkeypatch.setattr(routing, "EDGE_BOUND", 6)
    monkeypatch.setattr(routing, "REACH_ROUNDS", 2)
    assert got() == every
    monkeypatch.setattr(routing, "REACH_ROUNDS", 12)
    assert got() == every  # three nodes are more than a quarter of the bound
    edges = edges.unionByName(spark.createDataFrame([(n, n + 1) for n in range(100, 120)], "src long, dst long"))
    monkeypatch.setattr(routing, "EDGE_BOUND", 16)
    assert got() == [(1, 2), (2, 3), (3, 1)]


def test_trees_in_memory_equal_those_by_joins(spark):
    """the same seconds and, of ways of equal length, the same one."""
    rng = np.random.default_rng(5)
    src, dst, seconds = rng.integers(0, 60, 240), rng.integers(0, 60, 240), rng.integers(1, 5, 240).astype(float)
    edges = spark.createDataFrame([(int(u) * 7 - 50, int(v) * 7 - 50, float(s)) for u, v, s in zip(src, dst, seconds, strict=True) if u != v], "src long, dst long, seconds double")
    rows = routing.relax(edges, spark.createDataFrame([(-50,)], "source long")).collect()
    net = routing.Network(*(np.array(c) for c in zip(*edges.collect(), strict=True)))
    for step in (1, 20, 1 << 20):
        best, before = net.tree(net.index(-50), step)
        assert {int(n): (float(s), int(net.ids[b]) if b >= 0 else None) for n, s, b in zip(net.ids, best, before, strict=True) if np.isfinite(s)} == {r.node: (r.seconds, r.before) for r in rows}
