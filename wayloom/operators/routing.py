"""Exact shortest paths.

Routes go through a hierarchy: contraction rounds are joins, and what they leave is a core. Where
its edges are at most ``EDGE_BOUND``, they are counted and broadcast as arrays, and every request
climbs from both ends and crosses the core from both sides, stopping as soon as no better
meeting is possible; requests are dealt evenly over tasks. A network beyond that bound is taken apart
into its connected components first: requests between two of them have no route, and each component of
at most ``GROUP_EDGES`` edges is searched from both sides in a task that holds it alone. Only larger ones are
contracted, and beyond the bound the same search
runs as joins over the nodes on the way up only. Shortcuts are unpacked in both cases.

Requests from few origins need no hierarchy: roads of at most ``EDGE_BOUND`` edges are broadcast and relaxed in
memory. Larger ones are relaxed from these origins by joins, which read them once
for each round, and the trees found are broadcast to be followed back. ``within_reach`` leaves out first what no
origin reaches.

Distances from an origin to all nodes are a heap over arrays, or relaxation as joins: each round
joins only the nodes improved in the last round to the edges and stops when none improves.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators.graph import NODE_BOUND, cheapest, needed_shortcuts
from wayloom.sources.tables import cut, free, ship

#: Edges that may be broadcast: 32 bytes each in a hierarchy, so 256 MB. A city of 7 million edges fits.
EDGE_BOUND = 8_000_000
#: Requests from at most so many origins go through a tree from each.
FEW_SOURCES = 8
#: Rounds in which the nodes within reach of few origins must be found.
REACH_ROUNDS = 12
#: Edges of a component that one task may hold, about 100 bytes each, and its requests for a task.
GROUP_EDGES, GROUP_REQUESTS = 2_000_000, 500
#: Tasks that first connect a network's nodes, and rows of these (about 50 bytes each) that one task connects.
STAR_TASKS, STAR_ROWS = 6, 8_000_000
#: No node: the least long.
NONE = -(1 << 63)


class Network:
    """Adjacency arrays of (src, dst, seconds)."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, seconds: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst]))
        s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.lexsort((d, s))
        self.dst, self.seconds = d[order], seconds[order]
        self.first = np.searchsorted(s[order], np.arange(len(self.ids) + 1))

    def index(self, node: int) -> int | None:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else None

    def settle(self, origin: int, targets: set[int] | None = None) -> tuple[dict[int, float], dict[int, int]]:
        """Distances and predecessors by index, until all targets are settled (None: everything)."""
        best, before, done = {origin: 0.0}, {}, set()
        heap, left = [(0.0, origin)], None if targets is None else set(targets)
        dst, seconds, first = self.dst, self.seconds, self.first
        while heap and (left is None or left):
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if left is not None:
                left.discard(u)
            a, b = first[u], first[u + 1]
            for v, w in zip(dst[a:b].tolist(), seconds[a:b].tolist(), strict=True):
                n = d + w
                if n < best.get(v, np.inf):
                    best[v], before[v] = n, u
                    heapq.heappush(heap, (n, v))
        return {u: best[u] for u in done}, before

    def tree(self, origin: int, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Seconds to all nodes and the node before each (-1: none) by index, relaxed in rounds as :func:`relax` does, so ties end alike."""
        best, before = np.full(len(self.ids), np.inf), np.full(len(self.ids), -1, dtype=np.int64)
        best[origin], fresh = 0.0, np.array([origin])
        while len(fresh):
            n_out = self.first[fresh + 1] - self.first[fresh]
            ends, offers = np.cumsum(n_out), []
            a = 0
            while a < len(fresh):  # about ``step`` edges at a time
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, side="right")))
                n, u = n_out[a:b], np.repeat(fresh[a:b], n_out[a:b])
                e = np.repeat(self.first[fresh[a:b]] - (np.cumsum(n) - n), n) + np.arange(len(u))
                v, seconds = self.dst[e], best[u] + self.seconds[e]
                offers.append(_least(v, seconds, u, seconds < best[v]))
                a = b
            v, seconds, u = _least(*(np.concatenate(c) for c in zip(*offers, strict=True)))
            best[v], before[v], fresh = seconds, u, v
        return best, before


def _least(node: np.ndarray, seconds: np.ndarray, before: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the offers (or ``some`` of them) the least for each node, by seconds and then by the node before."""
    if some is not None:
        node, seconds, before = node[some], seconds[some], before[some]
    order = np.lexsort((before, seconds, node))
    first = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
    return node[first], seconds[first], before[first]


def _held(edges: DataFrame):
    """A broadcast network, or None where there are too many edges."""
    ship(edges.sparkSession)
    if edges.limit(EDGE_BOUND + 1).count() > EDGE_BOUND:
        return None
    t = edges.select("src", "dst", "seconds").toArrow()
    return edges.sparkSession.sparkContext.broadcast(Network(*(t.column(c).to_numpy() for c in ("src", "dst", "seconds"))))


def relax(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, seconds and the node before, by joins to the fixpoint; ``sources`` has source, ``edges`` src, dst, seconds."""
    start = F.col("source").cast("long")
    known = cut(sources.where("source is not null").select(start.alias("source"), start.alias("node"), F.lit(0.0).alias("seconds"), F.lit(None).cast("long").alias("before"), F.lit(True).alias("fresh")).distinct())
    out = edges.select(F.col("src").alias("node"), "dst", F.col("seconds").alias("w"))
    while True:
        offers = known.where("fresh").join(out, "node").groupBy("source", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("seconds") + F.col("w")).alias("seconds"), F.col("node").alias("before"))).alias("o"))
        merged = known.drop("fresh").join(offers, ["source", "node"], "full_outer")
        better = F.col("o").isNotNull() & (F.col("seconds").isNull() | (F.col("o.seconds") < F.col("seconds")))
        known = cut(merged.select("source", "node", F.when(better, F.col("o.seconds")).otherwise(F.col("seconds")).alias("seconds"), F.when(better, F.col("o.before")).otherwise(F.col("before")).alias("before"), better.alias("fresh")))
        if known.where("fresh").isEmpty():
            return known.drop("fresh")


def within_reach(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) that can be on a route of requests (source) from few origins.

    Nodes are followed outwards, which shuffles no edges. All ``edges`` are returned where nothing is gained: if at
    most ``EDGE_BOUND`` edges are asked, or if the origins, the rounds or the edges within reach are too many.
    """
    if edges.limit(EDGE_BOUND + 1).count() <= EDGE_BOUND:
        return edges
    origins = pairs.where("source is not null").select(F.col("source").cast("long").alias("node")).distinct().limit(FEW_SOURCES * 4 + 1).collect()
    if len(origins) > FEW_SOURCES * 4:
        return edges
    fresh = cut(edges.sparkSession.createDataFrame(origins, "node long"))
    known, n = fresh, len(origins)
    out = lambda nodes: edges.join(F.broadcast(nodes.withColumnRenamed("node", "src")), "src", "left_semi")
    for _ in range(REACH_ROUNDS):
        fresh = cut(out(fresh).select(F.col("dst").alias("node")).distinct().join(F.broadcast(known), "node", "left_anti"))
        more = fresh.count()
        n += more
        if n > EDGE_BOUND // 4:
            return edges
        if not more:
            near = out(known)
            return cut(near) if near.limit(EDGE_BOUND + 1).count() <= EDGE_BOUND else edges
        known = known.unionByName(fresh)
    return edges


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, seconds for every node that each source reaches."""
    edges = cut(edges)
    held = _held(edges)
    if held is None:
        return relax(edges, sources).drop("before")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        net, source = held.value, int(pdf["source"].iloc[0])
        at = net.index(source)
        found = {} if at is None else net.settle(at)[0]
        out = pd.DataFrame({"source": source, "node": net.ids[list(found)] if found else [source], "seconds": list(found.values()) or [0.0]})
        return out.astype({"source": "int64", "node": "int64", "seconds": "float64"})

    return sources.select(F.col("source").cast("long")).distinct().groupBy("source").applyInPandas(run, "source long, node long, seconds double")


class Side:
    """One direction of a search: all nodes on the way up from an origin, then the core, node by node."""

    __slots__ = ("before", "best", "done", "graph", "heap")

    def __init__(self, graph: Upward, core: np.ndarray, origin: int):
        self.graph, self.best, self.before, self.done, self.heap = graph, {origin: 0.0}, {}, set(), []
        climb = [(0.0, origin)]
        while climb:
            d, u = heapq.heappop(climb)
            if d > self.best[u]:
                continue
            if core[u]:
                self.heap.append((d, u))
                continue
            for v, w in self.graph.out(u):
                if d + w < self.best.get(v, np.inf):
                    self.best[v], self.before[v] = d + w, u
                    heapq.heappush(climb, (d + w, v))
        heapq.heapify(self.heap)

    def top(self) -> float:
        """The distance at which the search of the core goes on."""
        heap = self.heap
        while heap and (heap[0][1] in self.done or heap[0][0] > self.best[heap[0][1]]):
            heapq.heappop(heap)
        return heap[0][0] if heap else np.inf

    def step(self, other: Side, least: float, meet: int | None) -> tuple[float, int | None]:
        """Settles one node of the core; the best sum of both sides so far and where they meet."""
        d, u = heapq.heappop(self.heap)
        self.done.add(u)
        best, before, heap, far = self.best, self.before, self.heap, other.best
        for v, w in self.graph.out(u):
            n = d + w
            if n < best.get(v, np.inf):
                best[v], before[v] = n, u
                heapq.heappush(heap, (n, v))
                if v in far and n + far[v] < least:
                    least, meet = n + far[v], v
        return least, meet

    def path(self, node: int) -> list[int]:
        """From a node back to the origin."""
        out = [node]
        while out[-1] in self.before:
            out.append(self.before[out[-1]])
        return out


class Upward:
    """Adjacency arrays of the edges that lead from each node to higher ranks or, in the core, to the core."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, seconds: np.ndarray, mid: np.ndarray):
        order = np.lexsort((dst, src))
        self.dst, self.seconds, self.mid = dst[order].astype(np.int32), seconds[order], mid[order].astype(np.int32)
        self.first = np.searchsorted(src[order], np.arange(n + 1))

    def out(self, u: int) -> Iterator[tuple[int, float]]:
        a, b = self.first[u], self.first[u + 1]
        return zip(self.dst[a:b].tolist(), self.seconds[a:b].tolist(), strict=True)

    def middle(self, u: int, v: int) -> int | None:
        """The node that an edge of the graph goes through, -1 for a road; None if there is no such edge."""
        a, b = self.first[u], self.first[u + 1]
        k = a + int(np.searchsorted(self.dst[a:b], v))
        return int(self.mid[k]) if k < b and self.dst[k] == v else None


class Hierarchy:
    """A contracted network for exact routes: up from both ends, both sides through the core, stop as soon as they can't improve."""

    def __init__(self, node: np.ndarray, rank: np.ndarray, src: np.ndarray, dst: np.ndarray, seconds: np.ndarray, mid: np.ndarray):
        order = np.argsort(node)
        self.ids, rank = node[order], rank[order]
        at = lambda x: np.searchsorted(self.ids, x)
        s, d, m = at(src), at(dst), np.where(mid < 0, -1, at(mid))
        self.core = rank == rank.max() if len(rank) else np.zeros(0, dtype=bool)
        up, down = (rank[d] > rank[s]) | (self.core[s] & self.core[d]), (rank[s] > rank[d]) | (self.core[s] & self.core[d])
        n = len(self.ids)
        self.ahead = Upward(n, s[up], d[up], seconds[up], m[up])
        self.behind = Upward(n, d[down], s[down], seconds[down], m[down])

    def index(self, node: int | None) -> int | None:
        if node is None:
            return None
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else None

    def route(self, start: Side, t: int) -> tuple[float, list[int]] | None:
        """Seconds and nodes of the shortest route; ``start`` is searched further only as far as needed and can serve other ends."""
        end = Side(self.behind, self.core, t)
        least, meet = np.inf, None
        for v in end.best if len(end.best) < len(start.best) else start.best:
            if v in start.best and v in end.best and start.best[v] + end.best[v] < least:
                least, meet = start.best[v] + end.best[v], v
        while True:
            a, b = start.top(), end.top()
            if a + b >= least:
                break
            least, meet = start.step(end, least, meet) if a <= b else end.step(start, least, meet)
        if meet is None:
            return None
        return least, self.unpacked(start.path(meet)[::-1] + end.path(meet)[1:])

    def unpacked(self, path: list[int]) -> list[int]:
        """Shortcuts replaced by their two halves until every step is a road."""
        out, todo = path[:1], list(zip(path[:-1], path[1:], strict=True))[::-1]
        while todo:
            u, v = todo.pop()
            mid = self.ahead.middle(u, v)
            if mid is None:
                mid = self.behind.middle(v, u)
            if mid < 0:
                out.append(v)
            else:
                todo += [(mid, v), (u, mid)]
        return out


SCHEMA = "req_id long, source long, target long, valid boolean, seconds double, path_nodes array<long>"


def _answered(net: Hierarchy, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Routes of requests (req_id, source, target) in order of their sources."""
    last, start = None, None
    for b in batches:
        rows = []
        for req, source, target in zip(*(c.to_pylist() for c in b.columns), strict=True):
            s, t = net.index(source), net.index(target)
            found = None
            if s is not None and t is not None:
                if s != last:
                    last, start = s, Side(net.ahead, net.core, s)
                found = net.route(start, t)
            rows.append((req, source, target, found is not None, found and found[0], found and net.ids[found[1]].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, _KINDS, strict=True)], names=["req_id", "source", "target", "valid", "seconds", "path_nodes"])


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _answered(held.value, batches)

    return run


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node that these edges connect each to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return ids, ids[root]


def _stars(batches: Iterator[pa.RecordBatch], step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the least that it is connected to here."""
    a, b, held = [], [], 0
    for t in batches:
        a.append(t.column(0).to_numpy())
        b.append(t.column(1).to_numpy())
        held += t.num_rows
        if held > step:
            n, r = _roots(np.concatenate(a), np.concatenate(b))
            a, b, held = [n], [r], 0
    if a:
        n, r = _roots(np.concatenate(a), np.concatenate(b))
        for k in range(0, len(n), step):
            yield pa.record_batch([n[k : k + step], r[k : k + step]], names=["a", "b"])


def _in_component(roads: pa.Table, asked: pa.Table) -> pa.Table:
    """Requests of one component by searches from both sides: nothing is contracted, so all of it is core."""
    src, dst, seconds = (roads.column(c).to_numpy() for c in ("src", "dst", "seconds"))
    node = np.unique(np.concatenate([src, dst]))
    net = Hierarchy(node, np.ones(len(node), dtype=np.int32), src, dst, seconds, np.full(len(src), -1))
    rows = asked.select(["req_id", "source", "target"]).sort_by("source")
    return pa.Table.from_batches(_answered(net, rows.to_batches()), schema=pa.schema(list(zip(("req_id", "source", "target", "valid", "seconds", "path_nodes"), _KINDS, strict=True))))


def _by_component(roads: DataFrame, pairs: DataFrame, contracted: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Routes in a network beyond ``EDGE_BOUND``; ``contracted`` makes a hierarchy of the components that no task can hold."""
    from wayloom.llm.probminhash import components

    spark = roads.sparkSession
    # a task's rows are as many as its nodes, so few tasks make few rows; those of few nodes are joined in one
    stars = cut(roads.select("src", "dst").coalesce(STAR_TASKS).mapInArrow(_stars, "a long, b long"))
    if stars.count() <= STAR_ROWS:
        of = cut(stars.coalesce(1).mapInArrow(_stars, "node long, component long"))
    else:
        of = cut(components(stars).distinct())
    free(spark)
    at = lambda c, k: of.select(F.col("node").alias(c), F.col("component").alias(k))
    told = cut(pairs.join(at("source", "component"), "source", "left").join(at("target", "other"), "target", "left").select("req_id", "source", "target", "component", F.col("component").eqNullSafe(F.col("other")).alias("met")))
    none = told.where("not met or component is null").select("req_id", "source", "target", F.lit(False).alias("valid"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("array<long>").alias("path_nodes"))
    held = told.where("met and component is not null").drop("met")
    near = of.join(held.select("component").distinct(), "component", "left_semi").withColumnRenamed("node", "src")
    # roads aren't shuffled to find their component, only to meet in it
    placed = roads.join(F.broadcast(near) if of.limit(NODE_BOUND + 1).count() <= NODE_BOUND else near, "src")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n_edges"))
    # a component of many requests is copied to several tasks
    most = spark.sparkContext.defaultParallelism
    parts = held.groupBy("component").agg(F.least(F.lit(most), F.ceil(F.count("*") / GROUP_REQUESTS)).cast("int").alias("parts"))
    groups = cut(sizes.join(parts, "component"))
    small = groups.where(F.col("n_edges") <= GROUP_EDGES).select("component", "parts")
    dealt = placed.join(small, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "src", "dst", "seconds")
    asked = held.join(small, "component").select("component", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("part"), "req_id", "source", "target")
    found = dealt.groupBy("component", "part").cogroup(asked.groupBy("component", "part")).applyInArrow(_in_component, SCHEMA)
    out = cut(found).unionByName(none)
    free(spark)
    large = groups.where(F.col("n_edges") > GROUP_EDGES).select("component")
    if large.isEmpty():
        return out
    rest = cut(placed.join(large, "component", "left_semi").select("src", "dst", "seconds"))
    return out.unionByName(_through(*contracted(rest), cut(held.join(large, "component", "left_semi").select("req_id", "source", "target"))))


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.int64()))


def paths(edges: DataFrame, pairs: DataFrame, hierarchy: tuple[DataFrame, DataFrame] | Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """req_id, source, target, valid, seconds and path_nodes of each request (req_id, source, target).

    Without ``hierarchy``, (ranks, edges) of :func:`contract`, the network is contracted first if there are more
    than ``FEW_SOURCES`` origins; a function makes it from the roads (src, dst, seconds) where it is needed. A request
    whose ends are the same node is valid with no length; one that has no path, or an end that is null or
    on no road to another node, isn't valid. Of routes of equal length any may be given.
    """
    pairs = pairs.select("req_id", F.col("source").cast("long"), F.col("target").cast("long"))
    ship(edges.sparkSession)
    if hierarchy is None or callable(hierarchy):
        pairs, roads = cut(pairs), cut(edges.where("src <> dst").select("src", "dst", "seconds"))
        free(edges.sparkSession)
        if hierarchy is None:
            sources = [r[0] for r in pairs.where("source is not null").select("source").distinct().limit(FEW_SOURCES + 1).collect()]
            if len(sources) <= FEW_SOURCES and (found := _from_few(roads, pairs, sources)) is not None:
                return found
        contracted = hierarchy or contract_cheapest
        if roads.count() > EDGE_BOUND:
            return _by_component(roads, pairs, contracted)
        hierarchy = contracted(roads)
    return _through(*hierarchy, pairs)


def _through(ranks: DataFrame, full: DataFrame, pairs: DataFrame) -> DataFrame:
    """Routes through a hierarchy, broadcast or joined."""
    if full.limit(EDGE_BOUND + 1).count() > EDGE_BOUND:
        return _joined(ranks, full, cut(pairs))
    r, e = ranks.select("node", "rank").toArrow(), full.select("src", "dst", "seconds", F.coalesce("mid_node", F.lit(-1).cast("long")).alias("mid")).toArrow()
    spark = full.sparkSession
    held = spark.sparkContext.broadcast(Hierarchy(*(t.column(c).to_numpy() for t, c in ((r, "node"), (r, "rank"), (e, "src"), (e, "dst"), (e, "seconds"), (e, "mid")))))
    # an origin of many requests is split by their numbers, and its requests in a task share one search
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few requests are much work, too
    dealt = pairs.repartitionByRange(tasks, "source", "req_id").sortWithinPartitions("source")
    return dealt.mapInArrow(_search(held), SCHEMA)


class Trees:
    """Shortest ways from few origins to all nodes they reach: rows of (source, node, seconds, before)."""

    def __init__(self, source: np.ndarray, node: np.ndarray, seconds: np.ndarray, before: np.ndarray):
        order = np.lexsort((node, source))
        source, self.node, self.seconds, before = source[order], node[order], seconds[order], before[order]
        self.part = {int(s): (int(a), int(b)) for s in np.unique(source) for a, b in [(np.searchsorted(source, s), np.searchsorted(source, s, side="right"))]}
        self.parent = np.full(len(node), -1, dtype=np.int64)
        for a, b in self.part.values():
            known = np.flatnonzero(before[a:b] != NONE) + a
            self.parent[known] = a + np.searchsorted(self.node[a:b], before[known])

    def route(self, source: int | None, target: int | None) -> tuple[float, list[int]] | None:
        a, b = self.part.get(source, (0, 0))
        k = a + int(np.searchsorted(self.node[a:b], target)) if target is not None else b
        if k >= b or self.node[k] != target:
            return None
        seconds, path = float(self.seconds[k]), []
        while k >= 0:
            path.append(int(self.node[k]))
            k = int(self.parent[k])
        return seconds, path[::-1]


def _from_few(roads: DataFrame, pairs: DataFrame, sources: list[int]) -> DataFrame | None:
    """Routes from few origins; None if their trees have more than ``EDGE_BOUND`` nodes."""
    spark = roads.sparkSession
    if (held := _held(roads)) is not None:
        return pairs.repartitionByRange(spark.sparkContext.defaultParallelism, "source", "req_id").sortWithinPartitions("source").mapInArrow(_along(held), SCHEMA)
    used = roads.select(F.explode(F.array("src", "dst")).alias("source")).where(F.col("source").isin(sources)).distinct()
    tree = relax(roads, used)
    if tree.limit(EDGE_BOUND + 1).count() > EDGE_BOUND:
        return None
    t = tree.select("source", "node", "seconds", F.coalesce("before", F.lit(NONE).cast("long")).alias("before")).toArrow()
    held = spark.sparkContext.broadcast(Trees(*(t.column(c).to_numpy() for c in t.column_names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for b in batches:
            asked = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            found = [trees.route(s, t) for _, s, t in asked]
            columns = (*b.columns, [f is not None for f in found], [f and f[0] for f in found], [f and f[1] for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, _KINDS, strict=True)], names=["req_id", "source", "target", "valid", "seconds", "path_nodes"])

    return pairs.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, SCHEMA)


def _along(held):
    """Routes of requests (req_id, source, target), in order of their sources, along the tree of each source in a broadcast network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, last, seconds, before = held.value, None, None, None
        for b in batches:
            asked, found = list(zip(*(c.to_pylist() for c in b.columns), strict=True)), []
            for _, source, target in asked:
                s, t = (None if x is None else net.index(x) for x in (source, target))
                if s is None or t is None:
                    found.append(None)
                    continue
                if s != last:
                    last, (seconds, before) = s, net.tree(s)
                path = [t] if np.isfinite(seconds[t]) else None
                while path and before[path[-1]] >= 0:
                    path.append(int(before[path[-1]]))
                found.append(path and (float(seconds[t]), net.ids[path[::-1]].tolist()))
            columns = (*b.columns, [f is not None for f in found], [f and f[0] for f in found], [f and f[1] for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, _KINDS, strict=True)], names=["req_id", "source", "target", "valid", "seconds", "path_nodes"])

    return run


def _upward(ranks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges to equal or higher ranks, forward and turned round."""
    at = lambda c, r: ranks.select(F.col("node").alias(c), F.col("rank").alias(r))
    up = edges.join(at("src", "r1"), "src").join(at("dst", "r2"), "dst")
    return cut(up.where("r2 >= r1").select("src", "dst", "seconds")), cut(up.where("r1 >= r2").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seconds"))


def _joined(ranks: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Routes by joins: only the nodes on the way up from the ends are relaxed, never the whole network."""
    ahead, behind = _upward(ranks, edges)
    known = ranks.select(F.col("node").alias("source"))
    f = cut(relax(ahead, pairs.select("source").distinct().join(known, "source", "left_semi")))
    b = cut(relax(behind, pairs.select(F.col("target").alias("source")).distinct().join(known, "source", "left_semi")))
    ends = b.select(F.col("source").alias("target"), "node", F.col("seconds").alias("db"))
    met = pairs.join(f.select("source", "node", F.col("seconds").alias("df")), "source").join(ends, ["target", "node"])
    met = met.groupBy("req_id").agg(F.min(F.struct((F.col("df") + F.col("db")).alias("seconds"), "node")).alias("m"))
    rows = cut(pairs.join(met, "req_id", "left").select("req_id", "source", "target", F.col("m").isNotNull().alias("valid"), F.col("m.seconds").alias("seconds"), F.when(F.col("m").isNotNull(), F.array("m.node")).alias("path_nodes")))

    def walked(rows: DataFrame, steps: DataFrame, origin: str, at: int) -> DataFrame:
        """Follows the nodes before, at the front (1) or the back (-1), until ``origin``."""
        back = steps.where("before is not null").select(F.col("source").alias("o"), F.col("node").alias("n"), "before")
        while True:
            tip = F.element_at("path_nodes", at)
            if rows.where(F.col("valid") & (tip != F.col(origin))).isEmpty():
                return rows
            step = rows.join(back, (F.col(origin) == F.col("o")) & (tip == F.col("n")), "left")
            grown = F.concat(F.array("before"), "path_nodes") if at == 1 else F.concat("path_nodes", F.array("before"))
            rows = cut(step.withColumn("path_nodes", F.when(F.col("before").isNull(), F.col("path_nodes")).otherwise(grown)).drop("o", "n", "before"))

    rows = walked(walked(rows, f, "source", 1), b, "target", -1)
    whole = unpack(rows.where("valid").select("req_id", "path_nodes"), edges)
    return rows.drop("path_nodes").join(whole, "req_id", "left").select("req_id", "source", "target", "valid", "seconds", "path_nodes")


def with_coordinates(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds path_coords and distance_m, the sum over consecutive nodes."""
    steps = routes.where("valid").select("req_id", F.posexplode("path_nodes").alias("pos", "osm_id")).join(nodes.select("osm_id", "lat", "lon"), "osm_id")
    rows = steps.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("c"))
    pair = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    length = F.when(F.size("c") < 2, F.lit(0.0)).otherwise(F.aggregate(pair, F.lit(0.0), lambda s, x: s + x))
    coords = F.transform("c", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    return routes.join(rows.select("req_id", coords.alias("path_coords"), length.alias("distance_m")), "req_id", "left")


#: A node is contracted while it has at most so many pairs of an edge in and an edge out.
PAIRS = 36
#: Contraction ends when fewer than this share of the nodes can go in a round.
LEAST_SHARE = 0.02


def contract(edges: DataFrame, mode: int, rounds: int | None = None, pairs: int | None = PAIRS) -> tuple[DataFrame, DataFrame]:
    """:func:`contract_cheapest` over the roads of a mode."""
    return contract_cheapest(cheapest(edges, mode), rounds, pairs)


def contract_cheapest(edges: DataFrame, rounds: int | None = None, pairs: int | None = PAIRS) -> tuple[DataFrame, DataFrame]:
    """A hierarchy of (src, dst, seconds): ranks (node, rank) and edges (src, dst, seconds, mid_node) with shortcuts.

    Each round contracts the nodes whose priority is smaller than that of all their neighbours, among those with
    at most ``pairs`` pairs of edges that need no more shortcuts than they have edges (None: among all). It
    goes on to the end, or for ``rounds`` rounds: until less than LEAST_SHARE of the nodes can go. What is left
    is a core of equal rank, empty or small on roads and large where nodes have many neighbours; distances stay
    exact in any case.
    """
    now = cut(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("seconds").alias("seconds")).withColumn("mid_node", F.lit(None).cast("long")))
    loose = cut(now.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    full, ranks, r = now, None, 0
    while rounds is None or r < rounds:
        r += 1
        sides = now.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(now.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        degree = sides.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        if pairs is not None:
            n, few = degree.agg(F.count("*"), F.count_if(F.col("o") * F.col("i") <= pairs)).first()
            if not few or few < LEAST_SHARE * n:
                break
            degree = degree.where(F.col("o") * F.col("i") <= pairs)
        degree = cut(degree.select("node", (F.col("o") + F.col("i")).alias("n")))
        cuts = cut(needed_shortcuts(now.select("src", "dst", "seconds"), None, degree.select(F.col("node").alias("via")) if pairs is not None else None))
        made = cuts.groupBy(F.col("via").alias("node")).agg(F.count("*").alias("m"))
        more = F.coalesce("m", F.lit(0).cast("long")) - F.col("n")
        rank = degree.join(made, "node", "left").select("node", F.struct(more.alias("p"), F.xxhash64("node", F.lit(r)).alias("h"), "node").alias("k"))
        rank = cut(rank if pairs is None else rank.where("k.p <= 0"))
        near = now.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(now.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        least = near.join(rank.select(F.col("node").alias("other"), F.col("k").alias("ko")), "other").groupBy("node").agg(F.min("ko").alias("ko"))
        out = cut(rank.join(least, "node", "left").where("ko is null or k < ko").select("node"))
        if out.isEmpty():
            break
        ranks = out.withColumn("rank", F.lit(r)) if ranks is None else ranks.unionByName(out.withColumn("rank", F.lit(r)))
        new = cuts.join(out.select(F.col("node").alias("via")), "via", "left_semi").groupBy("u", "w").agg(F.min(F.struct("seconds", "via")).alias("b")).select(F.col("u").alias("src"), F.col("w").alias("dst"), F.col("b.seconds").alias("seconds"), F.col("b.via").alias("mid_node"))
        new = cut(new)
        full = full.unionByName(new)
        gone = lambda df, c: df.join(out.select(F.col("node").alias(c)), c, "left_anti")  # noqa: B023, E731
        now = cut(gone(gone(now, "src"), "dst").unionByName(new).groupBy("src", "dst").agg(F.min(F.struct("seconds", "mid_node")).alias("b")).select("src", "dst", "b.seconds", "b.mid_node"))
    done = ranks.select("node") if ranks is not None else loose.limit(0)
    core = loose.join(done, "node", "left_anti").withColumn("rank", F.lit(r + 1))
    full = full.groupBy("src", "dst").agg(F.min(F.struct("seconds", "mid_node")).alias("b")).select("src", "dst", "b.seconds", "b.mid_node")
    return cut(core if ranks is None else ranks.unionByName(core)), cut(full)


def hierarchy_distance(ranks: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target, seconds by upward searches from both ends that meet: equal ranks pass."""
    ahead, behind = _upward(ranks, edges)
    f = distances(ahead, pairs.select("source")).select("source", "node", F.col("seconds").alias("df"))
    b = distances(behind, pairs.select(F.col("target").alias("source"))).select(F.col("source").alias("target"), "node", F.col("seconds").alias("db"))
    return pairs.select("source", "target").distinct().join(f, "source").join(b, ["target", "node"]).groupBy("source", "target").agg(F.min(F.col("df") + F.col("db")).alias("seconds"))


def unpack(path: DataFrame, edges: DataFrame) -> DataFrame:
    """Replaces shortcuts in (req_id, path_nodes) by their two halves until none is left."""
    middle = edges.where("mid_node is not null").select("src", "dst", "mid_node")
    while True:
        pairs = path.select("req_id", F.posexplode(F.arrays_zip(F.slice("path_nodes", F.lit(1), F.size("path_nodes") - 1).alias("a"), F.slice("path_nodes", F.lit(2), F.size("path_nodes") - 1).alias("b"))).alias("pos", "e")).select("req_id", "pos", F.col("e.a").alias("src"), F.col("e.b").alias("dst"))
        found = pairs.join(middle, ["src", "dst"])
        if found.isEmpty():
            return path
        put = found.groupBy("req_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "mid_node"))).alias("m"))
        grown = F.flatten(F.transform("path_nodes", lambda n, i: F.when(F.try_element_at("m", i).isNotNull(), F.array(n, F.try_element_at("m", i))).otherwise(F.array(n))))
        path = cut(path.join(put, "req_id", "left").select("req_id", F.when(F.col("m").isNull(), F.col("path_nodes")).otherwise(grown).alias("path_nodes")))

