"""Near-duplicate classes with ProbMinHash.

A text is its weighted set of word shingles, weight 1 + ln(count). Every element sends arrivals
of a Poisson process whose rate is its weight to random registers; a register keeps the element
of its earliest arrival, and an element stops as soon as its next arrival comes after all
registers of the text. Two texts agree in a register with the probability Jaccard similarity
of their weighted sets. Registers of unit weights estimate the plain Jaccard similarity in the
same way. Bands of both give candidates, and the exact Jaccard similarity of the shingle sets
decides: texts that differ in repetition only still share bands of unit weights.

How it scales. Texts with equal shingle sets are one node. A bucket of up to ``SMALL`` nodes
offers all its pairs, a larger one the pairs with three leaders (the node that shares most
buckets with others, and two by hash), chosen by aggregation, so candidates grow in proportion
to bucket sizes. Classes are connected components by alternating star contraction. Then
nodes of larger buckets that hold several classes are joined exactly: every pair between classes
that can reach the threshold shares one of its rarest shingles (a prefix filter by size classes)
and is offered, without any cap. The largest class of a shingle meets only the others. Pairs
whose registers of unit weights (8 bits of each) agree in less than ``AGREE`` of all cannot be at
the threshold, but for one in 200,000 of those right at it, and are dropped before texts are
compared. Only texts of nodes that share a bucket, and rows that may have to go, are shuffled:
bitmaps of fixed size, broadcast, let most others pass. Keys that hold more than one in a
thousand rows (a bucket, a hub of links, a node, a class) are answered by a broadcast of at most a
thousand of them, so none fills a task. Nothing else is collected.

Words are runs of letters, digits and non-ASCII characters, lower-cased (A-Z); sets are keyed
by 64-bit hashes, and texts with equal sets by 128 bits. Defined results: a text of fewer than five words is one shingle of them all;
texts without words (null, empty) form no links and are classes of their own; a class is named
by its smallest doc_id, rows without an id after all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import Bitmap, among, carry, restored, ship, spread_join, store
from wayloom.llm.text import ALNUM, Words, chunks, mix, norm_bytes, release, shingles, signed

K, THRESHOLD = 5, 0.8
#: 24 bands of 5 registers: a pair at 0.8 is missed with probability 7e-5.
BANDS, ROWS = 24, 5
SMALL = 8
#: 4.5 standard deviations of 120 registers below the threshold.
AGREE = 0.63
#: Counters that order shingles by frequency: 8 MB.
SKETCH = 1 << 20
_STEP = np.uint64(0xD1342543DE82EF95)


def weighted_sets(bodies: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of text and hash: hashes, texts, counts."""
    w = Words(bodies, ALNUM)
    h, owner = shingles(w.hashes(), w.first, k)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if not len(h):
        return h, owner, owner
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    return h[new], owner[new], np.diff(np.append(new, len(h)))


def prob_min_hash(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Registers of n texts: the element hash of the earliest arrival; 0 for texts without elements."""
    time, value = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    at, t, r = np.arange(len(h)), np.zeros(len(h)), 0
    while len(at):
        r += 1
        u = mix(h[at] + np.uint64(r * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[at]
        flat = owner[at] * m + (mix(u ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(t < time[flat])
        better = better[np.argsort(-t[better], kind="stable")]
        time[flat[better]], value[flat[better]] = t[better], h[at[better]]
        going = t < time.reshape(n, m).max(axis=1)[owner[at]]
        at, t = at[going], t[going]
    return value.reshape(n, m)


def _sets(bodies: list[bytes], k: int):
    """Sets of a run of texts, where each starts, and 128 bits of each: a node and a check."""
    h, owner, count = weighted_sets(bodies, k)
    first = np.searchsorted(owner, np.arange(len(bodies) + 1))
    digests = b"".join(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else bytes(16) for a, b in zip(first[:-1], first[1:], strict=True))
    nodes = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
    return h, owner, count, first, np.ascontiguousarray(nodes[:, 0]), np.ascontiguousarray(nodes[:, 1])


def _bands(h: np.ndarray, owner: np.ndarray, count: np.ndarray, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers of unit weights, and band keys of both weightings with the mask of those to keep.

    Without a repeated shingle both weightings are the same, so only other texts are signed twice.
    """

    def keyed(sig: np.ndarray) -> np.ndarray:
        keys = np.zeros((len(sig), bands), dtype=np.uint64)
        for j in range(bands):
            x = np.full(len(sig), j + 1, dtype=np.uint64)
            for v in sig[:, j * rows : (j + 1) * rows].T:
                x = mix(x ^ v) + _STEP
            keys[:, j] = x
        return keys

    sig = prob_min_hash(h, owner, np.ones(len(h)), n, bands * rows)
    unit = keyed(sig)
    weighted = unit.copy()
    again = np.zeros(n, dtype=bool)
    again[owner[count > 1]] = True
    if again.any():
        at = again[owner]
        weighted[again] = keyed(prob_min_hash(h[at], (np.cumsum(again) - 1)[owner[at]], 1 + np.log(count[at]), int(again.sum()), bands * rows))
    some = np.bincount(owner, minlength=n) > 0
    return sig, np.hstack([unit, weighted]), np.hstack([np.repeat(some[:, None], bands, axis=1), weighted != unit])


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, bodies in chunks(norm_bytes(t) for t in b.column(2).to_pylist()):
                h, owner, count, first, nodes, check = _sets(bodies, k)
                sig, keys, own = _bands(h, owner, count, len(bodies), bands, rows)
                offsets = np.concatenate([[0], np.cumsum(own.sum(axis=1))]).astype(np.int32)
                yield pa.record_batch([b.column(0).slice(at, len(bodies)), b.column(1).slice(at, len(bodies)), nodes, check, np.diff(first).astype(np.int32), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys[own]))), pa.array([r.tobytes() for r in (sig >> np.uint64(56)).astype(np.uint8)], pa.binary())], names=["doc_id", "row_key", "node", "check", "n", "bands", "registers"])

    return run


def _node_texts(k: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for b in batches:
            for at, bodies in chunks(norm_bytes(t) for t in b.column(0).to_pylist()):
                *_, first, nodes, check = _sets(bodies, k)
                some = np.flatnonzero((np.diff(first) > 0) & among(bits, nodes))
                yield pa.record_batch([nodes[some], check[some], b.column(0).slice(at, len(bodies)).take(pa.array(some))], names=["node", "check", "text"])

    return run


def _agreeing(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least if b.num_rows else np.zeros(0, dtype=bool))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return run


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            similarity = np.zeros(b.num_rows)
            texts = (x for pair in zip(b.column(2), b.column(3), strict=True) for x in (norm_bytes(t.as_py()) for t in pair))
            for at, bodies in _even(texts):
                h, _, _, first, *_ = _sets(bodies, k)
                for j in range(0, len(bodies), 2):
                    x, y = h[first[j] : first[j + 1]], h[first[j + 1] : first[j + 2]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    similarity[(at + j) // 2] = both / max(1, len(x) + len(y) - both)
            keep = pa.array(similarity >= threshold)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (b.column(0), b.column(1), pa.array(similarity))], names=["a", "b", "similarity"])

    return run


def _counts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, bodies in chunks(norm_bytes(t) for t in b.column(0).to_pylist()):
                at, n = np.unique(_sets(bodies, k)[0] & np.uint64(SKETCH - 1), return_counts=True)
                yield pa.record_batch([signed(at), n.astype(np.int64)], names=["at", "n"])

    return run


def _frequencies(held: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each of SKETCH hash classes occur; only an order, so collisions lose nothing."""
    out = np.zeros(SKETCH, dtype=np.int64)
    for r in held.select("text").mapInArrow(_counts(k), "at long, n long").groupBy("at").agg(F.sum("n")).toLocalIterator():  # at most SKETCH rows
        out[r[0]] = r[1]
    release()
    return out


def _steps() -> np.ndarray:
    """Least sizes of the size classes: single sizes at first, then 5 % wide."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, out[-1] * 21 // 20))
    return np.array(out)


def _prefixes(k: int, threshold: float, seen):
    """Keys of each set's rarest shingles, one for each size class that a partner may have.

    Sets of x and y elements with a Jaccard similarity of t share at least o = t / (1 + t) (x + y), so they
    share one of the first x - o + 1 and y - o + 1 in any common order. A key names the shingle
    and both size classes; side is 0 for the lesser class, 1 for the greater, 2 for one's own.
    """
    steps = _steps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, bodies in chunks(norm_bytes(t) for t in b.column(2).to_pylist()):
                h, owner, _, first, *_ = _sets(bodies, k)
                h = h[np.lexsort((h, seen.value[h & np.uint64(SKETCH - 1)], owner))]
                keys, rows, sides = [], [], []
                for i in range(len(bodies)):
                    n = int(first[i + 1] - first[i])
                    least, most = int(np.ceil(threshold * n - 1e-9)), int(n / threshold + 1e-9)
                    own, lo, hi = np.searchsorted(steps, [n, max(1, least), most], side="right") - 1
                    for c in range(lo, hi + 1):
                        shared = int(np.ceil(threshold / (1 + threshold) * (n + max(least, int(steps[c]))) - 1e-9))
                        part = h[first[i] : first[i] + max(0, n - shared + 1)]
                        keys.append(mix(part ^ mix(np.full(1, min(own, c) << 20 | max(own, c), dtype=np.uint64))))
                        rows.append(np.full(len(part), at + i))
                        sides.append(np.full(len(part), 2 if c == own else int(own > c), dtype=np.int32))
                    if i + 1 == len(bodies) or sum(map(len, keys[-64:])) > 1 << 16 or len(keys) > 1 << 12:
                        row, key = np.concatenate(rows or [[]]).astype(np.int64), np.concatenate(keys or [[]]).astype(np.uint64)
                        size = (np.diff(first)[row - at]).astype(np.int32)
                        yield pa.record_batch([signed(key), b.column(0).take(pa.array(row)), size, b.column(1).take(pa.array(row)), np.concatenate(sides or [[]]).astype(np.int32)], names=["key", "node", "n", "component", "side"])
                        keys, rows, sides = [], [], []

    return run


def _even(texts: Iterator[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole pairs of about ``limit`` bytes, with the first text's index."""
    run, size, at = [], 0, 0
    for i, t in enumerate(texts):
        if i % 2 == 0 and size > limit:
            yield at, run
            run, size, at = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield at, run
    run = []
    release()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star contraction; every round is written to the shared folder.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        ends = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = ends.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).select("a", F.least("a", "m").alias("m"), "c")
        linked = spread_join(ends, least, "a", "c", 2 * n if large else n)  # a hub's edges go to many tasks
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    e = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = mark(e)
    while True:
        e = store(star(star(e, True, was[0]), False, was[0]), "edges")
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, n_found (links that were compared, not all there are), row_key."""
    ship(docs.sparkSession)
    rows_, spark = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), docs.sparkSession
    signed_ = rows_.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(_sign(k, bands, rows), "doc_id long, row_key long, node long, check long, n int, bands array<long>, registers binary")
    signed_ = store(signed_, "signatures")

    def as_nodes(df: DataFrame) -> DataFrame:
        return df.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.max("bands").alias("bands"), F.first("registers").alias("registers"), F.min("check").alias("lo"), F.max("check").alias("hi"))

    nodes, apart = store(as_nodes(signed_), "nodes"), None
    if not nodes.where("lo <> hi").isEmpty():  # sets that differ under the same 64 bits: their nodes take in the check
        clash = store(nodes.where("lo <> hi").select("node", F.lit(True).alias("clash")), "clashes")
        apart = lambda df: df.join(clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("clash")
        signed_ = store(apart(signed_), "signatures")
        nodes = store(as_nodes(signed_), "nodes")
    n_rows = signed_.count()
    n_nodes, n_members = nodes.agg(F.count("*"), F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()
    fit = lambda a, b: F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)  # noqa: E731  no similarity above the ratio of the sizes

    def sized(buckets: DataFrame) -> DataFrame:
        """(node, n, bucket) with the size of each bucket of two nodes or more."""
        sizes = buckets.groupBy("bucket").agg(F.count("*").alias("w")).where("w > 1").select("bucket", "w", F.col("w").alias("size"))
        return spread_join(buckets, sizes, "bucket", "w", n_members)

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def offered(members: DataFrame) -> DataFrame:
        """Pairs of nodes: all of a small bucket, those with three leaders of a larger one."""
        small, large = (members.where(c).select("bucket", "node", "n", "rank") for c in (f"size <= {SMALL}", f"size > {SMALL}"))
        on = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.node") < F.col("r.node")) & fit(F.col("l.n"), F.col("r.n"))
        within = small.alias("l").join(small.alias("r"), on).select(*ordered("l.node", "r.node"))
        chosen = [F.max(F.struct(order.alias("o"), "node", "n")) for order in (F.col("rank"), F.xxhash64("node", F.lit(0)), F.xxhash64("node", F.lit(1)))]
        leader = F.array_distinct(F.transform(F.array(*chosen), lambda x: F.struct(x["node"].alias("leader"), x["n"].alias("m"))))
        leaders = large.groupBy("bucket").agg(leader.alias("leaders"), F.count("*").alias("w"))
        led = spread_join(large, leaders, "bucket", "w", n_members).select("node", "n", F.inline("leaders")).where((F.col("node") != F.col("leader")) & fit(F.col("n"), F.col("m")))
        return within.unionByName(led.select(*ordered("node", "leader"))).distinct()

    register = lambda c, r: nodes.select(F.col("node").alias(c), F.col("registers").alias(r))
    words = lambda c, t: texts.select(F.col("node").alias(c), F.col("text").alias(t))

    def linked(found: DataFrame) -> DataFrame:
        near = found.join(register("a", "ra"), "a").join(register("b", "rb"), "b").select("a", "b", "ra", "rb").mapInArrow(_agreeing(AGREE if bands * rows >= 120 else 0.0), "a long, b long")
        near = store(near, "candidates").join(words("a", "ta"), "a").join(words("b", "tb"), "b")
        return store(near.select("a", "b", "ta", "tb").mapInArrow(_verify(k, threshold), "a long, b long, similarity double"), "links")

    def crossing() -> DataFrame:
        """Pairs between classes, of nodes in larger buckets: all that can reach the threshold."""
        placed = members.where(F.col("size") > SMALL).select("node", "bucket").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = store(placed, "placed")
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("w")).where("lo <> hi").select("bucket", "w")
        asked = store(spread_join(placed, mixed, "bucket", "w", n_members).select("node", "component").distinct(), "asked")
        held = store(asked.join(texts, "node"), "asked")
        seen = spark.sparkContext.broadcast(_frequencies(held, k))
        keyed = store(held.mapInArrow(_prefixes(k, threshold, seen), "key long, node long, n int, component long, side int"), "prefixes")
        parts = keyed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("parts"), F.sum("c").alias("w"), F.max(F.struct("c", "component")).alias("most")).where("parts > 1").select("key", "w", F.col("most.component").alias("most"))
        both = spread_join(keyed, parts, "key", "w", keyed.count())  # no pair lies inside the largest class of a key
        on = (F.col("l.key") == F.col("r.key")) & (F.col("l.component") != F.col("r.component")) & fit(F.col("l.n"), F.col("r.n")) & ((F.col("l.side") != F.col("r.side")) | (F.col("l.side") == 2))
        met = both.where("component <> most").alias("l").join(keyed.alias("r"), on)
        return met.select(*ordered("l.node", "r.node")).distinct()

    members = store(sized(nodes.select("node", "n", F.explode("bands").alias("bucket"))), "members")
    rank = store(members.groupBy("node").agg(F.sum("size").alias("rank")), "ranks")
    wanted = Bitmap(rank, "node").held
    texts = rows_.select("text").mapInArrow(_node_texts(k, wanted), "node long, check long, text string")
    texts = store((apart(texts) if apart else texts).join(rank, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "texts")
    edges = linked(offered(members.join(rank, "node")))
    classes = components(edges)
    more = linked(crossing())
    if not more.isEmpty():
        edges = store(edges.unionByName(more).dropDuplicates(["a", "b"]), "links")
        classes = components(edges)
    degree = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_found"))
    # rows are gathered by node and nodes by class, so a class of a third of all rows is few numbers
    per = signed_.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.min(F.when(F.col("doc_id").isNull(), F.col("row_key"))).alias("nameless"))
    per = store(per.join(classes, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    named = per.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"), F.min("nameless").alias("unnamed"), F.count("*").alias("w"))
    told = spread_join(per.select("node", "component", "rows", F.coalesce("n_found", F.lit(0).cast("long")).alias("n_found")), named, "component", "w", n_nodes)
    worded = spread_join(signed_.where("n > 0").select("doc_id", "row_key", "node"), told.drop("component"), "node", "rows", n_rows)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("doc_id").isNotNull() | (F.col("row_key") == F.col("unnamed")))
    none = signed_.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_found"), "row_key", F.lit(True).alias("first"))
    return worded.select("doc_id", "class_id", "class_size", "n_found", "row_key", first.alias("first")).unionByName(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each class, with their own columns."""
    marks = store(near_classes(docs, id_col, text_col), "classes")
    at, text = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col))
    keyed = carry(docs).withColumns({"doc_id": at.cast("long"), "row_key": F.xxhash64(at.cast("long"), text.cast("string"))})
    gone = marks.where(~F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()
    # only rows that a bitmap of fixed size doesn't clear are shuffled with their texts
    asked = Bitmap(gone, "gone_key").has(F.col("row_key"))
    same = (F.col("row_key") == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id"))
    kept = keyed.where(~asked).unionByName(keyed.where(asked).join(gone, same, "left_anti"))
    if not marks.where("first").groupBy("doc_id", "row_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "row_key"])
    return restored(kept, docs)
