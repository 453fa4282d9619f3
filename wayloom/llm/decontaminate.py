"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table: the corpus is cut into segments, a segment being a run of whole
texts of one task, and each segment has a posting list (sorted word positions) for every term
in it. Lists of one segment stay together, so a very common term makes one bounded list in
each segment and never a list that one task must hold. A benchmark asks for the lists of its own
terms only; they meet by segment, and each window starts from its rarest term there and
intersects the offset-adjusted lists of the others in order of rarity. One index answers any
number of benchmarks. Terms are 64-bit word hashes.

How it scales. Lists hold four bytes a word and are written once; texts are not shuffled:
rows that a bitmap clears of any hit pass it by, the others meet their spans by row number.
The benchmark is broadcast in slices of at most ``SLICE`` bytes each; more slices
mean more passes over the lists, never over the texts, and each slice is freed before the next.

Defined results: null texts and texts without words have no windows and no hits; an item
without words matches nothing; a null item id counts as the empty string; repeated rows give
repeated results; a very long text is a segment of its own; columns of any name are carried, and
input columns named like an output give way to it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from wayloom.llm.shared import Bitmap, carry, restored, ship, store
from wayloom.llm.text import ALNUM, Words, chunks, norm_bytes, signed

#: Bytes of benchmark text in one broadcast.
SLICE = 16 << 20
WINDOW = 13
#: Columns of the index besides those of the documents. A row is a document (rid, n_words), a
#: posting list (seg, term, at) or the starts of a segment's texts (seg, at).
_INDEX = [StructField(n, t) for n, t in (("rid", LongType()), ("n_words", LongType()), ("seg", LongType()), ("term", LongType()), ("at", BinaryType()))]
_SPANS = "array<struct<item_id:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _lists(w: Words) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Terms of a segment, their positions, and where its texts start. Texts are one position apart, so no phrase crosses them."""
    h = signed(w.hashes())
    order = np.argsort(h, kind="stable")
    terms, begin = np.unique(h[order], return_index=True)
    at = (w.text + np.arange(len(h)))[order].astype(np.int32)
    cuts = 4 * np.append(begin, len(h)).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(cuts), pa.py_buffer(at)])
    return terms, lists, (w.first + np.arange(len(w.first))).astype(np.int32)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _INDEX]
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        own = [i for i, c in enumerate(b.schema.names) if c != "_text"]
        columns = [b.schema.names[i] for i in own]

        def out(n: int, b=b, own=own, columns=columns, **new) -> pa.RecordBatch:
            kinds = {"at": pa.binary()}
            more = [new.get(c, pa.nulls(n, kinds.get(c, pa.int64()))) for c in names]
            kept = [b.column(i) if "rid" in new else pa.nulls(n, b.column(i).type) for i in own]
            return pa.RecordBatch.from_arrays([*more, *kept], names=[*names, *columns])

        n_words = np.zeros(b.num_rows, dtype=np.int64)
        for first, bodies in chunks(norm_bytes(t.as_py()) for t in b.column(b.schema.names.index("_text"))):
            w = Words(bodies, ALNUM)
            n_words[first : first + len(bodies)] = np.diff(w.first)
            if len(w.start):
                terms, lists, starts = _lists(w)
                yield out(1, seg=pa.array([row + first]), at=pa.array([starts.tobytes()], pa.binary()))
                yield out(len(terms), seg=pa.array(np.full(len(terms), row + first)), term=pa.array(terms), at=lists)
        yield out(b.num_rows, rid=pa.array(row + np.arange(b.num_rows)), n_words=pa.array(n_words))
        row += b.num_rows


def index(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The stored positional index of whole texts, with the documents' columns (or those named) as _c0, _c1, ..."""
    ship(docs.sparkSession)
    rows = carry(docs)
    text = F.col(f"_c{docs.columns.index(text_col)}").cast("string").alias("_text")
    rows = rows.select(text, *[f"_c{i}" for i, c in enumerate(docs.columns) if columns is None or c in columns])
    schema = StructType(_INDEX + [StructField(f.name, f.dataType) for f in rows.schema.fields[1:]])
    return store(rows.mapInArrow(_index, schema), "postings")


class Phrases:
    """The windows of a slice of the benchmark, as rows of term numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        w = Words([norm_bytes(t) for _, t in items], ALNUM)
        self.vocab, term = np.unique(signed(w.hashes()), return_inverse=True)
        by: dict[bytes, set[str]] = {}
        for k, (item, _) in enumerate(items):
            words = term[w.first[k] : w.first[k + 1]].astype(np.int32)
            for i in range(max(1, len(words) - window + 1) if len(words) else 0):
                by.setdefault(words[i : i + window].tobytes(), set()).add(item)
        sizes: dict[int, list[bytes]] = {}
        for x in by:
            sizes.setdefault(len(x) // 4, []).append(x)
        self.groups = [(n, np.frombuffer(b"".join(xs), dtype=np.int32).reshape(-1, n), [by[x] for x in xs]) for n, xs in sizes.items()]


class Segment:
    """The posting lists of one segment that a benchmark asked for."""

    def __init__(self, vocab: np.ndarray, terms: np.ndarray, lists: list[bytes], starts: np.ndarray):
        self.starts = starts
        number = np.searchsorted(vocab, terms)
        self.lists = {int(k): np.frombuffer(x, dtype=np.int32) for k, x in zip(number, lists, strict=True)}
        self.df = np.zeros(len(vocab), dtype=np.int64)
        for k, x in self.lists.items():
            self.df[k] = len(x)

    def find(self, row: np.ndarray) -> np.ndarray:
        """Positions where the exact phrase starts."""
        order = np.argsort(self.df[row], kind="stable")
        at = self.lists[row[order[0]]] - order[0]
        for o in order[1:]:
            if not len(at):
                break
            other = self.lists[row[o]]
            k = np.minimum(np.searchsorted(other, at + o), len(other) - 1)
            at = at[other[k] == at + o]
        return at

    def near(self, row: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term of the same text within ``slop`` words of its place in the phrase."""
        order = np.argsort(self.df[row], kind="stable")
        at = self.lists[row[order[0]]]
        for o in order[1:]:
            if not len(at):
                break
            other, want, t = self.lists[row[o]], at + (o - order[0]), self.text(at)
            k = np.searchsorted(other, np.maximum(want - slop, self.starts[t]))
            hit = np.append(other, np.iinfo(np.int32).max)[k]
            at = at[(hit <= want + slop) & (hit < self.starts[t + 1])]
        return at

    def text(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _found(phrases: Broadcast, slop: int | None):
    def run(t: pa.Table) -> pa.Table:
        p, terms, lists = phrases.value, t.column("term").to_pylist(), t.column("at").to_pylist()
        k = terms.index(None)
        starts = np.frombuffer(lists.pop(k), dtype=np.int32)
        terms.pop(k)
        seg, first = Segment(p.vocab, np.array(terms, dtype=np.int64), lists, starts), t.column("seg")[0].as_py()
        spans: dict[int, list[dict]] = {}
        for n, rows, items in p.groups:
            for k in np.flatnonzero((seg.df[rows] > 0).all(axis=1)):
                at = seg.find(rows[k]) if slop is None else seg.near(rows[k], slop)
                for text, i in zip(seg.text(at).tolist(), at.tolist(), strict=True):
                    s = i - int(starts[text])
                    spans.setdefault(text, []).extend({"item_id": x, "start": s, "end": s + n if slop is None else s + 1} for x in items[k])
        hit = sorted(spans)
        n_words = [int(starts[x + 1] - starts[x]) - 1 for x in hit]
        return pa.table({"rid": pa.array([first + x for x in hit], pa.int64()), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array([spans[x] for x in hit], _ARROW)})

    return run


def search(postings: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """The rows of an index that hold benchmark windows: rid, n_words, spans; a stored table."""
    spark = postings.sparkSession
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * total // slice_bytes) if total > slice_bytes else 1
    lists = postings.where("seg is not null").select("seg", "term", "at")
    found = []
    for k in range(n):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else bench
        phrases = Phrases([(r[0], r[1]) for r in part.toLocalIterator()], window)  # one slice
        terms = spark.createDataFrame(pa.table({"term": phrases.vocab}))
        held = spark.sparkContext.broadcast(phrases)
        asked = lists.where("term is not null").join(F.broadcast(terms), "term", "left_semi").unionByName(lists.where("term is null"))
        found.append(store(asked.groupBy("seg").applyInArrow(_found(held, slop), f"rid long, n_words long, spans {_SPANS}"), "hits"))
        held.destroy()
    if n == 1:
        return found[0]
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("rid", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _asked(found: DataFrame, key: str):
    """Whether a row may be among ``found``: texts of all others are never shuffled."""
    return Bitmap(found.select(F.xxhash64(key).alias("key")), "key").has(F.xxhash64(key))


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, slop: int | None = None, slice_bytes: int = SLICE, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns, or those named) with n_words and spans (item_id, start, end: word positions).

    ``slop`` None gives exact phrases; a number gives proximity matches: the position of the
    rarest term of a window all of whose terms lie within so many words of their places.
    """
    postings = index(docs, text_col, columns)
    rows, found = postings.where("rid is not null").drop("seg", "term", "at"), search(postings, benchmark, window, slop, slice_bytes)
    asked, none = _asked(found, "rid"), F.array().cast(_SPANS)
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("n_words", "spans") and (columns is None or c in columns)]
    hit = rows.where(asked).join(found.select("rid", "spans"), "rid", "left").withColumn("spans", F.coalesce("spans", none))
    return rows.where(~asked).withColumn("spans", none).unionByName(hit).select(*own, "n_words", "spans")


def hit_counts(df: DataFrame) -> DataFrame:
    """Adds n_hit (words inside any span), items (distinct ids) and contaminated to the result of :func:`matches`.

    Spans are merged in order of their starts, so no array of positions is built.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    merge = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto"))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    out = df.withColumn("n_hit", F.aggregate(ordered, start, merge, lambda a: a["n"])).withColumn("items", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their own columns.

    A text decides alone, so the index carries a digest of 128 bits for each row, and no text is stored again.
    """
    text = F.col(f"_c{docs.columns.index(text_col)}").cast("string")
    rows = carry(docs).withColumn("_md5", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    postings = index(rows.select("_md5", text.alias("_t")), "_t", ["_md5"])
    found = hit_counts(search(postings, benchmark)).where("contaminated").select("rid")
    gone = store(postings.where("rid is not null").join(found, "rid").select(F.col("_c0").alias("_md5")).distinct(), "gone")
    asked = _asked(gone, "_md5")
    return restored(rows.where(~asked).unionByName(rows.where(asked).join(gone, "_md5", "left_anti")), docs)
