"""Exact deduplication with Patricia-trie owners.

Every task first inserts its own texts into a compressed radix trie, so that a text repeated
in a third of all rows leaves each task about once: what a task writes out early is what it saw
once, repeated texts stay in its trie. The survivors are partitioned by length and content hash,
and a second trie per partition merges them. A terminal node stores the smallest identifier
under the chosen order. Tries compare full byte strings; the leading hash bytes of a key only
spread the subtrees evenly, so that a subtree that outgrows the memory budget can be spilled
alone and rebuilt later. Spilled bytes, and rows that wait for their partition's trie, are
scratch of one task attempt, deleted with it: a lost executor's task simply starts again.

``exact_dedup`` tells every row its owner. Rows are dealt into ``PARTS`` parts by their id, a trie
returns its answer once for each part that holds the text, and rows meet it by text and part.
``keep_owners`` sends whole rows through the tries, with one shuffle of the texts.

Defined results: a null text is the empty text; a null id counts as -2^63, smaller than any other;
of equal rows that also share an id exactly one is kept; columns of any name, and extra ones, are
carried; very long texts are keys like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import marshal
import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import carry, restored, ship
from wayloom.llm.text import norm_bytes, release

#: Bytes of keys a task holds before it spills its largest subtree, or writes out what it saw once.
BUDGET = 32 << 20
#: Parts that the rows of one text are dealt into.
PARTS = 64
_NONE = -(1 << 63)
_HEAD = struct.Struct("<ii")


class Node:
    __slots__ = ("children", "edge", "value")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.value, self.children = edge, value, None


class PatriciaTrie:
    """Byte strings to values, equal keys' values put together by ``join``; the first byte of a key names its subtree."""

    def __init__(self, join: Callable = min, budget: int = BUDGET):
        self.join, self.budget, self.held = join, budget, 0
        self.roots: dict[int, Node] = {}
        self.sizes: dict[int, int] = {}
        self.spilled: dict[int, object] = {}

    def insert(self, key: bytes, value) -> None:
        top = key[0]
        if top in self.spilled:
            self._write(self.spilled[top], key, value)
            return
        if top not in self.roots:
            self.roots[top] = Node(b"")
            self.sizes[top] = 0
        more = self._put(self.roots[top], key, value)
        self.sizes[top] += more
        self.held += more
        if self.held > self.budget and len(self.sizes) > 1:
            self._spill(max(self.sizes, key=self.sizes.get))

    def _put(self, node: Node, key: bytes, value) -> int:
        """Inserts below ``node``; the number of new bytes."""
        i = 0
        while True:
            if i == len(key):
                node.value = value if node.value is None else self.join(node.value, value)
                return 0
            children = node.children
            child = children.get(key[i]) if children else None
            if child is None:
                if children is None:
                    node.children = children = {}
                children[key[i]] = Node(key[i:], value)
                return len(key) - i + 200
            edge = child.edge
            if key.startswith(edge, i):
                i += len(edge)
                node = child
                continue
            low, high = 1, min(len(edge), len(key) - i)
            while low < high:  # the longest common prefix
                mid = (low + high + 1) // 2
                if key.startswith(edge[:mid], i):
                    low = mid
                else:
                    high = mid - 1
            fork = Node(edge[:low])
            child.edge = edge[low:]
            fork.children = {child.edge[0]: child}
            children[key[i]] = fork
            i += low
            node = fork

    @staticmethod
    def _walk(root: Node) -> Iterator[tuple[bytes, object]]:
        stack = [(root, b"")]
        while stack:
            node, path = stack.pop()
            path = path + node.edge if path else node.edge
            if node.value is not None:
                yield path, node.value
            if node.children:
                stack.extend((c, path) for c in node.children.values())

    @staticmethod
    def _write(file, key: bytes, value) -> None:
        packed = marshal.dumps(value)
        file.write(_HEAD.pack(len(key), len(packed)) + key + packed)

    def _spill(self, top: int) -> None:
        file = tempfile.TemporaryFile()
        for key, value in self._walk(self.roots.pop(top)):
            self._write(file, key, value)
        self.held -= self.sizes.pop(top)
        self.spilled[top] = file

    def drain(self) -> Iterator[tuple[bytes, object]]:
        """All keys with their values; spilled subtrees one after another."""
        for top in list(self.roots):
            yield from self._walk(self.roots.pop(top))
        self.sizes.clear()
        self.held = 0
        for top in list(self.spilled):
            root, file = Node(b""), self.spilled.pop(top)
            file.seek(0)
            while head := file.read(_HEAD.size):
                n, m = _HEAD.unpack(head)
                self._put(root, file.read(n), marshal.loads(file.read(m)))
            file.close()
            yield from self._walk(root)


def _key(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()[:8] + body


def _head(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _runs(rows: Iterator, size: Callable, step: int = 8 << 20) -> Iterator[list]:
    """Runs of rows of about ``step`` bytes."""
    run, held = [], 0
    for row in rows:
        run.append(row)
        held += size(row)
        if held > step:
            yield run
            run, held = [], 0
    if run:
        yield run


# ---- owners: (smallest identifier, count, parts) of every text


def _together(a: tuple, b: tuple) -> tuple:
    return min(a[0], b[0]), a[1] + b[1], tuple(sorted({*a[2], *b[2]}))


_COMBINED = pa.schema([("size", pa.int64()), ("head", pa.int64()), ("body", pa.binary()), ("ident", pa.int64()), ("n", pa.int64()), ("parts", pa.list_(pa.int32()))])
_OWNERS = pa.schema([("text_sha256", pa.string()), ("part", pa.int32()), ("ident", pa.int64()), ("n", pa.int64())])


def _combine(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            for part in _runs(rows, lambda r: len(r[0])):
                yield pa.record_batch([[len(k) - 8 for k, _ in part], [_head(k) for k, _ in part], [k[8:] for k, _ in part], *([v[i] for _, v in part] for i in range(3))], schema=_COMBINED)

        def apart(trie, kept):
            """What was seen once; the rest goes on to ``kept``, up to a quarter of the budget."""
            for key, value in trie.drain():
                if value[1] > 1 and kept.held < budget // 4:
                    kept.insert(key, value)
                else:
                    yield key, value

        trie = PatriciaTrie(_together, 2 * budget)
        for b in batches:
            for text, ident, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                trie.insert(_key(norm_bytes(text)), (ident, 1, (part,)))
            if trie.held > budget:
                kept = PatriciaTrie(_together, 2 * budget)
                yield from emit(apart(trie, kept))
                trie = kept
                release()
        yield from emit(trie.drain())
        del trie
        release()

    return run


def _merge(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(_together, budget)
        for b in batches:
            for head, body, ident, n, parts in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                trie.insert(head.to_bytes(8, "little", signed=True) + body, (ident, n, tuple(parts)))
        for rows in _runs(trie.drain(), lambda r: len(r[0])):
            out = [(sha, part, ident, n) for sha, (ident, n, parts) in ((hashlib.sha256(memoryview(k)[8:]).hexdigest(), v) for k, v in rows) for part in parts]
            yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=_OWNERS)
        del trie
        release()

    return run


# ---- whole rows


class _Waiting:
    """Batches that wait for the trie's decision, in memory up to ``budget`` and then in a file of the task attempt."""

    def __init__(self, schema: pa.Schema, budget: int):
        self.file = tempfile.SpooledTemporaryFile(max_size=budget)
        self.out = pa.ipc.new_stream(pa.PythonFile(self.file, mode="w"), schema)

    def write(self, batch: pa.RecordBatch) -> None:
        self.out.write_batch(batch)

    def chosen(self, seqs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows with these numbers, in order; the file goes with them."""
        self.out.close()
        self.file.seek(0)
        first, seqs = 0, np.sort(seqs)
        for batch in pa.ipc.open_stream(pa.PythonFile(self.file, mode="r")):
            a, b = np.searchsorted(seqs, [first, first + batch.num_rows])
            if b > a:
                yield batch.take(pa.array(seqs[a:b] - first))
            first += batch.num_rows
        self.file.close()


def _sliced(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes."""
    for b in batches:
        n = max(1, b.num_rows * limit // max(1, b.nbytes))
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def _owning(text_at: int, budget: int, placed: bool):
    """Of equal texts the row with the smallest ``ident``, the last column but two; size and head follow it.

    Unless ``placed``, a task's rows are decided in runs of about ``budget`` bytes, and size and head are set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, waiting, held, seq = PatriciaTrie(budget=2 * budget), None, 0, 0

        def decided():
            yield from waiting.chosen(np.array([value[1] for _, value in trie.drain()], dtype=np.int64))
            release()

        for b in _sliced(batches):
            cut = b.num_columns - 3
            bodies, idents = [norm_bytes(t) for t in b.column(text_at).cast(pa.string()).to_pylist()], b.column(cut).to_pylist()
            if not placed:
                keys = [_key(x) for x in bodies]
                b = pa.RecordBatch.from_arrays([*b.columns[: cut + 1], pa.array([len(x) for x in bodies], pa.int64()), pa.array([_head(k) for k in keys], pa.int64())], schema=b.schema)
            else:
                keys = [h.to_bytes(8, "little", signed=True) + x for h, x in zip(b.column(cut + 2).to_pylist(), bodies, strict=True)]
            if waiting is None:
                waiting = _Waiting(b.schema, budget)
            waiting.write(b)
            for key, ident in zip(keys, idents, strict=True):
                trie.insert(key, (ident, seq))
                seq += 1
            held += b.nbytes
            if not placed and held > budget:
                yield from decided()
                trie, waiting, held, seq = PatriciaTrie(budget=2 * budget), None, 0, 0
        if waiting is not None:
            yield from decided()
        del trie
        release()

    return run


def _digest(texts: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(norm_bytes(t)).hexdigest() for t in texts], dtype=object)


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the A-Z lower-cased UTF-8 text; null is empty."""
    return F.pandas_udf(_digest, "string")(text)


def _rank(ident: Column, largest: bool) -> Column:
    """A number that is smallest for the row that stays; a null id is the smallest of all."""
    known = -ident - 1 if largest else ident
    return F.when(ident.isNull(), F.lit((1 << 63) - 1 if largest else _NONE)).otherwise(known)


def _unranked(rank: Column, largest: bool) -> Column:
    return F.when(rank != F.lit((1 << 63) - 1), -rank - 1) if largest else F.when(rank != F.lit(_NONE), rank)


def _owners(rows: DataFrame, budget: int) -> DataFrame:
    """text_sha256, part, ident, n for every part that holds the text; ``rows``: text, ident, part."""
    ship(rows.sparkSession)
    combined = rows.mapInArrow(_combine(budget), "size long, head long, body binary, ident long, n long, parts array<int>")
    return combined.repartition("size", "head").mapInArrow(_merge(budget), "text_sha256 string, part int, ident long, n long")


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size. ``keep``: 'smallest' or 'largest' id."""
    rows = docs.select(F.col(text_col).cast("string"), _rank(F.col(id_col).cast("long"), keep == "largest"), F.lit(0))
    return _owners(rows, budget).select("text_sha256", _unranked(F.col("ident"), keep == "largest").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    told = _owners(rows.select("text", _rank(F.col("doc_id"), keep == "largest"), part), budget)
    # rows alike in id and text are counted here and told apart again after the join
    alike = rows.select("doc_id", text_digest(F.col("text")).alias("text_sha256")).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("alike")).withColumn("part", part)
    both = alike.join(told, ["text_sha256", "part"]).withColumn("keep_id", _unranked(F.col("ident"), keep == "largest"))
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))))
    return each.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: tasks drop their own copies, then whole rows meet by length and hash."""
    ship(docs.sparkSession)
    text, at = docs.columns.index(text_col), docs.columns.index(id_col)
    rows = carry(docs).withColumns({"ident": _rank(F.col(f"_c{at}").cast("long"), keep == "largest"), "size": F.lit(0).cast("long"), "head": F.lit(0).cast("long")})
    return restored(rows.mapInArrow(_owning(text, budget, False), rows.schema).repartition("size", "head").mapInArrow(_owning(text, budget, True), rows.schema), docs)
