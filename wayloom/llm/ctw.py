"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased tokens joined by single blanks, then one end symbol. Each bit of a
byte is predicted by the context tree of the bits before it: nodes at depth 0 to DEPTH hold
the zeros and ones seen after the preceding bytes, each estimates by Krichevsky-Trofimov, and
the weights of context-tree weighting mix the estimates of all depths. A context that training
has not seen adds nothing to its parent's estimate.

How it scales. Training counts (context, byte) pairs with a combine in every task; the trees
are cut below the ``CUT`` nearest context bytes, and the branches dealt into shards of about
``SHARD`` pairs, so more input means more shards. A branch, which stays whole, has at most
256^(DEPTH-CUT+1) pairs; the levels above all branches have at most 255*256^(CUT-1) nodes each,
in practice those of the byte pairs that occur, and are broadcast. Scoring never broadcasts the model: texts are
dealt into blocks of about ``BLOCK`` bytes, each block asks for its distinct pairs and words,
the answers are joined on those keys and come back to the block.

Words and pairs are keyed by 64 bits (pairs exactly, words by hash).

Defined results: null texts are empty, and an empty text is the end symbol alone; without
training rows every estimate is one half for each bit; repeated rows are learned from and scored
each; very long texts are read in a step of their own; other columns are left out, so their names
can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import ship, store
from wayloom.llm.text import BLACK, Words, chunks, norm_bytes, release, signed

DEPTH = 5
#: Levels above the branches, and pairs in a shard of branches.
CUT, SHARD = 3, 1 << 14
#: Bytes of text in a block, and of a step inside it.
BLOCK, STEP = 20 << 20, 1 << 20
_END = b"\xff"
PAIR, WORD = 0, 1


def _body(text: str | None) -> bytes:
    return b" ".join(norm_bytes(text).split())


class Stream:
    """The (context, byte) pairs of a run of texts, and the text each is in."""

    def __init__(self, bodies: list[bytes], depth: int):
        gap = _END * depth
        buf = np.frombuffer(gap + b"".join(b + gap for b in bodies), dtype=np.uint8)
        sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
        self.text = np.repeat(np.arange(len(bodies)), sizes + 1)
        at = np.arange(len(self.text)) + depth + self.text * (depth - 1)
        wide = buf.astype(np.uint64)
        key = np.zeros(len(buf) - depth, dtype=np.uint64)
        for k in range(1, depth + 1):
            key = (key << np.uint64(8)) | wide[depth - k : len(buf) - k]
        key = (key << np.uint64(8)) | wide[depth:]
        self.key = signed(key[at - depth])


class Sums:
    """Sums by key, kept as sorted runs that are merged now and then."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, weight: int) -> None:
        u, c = np.unique(keys, return_counts=True)
        self.runs.append((u, c * weight))
        if len(self.runs) > 8:
            self.runs = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, c = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.diff(k, prepend=k[0] - 1 if len(k) else 0)) if len(k) else np.zeros(0, np.int64)
        return k[first], np.add.reduceat(c, first) if len(first) else c


def _emit(kind: int, keys: np.ndarray, n: np.ndarray, step: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), step):
        k = keys[i : i + step]
        yield pa.record_batch([np.full(len(k), kind, np.int32), k, n[i : i + step]], names=["kind", "key", "n"])


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = Sums(), Sums()
        for b in batches:
            texts, train = b.column(0).to_pylist(), b.column(1).to_pylist()
            for weight in (1, 0):  # unseen pairs are asked for too
                for _, bodies in chunks((_body(t) for t, x in zip(texts, train, strict=True) if x == bool(weight)), STEP):
                    pairs.add(Stream(bodies, depth).key, weight)
                    words.add(signed(Words(bodies, BLACK).hashes()), weight)
        yield from _emit(PAIR, *pairs.merged())
        yield from _emit(WORD, *words.merged())

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for i in range(7):
        shift += np.log(x + i)
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky-Trofimov gives a sequence of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - np.log(np.pi) - _lgamma(n0 + n1 + 1.0)


def _nodes(ctx: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (context * 256 + bit prefix), zeros and ones of a level."""
    pair, at = np.unique((ctx << 8) | x, return_inverse=True)
    n = np.bincount(at, weights=n)
    ctx, x = pair >> 8, pair & 255
    ids = np.concatenate([(ctx << 8) | (1 << j) | (x >> (8 - j)) for j in range(8)])
    bit = np.concatenate([(x >> (7 - j)) & 1 for j in range(8)])
    ids, at = np.unique(ids, return_inverse=True)
    n = np.tile(n, 8)
    return ids, np.bincount(at, weights=n * (1 - bit), minlength=len(ids)).astype(float), np.bincount(at, weights=n * bit, minlength=len(ids)).astype(float)


def _parent(ids: np.ndarray) -> np.ndarray:
    """The same bit prefix one context byte less."""
    return ((ids >> 16) << 8) | (ids & 255)


def _weights(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's log weighted probability and the weight of its own estimate."""
    own = log_kt(n0, n1)
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class Shard:
    """Levels CUT to depth of some branches of the trees (or of all, in tests)."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        seen = n > 0
        key, n = key[seen], n[seen]
        self.depth, self.levels = depth, {}
        child = None
        for d in range(depth, CUT - 1, -1):
            ids, n0, n1 = _nodes(key >> (8 * (depth - d) + 8), key & 255, n)
            if child is None:
                lw, beta = log_kt(n0, n1), np.ones(len(ids))
            else:
                below = np.bincount(np.searchsorted(ids, _parent(child[0])), weights=child[1], minlength=len(ids))
                lw, beta = _weights(n0, n1, below)
            self.levels[d] = (ids, n0, n1, beta)
            child = (ids, lw)
        self.top = child

    def log_p(self, key: np.ndarray, tops: Tops) -> np.ndarray:
        """Natural log probability of each pair's byte after its context."""
        x, out, levels = key & 255, np.zeros(len(key)), self.levels | tops.levels
        for j in range(8):
            node, bit = (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1
            p, some = np.zeros(len(key)), np.zeros(len(key), dtype=bool)
            for d in range(self.depth, -1, -1):
                ids, n0, n1, beta = levels[d]
                if not len(ids):
                    continue
                want = ((key >> (8 * (self.depth - d) + 8)) << 8) | node
                at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
                hit = ids[at] == want
                kt = (np.where(bit, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
                p = np.where(hit, np.where(some, beta[at] * kt + (1 - beta[at]) * p, kt), p)
                some |= hit
            out += np.log(np.where(some, p, 0.5))
        return out

    def summary(self) -> tuple[np.ndarray, ...]:
        """Per node of level CUT - 1: zeros, ones and the sum of the children's log weighted probabilities."""
        ids, n0, n1, _ = self.levels[CUT]
        up, at = np.unique(_parent(ids), return_inverse=True)
        return up, *(np.bincount(at, weights=w).astype(float) for w in (n0, n1, self.top[1]))


class Tops:
    """Levels 0 to CUT - 1 of the trees."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        order = np.argsort(ids)
        ids, n0, n1, below = ids[order], n0[order], n1[order], below[order]
        self.levels = {}
        for d in range(CUT - 1, -1, -1):
            lw, beta = _weights(n0, n1, below)
            self.levels[d] = (ids, n0, n1, beta)
            ids, at = np.unique(_parent(ids), return_inverse=True)
            n0, n1, below = (np.bincount(at, weights=w).astype(float) for w in (n0, n1, lw))


def _arrays(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _summary(depth: int):
    def run(t: pa.Table) -> pa.Table:
        up, n0, n1, below = Shard(*_arrays(t, "key", "n"), depth).summary()
        return pa.table({"id": up, "n0": n0, "n1": n1, "below": below})

    return run


def _answers(depth: int, tops):
    def run(t: pa.Table) -> pa.Table:
        key, n = _arrays(t, "key", "n")
        return pa.table({"kind": np.full(len(key), PAIR, np.int32), "key": key, "value": Shard(key, n, depth).log_p(key, tops.value)})

    return run


def _asks(depth: int):
    def run(t: pa.Table) -> pa.Table:
        pairs, words = Sums(), Sums()
        for _, bodies in chunks((_body(x.as_py()) for x in t.column("text")), STEP):
            pairs.add(Stream(bodies, depth).key, 0)
            words.add(signed(Words(bodies, BLACK).hashes()), 0)
        p, w = pairs.merged()[0], words.merged()[0]
        kind = np.concatenate([np.full(len(p), PAIR, np.int32), np.full(len(w), WORD, np.int32)])
        return pa.table({"block": np.full(len(kind), t.column("block")[0].as_py(), np.int64), "kind": kind, "key": np.concatenate([p, w])})

    return run


class _Answers:
    """The answers of one kind to a block, in order of their keys: a hash table beside them would take as much memory again."""

    def __init__(self, known: pa.Table, kind: int):
        mine = pc.equal(known.column("kind"), kind)
        key = known.column("key").filter(mine).to_numpy()
        order = np.argsort(key)
        self.key = key[order]
        del key
        self.value = known.column("value").filter(mine).to_numpy()[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        u, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.key, u)
        if len(u) and (at[-1] >= len(self.key) or (self.key[at] != u).any()):
            raise ValueError("a block's own pair or word came back without an answer")
        return self.value[at][back]


def _score(depth: int, n_train: int, n_tokens: int, n_distinct: int):
    log_total = np.log10(n_tokens + n_distinct + 1)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        pair, word = _Answers(known, PAIR), _Answers(known, WORD)
        pair.value /= np.log(10)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, bodies in chunks((_body(x.as_py()) for x in texts.column("text")), STEP // 4):
            s, w = Stream(bodies, depth), Words(bodies, BLACK)
            log_p, c = pair.of(s.key), word.of(signed(w.hashes()))
            n = np.diff(w.first) + 1
            sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) + 1
            base = np.bincount(w.text, weights=np.log10(c + 1), minlength=len(bodies)) + np.log10(n_train + 1) - n * log_total
            known_ = np.bincount(w.text, weights=c > 0, minlength=len(bodies)).astype(np.int64) + (n_train > 0)
            for o, v in zip(out, (n, known_, base, np.bincount(s.text, weights=log_p, minlength=len(bodies)), sizes), strict=True):
                o.append(v)
        n, known_, base, score, sizes = (np.concatenate(o) for o in out)
        del pair, word
        release()
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": n, "n_known": known_, "train_tokens": np.full(len(n), n_tokens, np.int64), "base_score": base, "score": score, "bits_per_byte": -score * np.log2(10) / sizes})

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Scores every row; the model learns from the rows where ``held_out`` is false. ``depth`` is CUT to 6."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size, n_train = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    counts = rows.select("text", ~F.col("held_out")).mapInArrow(_count(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = store(counts, "counts")
    word = (F.col("kind") == WORD) & (F.col("n") > 0)
    known, distinct, n_pairs = counts.agg(F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)), F.count_if(word), F.count_if(F.col("kind") == PAIR)).first()
    n_tokens, n_distinct = known + n_train, distinct + (n_train > 0)
    branch, shards = F.shiftright("key", 8 * (depth - CUT + 1)), max(1, -(-n_pairs // SHARD))
    pairs = counts.where(F.col("kind") == PAIR).select("key", "n", F.pmod(F.xxhash64(branch), F.lit(shards)).alias("shard"))
    tops = pairs.groupBy("shard").applyInArrow(_summary(depth), "id long, n0 double, n1 double, below double").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    t = tops.toPandas()  # at most 255 * 256 ** (CUT - 1) rows
    held = spark.sparkContext.broadcast(Tops(*(t[c].to_numpy(kind) for c, kind in (("id", np.int64), ("n0", float), ("n1", float), ("below", float)))))
    value = pairs.groupBy("shard").applyInArrow(_answers(depth, held), "kind int, key long, value double").unionByName(counts.where(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value")))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-int(size) // block)))))
    asks = blocks.groupBy("block").applyInArrow(_asks(depth), "block long, kind int, key long")
    answers = asks.join(value, ["kind", "key"], "left").select("block", "kind", "key", "value")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(depth, n_train, n_tokens, n_distinct), SCHEMA)
