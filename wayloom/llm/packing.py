"""Hierarchical multi-length packing of token sequences.

Documents are tokenised and routed to context-size tiers. The longest tier is packed first: a
piece that needs the tier opens a window, the gap takes the largest whole pieces of shorter
tiers that fit, and a last cut fills it exactly. What a group leaves in the shortest tier is
carried to the next group; at the end of a partition the rest becomes windows of smaller powers
of two. Every window is therefore full, whatever the lengths. Windows of a tier are dealt into
step groups of equally many tokens, in snake order of their attention cost.

Each partition of the input is packed by itself, without a shuffle; a lost task packs the same
rows into the same sequences again. White space, and an ASCII letter next to other visible
ASCII characters, end a token, so such words are tokenised once and put together by 64-bit hashes; the cache of a worker changes no result.

Defined results: null and empty texts are one end token; a null doc_id stays null; of repeated
rows each is packed; a very long text is a step of its own and is cut into windows; other columns
are left out, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import ship
from wayloom.llm.text import BLACK, Words, chunks, release

TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens of a packed group, of a step group, and words a worker's cache holds.
GROUP, STEP, CACHE = 1 << 20, 1 << 15, 250_000
#: A token never spans an ASCII letter (1) next to another visible ASCII character (2); apostrophes may join.
KINDS = np.array([1 if chr(b).isalpha() and b < 128 else 2 if b < 128 and BLACK[b] and b != 0x27 else 0 for b in range(256)], dtype=np.uint8)


class WordTokenizer:
    """Token ids of texts through a cache of words; equal to encoding each text whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.at: dict[int, int] = {}
        self.start, self.length, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0

    def _learn(self, words: list[bytes], keys: list[int]) -> None:
        for k in range(0, len(words), 2000):
            part = [w.decode("utf-8", "surrogatepass") for w in words[k : k + 2000]]
            sizes = np.cumsum([0] + [len(w) + 1 for w in part])
            enc = self.inner.encode("\n".join(part), add_special_tokens=False)
            ids = np.array(enc.ids, dtype=np.int32)
            where = np.array(enc.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            n = np.bincount(np.searchsorted(sizes, where, side="right") - 1, minlength=len(part))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            first = len(self.at)
            while first + len(part) > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            self.start[first : first + len(part)] = self.used + np.cumsum(n) - n
            self.length[first : first + len(part)] = n
            self.at.update(zip(keys[k : k + 2000], range(first, first + len(part)), strict=True))
            self.used += len(ids)

    def encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        # a special token's name is read before its text is lower-cased and split
        special = {i: np.array(self.inner.encode(b.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, dtype=np.int32) for i, b in enumerate(bodies) if b"<|" in b}
        out = self._encode([b"" if i in special else b.lower() for i, b in enumerate(bodies)])
        return [special.get(i, ids) for i, ids in enumerate(out)]

    def _encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        w = Words(bodies, BLACK, kinds=KINDS)
        code, keys = pd.factorize(w.hashes())
        if len(self.at) + len(keys) > max(CACHE, 2 * len(keys)):
            self.forget()
        keys = keys.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            some = np.zeros(len(keys), dtype=np.int64)
            some[code[::-1]] = np.arange(len(code))[::-1]
            raw = w.buf.tobytes()
            self._learn([raw[w.start[some[i]] : w.end[some[i]]] for i in new], [keys[i] for i in new])
        index = np.array([self.at[k] for k in keys], dtype=np.int64)[code] if len(code) else np.zeros(0, np.int64)
        n = self.length[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.start[index] - (ends - n), n) + np.arange(total)]
        edge = np.concatenate([[0], ends])[w.first]
        return [flat[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


#: A piece: (length, order of arrival, start, document); documents are (doc_id, ids).
Piece = tuple[int, int, int, tuple]


class Packer:
    """Packs pieces into full windows; ``emit(window size, pieces)`` is called for each window."""

    def __init__(self, emit: Callable[[int, list[Piece]], None], tiers: tuple[int, ...] = TIERS):
        self.emit, self.tiers = emit, tuple(sorted(tiers))
        self.pool: list[Piece] = []
        self.order = 0

    def add(self, doc: tuple, n: int) -> None:
        top, start = self.tiers[-1], 0
        while n - start >= top:
            self.emit(top, [(top, self.order, start, doc)])
            start += top
        if n > start:
            insort(self.pool, (n - start, self.order, start, doc), key=lambda p: p[:2])
        self.order += 1

    def _fill(self, size: int) -> None:
        """One window of ``size``, full, from the pool; the pool holds enough."""
        pool, row, gap = self.pool, [], size
        while gap:
            k = bisect_right(pool, (gap, float("inf")), key=lambda p: p[:2]) - 1
            if k >= 0:
                piece = pool.pop(k)
                row.append(piece)
                gap -= piece[0]
            else:  # no whole piece fits: cut the shortest
                n, order, start, doc = pool.pop(0)
                row.append((gap, order, start, doc))
                insort(pool, (n - gap, order, start + gap, doc), key=lambda p: p[:2])
                gap = 0
        self.emit(size, row)

    def pack(self, last: bool = False) -> None:
        """All windows that the pool can fill; with ``last`` also the rest, in smaller powers of two."""
        total = sum(p[0] for p in self.pool)
        for size, below in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0), strict=True):
            while self.pool and self.pool[-1][0] > below and total >= size:
                self._fill(size)
                total -= size
        size = self.tiers[-1]
        while last and total:
            while size > total:
                size //= 2
            self._fill(size)
            total -= size


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _task(path: str, tiers: tuple[int, ...], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer(path)  # loads in a tenth of a second; a worker that is kept does not hold it
        base = TaskContext.get().partitionId() << 36
        windows: list[tuple[int, list[Piece]]] = []
        packer = Packer(lambda size, row: windows.append((size, row)), tiers)
        made = {"seq": 0, "step": 0}

        def rows() -> pa.RecordBatch:
            by: dict[int, list[list[Piece]]] = {}
            for size, row in windows:
                by.setdefault(size, []).append(row)
            windows.clear()
            out: list[list] = [[] for _ in _OUT]
            ids_out = []
            for size in sorted(by, reverse=True):
                ranked = sorted(by[size], key=lambda r: -sum(p[0] ** 2 for p in r))
                steps = max(1, -(-len(ranked) * size // STEP))
                dealt: list[list[list[Piece]]] = [[] for _ in range(steps)]
                for i, row in enumerate(ranked):
                    turn, k = divmod(i, steps)
                    dealt[k if turn % 2 == 0 else steps - 1 - k].append(row)
                for group in dealt:
                    for row in group:
                        offset = 0
                        for n, _, start, (doc_id, ids) in row:
                            part = ids[start : start + n]
                            for c, v in zip(out, (doc_id, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), base + made["seq"], offset, size, base + made["step"]), strict=True):
                                c.append(v)
                            if with_ids:
                                ids_out.append(part.astype(np.int32))
                            offset += n
                        made["seq"] += 1
                    made["step"] += 1
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _OUT, strict=True)], schema=_OUT)
            return batch.append_column("ids", pa.array(ids_out, type=pa.list_(pa.int32()))) if with_ids else batch

        held = 0
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            bodies = (b"" if t is None else t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist())
            for first, run_ in chunks(bodies):
                for k, ids in enumerate(tok.encode(run_)):
                    full = np.append(ids, np.int32(END))
                    packer.add((doc_ids[first + k], full), len(full))
                    held += len(full)
                if held >= GROUP:
                    packer.pack()
                    held = 0
                    yield rows()
        packer.pack(last=True)
        yield rows()
        del tok
        release()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's token ids."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_task(tokenizer_path, tiers, with_ids), SCHEMA + (", ids array<int>" if with_ids else ""))
