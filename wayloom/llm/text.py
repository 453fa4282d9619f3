"""Byte-level text primitives shared by the operators, vectorised with NumPy.

Texts are handled as UTF-8 bytes. ``bytes.lower`` changes A-Z only, which is the case
folding every contract here asks for. All hashes are 64 bits wide.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text makes a chunk of its own.
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_class(pred) -> np.ndarray:
    """Boolean table over the 256 bytes."""
    return np.array([bool(pred(b)) for b in range(256)])


#: Words of letters and digits after lower-casing A-Z; every byte of a non-ASCII character counts.
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Words split at ASCII white space.
BLACK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def norm_bytes(text: str | None) -> bytes:
    """Lower-cased (A-Z) UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine: workers are kept from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(bodies: Iterable[bytes], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about ``limit`` bytes, with the first one's index."""
    run: list[bytes] = []
    size = first = n = 0
    for b in bodies:
        if run and size + len(b) > limit:
            yield first, run
            run, size, first = [], 0, n
        run.append(b)
        size += len(b) + 1
        n += 1
    if run:
        yield first, run
    run = []
    release()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _cache or len(_cache["p"]) < n:
        size = max(n, CHUNK + 4096)
        tables = _powers(_P, size), _powers(pow(_P, -1, 1 << 64), size)
        if n > 4 * CHUNK:  # a table for one very long text isn't kept
            return tables
        _cache["p"], _cache["q"] = tables
    return _cache["p"], _cache["q"]


class Words:
    """The words of a chunk of texts: starts, ends, 64-bit hashes, and the text each is in."""

    def __init__(self, bodies: list[bytes], table: np.ndarray, sep: bytes = b"\n", kinds: np.ndarray | None = None):
        """``kinds`` (a number for each byte) also cuts a word where a byte of kind 1 meets one of kind 2."""
        self.buf = np.frombuffer(sep.join(bodies) + sep, dtype=np.uint8)
        sizes = np.fromiter((len(b) + len(sep) for b in bodies), dtype=np.int64, count=len(bodies))
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        inside = table[self.buf]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        if kinds is not None:
            k = kinds[self.buf]
            more = np.flatnonzero(k[:-1] * k[1:] == 2) + 1
            edge = np.sort(np.concatenate([edge, more, more]), kind="stable")
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(self.text_end, self.start, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(bodies) + 1))

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        p, q = _tables(len(self.buf))
        x = _BYTE[self.buf] * p[: len(self.buf)]
        at = np.empty(2 * len(self.start), dtype=np.int64)
        at[::2], at[1::2] = self.start, self.end
        if at[-1] >= len(x):
            x = np.append(x, np.uint64(0))
        return mix(np.add.reduceat(x, at)[::2] * q[self.start])


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a text, and each one's text.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    full = np.zeros(0, dtype=np.uint64)
    owner = np.zeros(0, dtype=np.int64)
    if len(h) >= k:
        full = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            full = full * np.uint64(_P) + h[i : len(h) - k + 1 + i]
        ok = text[: len(full)] == text[k - 1 :]
        full, owner = mix(full[ok]), text[: len(full)][ok]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        more = []
        for t in short:
            x = 0x1234567
            for w in h[first[t] : first[t + 1]]:
                x = (x * _P + int(w)) & 0xFFFFFFFFFFFFFFFF
            more.append(x)
        full = np.concatenate([full, mix(np.array(more, dtype=np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        full, owner = full[order], owner[order]
    return full, owner


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
