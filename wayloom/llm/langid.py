"""Language identification with bit-sliced Bloom filters of n-grams.

Training counts byte 4-grams of the lower-cased text per language over all training rows. A
language's filter takes the grams that make up at least ``SHARE`` of its grams, so each filter
holds at most 1/SHARE grams however large the corpus is, and the broadcast has a fixed size.
The filters are bit-sliced: slot s of the table holds one bit per language, and the AND of a
gram's K slots is the mask of all languages whose filters contain it.

A text's score per language is its popcount over all grams, corrected for the filter's
false-positive rate; the largest decides, and ``score`` is its share of the sum.

Defined results: null or empty texts and texts without a letter are ``und`` with score 0;
ties go to the first language by name; without training rows every text is ``und``; repeated rows
count once each; very long texts are a step of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import ship, store
from wayloom.llm.text import chunks, mix

N = 4
SHARE = 2e-5
#: Hash functions, and slots for each gram of the fullest filter.
K, ROOM = 4, 8
#: Share of known n-grams below which a text is in no language: noise has under 0.03, prose with many numbers 0.2 and more.
LEAST_KNOWN = 0.15
#: Languages in one 64-bit slice.
SLICE = 64


def _grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams as integers, and the text each is in; texts are padded with one blank."""
    parts = [b" " + b + b" " for b in bodies]
    buf = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    if len(buf) < N:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    g = (buf[:-3] << np.uint32(24)) | (buf[1:-2] << np.uint32(16)) | (buf[2:-1] << np.uint32(8)) | buf[3:]
    text = np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0))
    ok = text[:-3] == text[3:]
    return g[ok], text[:-3][ok]


def _body(t: str | None) -> bytes:
    return b"" if t is None else " ".join(t.lower().split()).encode("utf-8", "surrogatepass")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang):
        g, c = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        u, at = np.unique(g, return_inverse=True)
        return u, np.bincount(at, weights=c).astype(np.int64)

    for b in batches:
        by: dict[str, list[bytes]] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(_body(text))
        for lang, bodies in by.items():
            for _, run in chunks(bodies, 1 << 20):
                held.setdefault(lang, []).append(np.unique(_grams(run)[0], return_counts=True))
            if len(held[lang]) > 8:
                held[lang] = [merged(lang)]
    for lang in held:
        u, c = merged(lang)
        yield pa.record_batch([pa.array([lang] * len(u), pa.string()), u.astype(np.int64), c], names=["lang", "gram", "n"])


class Filters:
    """Bit-sliced Bloom filters over languages."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]):
        self.langs = langs
        most = max((len(g) for g in grams.values()), default=1)
        self.bits = max(10, int(np.ceil(np.log2(max(1, most * ROOM)))))
        self.slices = [np.zeros(1 << self.bits, dtype=np.uint64) for _ in range(0, max(1, len(langs)), SLICE)]
        for i, lang in enumerate(langs):
            for slot in self._slots(grams[lang].astype(np.uint32)):
                self.slices[i // SLICE][slot] |= np.uint64(1 << i % SLICE)
        fill = [((self.slices[i // SLICE] >> np.uint64(i % SLICE)) & np.uint64(1)).mean() for i in range(len(langs))]
        self.false_rate = np.array(fill) ** K

    def _slots(self, g: np.ndarray) -> list[np.ndarray]:
        h = mix(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(k) * b) & np.uint64((1 << self.bits) - 1)).astype(np.int64) for k in range(K)]

    def masks(self, g: np.ndarray) -> list[np.ndarray]:
        """For each slice, the mask of the languages that contain each gram."""
        slots = self._slots(g)
        out = []
        for s in self.slices:
            m = s[slots[0]]
            for slot in slots[1:]:
                m = m & s[slot]
            out.append(m)
        return out

    def counts(self, g: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Corrected popcounts: a row for each text, a column for each language.

        Equal grams of a chunk are looked up once.
        """
        code, u = pd.factorize(g)
        masks = self.masks(u)
        total = np.bincount(text, minlength=n).astype(float)
        out = np.zeros((n, len(self.langs)))
        for i in range(len(self.langs)):
            has = ((masks[i // SLICE] >> np.uint64(i % SLICE)) & np.uint64(1)).astype(np.float64)
            hits = np.bincount(text, weights=has[code], minlength=n)
            fp = self.false_rate[i]
            out[:, i] = np.maximum(0, (hits - fp * total) / max(1e-9, 1 - fp))
        return out


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = SHARE) -> Filters:
    """Filters from all rows with a text and a language."""
    ship(rows.sparkSession)
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = store(counts, "grams")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Filters([], {})
    limit = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(totals[lang]) * share)])
    kept = counts.where(F.col("n") >= F.element_at(limit, F.col("lang"))).select("lang", "gram")
    grams: dict[str, list[int]] = {lang: [] for lang in langs}  # at most 1/share of them for each language
    for lang, gram in kept.toLocalIterator(prefetchPartitions=True):
        grams[lang].append(gram)
    return Filters(langs, {k: np.array(v, dtype=np.int64) for k, v in grams.items()})


def predict(text: Column, filters: Filters, spark) -> Column:
    """struct<lang_pred, score, known, grams>: known is the share of a text's grams in the chosen filter."""
    ship(spark)
    held = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double, known double, grams long")
    def udf(texts: pd.Series) -> pd.DataFrame:
        f = held.value
        lang, score, known, grams = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        if f.langs:
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            for first, run in chunks((_body(t) for t in texts), 1 << 20):
                g, text = _grams(run)
                c = f.counts(g, text, len(run))
                best, at = c.argmax(axis=1), slice(first, first + len(run))
                top, total = c[np.arange(len(run)), best], c.sum(axis=1)
                lang[at] = np.where(letters[at], np.array(f.langs, dtype=object)[best], "und")
                score[at] = np.where(letters[at] & (total > 0), top / np.maximum(total, 1e-9), 0)
                grams[at] = np.bincount(text, minlength=len(run))
                known[at] = np.where(letters[at], top / np.maximum(1, grams[at]), 0)
        return pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1), "known": np.clip(known, 0, 1), "grams": grams})

    return udf(text.cast("string"))


def is_language(p: Column, least: float = LEAST_KNOWN, z: float = 1.64) -> Column:
    """Whether a result of :func:`predict` is a text in a language.

    It isn't if it has no letter, or if the share of its n-grams that the best language knows is below
    ``least`` even at the upper end of Wilson's interval: of a short text more has to be foreign.
    """
    n, known = F.greatest(p["grams"], F.lit(1)).cast("double"), p["known"]
    upper = (known + z * z / (2 * n) + z * F.sqrt(known * (1 - known) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return (p["lang_pred"] != "und") & (upper >= least)
