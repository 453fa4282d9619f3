"""Quality scores by a sparse ensemble of rules.

Statistics of whole texts are the only inputs. Boosted regression trees of small depth are
grown on a bounded sample of labelled rows, every path from a root becomes a conjunctive rule,
an L1-penalised logistic regression keeps few of the rules and statistics, and what it keeps
is compiled into one Spark column expression over the statistics.

Defined results: null and empty texts have all-zero statistics and get a score like any other;
without labelled rows of both classes the score is the share of label 1 (0.5 without any); a text
of any length is read whole; of repeated rows each gets its score, and of rows with one labelled
id the one with the smallest statistics is learned from; of contradicting labels the greater
counts; other columns are left out, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import ship, store
from wayloom.llm.text import BLACK, Words, chunks, norm_bytes

#: Labelled rows used for fitting: those with the smallest hash of their id.
MAX_LABELLED = 20_000
STATS = ("log_bytes", "log_words", "word_length", "upper", "digit", "punct", "symbol", "wide", "space", "line_length", "distinct_words", "top_word", "repeat_words", "repeat_lines", "punct_words", "pipes", "short_words", "long_words", "line_ends")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#$%&*@^~_=+<>{}[]|\\/", dtype=np.uint8)] = True


def _share(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[end] - total[start]) / np.maximum(1, end - start)


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATS for each text."""
    out = np.zeros((len(texts), len(STATS)))
    for first, raw in chunks(b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts):
        buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        start = np.cumsum(size + 1) - size - 1
        end, n = start + size, len(raw)
        w = Words([b.lower() for b in raw], BLACK)
        h, count = w.hashes(), np.diff(w.first)
        one, length = np.maximum(1, count), w.end - w.start
        sums = lambda x: np.bincount(w.text, weights=x, minlength=n) / one  # noqa: B023, E731
        order = np.lexsort((h, w.text))
        sh, st = h[order], w.text[order]
        new = np.flatnonzero(np.concatenate([[True], (sh[1:] != sh[:-1]) | (st[1:] != st[:-1])])) if len(sh) else np.zeros(0, np.int64)
        most = np.zeros(n)
        np.maximum.at(most, st[new], np.diff(np.append(new, len(sh))))
        upper, digit = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)
        letter = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        punct = ~letter & ~digit & ~space & (buf > 32)
        line = buf == 10
        lines = [b.split(b"\n") for b in raw]
        same = np.zeros(len(h), dtype=bool)
        if len(h) > 1:
            same[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
        at = slice(first, first + n)
        cols = [
            np.log1p(size), np.log1p(count), sums(length), _share(upper, start, end), _share(digit, start, end), _share(punct, start, end), _share(_SYMBOL[buf], start, end), _share(buf >= 128, start, end), _share(space, start, end),
            [np.log1p(s / len(x)) for s, x in zip(size, lines, strict=True)], np.bincount(st[new], minlength=n) / one, most / one, sums(same), [1 - len(set(x)) / len(x) for x in lines], sums(punct[np.maximum(w.end - 1, 0)] if len(h) else np.zeros(0)), _share(buf == 124, start, end), sums(length <= 2), sums(length >= 15), _share(line, start, end),
        ]
        out[at] = np.stack([np.asarray(c, dtype=float) for c in cols], axis=1)
    return out


def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(statistics(list(texts)), columns=list(STATS))


def text_statistics(text: Column) -> Column:
    """struct of STATS of whole texts."""
    return F.pandas_udf(_statistics, ", ".join(f"{s} double" for s in STATS))(text)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for i, above, v in self.terms:
            out &= (x[:, i] > v) == above
        return out

    def column(self, stats: str) -> Column:
        cond = F.lit(True)
        for i, above, v in self.terms:
            c = F.col(f"{stats}.{STATS[i]}")
            cond = cond & ((c > v) if above else (c <= v))
        return cond.cast("double")


@dataclass
class Model:
    """Weighted rules and clipped, scaled statistics."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)  # statistic, low, high, weight

    def column(self, stats: str) -> Column:
        """The compiled score: a logistic of a sum, all in Spark expressions."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + rule.column(stats) * F.lit(weight)
        for i, low, high, weight in self.linear:
            c = F.least(F.greatest(F.col(f"{stats}.{STATS[i]}"), F.lit(low)), F.lit(high))
            total = total + (c - F.lit(low)) * F.lit(weight / max(high - low, 1e-9))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set[Rule], pred: np.ndarray) -> None:
    """Grows a least-squares tree on g; adds each node's path to ``rules`` and sets leaves' means in ``pred``."""
    if path:
        rules.add(Rule(path))
    best = (1e-9, None)
    if depth and len(rows) >= 40:
        total, n = g[rows].sum(), len(rows)
        for i, c in enumerate(cuts):
            if not len(c):
                continue
            b = bins[rows, i]
            k = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            s = np.cumsum(np.bincount(b, weights=g[rows], minlength=len(c) + 1))[:-1]
            ok = (k >= 10) & (n - k >= 10)
            gain = np.where(ok, s**2 / np.maximum(k, 1) + (total - s) ** 2 / np.maximum(n - k, 1) - total**2 / n, 0)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], (i, j))
    if best[1] is None:
        pred[rows] = g[rows].mean()
        return
    i, j = best[1]
    left = bins[rows, i] <= j
    for above, part in ((False, rows[left]), (True, rows[~left])):
        _tree(x, bins, cuts, g, part, depth - 1, (*path, (i, above, float(cuts[i][j]))), rules, pred)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 2e-3, steps: int = 600) -> Model:
    """Rules from boosted trees, weights from an L1-penalised logistic regression (FISTA)."""
    share = float(y.mean()) if len(y) else 0.5
    base = math.log(max(share, 1e-3) / max(1 - share, 1e-3))
    if not len(y) or share in (0.0, 1.0):
        return Model(base if len(y) else 0.0)
    rng = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    rules: set[Rule] = set()
    score = np.full(len(y), base)
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-score))
        pred = np.zeros(len(y))
        _tree(x, bins, cuts, g, np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False)), depth, (), grown := set(), pred)
        rules |= grown
        score = score + rate * 4 * pred
    ordered = sorted(rules, key=lambda r: r.terms)
    low, high = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
    a = np.concatenate([np.stack([r.of(x) for r in ordered], axis=1).astype(float) if ordered else np.zeros((len(y), 0)), (np.clip(x, low, high) - low) / np.maximum(high - low, 1e-9)], axis=1)
    mean = a.mean(axis=0)
    a = a - mean
    w, z, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), base, 1.0
    step = 1 / (0.25 * np.linalg.norm(a.T @ a / len(y), 2) + 1e-9)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ z + b))) - y
        new = z - step * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        b -= 2 * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    k = len(ordered)
    return Model(float(b - mean @ w), [(r, float(v)) for r, v in zip(ordered, w, strict=False) if abs(v) > 1e-4], [(i, float(low[i]), float(high[i]), float(w[k + i])) for i in range(len(STATS)) if abs(w[k + i]) > 1e-4])


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on at most ``max_labelled`` rows of ``labels`` (doc_id and a 0/1 column), ``stats`` having doc_id and stats."""
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = stats.select("doc_id", "stats.*").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*STATS, "y")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toPandas()  # at most max_labelled rows
    return fit(rows[list(STATS)].to_numpy(float).reshape(len(rows), len(STATS)), rows["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, stats and score of every row; the texts are read once and their statistics kept in the shared folder."""
    ship(docs.sparkSession)
    stats = store(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_statistics(F.col(text_col).cast("string")).alias("stats")), "stats")
    return stats.withColumn("score", train(stats, labels, label).column("stats"))
