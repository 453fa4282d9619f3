"""Places that all executors share, and row identities that survive a recomputation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.text import release
from wayloom.sources.tables import cut, ship

__all__ = ["Bitmap", "carry", "crc_bucket", "restored", "ship", "spread_join", "store"]

#: A key is heavy if it holds more than one in so many rows; there are at most so many heavy keys.
HEAVY = 1000
#: Bits of a bitmap of hashes: 8 MB.
BITS = 1 << 26


def store(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes a table in the shared folder and reads it again: lineage is cut, and a lost executor loses nothing."""
    return cut(df, name)


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def carry(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns renamed _c0, _c1, ..., so that no operator's column can clash with them."""
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])


def restored(df: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """Undoes :func:`carry`; the operator's columns ``more`` follow and replace columns of the same name."""
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in more]
    return df.select(*own, *more)


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each ``key`` and in ``weight`` about how many rows hold it.

    Keys that hold more than one in ``HEAVY`` of the ``total`` rows, so at most ``HEAVY`` of them, are broadcast;
    the others are joined by a shuffle that no key can make uneven. ``how`` is 'inner' or 'left'.
    """
    names = [c for c in table.columns if c not in (key, weight)]
    packed = table.select(F.col(key), (F.col(weight) * HEAVY > F.lit(total)).alias("_heavy"), F.struct(F.lit(True).alias("_found"), *names).alias("_v"))
    heavy = packed.where("_heavy").select(F.col(key).alias("_hk"), F.col("_v").alias("_hv"))
    light = packed.where("not _heavy").select(F.col(key).alias("_lk"), F.pmod(F.xxhash64(key), F.lit(1).cast("long")).alias("_ls"), F.col("_v").alias("_lv"))  # always 0, which the optimiser must not know
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    # rows that are answered go anywhere, not to one task
    aside = F.pmod(F.xxhash64(*rows.columns), F.lit(HEAVY)) + 1
    out = out.withColumn("_ls0", F.when(F.col("_hv").isNull(), F.lit(0).cast("long")).otherwise(aside))
    out = out.join(light, (F.col(key) == F.col("_lk")) & (F.col("_ls0") == F.col("_ls")), "left").withColumn("_v", F.coalesce("_hv", "_lv"))
    if how == "inner":
        out = out.where("_v is not null")
    return out.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in names])


class Bitmap:
    """Which of BITS positions some key has; a fuller one lets more pass and loses none. At most 8 MB are collected and broadcast."""

    def __init__(self, df: DataFrame, key: str):
        at = F.col(key).bitwiseAND(F.lit(BITS - 1))
        bit = F.expr(f"shiftleft(1L, cast(({key} & {BITS - 1}) & 63 as int))")
        words = df.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
        out = np.zeros(BITS // 64, dtype=np.int64)
        for r in words.toLocalIterator():  # at most BITS / 64 rows
            out[r[0]] = r[1]
        self.held = df.sparkSession.sparkContext.broadcast(out.view(np.uint64))
        release()

    def has(self, key: Column) -> Column:
        """Whether a 64-bit key may be among those of the bitmap."""
        held = self.held

        @F.pandas_udf("boolean")
        def udf(keys: pd.Series) -> pd.Series:
            return pd.Series(among(held.value, keys.to_numpy(np.int64)))

        return udf(key)


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    i = keys & (BITS - 1)
    return (bits[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0
