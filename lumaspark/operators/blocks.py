"""Block transforms: DCT, quantisation, zig-zag, prediction and run-length.

A block is one row with an ARRAY of 64 values in row-major order, so transforms need no shuffle.
Results that are rounded are first rounded to 6 decimals: a sum that is exactly a half then goes
away from zero whatever the order it was added up in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables


def half_away(x: Column) -> Column:
    """Round a half away from zero, as INT."""
    return F.round(F.round(x, 6), 0).cast("int")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def samples(vector: Column, scale: float = 256.0) -> Column:
    """A vector of numbers around 0 as samples from 0 to 255."""
    return F.transform(vector, lambda e: clamp(F.round(F.lit(128.0) + e.cast("double") * scale, 0).cast("int"), 0, 255))


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, 64))


def _round(x: np.ndarray) -> np.ndarray:
    """A half away from zero, after 6 decimals, like ``half_away``."""
    x = np.round(x, 6)
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


#: Weight of sample n (row) in coefficient k (column) of the 8-point transform.
_WAVES = np.array([[0.5 * tables.alpha(k) * tables.cosine(n, k) for k in range(8)] for n in range(8)])


def _spread(blocks: np.ndarray, known: pd.Series) -> pd.Series:
    """Blocks at the places of the known rows, None elsewhere."""
    done = iter(blocks.reshape(-1, 64))
    return pd.Series([next(done) if k else None for k in known], dtype="object")


def _fdct(series: pd.Series) -> pd.Series:
    known = series.notna()
    s = _matrix(series[known]).reshape(-1, 8, 8) - 128.0
    c = np.clip(_round(np.einsum("bij,jk->bik", np.einsum("bij,ik->bkj", s, _WAVES), _WAVES)), -32768, 32767).astype(np.int32)
    return _spread(c, known)


def _idct(series: pd.Series) -> pd.Series:
    known = series.notna()
    c = _matrix(series[known]).reshape(-1, 8, 8)
    s = np.clip(_round(np.einsum("bij,kj->bik", np.einsum("bij,ki->bkj", c, _WAVES), _WAVES)) + 128, 0, 255).astype(np.int32)
    return _spread(s, known)


def fdct(block: Column) -> Column:
    """Forward DCT of 64 samples: level shift by 128, 64 coefficients row by row, within 16 bits.

    Dense 8x8 products are what arrays of numbers are best at: whole Arrow batches of blocks are
    multiplied at once, by rows and then by columns. A null block gives null.
    """
    return F.pandas_udf(_fdct, "array<int>")(block)


def idct_two_pass(coefs: Column) -> Column:
    """Inverse DCT by rows, then by columns: samples from 0 to 255. A null block gives null."""
    return F.pandas_udf(_idct, "array<int>")(coefs)


def idct_precomputed(coefs: DataFrame, key: str, k: str = "k", value: str = "coef") -> DataFrame:
    """Inverse DCT of (key, k, value) rows by one join with the 4,096-row basis: (key, i, px)."""
    basis = F.broadcast(tables.basis_df(coefs.sparkSession))
    summed = coefs.join(basis, coefs[k] == basis["k"]).groupBy(key, "i").agg(F.sum(F.col(value) * F.col("w")).alias("s"))
    return summed.select(key, "i", clamp(half_away(F.col("s")) + 128, 0, 255).alias("px"))


def idct_naive(coefs: DataFrame, key: str, k: str = "k", value: str = "coef") -> DataFrame:
    """The same with cosines computed for each term."""
    every = coefs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    x, y, u, v = F.col("i") % 8, F.floor(F.col("i") / 8), F.col(k) % 8, F.floor(F.col(k) / 8)
    a = lambda q: F.when(q == 0, F.sqrt(F.lit(0.5))).otherwise(F.lit(1.0))
    pi16 = F.pi() / 16
    term = F.col(value) * 0.25 * a(u) * a(v) * F.cos((2 * x + 1) * u * pi16) * F.cos((2 * y + 1) * v * pi16)
    return every.groupBy(key, "i").agg(F.sum(term).alias("s")).select(key, "i", clamp(half_away(F.col("s")) + 128, 0, 255).alias("px"))


def toward_zero(a: Column, b: Column | int) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", a.cast("long"), F.lit(b) if isinstance(b, int) else b.cast("long")).cast("int")


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def quantise(coefs: Column, quant: list[int]) -> Column:
    """Coefficients in zig-zag order divided by the table's entry of the same zig-zag index."""
    return F.transform(_ints(tables.zigzag()), lambda pos, k: (coefs[pos] / _ints(quant)[k]).cast("int"))


def dequantise(levels: Column, quant: list[int]) -> Column:
    """Levels in zig-zag order back as coefficients row by row."""
    at = {pos: k for k, pos in enumerate(tables.zigzag())}
    return F.transform(_ints([at[p] for p in range(64)]), lambda k: levels[k] * _ints(quant)[k])


def dc_delta(df: DataFrame, group: list[str], order: str, dc: str, to: str = "delta") -> DataFrame:
    """Difference of each block's DC to the one before it in its image and component."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn(to, F.col(dc) - F.coalesce(F.lag(dc).over(w), F.lit(0)))


def dc_sum(df: DataFrame, group: list[str], order: str, delta: str, to: str = "dc") -> DataFrame:
    """DC values back from their differences."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.sum(delta).over(w).cast("int"))


def ac_runs(levels: Column) -> Column:
    """Run-length of the AC levels in zig-zag order: array of struct(k, run, value).

    A run over 15 is split into ZRL entries (run 15, value 0); zeros at the end give one end-of-block
    entry (run 0, value 0, k 64). It is a fold within the row, so no window or shuffle is needed.
    """
    entry = "struct<k:int,run:int,value:int>"
    start = F.struct(F.lit(0).alias("run"), F.array().cast(f"array<{entry}>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        v = levels[k]
        zrl = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (acc["run"] / 16).cast("int"))), lambda j: F.struct((k - acc["run"] + 16 * j - 1).cast("int").alias("k"), F.lit(15).alias("run"), F.lit(0).alias("value")))
        zrl = F.when(acc["run"] >= 16, zrl).otherwise(F.array().cast(f"array<{entry}>"))
        hit = F.struct(F.lit(0).alias("run"), F.concat(acc["out"], zrl, F.array(F.struct(k.cast("int").alias("k"), (acc["run"] % 16).cast("int").alias("run"), v.alias("value")))).alias("out"))
        miss = F.struct((acc["run"] + 1).alias("run"), acc["out"].alias("out"))
        return F.when(v != 0, hit).otherwise(miss)

    end = lambda acc: F.when(acc["run"] > 0, F.concat(acc["out"], F.array(F.struct(F.lit(64).alias("k"), F.lit(0).alias("run"), F.lit(0).alias("value"))))).otherwise(acc["out"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step, end)
