"""Aggregates and their fixed conventions: zero for what is undefined, nulls skipped."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measure_stats(df: DataFrame, col: str) -> DataFrame:
    """One row ``n, toplam, ortalama, en_kucuk, en_buyuk, std``: sample deviation, 0 for one value; nulls for none."""
    c = F.col(col)
    std = F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))
    return df.agg(F.count(c).alias("n"), F.sum(c).alias("toplam"), F.avg(c).alias("ortalama"), F.min(c).alias("en_kucuk"), F.max(c).alias("en_buyuk"), std.alias("std"))


def not_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def nan_stats(df: DataFrame, col: str) -> DataFrame:
    """min, max, mean and count of what is neither null nor NaN."""
    c = not_nan(F.col(col).cast("double"))
    return df.agg(F.min(c).alias("en_kucuk"), F.max(c).alias("en_buyuk"), F.avg(c).alias("ortalama"), F.count(c).alias("gecerli"))


def percentile(c: Column, p: float) -> Column:
    """Exact, linear between ranks at (n - 1) p."""
    return F.percentile(c, F.lit(p))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """``k, left, right, n`` of equal-width bins over [min, max], empty ones included; the top value falls in the last bin, a range of 0 counts as 1."""
    c = F.col(col)
    v = df.where(c.isNotNull() & ~F.isnan(c.cast("double"))).select(c.cast("double").alias("v"))
    edge = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")
    edge = edge.withColumn("span", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)))
    k = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("span") * bins), F.lit(bins - 1)).cast("int")
    # one row of edges: an aggregate without keys
    counts = v.join(F.broadcast(edge)).groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    frame = edge.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = F.col("span") / bins
    return frame.join(counts, "k", "left").select("k", (F.col("lo") + F.col("k") * width).alias("left"), (F.col("lo") + (F.col("k") + 1) * width).alias("right"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def precision_recall_f1(tp: Column, pred: Column, ref: Column) -> list[Column]:
    """tp, fp, fn and the three ratios, 0 where a denominator is 0."""
    p = F.coalesce(F.try_divide(tp.cast("double"), pred), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), ref), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0))
    return [tp.alias("tp"), (pred - tp).alias("fp"), (ref - tp).alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def r_squared(x: Column, y: Column) -> Column:
    """Squared Pearson correlation: 0 if a side doesn't vary, null for fewer than two pairs."""
    both = F.coalesce(F.try_divide(F.pow(F.covar_pop(x, y), F.lit(2)), F.var_pop(x) * F.var_pop(y)), F.lit(0.0))
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 2, both)


def rmse(x: Column, y: Column) -> Column:
    """Over the pairs themselves, not one less."""
    return F.sqrt(F.avg(F.pow(y - x, F.lit(2))))


def exact_round(digits: int):
    """Rounds the double's exact binary value, halves away from zero: 1.005 becomes 1.0 at two digits. An Arrow UDF, for exports.

    Values are rounded a batch at a time; only those whose scaled value is too near a half for doubles to tell go through decimals.
    """
    unit, scale = Decimal(1).scaleb(-digits), 10.0**digits

    @F.pandas_udf("double")
    def go(v: pd.Series) -> pd.Series:
        x = v.to_numpy(dtype=float, na_value=np.nan)
        size = np.abs(x) * scale
        with np.errstate(invalid="ignore"):
            fine = size < 2.0**52
            out = np.where(fine, np.copysign(np.floor(size + 0.5) / scale, x), x)
            near = np.flatnonzero(fine & (np.abs(size - np.floor(size) - 0.5) <= 1e-9 + size * 1e-15))
        out[near] = [float(Decimal(float(x[i])).quantize(unit, ROUND_HALF_UP)) for i in near]
        # a missing value stays missing, and no zero is negative
        return pd.Series(out + 0.0).where(v.notna().to_numpy(), None)

    return go


def binned(df: DataFrame, x: str, y: str, bins: int = 256) -> DataFrame:
    """``x, y, n``: the means of the pairs in each cell of a grid of ``bins`` x ``bins`` from 0 to the largest value, for charts."""
    v = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    top = v.agg(F.greatest(F.max("x"), F.max("y"), F.lit(1e-300)).alias("top"))
    at = lambda c: F.least(F.floor(F.col(c) / F.col("top") * bins), F.lit(bins - 1))
    # one row of one figure: an aggregate without keys
    return v.join(F.broadcast(top)).groupBy(at("x").alias("i"), at("y").alias("j")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).select("x", "y", "n")


def nice_step(span: Column, steps: int) -> Column:
    """The smallest of 1, 2, 5, 10 times a power of ten that covers the span in about ``steps`` steps."""
    raw = span / steps
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / power
    return F.when(m <= 1, power).when(m <= 2, 2 * power).when(m <= 5, 5 * power).otherwise(10 * power)


def nice_ticks(lo: Column, hi: Column, steps: int = 5, whole: bool = False) -> Column:
    """Axis ticks: multiples of a nice step from the one at or below ``lo`` to the one at or above ``hi``; ``whole`` keeps steps at 1 or more."""
    low = F.when(lo == hi, lo - 1).otherwise(lo)
    high = F.when(lo == hi, hi + 1).otherwise(hi)
    step = nice_step(high - low, steps)
    step = F.greatest(step, F.lit(1.0)) if whole else step
    return F.transform(F.sequence(F.floor(low / step), F.ceil(high / step)), lambda k: k * step)
