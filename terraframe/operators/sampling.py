"""Seeded rejection sampling of sample squares, and samples of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions.prng import draws


def candidates(spark: SparkSession, left: float, bottom: float, right: float, top: float, side: float = 30.0, tries: int = 2000, seed: int = 42) -> DataFrame:
    """``attempt, xmin, ymin, xmax, ymax``: two draws for each attempt, x first, whether it is accepted or not."""
    if right - left < side or top - bottom < side:
        raise ValueError(f"the extent is smaller than a square of {side}")
    d = draws(spark, 2 * tries, seed).withColumn("attempt", F.ceil(F.col("k") / 2).cast("int"))
    at = lambda odd: F.max(F.when(F.col("k") % 2 == odd, F.col("u")))
    p = d.groupBy("attempt").agg(at(1).alias("ux"), at(0).alias("uy"))
    p = p.withColumn("xmin", left + F.col("ux") * F.lit(right - left - side)).withColumn("ymin", bottom + F.col("uy") * F.lit(top - bottom - side))
    return p.select("attempt", "xmin", "ymin", (F.col("xmin") + side).alias("xmax"), (F.col("ymin") + side).alias("ymax"))


def accept(cands: DataFrame, n: int = 3, usable: Column | None = None) -> DataFrame:
    """The first ``n`` candidates by attempt that overlap none accepted before (touching is no overlap) and are ``usable``.

    A fold over the attempts, at most a few thousand whatever the raster's size. Returns ``square_id`` 1..n with the box.
    """
    rows = cands if usable is None else cands.where(usable)
    box = F.struct("attempt", "xmin", "ymin", "xmax", "ymax")
    every = rows.agg(F.array_sort(F.collect_list(box)).alias("all"))
    kind = every.schema["all"].dataType
    hits = lambda s, c: F.exists(s, lambda k: (c["xmin"] < k["xmax"]) & (c["xmax"] > k["xmin"]) & (c["ymin"] < k["ymax"]) & (c["ymax"] > k["ymin"]))
    chosen = F.aggregate("all", F.array().cast(kind), lambda s, c: F.when((F.size(s) >= n) | hits(s, c), s).otherwise(F.concat(s, F.array(c))))
    return every.select(F.posexplode(chosen).alias("i", "s")).select((F.col("i") + 1).alias("square_id"), "s.*")


def head(df: DataFrame, order: str | list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in order: a top-k, no global sort."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)


def seeded(df: DataFrame, key: str, n: int = 4, seed: int = 42) -> DataFrame:
    """``n`` random rows, the same for the same seed however the table is dealt: those with the least hash of ``key``."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
