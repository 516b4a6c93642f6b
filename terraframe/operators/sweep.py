"""Confidence sweep over detections that went through suppression once.

Suppression commutes with a lower bound on the score: rows below it rank after
all others and suppress none of them. So one pass at the smallest threshold
serves all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold_sweep(kept: DataFrame, thresholds, score: str = "conf", area: str = "area", digits: int = 2) -> DataFrame:
    """``esik, tespit_sayisi, toplam_alan_m2, ortalama_alan_m2`` for each threshold; zeros where nothing remains."""
    spark = kept.sparkSession
    t = spark.createDataFrame([(float(x),) for x in sorted(thresholds)], "esik double")
    # the thresholds are a handful of literals; each kept row is counted by the number it reaches
    reach = F.explode(F.filter(F.array(*[F.lit(float(x)) for x in sorted(thresholds)]), lambda x: F.col(score) >= x))
    g = kept.select(reach.alias("e"), F.col(area).alias("a")).groupBy("e").agg(F.count("*").alias("n"), F.sum("a").alias("s"), F.avg("a").alias("m"))
    zero = lambda c: F.coalesce(F.round(c, digits), F.lit(0.0))
    return t.join(g, F.col("esik") == F.col("e"), "left").select("esik", F.coalesce("n", F.lit(0).cast("long")).alias("tespit_sayisi"), zero("s").alias("toplam_alan_m2"), zero("m").alias("ortalama_alan_m2"))
