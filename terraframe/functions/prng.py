"""A counter-based 32-bit generator as a column expression.

Draw k of a seed depends on k alone, since the state before it is seed + k *
step mod 2**32; draws are thus made in parallel by range().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the mulberry32 generator.
STEP = 0x6D2B79F5
MASK = 0xFFFFFFFF


def _imul(a: Column, b: Column) -> Column:
    """Low 32 bits of a product, within 64-bit arithmetic."""
    low, high = b.bitwiseAND(F.lit(65535).cast("long")), F.shiftrightunsigned(b, 16)
    part = (a * high).bitwiseAND(F.lit(65535).cast("long")) * 65536
    return (a * low + part).bitwiseAND(F.lit(MASK).cast("long"))


def draws(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``k`` = 1..n and ``u`` in [0, 1)."""
    mask = F.lit(MASK).cast("long")
    d = spark.range(1, n + 1).withColumnRenamed("id", "k")
    d = d.withColumn("a", (F.lit(seed).cast("long") + F.col("k") * F.lit(STEP).cast("long")).bitwiseAND(mask))
    # steps in columns of their own, or each use would repeat the last step's whole expression
    d = d.withColumn("t", _imul(F.col("a").bitwiseXOR(F.shiftrightunsigned("a", 15)), F.lit(1).cast("long").bitwiseOR(F.col("a"))))
    d = d.withColumn("s", _imul(F.col("t").bitwiseXOR(F.shiftrightunsigned("t", 7)), F.lit(61).cast("long").bitwiseOR(F.col("t"))))
    d = d.withColumn("t", ((F.col("t") + F.col("s")).bitwiseAND(mask)).bitwiseXOR(F.col("t")))
    return d.select("k", (F.col("t").bitwiseXOR(F.shiftrightunsigned("t", 14)) / F.lit(float(2**32))).alias("u"))
