"""Dense numbering in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def dense_number(df: DataFrame, order: list[Column], name: str = "id", partitions: int | None = None) -> DataFrame:
    """Adds 1..n by ``order``, which must be total.

    Rows are range-partitioned by the first sort column, numbered within their partition, and moved up by the count of
    the partitions before: one number a partition passes through the driver's plan, not the rows.
    """
    from terraframe.operators.components import _folder, _write

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that counting and numbering see the same partitions
    dealt = _write(df.repartitionByRange(n, order[0]).withColumn("_p", F.spark_partition_id()), f"{_folder(df.sparkSession)}/ranged")
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    base = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.join(F.broadcast(base), "_p").withColumn(name, (rank + F.col("_base")).cast("int")).drop("_p", "_base")
