"""Connected components of an edge table, by alternating star contraction.

Each round points the larger neighbours of every node at its smallest one (large
star), then every node and its smaller neighbours at the smallest (small star),
until the edges no longer change; what is left is one star for each component,
centred on its smallest node. A round costs aggregations by key with partial
sums and joins against one row for each node, which adaptive execution can
split when a centre is hot; no node's neighbours are ever gathered.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='components')}"
    return f"{base.rstrip('/')}/components/{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # every larger neighbour goes to the smallest: (v, m) for v > u
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # edges run from the larger node u to the smaller v
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """One row ``(node, component)`` for each node of an edge; a component is named by its smallest node.

    Nodes are integers. Rows with a null end are left out, loops give a component of their own unless
    the node has other edges, and repeated or reversed edges count once. Each round's edges are written
    to the folder in spark.checkpoint.dir, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    base, n = _folder(spark), 0
    clean = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    start = _write(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{base}/start")
    shape = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = start.where("u != v")
    state = shape(e)
    while state[0]:
        nxt = _write(_small_star(_large_star(e)), f"{base}/{n}")
        got = shape(nxt)
        if n:
            _delete(spark, f"{base}/{n - 1}")
        e, n = nxt, n + 1
        if got == state:
            break
        if n >= max_rounds:
            raise RuntimeError("the components did not settle")
        state = got
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    loops = start.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return stars.union(e.select("v", "v")).union(loops).groupBy("node").agg(F.min("component").alias("component"))
