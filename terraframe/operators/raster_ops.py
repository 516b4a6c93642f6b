"""Map algebra, regridding and zonal aggregation over raster cells as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canopy(dsm: Column, dtm: Column, nodata: Column | None = None, most: float = 50.0) -> Column:
    """Height dsm - dtm as float: null at no-data, 0 below ground, null above ``most``."""
    d = dsm.cast("double") - dtm.cast("double")
    v = F.when(d < 0, F.lit(0.0)).when(d > most, F.lit(None)).otherwise(d)
    ok = dsm.isNotNull() & dtm.isNotNull() & ~F.isnan(dsm.cast("double")) & ~F.isnan(dtm.cast("double"))
    ok = ok if nodata is None else ok & ~F.coalesce(dsm == nodata, F.lit(False))
    return F.when(ok, v).cast("float")


def chm(dsm: DataFrame, dtm: DataFrame, nodata: float | None = None) -> DataFrame:
    """``row, col, v`` of cells that both sides (``row, col, z``) have on one grid; others of the dsm are null."""
    t = dtm.select("row", "col", F.col("z").alias("ground"))
    return dsm.join(t, ["row", "col"], "left").select("row", "col", canopy(F.col("z"), F.col("ground"), None if nodata is None else F.lit(nodata)).alias("v"))


def bilinear(fine: DataFrame, coarse: DataFrame, ratio: float) -> DataFrame:
    """``fine`` (row, col) with ``ground``, the bilinear value of ``coarse`` (row, col, z) at the cell's centre.

    The four corners of each square of coarse centres are gathered once, on the coarse side; a fine cell joins its
    square by one row. A neighbour that is missing leaves its weight to the others; none at all gives null.
    """
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    c = coarse.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), F.col("z").cast("double").alias("z")).where("z is not null and not isnan(z)")
    each = c.select(F.explode(F.array(*[F.struct((F.col("r") - i).alias("r0"), (F.col("c") - j).alias("c0"), F.lit(2 * i + j).alias("k"), "z") for i, j in corners])).alias("q")).select("q.*")
    square = each.groupBy("r0", "c0").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z{k}") for k in range(4)])
    at = lambda c: (F.col(c) + F.lit(0.5)) / F.lit(float(ratio)) - F.lit(0.5)
    f = fine.select("row", "col").withColumn("fr", at("row")).withColumn("fc", at("col"))
    j = f.withColumn("r0", F.floor("fr")).withColumn("c0", F.floor("fc")).join(square, ["r0", "c0"], "left")
    wr, wc = F.col("fr") - F.col("r0"), F.col("fc") - F.col("c0")
    weights = [((wr if i else 1 - wr) * (wc if j else 1 - wc), F.col(f"z{2 * i + j}")) for i, j in corners]
    value = sum((F.coalesce(w * z, F.lit(0.0)) for w, z in weights), F.lit(0.0))
    # the weights of neighbours that exist, brought to one
    weight = sum((F.when(z.isNotNull(), w).otherwise(F.lit(0.0)) for w, z in weights), F.lit(0.0))
    return j.select("row", "col", F.when(weight > 0, value / weight).alias("ground"))


HEIGHTS = ("max", "mean", "p95")


def height(method: str, v: Column) -> Column:
    """The zonal aggregate by name; an unknown name is max."""
    if method == "mean":
        return F.avg(v)
    if method == "p95":
        return F.percentile(v, F.lit(0.95))
    return F.max(v)


def zonal(zones: DataFrame, cells: DataFrame, size: float, inside: Column, chunk: int = 64) -> DataFrame:
    """Pairs of zones and the valid cells inside, ready to be grouped by zone.

    ``zones`` has ``id`` and a box in cell units times ``size``; ``cells`` has ``row, col, v``. Zones are dealt
    to the chunks that their box touches and joined by chunk; ``inside`` refers to ``z.*`` and to the centre ``x``, ``y``.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / (size * chunk)), F.floor(F.col(hi) / (size * chunk))))
    z = zones.withColumn("gx", span("xmin", "xmax")).withColumn("gy", span("ymin", "ymax")).alias("z")
    c = cells.where("v is not null").withColumn("gx", F.floor(F.col("col") / chunk)).withColumn("gy", F.floor(F.col("row") / chunk))
    c = c.withColumn("x", (F.col("col") + 0.5) * size).withColumn("y", (F.col("row") + 0.5) * size).alias("c")
    near = (F.col("x") >= F.col("z.xmin")) & (F.col("x") <= F.col("z.xmax")) & (F.col("y") >= F.col("z.ymin")) & (F.col("y") <= F.col("z.ymax"))
    return z.join(c, (F.col("z.gx") == F.col("c.gx")) & (F.col("z.gy") == F.col("c.gy")) & near & inside).select(F.col("z.id").alias("id"), F.col("c.v").cast("double").alias("v"))


def empty_ratio(v: Column, nodata: float | None) -> Column:
    """Share of cells that are no-data or exactly zero; 1 where there is none."""
    empty = v == 0
    if nodata is not None:
        empty = empty | (v == F.lit(nodata))
    return F.coalesce(F.avg(F.coalesce(empty, F.lit(True)).cast("double")), F.lit(1.0))
