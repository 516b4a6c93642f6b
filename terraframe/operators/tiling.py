"""Overlapping tile windows as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stride(tile: int, overlap: float) -> int:
    s = int(tile * (1 - overlap))
    if s <= 0 or overlap < 0:
        raise ValueError("the overlap must be at least 0 and leave a stride of one pixel")
    return s


def tile_windows(rasters: DataFrame, tile: int = 1280, overlap: float = 0.2, cover_edges: bool = False) -> DataFrame:
    """``rasters`` has ``width`` and ``height``; its rows times ``x_off, y_off, w, h``.

    Windows start at every stride in either direction and are clipped at the edges; a window under a quarter
    of the tile in either direction is left out, unless ``cover_edges``.
    """
    s = stride(tile, overlap)
    starts = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)).cast("int"), F.lit(s)))
    t = rasters.where("width > 0 and height > 0").withColumn("y_off", starts("height")).withColumn("x_off", starts("width"))
    t = t.withColumn("w", F.least(F.lit(tile), F.col("width") - F.col("x_off")).cast("int")).withColumn("h", F.least(F.lit(tile), F.col("height") - F.col("y_off")).cast("int"))
    return t if cover_edges else t.where((F.col("w") >= tile // 4) & (F.col("h") >= tile // 4))
