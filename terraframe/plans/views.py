"""Adapter views: detections, references, rasters and squares from the driver's relational tables, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions.geometry import box_ring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _boxes(spark: SparkSession, sf_dir: str, spacing: int, shift: str = "0.0D") -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").selectExpr("event_id AS id", "CAST(ROUND(value * 100) AS BIGINT) AS v", "event_id DIV 4 AS k")
    b = e.selectExpr(
        "id", "v", "k", f"(k % 100) * {spacing} + (v % 40) / 10 + {shift} AS xmin", f"(k DIV 100) * {spacing} + ((v * 7) % 40) / 10 AS ymin", "7 + v % 3 AS w", "7 + (v DIV 3) % 3 AS h", "0.25D + ((v * 31 + id * 17) % 7001) / 10000 AS conf"
    )
    return b.selectExpr("id", "v", "k", "xmin", "ymin", "xmin + w AS xmax", "ymin + h AS ymax", "CAST(w * h AS DOUBLE) AS area", "conf")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in clusters of four that overlap their neighbours."""
    return _boxes(spark, sf_dir, 9)


def match_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in clusters of four that touch no other cluster."""
    return _boxes(spark, sf_dir, 14)


def match_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other prediction's box, shifted a little: the references."""
    return _boxes(spark, sf_dir, 14, "(v % 5) / 10").where("id % 2 = 0")


def _cells(spark: SparkSession, sf_dir: str, n: int, mod: int) -> DataFrame:
    z = F.expr(f"(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) % {mod}) / 10")
    return table(spark, sf_dir, "lineitem").groupBy(F.expr(f"l_suppkey % {n}").alias("row"), F.expr(f"l_partkey % {n}").alias("col")).agg(z.alias("z"))


def dsm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, 64, 800)


def dtm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, 16, 200)


def squares(spark: SparkSession) -> DataFrame:
    """Three touching or separate sample squares in the detections' plane."""
    return spark.createDataFrame([(1, 100.0, 20.0, 400.0, 120.0), (2, 400.0, 20.0, 500.0, 120.0), (3, 650.0, 0.0, 880.0, 90.0)], "square_id int, xmin double, ymin double, xmax double, ymax double")


def polygons(df: DataFrame) -> DataFrame:
    """Adds ``geom``, the box as a polygon with one ring."""
    return df.withColumn("geom", F.array(box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))))


# The same views for DuckDB.
def _duck_boxes(name: str, spacing: int, shift: str = "0.0::DOUBLE", where: str = "") -> str:
    return f"""
{name} AS (
  SELECT id, v, k, xmin, ymin, xmin + w AS xmax, ymin + h AS ymax, CAST(w * h AS DOUBLE) AS area, conf FROM (
    SELECT id, v, k, (k % 100) * {spacing} + (v % 40) / 10.0::DOUBLE + {shift} AS xmin, (k // 100) * {spacing} + ((v * 7) % 40) / 10.0::DOUBLE AS ymin,
           7 + v % 3 AS w, 7 + (v // 3) % 3 AS h, 0.25::DOUBLE + ((v * 31 + id * 17) % 7001) / 10000.0::DOUBLE AS conf
    FROM (SELECT event_id AS id, CAST(round(value * 100) AS BIGINT) AS v, event_id // 4 AS k FROM events WHERE value IS NOT NULL) {where}))"""


def _duck_cells(name: str, n: int, mod: int) -> str:
    return f"""
{name} AS (
  SELECT l_suppkey % {n} AS row, l_partkey % {n} AS col, (CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) % {mod}) / 10.0::DOUBLE AS z
  FROM lineitem GROUP BY 1, 2)"""


DUCK = {
    "detections": _duck_boxes("detections", 9),
    "match_pred": _duck_boxes("match_pred", 14),
    "match_ref": _duck_boxes("match_ref", 14, "(v % 5) / 10.0::DOUBLE", "WHERE id % 2 = 0"),
    "dsm_cells": _duck_cells("dsm_cells", 64, 800),
    "dtm_cells": _duck_cells("dtm_cells", 16, 200),
    "squares": "\nsquares(square_id, xmin, ymin, xmax, ymax) AS (VALUES (1, 100.0::DOUBLE, 20.0::DOUBLE, 400.0::DOUBLE, 120.0::DOUBLE), (2, 400.0, 20.0, 500.0, 120.0), (3, 650.0, 0.0, 880.0, 90.0))",
}


def duck(sql: str, *names: str) -> str:
    """A query for DuckDB after the named views and any of its own, given as ``name AS (...)``."""
    return "WITH RECURSIVE " + ",".join(DUCK.get(n, n) for n in names) + "\n" + sql
