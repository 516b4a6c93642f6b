"""Accuracy of predictions against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions import stats
from terraframe.functions.geometry import box_iou
from terraframe.operators.assignment import assign
from terraframe.operators.spatial_join import box_of, box_pairs


def iou_edges(pred: DataFrame, ref: DataFrame, cell: float, iou: Column | None = None) -> DataFrame:
    """``t, r, iou`` of every overlapping pair; both sides have ``id`` and a box. ``iou`` refers to ``l.*`` and ``r.*``."""
    areas = (F.col("l.area"), F.col("r.area")) if "area" in pred.columns and "area" in ref.columns else None
    value = box_iou(box_of("l"), box_of("r"), areas) if iou is None else iou
    return box_pairs(pred, ref, cell).select(F.col("l.id").alias("t"), F.col("r.id").alias("r"), value.alias("iou")).where("iou > 0")


def matches(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs of the optimal assignment with IoU at or above the threshold, which comes after."""
    if threshold <= 0:
        raise ValueError("the IoU threshold must be above 0")
    return assign(edges).where(F.col("iou") >= threshold)


def with_areas(pairs: DataFrame, pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Adds ``pred_area`` and ``ref_area`` by id."""
    p = pairs.join(pred.select(F.col("id").alias("t"), F.col("area").alias("pred_area")), "t")
    return p.join(ref.select(F.col("id").alias("r"), F.col("area").alias("ref_area")), "r")


def accuracy(pairs: DataFrame, pred: DataFrame, ref: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1, mean IoU, R2, RMSE and the areas' sums."""
    a = with_areas(pairs, pred, ref).agg(
        F.count("*").alias("m"), F.avg("iou").alias("mean_iou"), stats.r_squared(F.col("ref_area"), F.col("pred_area")).alias("r2"), stats.rmse(F.col("ref_area"), F.col("pred_area")).alias("rmse"), F.sum("ref_area").alias("ref_area"), F.sum("pred_area").alias("pred_area")
    )
    # three rows of one, from aggregates without keys
    n = a.join(F.broadcast(pred.agg(F.count("*").alias("np")))).join(F.broadcast(ref.agg(F.count("*").alias("nr"))))
    return n.select(*stats.precision_recall_f1(F.col("m"), F.col("np"), F.col("nr")), "mean_iou", "r2", "rmse", "ref_area", "pred_area")
