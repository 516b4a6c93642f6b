"""Greedy non-maximum suppression, partition-safe.

Suppression acts along edges IoU > t only, so components of that graph are
settled apart: a fold over each component's rows in rank order keeps a row unless
a kept neighbour ranks above it. Components beyond FOLD rows go by rounds
instead: a row that outranks all undecided neighbours is kept, its neighbours go.
Both give the same set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions.geometry import box_area, box_iou
from terraframe.operators.components import _delete, _folder, _write, connected_components
from terraframe.operators.spatial_join import box_of, box_pairs

#: Rows of a component that one fold takes.
FOLD = 1024


def conflicts(dets: DataFrame, threshold: float, cell: float, id: str = "id", iou: Column | None = None) -> DataFrame:
    """Edges ``a, b, iou`` (a < b) with IoU > threshold. ``iou`` refers to ``l.*`` and ``r.*``; by default that of the boxes, with the column ``area`` if there is one."""
    areas = (F.col("l.area"), F.col("r.area")) if "area" in dets.columns else None
    la, rb = box_of("l"), box_of("r")
    # IoU is at most the smaller area over the larger
    sa, sb = areas or (box_area(la), box_area(rb))
    sizes = F.least(sa, sb) > threshold * F.greatest(sa, sb)
    order = F.col(f"l.{id}") < F.col(f"r.{id}")
    pairs = box_pairs(dets, dets, cell, order & sizes if iou is None else order)
    value = box_iou(box_of("l"), box_of("r"), areas) if iou is None else iou
    return pairs.select(F.col(f"l.{id}").alias("a"), F.col(f"r.{id}").alias("b"), value.alias("iou")).where(F.col("iou") > threshold)


def greedy_nms(dets: DataFrame, threshold: float = 0.5, cell: float = 16.0, id: str = "id", score: str = "conf", iou: Column | None = None, fold: int = FOLD) -> DataFrame:
    """The kept rows of ``dets``: by (score desc, id), a row goes if its IoU with a kept earlier one is above the threshold."""
    spark = dets.sparkSession
    base = _folder(spark)
    edges = _write(conflicts(dets, threshold, cell, id, iou).select("a", "b"), f"{base}/edges")
    comp = _write(connected_components(edges, "a", "b"), f"{base}/components")
    both = edges.union(edges.select("b", "a"))
    ranked = comp.join(dets.select(F.col(id).alias("node"), F.col(score).alias("s")), "node")
    big = comp.groupBy("component").count().where(F.col("count") > fold).select("component")
    some_big = not big.isEmpty()
    small = ranked.join(big, "component", "left_anti") if some_big else ranked
    # neighbours are gathered for the components that are folded only, which bounds them
    few = both.join(small.select(F.col("node").alias("a")), "a", "left_semi") if some_big else both
    near = few.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("nb"))
    rows = small.join(near, "node").groupBy("component").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), F.col("node"), "nb"))).alias("rows"))
    kept = rows.select(F.explode(F.aggregate("rows", F.array().cast("array<bigint>"), lambda k, x: F.when(F.arrays_overlap(k, x["nb"]), k).otherwise(F.concat(k, F.array(x["node"]))))).alias("node"))
    if some_big:
        kept = kept.union(_rounds(ranked.join(big, "component", "left_semi").select("node", "s"), both, base))
    # rows without a conflict never entered the graph
    lost = comp.select("node").join(kept, "node", "left_anti")
    return dets.join(lost.select(F.col("node").alias("_lost")), F.col(id) == F.col("_lost"), "left_anti")


def _rounds(nodes: DataFrame, both: DataFrame, base: str) -> DataFrame:
    """The kept nodes, by synchronous rounds."""
    spark = nodes.sparkSession
    open_, kept, n = _write(nodes, f"{base}/open0"), None, 0
    while not open_.isEmpty():
        e = both.join(open_.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(open_.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        beaten = e.where((F.col("sb") > F.col("sa")) | ((F.col("sb") == F.col("sa")) & (F.col("b") < F.col("a")))).select(F.col("a").alias("node")).distinct()
        top = _write(open_.join(beaten, "node", "left_anti").select("node"), f"{base}/kept{n}")
        gone = both.join(top.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).union(top)
        nxt = _write(open_.join(gone, "node", "left_anti"), f"{base}/open{n + 1}")
        _delete(spark, f"{base}/open{n}")
        kept, open_, n = top if kept is None else kept.union(top), nxt, n + 1
    return kept if kept is not None else nodes.select("node").limit(0)
