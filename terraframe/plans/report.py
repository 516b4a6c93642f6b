"""Text reports over one-row aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terraframe.functions.stats import measure_stats

RULE, THIN = "=" * 60, "-" * 40


def _section(title: str, lines: list[str]) -> list[str]:
    return [title, THIN, *lines, ""]


def _measure(df: DataFrame, col: str, unit: str, digits: int = 2, total: bool = False) -> list[str]:
    s = measure_stats(df, col).first()
    if not s.n:
        return ["no values"]
    rows = [("Total", s.toplam)] if total else []
    rows += [("Mean", s.ortalama), ("Minimum", s.en_kucuk), ("Maximum", s.en_buyuk), ("Std. deviation", s.std)]
    return [f"{k}: {v:.{digits}f}{unit}" for k, v in rows]


def trees(df: DataFrame, crs: str) -> str:
    """The export report; statistics are those of the rounded values."""
    out = [RULE, "TREE DETECTION REPORT", RULE, ""]
    out += _section("GENERAL", [f"Detected trees: {df.count()}", f"Coordinate system: {crs}"])
    out += _section("CROWN AREA", _measure(df, "alan_m2", " m²", total=True))
    out += _section("CROWN DIAMETER", _measure(df, "cap_m", " m"))
    valid = df.where("boy_m is not null").count()
    if valid:
        out += _section("TREE HEIGHT", [f"Trees with a height: {valid}", *_measure(df, "boy_m", " m")])
    out += _section("CONFIDENCE", _measure(df, "conf", "", 3))
    return "\n".join([*out, RULE, ""])


def detections(f: dict) -> str:
    """The detection summary of jobs.summary()'s row."""
    out = [RULE, "DETECTIONS", RULE, "", f"Trees: {f['n']}"]
    if f["n"]:
        out += [f"Total crown area: {f['toplam_alan']:.2f} m²", f"Mean crown area: {f['ortalama_alan']:.2f} m²", f"Mean crown diameter: {f['ortalama_cap']:.2f} m"]
        out += [f"Confidence: {f['en_kucuk']:.3f} to {f['en_buyuk']:.3f}, mean {f['ortalama']:.3f}"]
    return "\n".join([*out, RULE, ""])


def accuracy(f: dict, iou: float, squares: bool) -> str:
    """The accuracy report of matching.accuracy()'s row."""
    out = [RULE, "ACCURACY BY TREE", RULE, ""]
    out += _section("DATA", [f"Predictions: {f['tp'] + f['fp']}", f"References: {f['tp'] + f['fn']}", *(["Predictions are those inside the sample squares."] if squares else [])])
    out += _section(f"MATCHES (IoU threshold {iou})", [f"True positives: {f['tp']}", f"False positives: {f['fp']}", f"False negatives: {f['fn']}"])
    out += _section("METRICS", [f"{k}: {f[c]:.4f} ({100 * f[c]:.1f} %)" for k, c in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"))])
    if f["mean_iou"] is not None:
        out += [f"Mean IoU of matched pairs: {f['mean_iou']:.4f}", ""]
    if f["r2"] is not None:
        out += _section("CROWN AREA OF MATCHED PAIRS", [f"Pairs: {f['tp']}", f"R²: {f['r2']:.4f}", f"RMSE: {f['rmse']:.3f} m²", f"Reference area: {f['ref_area']:.2f} m²", f"Predicted area: {f['pred_area']:.2f} m²"])
    return "\n".join([*out, RULE, ""])
