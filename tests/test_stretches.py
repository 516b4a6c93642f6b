"""Large lists of JSON documents, read in stretches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terraframe.sources import documents, stretches

SQUARE = {"type": "Polygon", "coordinates": [[[0.0, 0.0], [0.0, 2.0], [2.0, 2.0], [2.0, 0.0], [0.0, 0.0]]]}
TEXTS = ['"', "\\", '\\"', '{"a": [', "]}", "},{", "ğ,é", "\\\\", "", "\n\t", "😀[" * 40, "\\" * 70 + '"']


def nasty(n, seed):
    """A feature collection whose texts hold brackets, quotes, commas and backslashes, with other values around the list."""
    r = random.Random(seed)
    features = [None if k % 11 == 5 else {"type": "Feature", "properties": {"id": k, "s": "".join(r.choices(TEXTS, k=3)), "deep": [[k], {"x": [1, {}]}]}, "geometry": None if k % 13 == 7 else SQUARE} for k in range(n)]
    return {'od"d, [': TEXTS, "name": "[{", "features": features, "bbox": [0, 1], "last": {"features": [1, 2]}}


@pytest.mark.parametrize("how", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
@pytest.mark.parametrize("tasks", [7, 40])
def test_elements(spark, tmp_path, how, tasks):
    doc = nasty(60, tasks)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(doc, **how), encoding="utf-8")
    split = path.stat().st_size // tasks
    root = stretches.root(spark, str(path), split)
    found = root.elements(spark, "features")
    assert found.rdd.getNumPartitions() > 4
    got = found.orderBy("i").collect()
    assert [r.i for r in got] == list(range(len(doc["features"]))) and [json.loads(r.text) for r in got] == doc["features"]
    assert json.loads(root.text(["name", "bbox", "last", "none"])) == {"name": "[{", "bbox": [0, 1], "last": {"features": [1, 2]}, "none": None}
    assert root.elements(spark, "name") is None and root.elements(spark, "last") is None and root.elements(spark, "none") is None


def test_long_element(spark, tmp_path):
    """An element over many stretches, lists that are empty, and documents that are left to Spark's reader."""
    path = tmp_path / "a.json"
    doc = {"a": [], "b": [1, "x" * 3000 + '\\",[', 2], "c": [ ], "d": [["y" * 500]]}
    path.write_text(json.dumps(doc).replace('"c": []', '"c": [ \n ]'))
    root = stretches.root(spark, str(path), 300)
    assert {k: [json.loads(r.text) for r in root.elements(spark, k).orderBy("i").collect()] for k in doc} == doc
    for text in ("[{}, {}]" * 30, '{"a": [1, 2}' * 30, json.dumps({"a": "b" * 200})[:-2], json.dumps({"a": [1] * 99}) * 2):
        path.write_text(text)
        assert stretches.root(spark, str(path), 20) is None
    path.write_bytes(json.dumps(doc).encode("utf-16"))
    assert stretches.root(spark, str(path), 20) is None and stretches.root(spark, str(tmp_path), 20) is None and stretches.root(spark, str(tmp_path / "*.json"), 20) is None


def test_detections_in_stretches(spark, tmp_path):
    """Records and metadata of one document by many tasks; before, one task held the whole."""
    path = str(tmp_path / "d.json")
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (0, 1), (1, 1), (0, 0))])
    d = spark.range(0, 300, 1, 4).select(F.col("id"), (F.col("id") / 7).alias("confidence"), F.lit(1.5).alias("alan_m2"), F.lit(2.5).alias("cap_m"), F.lit(None).cast("double").alias("merkez_x"), F.lit(-1e-9).alias("merkez_y"), F.array(ring).alias("geom"))
    documents.write_detections(d, path, "EPSG:32635", dict(zip("abcdef", (0.5, 0, 1, 0, -0.5, 2), strict=True)), {"left": 0.0, "right": 1.0, "bottom": 0.0, "top": 1.0}, 0.5)
    rows, meta = documents.read_detections(spark, path, 2000)
    whole, same = documents.read_detections(spark, path)
    assert rows.rdd.getNumPartitions() > 10 and whole.rdd.getNumPartitions() == 1
    assert rows.dtypes == whole.dtypes and meta == same and meta["crs"] == "EPSG:32635" and meta["transform"]["e"] == -0.5
    assert rows.orderBy("id").collect() == whole.orderBy("id").collect() and rows.count() == 300


@pytest.mark.parametrize("how", [{}, {"indent": 1}])
def test_features_in_stretches(spark, tmp_path, how):
    """Features and their numbers of one document by many tasks; before, one task held the whole."""
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps(nasty(80, 1), **how))
    cols = "id long, s string"
    rows, whole = documents.read_geojson(spark, str(path), cols, 1500), documents.read_geojson(spark, str(path), cols)
    assert rows.rdd.getNumPartitions() > 10 and whole.rdd.getNumPartitions() == 1
    assert rows.dtypes == whole.dtypes and rows.orderBy("id").collect() == whole.orderBy("id").collect()
    assert [r.feature_no for r in rows.orderBy("id").collect()] == [k + 1 for k in range(80) if k % 11 != 5 and k % 13 != 7]
