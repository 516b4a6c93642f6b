"""Files round trip, and the jobs end to end on a drawn raster with an injected model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe import schemas
from terraframe.config import DetectConfig, GridConfig, SweepConfig
from terraframe.functions import geometry as G
from terraframe.plans import jobs
from terraframe.sources import documents, geotiff, shapefile

AFFINE = (0.5, 0.0, 500000.0, 0.0, -0.5, 4500000.0)
CROWNS = [(10, 10, 14), (40, 12, 12), (70, 40, 16), (20, 60, 10)]


@pytest.mark.parametrize("how", [{}, {"tile": 16}, {"deflate": True}, {"tile": 32, "deflate": True, "predictor": 2}])
@pytest.mark.parametrize("kind", ["uint8", "float32", "int16"])
def test_geotiff(tmp_path, how, kind):
    a = (np.random.default_rng(1).random((50, 70, 3)) * 200).astype(kind)
    if how.get("predictor") == 2 and kind == "float32":
        pytest.skip("differences of whole numbers")
    geotiff.write(str(tmp_path / "a.tif"), a, AFFINE, 32635, nodata=-9999 if kind != "uint8" else None, **how)
    t = geotiff.GeoTiff(str(tmp_path / "a.tif"))
    assert (t.width, t.height, t.bands, t.crs, t.transform) == (70, 50, 3, "EPSG:32635", AFFINE)
    assert (t.read(13, 7, 40, 30, (3, 1)) == a[7:37, 13:53][:, :, [2, 0]]).all() and t.rgb(0, 0, 70, 50).dtype == np.uint8
    with pytest.raises(ValueError):
        t.read(60, 0, 20, 10)


def test_codecs():
    assert geotiff.packbits(bytes([2, 65, 66, 67, 254, 90, 128])) == b"ABCZZZ"
    # clear, 65, 66, 258 (AB), end, nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 257))
    assert geotiff.lzw(int(bits.ljust(48, "0"), 2).to_bytes(6, "big")) == b"ABAB"


def test_geotiff_source(spark, tmp_path):
    a = np.arange(30 * 20, dtype=np.float32).reshape(20, 30)
    a[3, 4] = -9999
    path = str(tmp_path / "a.tif")
    geotiff.write(path, a, AFFINE, nodata=-9999)
    rows = geotiff.cells(geotiff.chunks(spark, path, 8)).collect()
    assert len(rows) == 600 and all(r.z == (None if (r.row, r.col) == (3, 4) else a[r.row, r.col]) for r in rows)
    geotiff.register(spark)
    assert geotiff.cells(spark.read.format("geotiff").option("chunk", "16").load(path)).count() == 600
    assert geotiff.raster_info(spark, path).first().bounds.left == 500000.0


def test_shapefile_splits(spark, tmp_path):
    """Stretches by the index and the file read whole give the same ids and shapes, with null shapes between."""
    import struct

    ring = lambda k: [(k, 0.0), (k, 2.0), (k + 1.0, 2.0), (k + 1.0, 0.0), (k, 0.0)]
    path = tmp_path / "n.shp"
    shapefile.write(str(path), [{"geom": [ring(float(k))], "id": k} for k in range(40)], [("id", "int")])
    shp, shx = path.read_bytes(), (tmp_path / "n.shx").read_bytes()
    size = (len(shp) - 100) // 40
    body, index, at = b"", b"", 100
    for k in range(40):
        for rec in ([struct.pack(">2i", 0, 2) + struct.pack("<i", 0)] if k % 3 == 0 else []) + [shp[100 + k * size : 100 + (k + 1) * size]]:
            body, index, at = body + rec, index + struct.pack(">2i", at // 2, len(rec) // 2 - 4), at + len(rec)
    path.write_bytes(shp[:100] + body)
    (tmp_path / "n.shx").write_bytes(shx[:100] + index)
    for split in (100, 1000, 1 << 20):
        parts = shapefile.read(spark, str(path), split)
        got = parts.select("id", F.element_at(F.element_at("geom", 1), 1)["x"].alias("x")).orderBy("id").collect()
        assert [(r.id, r.x) for r in got] == [(k + 1, float(k)) for k in range(40)], split
    assert len(shapefile._splits(str(path), 1000)) > 4
    (tmp_path / "n.shx").unlink()
    assert [r.id for r in shapefile.read(spark, str(path)).orderBy("id").collect()] == list(range(1, 41))


def test_lists_in_parts(spark, tmp_path):
    """Files joined from several parts, from empty ones and from none."""
    import json

    d = spark.range(0, 500, 1, 8).select(F.col("id"), F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (0, 1), (1, 1), (0, 0))])).alias("geom"))
    for rows, want in ((d, list(range(500))), (d.where("id = 499"), [499]), (d.limit(0), [])):
        documents.write_geojson(rows, str(tmp_path / "a.geojson"), "a")
        assert [f["properties"]["id"] for f in json.loads((tmp_path / "a.geojson").read_text())["features"]] == want
        documents.write_csv(rows.select("id"), str(tmp_path / "a.csv"), "id", bom=False)
        assert (tmp_path / "a.csv").read_text() == "id\n" + "".join(f"{i}\n" for i in want)


def test_shapefile(spark, tmp_path):
    outer = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    n = shapefile.write(str(tmp_path / "a.shp"), [{"geom": [outer, hole], "id": 1, "v": None}, {"geom": [outer], "id": 2, "v": 2.5}], [("id", "int"), ("v", "real")], "EPSG:32635")
    got = shapefile.read(spark, str(tmp_path / "a.shp")).orderBy("id").select("id", G.polygon_area(F.col("geom")).alias("a")).collect()
    assert n == 2 and [tuple(r) for r in got] == [(1, 15.0), (2, 16.0)]
    assert shapefile.crs_of(str(tmp_path / "a.shp")) == "EPSG:32635" and shapefile.crs_of(str(tmp_path / "b.shp")) is None
    assert shapefile.write(str(tmp_path / "a.shp"), [], [("id", "int")]) == 0 and shapefile.read(spark, str(tmp_path / "a.shp")).count() == 0
    with pytest.raises(ValueError):
        shapefile.parse(b"\0" * 100)


def test_shapefile_in_parts(spark, tmp_path, monkeypatch):
    """A layer joined from the parts of tasks is byte for byte that of one writer; before, the driver held every record."""
    ring = lambda k, d, side: [(k + d, 0.0 + d), (k + d + side, 0.0 + d), (k + d + side, side + d), (k + d, side + d), (k + d, 0.0 + d)]
    wide = 10**10
    rows = [{"id": wide + k, "v": None if k % 4 == 0 else k / 7, "geom": [ring(k, 0.0, 4.0), *([ring(k, 1.0, 1.0), ring(k, 2.5, 1.0)] if k % 3 == 0 else [])]} for k in range(700)]
    fields = [("id", "long"), ("v", "real")]
    df = spark.createDataFrame([(r["id"], r["v"], [[{"x": x, "y": y} for x, y in g] for g in r["geom"]]) for r in rows[::-1]], f"id long, v double, geom {schemas.POLYGON}").repartition(5)
    monkeypatch.setattr(shapefile, "ROWS", 64)
    monkeypatch.setattr(shapefile, "BLOCK", 2000)
    for few, name in ((df, "many"), (df.where("id < 10000000001"), "one"), (df.limit(0), "none")):
        want = [r for r in rows if name == "many" or name == "one" and r["id"] == wide]
        assert shapefile.write_frame(few, str(tmp_path / f"{name}.shp"), fields, "EPSG:32635") == len(want)
        assert shapefile.write(str(tmp_path / "w.shp"), want, fields, "EPSG:32635") == len(want)
        for e in shapefile.EXTENSIONS:
            assert (tmp_path / f"{name}.{e}").read_bytes() == (tmp_path / f"w.{e}").read_bytes(), (name, e)
    table = (tmp_path / "many.dbf").read_bytes()
    assert table[97:].startswith(b" " + b"10000000000".rjust(20) + b" " * 24 + b" " + b"10000000001".rjust(20))
    back = shapefile.read(spark, str(tmp_path / "many.shp"), 3000).orderBy("id").select("id", G.polygon_area(F.col("geom")).alias("a"), F.size("geom").alias("n")).collect()
    assert [tuple(r) for r in back] == [(k + 1, 14.0 if k % 3 == 0 else 16.0, 3 if k % 3 == 0 else 1) for k in range(700)]
    with pytest.raises(ValueError):
        shapefile.write(str(tmp_path / "w.shp"), rows[:1], [("id", "int")])
    with pytest.raises(Exception, match="null"):
        shapefile.write_frame(df.withColumn("geom", F.when(F.col("id") != wide, F.col("geom"))), str(tmp_path / "w.shp"), fields)
    found = shapefile._splits(str(tmp_path / "many.shp"), 5000)
    assert found[0][0] == 100 and found[-1][1] == (tmp_path / "many.shp").stat().st_size and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([(2, None, 'a"b,c'), (1, 0.5, "x")], "id int, v double, s string")
    documents.write_csv(df, str(tmp_path / "a.csv"), "id")
    assert (tmp_path / "a.csv").read_bytes() == '﻿id,v,s\n1,0.5,x\n2,,"a""b,c"\n'.encode()
    with pytest.raises(FileNotFoundError):
        documents.require({"one": str(tmp_path / "no")})
    assert documents.require({}, {"two": str(tmp_path / "no")}) == {"two": False}


def raster(path):
    a = np.full((96, 96, 3), 90, np.uint8)
    for x, y, s in CROWNS:
        a[y : y + s, x : x + s] = (30, 200, 30)
    geotiff.write(path, a, AFFINE, 32635)


def runner():
    """A stand-in for the model: green squares of a tile, each found by its pixels."""

    def run(x):
        size = x.shape[2]
        green = (x[0, 1] > 0.6) & (x[0, 0] < 0.3)
        protos = np.full((1, 32, size, size), 0.0, np.float32)
        protos[0, 0] = np.where(green, 12, -12)
        cols = []
        seen = np.zeros_like(green)
        for r, c in zip(*np.nonzero(green), strict=True):
            if not seen[r, c]:
                r1, c1 = r, c
                while r1 + 1 < size and green[r1 + 1, c]:
                    r1 += 1
                while c1 + 1 < size and green[r, c1 + 1]:
                    c1 += 1
                seen[r : r1 + 1, c : c1 + 1] = True
                cols.append([(c + c1 + 1) / 2, (r + r1 + 1) / 2, c1 - c + 1, r1 - r + 1, 0.3 + (r1 - r + 1) / 40, 1.0] + [0.0] * 31)
        head = np.array(cols, np.float32).reshape(-1, 37).T[None]
        return head, protos

    return run


def test_jobs(spark, tmp_path):
    path, out = str(tmp_path / "o.tif"), f"file://{tmp_path}/out"
    raster(path)
    cfg = DetectConfig(tile=64, overlap=0.5, confidence=0.4)
    trees = jobs.detect(spark, path, "", out, cfg, runner).orderBy("id").collect()
    # parts of crowns at tile edges may stay as detections of their own; every whole crown is there once
    centres = [(500000 + 0.5 * (x + s / 2), 4500000 - 0.5 * (y + s / 2), (s / 2) ** 2) for x, y, s in CROWNS]
    for cx, cy, area in centres:
        near = [t for t in trees if abs(t.merkez_x - cx) < 0.8 and abs(t.merkez_y - cy) < 0.8]
        assert len(near) == 1 and abs(near[0].alan_m2 - area) < 0.12 * area + 1
    assert [t.id for t in trees] == list(range(1, len(trees) + 1)) and all(a.confidence >= b.confidence for a, b in zip(trees, trees[1:], strict=False))
    assert jobs.summary(spark.read.parquet(f"{out}/trees")).first().n == len(trees)

    dsm, dtm = str(tmp_path / "dsm.tif"), str(tmp_path / "dtm.tif")
    z = np.full((96, 96), 100, np.float32)
    for k, (x, y, s) in enumerate(CROWNS):
        z[y : y + s, x : x + s] = 105 + k
    geotiff.write(dsm, z, AFFINE, 32635, nodata=-9999)
    geotiff.write(dtm, np.full((24, 24), 100, np.float32), (2.0, 0.0, 500000.0, 0.0, -2.0, 4500000.0), 32635)
    done = jobs.export(spark, f"{out}/detections.json", f"file://{tmp_path}/export", dsm, dtm).collect()
    for k, (cx, cy, _) in enumerate(centres):
        near = [t for t in done if abs(t.merkez_x - cx) < 0.8 and abs(t.merkez_y - cy) < 0.8]
        assert near[0].boy_m == 5 + k
    for name in ("trees.shp", "trees.dbf", "trees.geojson", "trees.csv", "summary.txt", "charts.html"):
        assert (tmp_path / "export" / name).stat().st_size > 0
    flat = jobs.export(spark, f"{out}/detections.json", f"file://{tmp_path}/flat", str(tmp_path / "none.tif"), None)
    assert flat.where("boy_m is not null").count() == 0 and "no height data" in (tmp_path / "flat/charts.html").read_text()

    crowns = [{"geom": [[(500000 + 0.5 * a, 4500000 - 0.5 * b) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]]} for x, y, s in CROWNS]
    shapefile.write(str(tmp_path / "ref.shp"), crowns, [], "EPSG:32635")
    f = jobs.assess(spark, str(tmp_path / "export/trees.shp"), str(tmp_path / "ref.shp"), f"file://{tmp_path}/assess").first()
    assert f.tp == 4 and f.fn == 0 and f.recall == 1 and f.r2 > 0.95
    assert "Recall: 1.0000" in (tmp_path / "assess/accuracy.txt").read_text()

    table = jobs.sweep(spark, path, "", f"file://{tmp_path}/sweep", cfg, SweepConfig(thresholds=(0.4, 0.6, 0.99)), runner).orderBy("esik").collect()
    assert table[0].tespit_sayisi == len(trees) and table[2].tespit_sayisi == 0 and table[1].tespit_sayisi < table[0].tespit_sayisi

    (tmp_path / "grid").mkdir()
    s = jobs.grid(spark, path, f"file://{tmp_path}/grid", GridConfig(side=10.0, squares=2)).collect()
    assert len(s) == 2 and all(abs(r.alan_m2 - 100) < 1e-6 for r in s)
    with pytest.raises(ValueError):
        jobs.grid(spark, path, f"file://{tmp_path}/grid", GridConfig(side=100.0))


def test_failed_tiles_are_reported(spark, tmp_path):
    path = str(tmp_path / "o.tif")
    raster(path)

    def broken():
        def run(x):
            raise RuntimeError("no model")

        return run

    raw = jobs.detect_raw(spark, path, "", DetectConfig(tile=64), 0.4, broken).collect()
    assert raw and all(r.error == "no model" and r.geom is None for r in raw)


def test_streaming(spark, tmp_path):
    from terraframe.streaming import tiles

    rows = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0, 4.0, 0.9), (2, 0.1, 0.0, 2.1, 2.0, 4.0, 0.8), (3, 9.0, 9.0, 11.0, 11.0, 4.0, 0.3)], "id long, xmin double, ymin double, xmax double, ymax double, area double, conf double").withColumn("arrived", F.lit("2024-01-01 00:01:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    q = tiles.suppress_each_batch(tiles.arrivals(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3}
    q = tiles.counts(tiles.arrivals(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.alan_m2) for r in spark.sql("select * from counted").collect()] == [(2, 8.0)]
