"""Queries through files, coordinate systems and tile inference, with their SQL: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions import geometry as G
from terraframe.operators.components import _folder
from terraframe.operators.spatial_join import box_pairs
from terraframe.operators.tiling import tile_windows
from terraframe.plans import report
from terraframe.plans import views as V
from terraframe.plans.queries import _EDGES, AFFINE, CELL, ORACLE, QUERIES, query, r6
from terraframe.plans.views import duck
from terraframe.sources import documents, geotiff, shapefile

__all__ = ["ORACLE", "QUERIES"]
CRS = "EPSG:32635"


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared one, made."""
    from pyarrow import fs

    path = _folder(spark)
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name, recursive=True)
    return path


def dsm_file(spark: SparkSession, sf_dir: str) -> str:
    """The surface model of 64 x 64 cells as a tiled GeoTIFF."""
    import numpy as np

    a = np.zeros((64, 64), np.float32)
    for r in V.dsm_cells(spark, sf_dir).collect():  # 64 x 64 cells
        a[r["row"], r["col"]] = r["z"]
    path = f"{scratch(spark)}/dsm.tif"
    geotiff.write(path, a, AFFINE, 32635, tile=16, deflate=True)
    return path


# rasters

_FULL = """
full_dsm AS (SELECT CAST(r.r AS INTEGER) AS row, CAST(c.c AS INTEGER) AS col, CAST(coalesce(z, 0) AS FLOAT) AS z
             FROM range(0, 64) r(r) CROSS JOIN range(0, 64) c(c) LEFT JOIN dsm_cells d ON d.row = r.r AND d.col = c.c)"""


@query(
    "geotiff_chunks",
    duck("SELECT row, col, round(CAST(z AS DOUBLE), 4) AS z FROM full_dsm", "dsm_cells", _FULL),
)
def geotiff_chunks(spark, sf_dir):
    """The surface model written as a GeoTIFF and read back in chunks, cell by cell."""
    return geotiff.cells(geotiff.chunks(spark, dsm_file(spark, sf_dir), 32)).select("row", "col", F.round("z", 4).alias("z"))


@query(
    "raster_info",
    "SELECT 64 AS width, 64 AS height, 1 AS bands, 'EPSG:32635' AS crs, 0.5::DOUBLE AS a, 100.0::DOUBLE AS c, -0.5::DOUBLE AS e, 200.0::DOUBLE AS f, 100.0::DOUBLE AS xmin, 132.0::DOUBLE AS xmax, 168.0::DOUBLE AS ymin, 200.0::DOUBLE AS ymax, 0.5::DOUBLE AS piksel",
)
def raster_info(spark, sf_dir):
    i = geotiff.raster_info(spark, dsm_file(spark, sf_dir))
    return i.select("width", "height", "bands", "crs", *[f"transform.{k}" for k in "acef"], F.col("bounds.left").alias("xmin"), F.col("bounds.right").alias("xmax"), F.col("bounds.bottom").alias("ymin"), F.col("bounds.top").alias("ymax"), F.col("pixel_size_x").alias("piksel"))


_WINDOWS = [(0, 0, 64, 64), (8, 16, 40, 30), (10, 20, 32, 32), (63, 0, 1, 7)]
_DUCK_WINDOWS = "\nw(x, y, w, h) AS (VALUES (0, 0, 64, 64), (8, 16, 40, 30), (10, 20, 32, 32), (63, 0, 1, 7))"


def _windowed(spark: SparkSession, sf_dir: str, read, fields: str) -> DataFrame:
    """Windows of the surface model's file, read by the tasks: a row for each sample."""
    import numpy as np
    import pandas as pd

    path = dsm_file(spark, sf_dir)

    def run(batches):
        own = geotiff.GeoTiff(path)
        for pdf in batches:
            for x, y, w, h in pdf[["x", "y", "w", "h"]].itertuples(index=False):
                a = read(own, int(x), int(y), int(w), int(h))
                i, j = np.indices(a.shape[:2]).reshape(2, -1)
                values = a.reshape(len(i), -1)
                yield pd.DataFrame({"x": x, "y": y, "i": i, "j": j, **{n.split()[0]: values[:, k] for k, n in enumerate(fields.split(", "))}})

    return spark.createDataFrame(_WINDOWS, "x int, y int, w int, h int").mapInPandas(run, f"x int, y int, i int, j int, {fields}")


@query(
    "raster_window_rgb",
    duck("SELECT x, y, row - y AS i, col - x AS j, CAST(floor(z) AS INTEGER) AS r, CAST(floor(z) AS INTEGER) AS g, CAST(floor(z) AS INTEGER) AS b FROM w JOIN full_dsm ON row >= y AND row < y + h AND col >= x AND col < x + w", "dsm_cells", _FULL, _DUCK_WINDOWS),
)
def raster_window_rgb(spark, sf_dir):
    """A raster of one band as three, cut to whole samples."""
    return _windowed(spark, sf_dir, lambda t, x, y, w, h: t.rgb(x, y, w, h), "r int, g int, b int")


@query(
    "raster_decimated",
    duck(
        "SELECT x, y, CAST(i.i AS INTEGER) AS i, CAST(j.j AS INTEGER) AS j, round(CAST(z AS DOUBLE), 4) AS z FROM w, range(0, 64) i(i), range(0, 64) j(j), full_dsm WHERE row = y + CAST(floor((i.i + 0.5) * h / 64) AS INTEGER) AND col = x + CAST(floor((j.j + 0.5) * w.w / 64) AS INTEGER)",
        "dsm_cells",
        _FULL,
        _DUCK_WINDOWS,
    ),
)
def raster_decimated(spark, sf_dir):
    """Windows of any size at 64 x 64 samples."""
    return _windowed(spark, sf_dir, lambda t, x, y, w, h: t.decimated(x, y, w, h), "z double").withColumn("z", F.round("z", 4))


# vector layers and tables


@query("shapefile_roundtrip", duck("SELECT row_number() OVER (ORDER BY id) AS id, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax, round(area, 6) AS area FROM detections", "detections"))
def shapefile_roundtrip(spark, sf_dir):
    """A polygon layer written and read back; shapes are numbered in file order."""
    path = f"{scratch(spark)}/layer.shp"
    d = V.polygons(V.detections(spark, sf_dir)).select("id", "conf", "geom")
    shapefile.write_frame(d, path, [("id", "long"), ("conf", "real")], CRS)
    assert shapefile.crs_of(path) == CRS
    b = G.bbox(F.col("geom"))
    return shapefile.read(spark, path).select("id", *[r6(b[c]).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], r6(G.polygon_area(F.col("geom"))).alias("area"))


@query("geojson_file", duck("SELECT id, round(conf, 6) AS conf, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax, round(area, 6) AS area FROM detections", "detections"))
def geojson_file(spark, sf_dir):
    """A feature collection written to one file and read back with its properties."""
    path = f"{scratch(spark)}/layer.geojson"
    documents.write_geojson(V.polygons(V.detections(spark, sf_dir)).select("id", "conf", "geom"), path, "layer", CRS)
    b = G.bbox(F.col("geom"))
    back = documents.read_geojson(spark, path, "id long, conf double")
    return back.select("id", r6("conf").alias("conf"), r6(b["xmin"]).alias("xmin"), r6(b["ymax"]).alias("ymax"), r6(G.polygon_area(F.col("geom"))).alias("area"))


@query(
    "detections_document",
    duck("SELECT id, round(conf, 6) AS confidence, round(area, 6) AS alan_m2, round(2 * sqrt(area / pi()), 6) AS cap_m, round((xmin + xmax) / 2, 6) AS merkez_x, round((ymin + ymax) / 2, 6) AS merkez_y, round(area, 6) AS alan, 'EPSG:32635' AS crs, 0.5::DOUBLE AS piksel FROM detections", "detections"),
)
def detections_document(spark, sf_dir):
    """The document that the jobs hand on, written and read back with its metadata."""
    path = f"{scratch(spark)}/detections.json"
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    d = V.polygons(V.detections(spark, sf_dir)).select("id", F.col("conf").alias("confidence"), F.col("area").alias("alan_m2"), G.equivalent_diameter(F.col("area")).alias("cap_m"), x.alias("merkez_x"), y.alias("merkez_y"), "geom")
    documents.write_detections(d, path, CRS, dict(zip("abcdef", AFFINE, strict=True)), {"left": 0.0, "right": 1.0, "bottom": 0.0, "top": 1.0}, 0.5)
    rows, meta = documents.read_detections(spark, path)
    return rows.select("id", *[r6(c).alias(c) for c in ("confidence", "alan_m2", "cap_m", "merkez_x", "merkez_y")], r6(G.polygon_area(F.col("geom"))).alias("alan"), F.lit(meta["crs"]).alias("crs"), F.lit(meta["pixel_size"]).alias("piksel"))


@query(
    "csv_export",
    duck(
        """
SELECT 'id,conf,alan_m2,boy_m,not' AS satir UNION ALL
SELECT CAST(id AS VARCHAR) || ',' || regexp_replace(CAST(round(conf, 4) AS VARCHAR), '\\.0$', '') || ',' || regexp_replace(CAST(area AS VARCHAR), '\\.0$', '') || ',' ||
       CASE WHEN id % 3 = 0 THEN '' ELSE regexp_replace(CAST(round(area / 8, 2) AS VARCHAR), '\\.0$', '') END || ',' || CASE WHEN id % 2 = 0 THEN '"a,""b""' || '"' ELSE 'c d' END FROM detections""",
        "detections",
    ),
)
def csv_export(spark, sf_dir):
    """One CSV file, line by line: a mark and a header first, shortest numbers, empty nulls, quoted texts."""
    path = f"{scratch(spark)}/table.csv"
    note = F.when(F.col("id") % 2 == 0, F.lit('a,"b"')).otherwise(F.lit("c d"))
    tall = F.when(F.col("id") % 3 != 0, F.round(F.col("area") / 8, 2))
    documents.write_csv(V.detections(spark, sf_dir).select("id", F.round("conf", 4).alias("conf"), F.col("area").alias("alan_m2"), tall.alias("boy_m"), note.alias("not")), path, "id")
    return spark.read.text(path).select(F.ltrim(F.col("value"), F.lit(documents.BOM)).alias("satir"))


@query(
    "export_report",
    duck(
        """
SELECT unnest(['Detected trees: ' || count(*), 'Coordinate system: EPSG:32635', 'Total: ' || format('{:.2f} m²', sum(area)),
  'Mean: ' || format('{:.2f} m²', avg(area)), 'Minimum: ' || format('{:.2f} m²', min(area)), 'Maximum: ' || format('{:.2f} m²', max(area)), 'Std. deviation: ' || format('{:.2f} m²', stddev_samp(area)),
  'Mean: ' || format('{:.2f} m', avg(cap)), 'Minimum: ' || format('{:.2f} m', min(cap)), 'Maximum: ' || format('{:.2f} m', max(cap)), 'Std. deviation: ' || format('{:.2f} m', stddev_samp(cap)),
  'Trees with a height: ' || count(boy),
  'Mean: ' || format('{:.2f} m', avg(boy)), 'Minimum: ' || format('{:.2f} m', min(boy)), 'Maximum: ' || format('{:.2f} m', max(boy)), 'Std. deviation: ' || format('{:.2f} m', stddev_samp(boy)),
  'Mean: ' || format('{:.3f}', avg(conf)), 'Minimum: ' || format('{:.3f}', min(conf)), 'Maximum: ' || format('{:.3f}', max(conf)), 'Std. deviation: ' || format('{:.3f}', stddev_samp(conf))]) AS satir
FROM (SELECT area, conf, 2 * sqrt(area / pi()) AS cap, CASE WHEN id % 3 <> 0 THEN area / 7 END AS boy FROM detections)""",
        "detections",
    ),
)
def export_report(spark, sf_dir):
    """The export report's figures, a line each; heights that are missing don't count."""
    d = V.detections(spark, sf_dir).select("conf", F.col("area").alias("alan_m2"), G.equivalent_diameter(F.col("area")).alias("cap_m"), F.when(F.col("id") % 3 != 0, F.col("area") / 7).alias("boy_m"))
    return spark.createDataFrame([(x,) for x in report.trees(d, CRS).splitlines() if ": " in x], "satir string")


# polygons and coordinate systems


@query("polygon_iou_pairs", duck("SELECT t, r, round(iou, 6) AS iou FROM e WHERE iou > 0.3::DOUBLE", "match_pred", "match_ref", _EDGES))
def polygon_iou_pairs(spark, sf_dir):
    """IoU of polygons that overlap; the rings start at different corners on either side."""
    from terraframe.plans.jobs import polygon_iou

    p, r = V.polygons(V.match_pred(spark, sf_dir)), V.polygons(V.match_ref(spark, sf_dir))
    turned = F.transform("geom", lambda g: F.concat(F.slice(g, 3, 2), F.slice(g, 1, 3)))
    r = r.withColumn("geom", turned)
    return box_pairs(p, r, CELL).select(F.col("l.id").alias("t"), F.col("r.id").alias("r"), polygon_iou().alias("iou")).where("iou > 0.3").withColumn("iou", r6("iou"))


# the inverse series to the fourth order, and the latitude by its fixed point
_LATITUDE = "2 * atan(exp(psi + {e} * atanh({e} * sin(lat)))) - pi() / 2"
_ECC = "0.0818191908426215::DOUBLE"
_DUCK_UTM = """
m AS (SELECT id, xmin * 300 + 200000 AS x, ymin * 300 + 100000 AS y FROM detections),
c AS (SELECT 1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE) AS n),
q AS (SELECT id, x, y, n, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS k FROM m, c),
z AS (SELECT *, y / k AS xi, (x - 500000) / k AS eta, n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360 AS b1, n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440 AS b2, 17 * n ** 3 / 480 - 37 * n ** 4 / 840 AS b3, 4397 * n ** 4 / 161280 AS b4 FROM q),
s AS (SELECT id, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) - b4 * sin(8 * xi) * cosh(8 * eta) AS xi,
             eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) - b4 * cos(8 * xi) * sinh(8 * eta) AS eta FROM z),
l0 AS (SELECT id, atan2(sinh(eta), cos(xi)) AS lon, asinh(sin(xi) / sqrt(sinh(eta) ** 2 + cos(xi) ** 2)) AS psi, xi AS lat FROM s),
""" + ",\n".join(f"l{i + 1} AS (SELECT id, lon, psi, {_LATITUDE.format(e=_ECC)} AS lat FROM l{i})" for i in range(8))


@query("utm_to_geographic", duck("SELECT id, round(degrees(lon) + 27, 6) AS boylam, round(degrees(lat), 6) AS enlem FROM l8", "detections", _DUCK_UTM))
def utm_to_geographic(spark, sf_dir):
    """Points far from and near to the central meridian of a zone, as longitude and latitude."""
    from terraframe.functions.crs import transform_polygon

    far = lambda p: G.point(p["x"] * 300 + 200000, p["y"] * 300 + 100000)
    d = V.polygons(V.detections(spark, sf_dir)).select("id", F.transform("geom", lambda r: F.transform(r, far)).alias("geom"))
    first = F.element_at(F.element_at(transform_polygon(F.col("geom"), CRS, "EPSG:4326"), 1), 1)
    return d.select("id", r6(first["x"]).alias("boylam"), r6(first["y"]).alias("enlem"))


# model input and the tile loop

_SAMPLE = "({p} * 7 + {r} * {r} + 5 * {c} + 70 * ch) % 251"


@query(
    "letterbox_samples",
    duck(
        f"""
SELECT p_partkey, ch, y, x, round(((1 - fy) * ((1 - fx) * ({_SAMPLE.format(p="p_partkey", r="r0", c="c0")}) + fx * ({_SAMPLE.format(p="p_partkey", r="r0", c="c1")})) + fy * ((1 - fx) * ({_SAMPLE.format(p="p_partkey", r="r1", c="c0")}) + fx * ({_SAMPLE.format(p="p_partkey", r="r1", c="c1")}))) / 255, 4) AS v
FROM (SELECT *, least(r0 + 1, 19) AS r1, least(c0 + 1, 31) AS c1, ay - r0 AS fy, ax - c0 AS fx FROM (SELECT *, greatest(CAST(floor(ay) AS INTEGER), 0) AS r0, greatest(CAST(floor(ax) AS INTEGER), 0) AS c0
FROM (SELECT *, least((y - 12 + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 19) AS ay, least((x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 31) AS ax FROM part, s)))""",
        "\ns(ch, y, x) AS (VALUES (0, 12, 0), (1, 12, 0), (2, 12, 0), (0, 20, 33), (1, 51, 63), (2, 30, 10), (0, 50, 1))",
    ),
)
def letterbox_samples(spark, sf_dir):
    """Samples of 20 x 32 images with a pattern of their own in each channel, scaled up twice: layout, interpolation and edges."""
    import numpy as np
    import pandas as pd

    from terraframe.operators.vision import letterbox

    at = [(0, 12, 0), (1, 12, 0), (2, 12, 0), (0, 20, 33), (1, 51, 63), (2, 30, 10), (0, 50, 1)]

    def run(batches):
        r, c, ch = np.ogrid[:20, :32, :3]
        for pdf in batches:
            rows = []
            for p in pdf["p_partkey"]:
                chw = letterbox(((p * 7 + r * r + 5 * c + 70 * ch) % 251).astype(np.uint8), 64)[0]
                rows += [(p, *k, float(chw[k])) for k in at]
            yield pd.DataFrame(rows, columns=["p_partkey", "ch", "y", "x", "v"])

    return V.table(spark, sf_dir, "part").select("p_partkey").mapInPandas(run, "p_partkey long, ch int, y int, x int, v double").withColumn("v", F.round("v", 4))


@query(
    "tile_loop",
    """
SELECT raster, CAST(x AS INTEGER) AS tile_x, CAST(y AS INTEGER) AS tile_y, CASE WHEN bad THEN NULL ELSE x + 18 END AS x0, CASE WHEN bad THEN NULL ELSE y + 10 END AS y0, CASE WHEN bad THEN NULL ELSE 0.75::DOUBLE END AS conf, bad AS hata
FROM (SELECT CAST(raster AS INTEGER) AS raster, x.x, y.y, (x.x // 51 + y.y // 51) % 5 = 4 AS bad FROM (VALUES (1, 217, 268), (2, 370, 166)) r(raster, width, height), range(0, 400, 51) x(x), range(0, 400, 51) y(y)
      WHERE x.x + 64 <= width AND y.y + 64 <= height) WHERE (x // 51 + y // 51) % 5 <> 3
""",
)
def tile_loop(spark, sf_dir):
    """Tiles through a stand-in model: two boxes of which one is suppressed, blank tiles that are skipped and tiles that fail and are reported."""
    import numpy as np

    from terraframe.operators.vision import infer

    def read(x, y, w, h):
        kind = (x // 51 + y // 51) % 5
        if kind == 4:
            raise OSError("unreadable")
        return np.full((h, w, 3), 0 if kind == 3 else 51, np.uint8)

    def runner():
        head = np.zeros((1, 37, 2), np.float32)
        head[0, :5, 0], head[0, :5, 1] = (32, 24, 28, 28, 0.75), (33, 24, 28, 28, 0.5)
        head[0, 5] = 1
        protos = np.full((1, 32, 64, 64), 20, np.float32)
        return lambda x: (head, protos)

    tiles = tile_windows(spark.createDataFrame([(1, 217, 268), (2, 370, 166)], "raster int, width int, height int"), 64, 0.2)
    out = None
    for raster in (1, 2):
        found = infer(tiles.where((F.col("raster") == raster) & (F.col("w") == 64) & (F.col("h") == 64)), read, runner, 64, 0.4, 0.5).withColumn("raster", F.lit(raster))
        out = found if out is None else out.unionByName(found)
    b = G.bbox(F.col("geom"))
    return out.select("raster", "tile_x", "tile_y", F.round(b["xmin"]).cast("long").alias("x0"), F.round(b["ymin"]).cast("long").alias("y0"), r6("confidence").alias("conf"), F.col("error").isNotNull().alias("hata"))


# figures of a model's validation


@query("metric_table", "SELECT * FROM (VALUES ('mAP50', 0.7123::DOUBLE, 0.6988::DOUBLE), ('mAP50-95', 0.4501::DOUBLE, 0.4::DOUBLE)) t(\"Metrik\", \"Box\", \"Mask\")")
def metric_table(spark, sf_dir):
    """Validation figures to four digits, through their CSV file."""
    from terraframe.plans.jobs import write_metrics

    path = f"{scratch(spark)}/metrics.csv"
    write_metrics([("mAP50", 0.712345, 0.69876), ("mAP50-95", 0.450067, 0.4)], spark, path)
    return spark.read.csv(path, header=True, schema="Metrik string, Box double, Mask double")
