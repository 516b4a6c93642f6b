"""The operators as queries over the driver's tables, with the SQL that DuckDB checks them by.

Doubles are rounded to 6 digits on either side, since sums run in different orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions import geometry as G
from terraframe.functions import stats
from terraframe.functions.prng import draws
from terraframe.functions.text import xml_escape as escaped
from terraframe.operators import matching, raster_ops, sampling
from terraframe.operators.nms import greedy_nms
from terraframe.operators.spatial_join import box_pairs, within_any
from terraframe.operators.sweep import threshold_sweep
from terraframe.operators.tiling import tile_windows
from terraframe.plans import views as V
from terraframe.plans.views import duck

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CELL = 16.0
MIN_AREA = 60.0
THRESHOLDS = (0.25, 0.30, 0.40, 0.50, 0.60)
AFFINE = (0.5, 0.0, 100.0, 0.0, -0.5, 200.0)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def box(alias: str = "") -> tuple:
    p = f"{alias}." if alias else ""
    return tuple(F.col(f"{p}{c}") for c in ("xmin", "ymin", "xmax", "ymax"))


def affine() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", AFFINE, strict=True)])


# tiles

_RASTERS = [(1, 3000, 2000), (2, 1343, 1280), (3, 1344, 1280), (4, 300, 5000), (5, 26000, 19000)]
_DUCK_TILES = """
r(raster, width, height) AS (VALUES (1, 3000, 2000), (2, 1343, 1280), (3, 1344, 1280), (4, 300, 5000), (5, 26000, 19000)),
s AS (SELECT raster, x.x AS x_off, y.y AS y_off, least(1280, width - x.x) AS w, least(1280, height - y.y) AS h
      FROM r, range(0, 30000, 1024) x(x), range(0, 30000, 1024) y(y) WHERE x.x < width AND y.y < height)"""
_TILE_COLS = "CAST(raster AS INTEGER) AS raster, CAST(x_off AS INTEGER) AS x_off, CAST(y_off AS INTEGER) AS y_off, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h"


def _tiles(spark: SparkSession, **how) -> DataFrame:
    rasters = spark.createDataFrame(_RASTERS, "raster int, width int, height int")
    return tile_windows(rasters, 1280, 0.2, **how).select("raster", "x_off", "y_off", "w", "h")


@query("tile_windows", duck(f"SELECT {_TILE_COLS} FROM s", _DUCK_TILES))
def tile_windows_all(spark, sf_dir):
    return _tiles(spark, cover_edges=True)


@query("tile_edge_filter", duck(f"SELECT {_TILE_COLS} FROM s WHERE w >= 320 AND h >= 320", _DUCK_TILES))
def tile_edge_filter(spark, sf_dir):
    return _tiles(spark)


# filters and projections of detections


@query("conf_filter", duck("SELECT id, round(conf, 6) AS conf FROM detections WHERE conf >= 0.4::DOUBLE", "detections"))
def conf_filter(spark, sf_dir):
    return V.detections(spark, sf_dir).where(F.col("conf") >= 0.4).select("id", r6("conf").alias("conf"))


@query("min_area_filter", duck(f"SELECT id, area FROM detections WHERE area > 0 AND area >= {MIN_AREA}", "detections"))
def min_area_filter(spark, sf_dir):
    return V.detections(spark, sf_dir).where((F.col("area") > 0) & (F.col("area") >= MIN_AREA)).select("id", "area")


@query("equiv_diameter", duck("SELECT id, round(2 * sqrt(area / pi()), 6) AS cap_m FROM detections", "detections"))
def equiv_diameter(spark, sf_dir):
    return V.detections(spark, sf_dir).select("id", r6(G.equivalent_diameter(F.col("area"))).alias("cap_m"))


@query("affine_pixel_to_map", duck("SELECT id, round(0.5 * (xmin + 0.5) + 100, 6) AS x, round(-0.5 * (ymin + 0.5) + 200, 6) AS y FROM detections", "detections"))
def affine_pixel_to_map(spark, sf_dir):
    p = G.pixel_to_map(F.col("xmin"), F.col("ymin"), affine())
    return V.detections(spark, sf_dir).select("id", r6(p["x"]).alias("x"), r6(p["y"]).alias("y"))


@query("tile_to_global_pixel", duck("SELECT id, round(xmin + 1024, 6) AS x, round(ymin + 2048, 6) AS y FROM detections", "detections"))
def tile_to_global_pixel(spark, sf_dir):
    d = V.polygons(V.detections(spark, sf_dir)).withColumn("ring", G.shift(F.element_at("geom", 1), F.lit(1024.0), F.lit(2048.0)))
    return d.select("id", r6(F.element_at("ring", 1)["x"]).alias("x"), r6(F.element_at("ring", 1)["y"]).alias("y"))


@query(
    "map_to_pixel_window",
    duck(
        """
SELECT id, CAST(greatest(0, least(floor((xmin - 100) / 0.5), 799)) AS INTEGER) AS c0, CAST(greatest(0, least(floor((ymax - 200) / -0.5), 599)) AS INTEGER) AS r0,
       CAST(greatest(0, least(ceil((xmax - 100) / 0.5), 799)) AS INTEGER) AS c1, CAST(greatest(0, least(ceil((ymin - 200) / -0.5), 599)) AS INTEGER) AS r1
FROM detections""",
        "detections",
    ),
)
def map_to_pixel_window(spark, sf_dir):
    w = G.pixel_window(box(), affine(), F.lit(800), F.lit(600))
    return V.detections(spark, sf_dir).select("id", w.alias("w")).select("id", "w.*")


@query("ring_area_shoelace", duck("SELECT id, round((xmax - xmin) * (ymax - ymin), 6) AS area FROM detections", "detections"))
def ring_area_shoelace(spark, sf_dir):
    return V.polygons(V.detections(spark, sf_dir)).select("id", r6(G.ring_area(F.element_at("geom", 1))).alias("area"))


@query("polygon_area_with_hole", duck("SELECT id, round((xmax - xmin) * (ymax - ymin) - 4, 6) AS area FROM detections", "detections"))
def polygon_area_with_hole(spark, sf_dir):
    d = V.detections(spark, sf_dir)
    x, y = F.col("xmin") + 2, F.col("ymin") + 2
    geom = F.array(G.box_ring(*box()), G.box_ring(x, y, x + 2, y + 2))
    return d.select("id", r6(G.polygon_area(geom)).alias("area"))


@query("ring_centroid", duck("SELECT id, round((xmin + xmax) / 2, 4) AS merkez_x, round((ymin + ymax) / 2, 4) AS merkez_y FROM detections", "detections"))
def ring_centroid(spark, sf_dir):
    # about the box's own corner, as far coordinates cancel digits
    d = V.detections(spark, sf_dir)
    local = F.array(G.box_ring(F.lit(0.0), F.lit(0.0), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))
    c = G.centroid(local)
    return d.select("id", F.round(F.col("xmin") + c["x"], 4).alias("merkez_x"), F.round(F.col("ymin") + c["y"], 4).alias("merkez_y"))


@query("polygon_bbox", duck("SELECT id, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM detections", "detections"))
def polygon_bbox(spark, sf_dir):
    b = V.polygons(V.detections(spark, sf_dir)).select("id", G.bbox(F.col("geom")).alias("b"))
    return b.select("id", *[r6(f"b.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(
    "round_and_rename",
    duck("SELECT CAST(id AS INTEGER) AS id, round(conf + 0.00001, 4) AS conf, round(area * 1.2345, 3) AS alan_m2, round(2 * sqrt(area / pi()), 3) AS cap_m FROM detections", "detections"),
)
def round_and_rename(spark, sf_dir):
    d = V.detections(spark, sf_dir).withColumn("conf", F.col("conf") + 0.00001)
    return d.select(F.col("id").cast("int").alias("id"), F.round("conf", 4).alias("conf"), F.round(F.col("area") * 1.2345, 3).alias("alan_m2"), F.round(G.equivalent_diameter(F.col("area")), 3).alias("cap_m"))


# joins and suppression

_IOU = """greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"""
_PAIRS = f"""
p AS (SELECT a.id AS a, b.id AS b, a.k AS k, {_IOU} AS i, a.area + b.area AS s
      FROM detections a JOIN detections b ON a.id < b.id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax),
e AS (SELECT a, b, k, i / (s - i) AS iou FROM p)"""


@query("box_iou_pairs", duck("SELECT a, b, round(iou, 6) AS iou FROM e WHERE iou > 0.3::DOUBLE", "detections", _PAIRS))
def box_iou_pairs(spark, sf_dir):
    d = V.detections(spark, sf_dir)
    pairs = box_pairs(d, d, CELL, F.col("l.id") < F.col("r.id"))
    return pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), G.box_iou(box("l"), box("r"), (F.col("l.area"), F.col("r.area"))).alias("iou")).where(F.col("iou") > 0.3).withColumn("iou", r6("iou"))


# conflicts at IoU 0.5 stay within a cluster of four, so each is settled in its own rank order
_KEPT = (
    _PAIRS
    + """,
c AS (SELECT * FROM e WHERE iou > 0.5::DOUBLE),
n AS (SELECT id, k, list(o) AS nb FROM (SELECT a AS id, k, b AS o FROM c UNION ALL SELECT b, k, a FROM c) GROUP BY 1, 2),
q AS (SELECT d.*, coalesce(n.nb, []) AS nb, row_number() OVER (PARTITION BY d.k ORDER BY d.conf DESC, d.id) AS rk FROM detections d LEFT JOIN n ON n.id = d.id),
g AS (SELECT k, 1 AS rk, [id] AS ids FROM q WHERE rk = 1
      UNION ALL
      SELECT q.k, q.rk, CASE WHEN list_has_any(g.ids, q.nb) THEN g.ids ELSE list_append(g.ids, q.id) END FROM g JOIN q ON q.k = g.k AND q.rk = g.rk + 1),
m AS (SELECT unnest(ids) AS id FROM (SELECT k, arg_max(ids, rk) AS ids FROM g GROUP BY k)),
kept AS (SELECT d.* FROM detections d JOIN m ON m.id = d.id)"""
)


def _kept(spark, sf_dir):
    return greedy_nms(V.detections(spark, sf_dir), 0.5, CELL)


@query("nms_greedy", duck("SELECT id, round(conf, 6) AS conf, area FROM kept", "detections", _KEPT))
def nms_greedy(spark, sf_dir):
    return _kept(spark, sf_dir).select("id", r6("conf").alias("conf"), "area")


@query("nms_kept_summary", duck("SELECT count(*) AS n, round(sum(area), 4) AS toplam, round(avg(area), 6) AS ortalama FROM kept", "detections", _KEPT))
def nms_kept_summary(spark, sf_dir):
    return _kept(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.sum("area"), 4).alias("toplam"), F.round(F.avg("area"), 6).alias("ortalama"))


@query(
    "threshold_sweep",
    duck(
        f"""
SELECT t.esik, count(a.id) AS tespit_sayisi, round(coalesce(sum(a.area), 0), 2) AS toplam_alan_m2, round(coalesce(avg(a.area), 0), 2) AS ortalama_alan_m2
FROM t LEFT JOIN (SELECT * FROM kept WHERE area >= {MIN_AREA}) a ON a.conf >= t.esik GROUP BY t.esik""",
        "detections",
        _KEPT,
        "t(esik) AS (VALUES (0.25::DOUBLE), (0.30), (0.40), (0.50), (0.60), (2.00))",
    ),
)
def sweep(spark, sf_dir):
    # the area filter stays above suppression: a small box may have taken a large one's place
    return threshold_sweep(_kept(spark, sf_dir).where(F.col("area") >= MIN_AREA), (*THRESHOLDS, 2.0))


@query(
    "record_build",
    duck(
        f"""
SELECT CAST(row_number() OVER (ORDER BY conf DESC, id) AS INTEGER) AS no, id, round(conf, 6) AS confidence, area AS alan_m2, round(2 * sqrt(area / pi()), 6) AS cap_m
FROM kept WHERE area >= {MIN_AREA}""",
        "detections",
        _KEPT,
    ),
)
def record_build(spark, sf_dir):
    from terraframe.operators.ranking import dense_number

    d = _kept(spark, sf_dir).where(F.col("area") >= MIN_AREA)
    n = dense_number(d, [F.col("conf").desc(), F.col("id").asc()], "no")
    return n.select("no", "id", r6("conf").alias("confidence"), F.col("area").alias("alan_m2"), r6(G.equivalent_diameter(F.col("area"))).alias("cap_m"))


@query(
    "squares_semi_join",
    duck(
        """
SELECT id FROM detections d WHERE EXISTS (SELECT 1 FROM squares s WHERE (d.xmin + d.xmax) / 2 > s.xmin AND (d.xmin + d.xmax) / 2 < s.xmax
  AND (d.ymin + d.ymax) / 2 > s.ymin AND (d.ymin + d.ymax) / 2 < s.ymax)""",
        "detections",
        "squares",
    ),
)
def squares_semi_join(spark, sf_dir):
    d = V.detections(spark, sf_dir).select("id", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"))
    return within_any(d, V.squares(spark), "cx", "cy", 64.0).select("id")


# statistics


@query(
    "detection_summary",
    duck(
        """
SELECT count(*) AS n, round(sum(area), 4) AS toplam, round(avg(area), 6) AS ortalama, round(avg(2 * sqrt(area / pi())), 6) AS ortalama_cap,
       round(min(conf), 6) AS en_kucuk, round(max(conf), 6) AS en_buyuk, round(avg(conf), 6) AS ortalama_conf FROM detections""",
        "detections",
    ),
)
def detection_summary(spark, sf_dir):
    from terraframe.plans.jobs import summary

    d = V.detections(spark, sf_dir)
    s = summary(d.select(F.col("conf").alias("confidence"), F.col("area").alias("alan_m2"), G.equivalent_diameter(F.col("area")).alias("cap_m")))
    return s.select("n", F.round("toplam_alan", 4).alias("toplam"), r6("ortalama_alan").alias("ortalama"), r6("ortalama_cap").alias("ortalama_cap"), r6("en_kucuk").alias("en_kucuk"), r6("en_buyuk").alias("en_buyuk"), r6("ortalama").alias("ortalama_conf"))


@query(
    "measure_stats",
    duck("SELECT count(conf) AS n, round(sum(conf), 4) AS toplam, round(avg(conf), 6) AS ortalama, round(min(conf), 6) AS en_kucuk, round(max(conf), 6) AS en_buyuk, round(coalesce(stddev_samp(conf), 0), 6) AS std FROM detections", "detections"),
)
def measure_stats(spark, sf_dir):
    s = stats.measure_stats(V.detections(spark, sf_dir), "conf")
    return s.select("n", F.round("toplam", 4).alias("toplam"), *[r6(c).alias(c) for c in ("ortalama", "en_kucuk", "en_buyuk", "std")])


@query("percentile95_linear", duck("SELECT k % 10 AS g, round(quantile_cont(conf, 0.95), 6) AS p95 FROM detections GROUP BY 1", "detections"))
def percentile95_linear(spark, sf_dir):
    return V.detections(spark, sf_dir).groupBy((F.col("k") % 10).alias("g")).agg(r6(stats.percentile(F.col("conf"), 0.95)).alias("p95"))


def _duck_hist(col: str, bins: int) -> str:
    return f"""
b AS (SELECT min({col}) AS lo, CASE WHEN max({col}) > min({col}) THEN max({col}) - min({col}) ELSE 1 END AS span FROM detections),
c AS (SELECT CAST(least(floor(({col} - lo) / span * {bins}), {bins - 1}) AS INTEGER) AS k, count(*) AS n FROM detections, b GROUP BY 1)"""


_HIST = 'SELECT CAST(i AS INTEGER) AS k, round(lo + i * (span / {n}), 6) AS "left", round(lo + (i + 1) * (span / {n}), 6) AS "right", coalesce(c.n, 0) AS n FROM range(0, {n}) r(i) CROSS JOIN b LEFT JOIN c ON c.k = i'


@query("histogram_equal_width", duck(_HIST.format(n=30), "detections", _duck_hist("area", 30)))
def histogram_equal_width(spark, sf_dir):
    return stats.histogram(V.detections(spark, sf_dir), "area", 30).select("k", r6("left").alias("left"), r6("right").alias("right"), "n")


@query("histogram_confidence", duck(_HIST.format(n=20), "detections", _duck_hist("conf", 20)))
def histogram_confidence(spark, sf_dir):
    return stats.histogram(V.detections(spark, sf_dir), "conf", 20).select("k", r6("left").alias("left"), r6("right").alias("right"), "n")


@query(
    "nice_axis_ticks",
    """
WITH b AS (SELECT o_orderpriority AS g, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
s AS (SELECT g, lo, hi, (hi - lo) / 5 AS raw FROM b), p AS (SELECT *, pow(10, floor(log10(raw))) AS pw FROM s),
t AS (SELECT *, CASE WHEN raw / pw <= 1 THEN 1 WHEN raw / pw <= 2 THEN 2 WHEN raw / pw <= 5 THEN 5 ELSE 10 END * pw AS step FROM p)
SELECT g, round(k * step, 6) AS tick FROM (SELECT g, step, unnest(range(CAST(floor(lo / step) AS BIGINT), CAST(ceil(hi / step) AS BIGINT) + 1)) AS k FROM t)""",
)
def nice_axis_ticks(spark, sf_dir):
    g = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return g.select("g", F.explode(stats.nice_ticks(F.col("lo"), F.col("hi"))).alias("t")).select("g", r6("t").alias("tick"))


@query(
    "nan_stats",
    duck(
        """
SELECT round(min(z), 6) AS en_kucuk, round(max(z), 6) AS en_buyuk, round(avg(z), 6) AS ortalama, count(z) AS gecerli
FROM (SELECT CASE WHEN (row + col) % 7 = 0 THEN NULL ELSE z END AS z FROM dsm_cells)""",
        "dsm_cells",
    ),
)
def nan_stats(spark, sf_dir):
    z = F.when((F.col("row") + F.col("col")) % 7 == 0, F.lit(float("nan"))).otherwise(F.col("z"))
    s = stats.nan_stats(V.dsm_cells(spark, sf_dir).select(z.alias("z")), "z")
    return s.select(*[r6(c).alias(c) for c in ("en_kucuk", "en_buyuk", "ortalama")], "gecerli")


# sampling

_M = "4294967295"


def _duck_imul(a: str, b: str) -> str:
    return f"((({a}) * (({b}) & 65535) + (((({a}) * (({b}) >> 16)) & 65535) * 65536)) & {_M})"


_DRAWS = f"""
d0 AS (SELECT k, (42 + k * 1831565813) & {_M} AS a FROM range(1, 4001) r(k)),
d1 AS (SELECT k, {_duck_imul("xor(a, a >> 15)", "a | 1")} AS t FROM d0),
d2 AS (SELECT k, t, {_duck_imul("xor(t, t >> 7)", "t | 61")} AS s FROM d1),
d3 AS (SELECT k, xor((t + s) & {_M}, t) AS t FROM d2),
d AS (SELECT k, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM d3)"""


@query("mulberry32_draws", duck("SELECT k, u FROM d", _DRAWS))
def mulberry32_draws(spark, sf_dir):
    return draws(spark, 4000, 42)


_CANDS = """
c AS (SELECT CAST((k + 1) // 2 AS INTEGER) AS attempt, max(CASE WHEN k % 2 = 1 THEN u END) * 870 AS xmin, max(CASE WHEN k % 2 = 0 THEN u END) * 195 AS ymin FROM d GROUP BY 1)"""


@query(
    "sample_squares",
    duck(
        """
SELECT CAST(row_number() OVER (ORDER BY attempt) AS INTEGER) AS square_id, attempt, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin FROM (
  SELECT unnest(a, recursive := true) FROM (SELECT arg_max(acc, step) AS acc FROM f) x(acc), LATERAL (SELECT unnest(acc) AS a))""",
        _DRAWS,
        _CANDS,
        """
f AS (SELECT 0 AS step, CAST([] AS STRUCT(attempt INTEGER, xmin DOUBLE, ymin DOUBLE)[]) AS acc
      UNION ALL
      SELECT step + 1, CASE WHEN len([q FOR q IN acc IF c.xmin < q.xmin + 30 AND c.xmin + 30 > q.xmin AND c.ymin < q.ymin + 30 AND c.ymin + 30 > q.ymin]) > 0 THEN acc
                            ELSE list_append(acc, {'attempt': c.attempt, 'xmin': c.xmin, 'ymin': c.ymin}) END
      FROM f JOIN c ON c.attempt = f.step + 1 WHERE len(acc) < 12)""",
    ),
)
def sample_squares(spark, sf_dir):
    s = sampling.accept(sampling.candidates(spark, 0.0, 0.0, 900.0, 225.0), 12)
    return s.select("square_id", "attempt", r6("xmin").alias("xmin"), r6("ymin").alias("ymin"))


# rasters

_CHM = """
h AS (SELECT s.row, s.col, s.z - t.z AS d FROM dsm_cells s LEFT JOIN dtm_cells t ON t.row = s.row // 4 AND t.col = s.col // 4),
chm AS (SELECT row, col, CAST(CASE WHEN d < 0 THEN 0 WHEN d > 50 THEN NULL ELSE d END AS FLOAT) AS v FROM h)"""


def _chm(spark, sf_dir):
    near = V.dtm_cells(spark, sf_dir).select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("z").alias("z_"))
    fine = V.dsm_cells(spark, sf_dir)
    ground = fine.join(near, (F.expr("row DIV 4") == F.col("tr")) & (F.expr("col DIV 4") == F.col("tc"))).select("row", "col", F.col("z_").alias("z"))
    return raster_ops.chm(fine, ground)


@query("chm_map_algebra", duck("SELECT row, col, round(CAST(v AS DOUBLE), 4) AS v FROM chm", "dsm_cells", "dtm_cells", _CHM))
def chm_map_algebra(spark, sf_dir):
    return _chm(spark, sf_dir).select("row", "col", F.round(F.col("v").cast("double"), 4).alias("v"))


@query(
    "dtm_bilinear_regrid",
    duck(
        """
SELECT row, col, round(sum(w * z) / sum(CASE WHEN z IS NOT NULL THEN w END), 8) AS ground FROM w LEFT JOIN (SELECT row AS tr, col AS tc, z FROM dtm_cells) ON tr = r AND tc = c
WHERE w > 0 GROUP BY 1, 2""",
        "dsm_cells",
        "dtm_cells",
        """
g AS (SELECT row, col, (row + 0.5) / 4 - 0.5 AS fr, (col + 0.5) / 4 - 0.5 AS fc FROM dsm_cells),
w AS (SELECT row, col, floor(fr) + i AS r, floor(fc) + j AS c,
             (CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w
      FROM g, range(0, 2) a(i), range(0, 2) b(j))""",
    ),
)
def dtm_bilinear_regrid(spark, sf_dir):
    return raster_ops.bilinear(V.dsm_cells(spark, sf_dir), V.dtm_cells(spark, sf_dir), 4).select("row", "col", F.round("ground", 8).alias("ground"))


@query(
    "empty_ratio",
    duck("SELECT row // 8 AS r, col // 8 AS c, round(avg(CASE WHEN z = 0 OR z = 7.5 THEN 1.0 ELSE 0 END), 6) AS bos_oran FROM dsm_cells GROUP BY 1, 2", "dsm_cells"),
)
def empty_ratio(spark, sf_dir):
    g = V.dsm_cells(spark, sf_dir).groupBy(F.expr("row DIV 8").alias("r"), F.expr("col DIV 8").alias("c"))
    return g.agg(r6(raster_ops.empty_ratio(F.col("z"), 7.5)).alias("bos_oran"))


_ZONE = "\nz AS (SELECT d.id, CAST(c.v AS DOUBLE) AS v FROM detections d JOIN chm c ON (c.col + 0.5) * 14 >= d.xmin AND (c.col + 0.5) * 14 < d.xmax AND (c.row + 0.5) * 14 >= d.ymin AND (c.row + 0.5) * 14 < d.ymax WHERE c.v IS NOT NULL)"


def _zonal(spark, sf_dir, method: str) -> DataFrame:
    d = V.polygons(V.detections(spark, sf_dir)).select("id", "xmin", "ymin", "xmax", "ymax", "geom")
    pairs = raster_ops.zonal(d, _chm(spark, sf_dir), 14.0, G.point_in_polygon(F.col("z.geom"), F.col("x"), F.col("y")), 16)
    return pairs.groupBy("id").agg(F.round(raster_ops.height(method, F.col("v")), 4).alias("boy_m"))


def _duck_zonal(agg: str) -> str:
    return duck(f"SELECT id, round({agg}, 4) AS boy_m FROM z GROUP BY id", "detections", "dsm_cells", "dtm_cells", _CHM, _ZONE)


@query("zonal_max", _duck_zonal("max(v)"))
def zonal_max(spark, sf_dir):
    return _zonal(spark, sf_dir, "max")


@query("zonal_mean", _duck_zonal("avg(v)"))
def zonal_mean(spark, sf_dir):
    return _zonal(spark, sf_dir, "mean")


@query("zonal_p95", _duck_zonal("quantile_cont(v, 0.95)"))
def zonal_p95(spark, sf_dir):
    return _zonal(spark, sf_dir, "p95")


@query(
    "zonal_left_join_heights",
    duck("SELECT d.id, round(max(z.v), 4) AS boy_m FROM detections d LEFT JOIN z ON z.id = d.id GROUP BY d.id", "detections", "dsm_cells", "dtm_cells", _CHM, _ZONE),
)
def zonal_left_join_heights(spark, sf_dir):
    return V.detections(spark, sf_dir).select("id").join(_zonal(spark, sf_dir, "max"), "id", "left")


@query(
    "point_in_polygon_even_odd",
    duck(
        """
SELECT id, (x >= 0 AND x < 10 AND y >= 0 AND y < 10) AND NOT (x >= 3 AND x < 6 AND y >= 3 AND y < 6) AS icinde
FROM (SELECT id, CAST(v % 12 AS DOUBLE) AS x, CAST((v // 12) % 12 AS DOUBLE) AS y FROM detections)""",
        "detections",
    ),
)
def point_in_polygon_even_odd(spark, sf_dir):
    ring = lambda lo, hi: G.box_ring(*[F.lit(float(v)) for v in (lo, lo, hi, hi)])
    d = V.detections(spark, sf_dir)
    return d.select("id", G.point_in_polygon(F.array(ring(0, 10), ring(3, 6)), (F.col("v") % 12).cast("double"), (F.expr("v DIV 12") % 12).cast("double")).alias("icinde"))


# matching

_EDGES = f"""
p AS (SELECT a.id AS t, b.id AS r, a.k AS k, a.area AS pa, b.area AS ra, {_IOU} AS i, a.area + b.area AS s
      FROM match_pred a JOIN match_ref b ON a.k = b.k),
e AS (SELECT t, r, k, pa, ra, i / (s - i) AS iou FROM p WHERE i > 0)"""
# a cluster has up to four predictions and two references: every assignment is written out
_BEST = (
    _EDGES
    + """,
rr AS (SELECT k, id AS r, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM match_ref),
o1 AS (SELECT rr.k, e.t, e.iou FROM rr JOIN e ON e.r = rr.r WHERE n = 1 UNION ALL SELECT k, NULL, 0 FROM rr WHERE n = 1),
o2 AS (SELECT rr.k, e.t, e.iou FROM rr JOIN e ON e.r = rr.r WHERE n = 2 UNION ALL SELECT DISTINCT k, NULL, 0 FROM rr),
x AS (SELECT o1.k, o1.t AS t1, o2.t AS t2, row_number() OVER (PARTITION BY o1.k ORDER BY round(o1.iou + o2.iou, 9) DESC, o1.t NULLS LAST, o2.t NULLS LAST) AS n
      FROM o1 JOIN o2 ON o1.k = o2.k AND (o1.t IS NULL OR o2.t IS NULL OR o1.t <> o2.t)),
y AS (SELECT k, t1 AS t, 1 AS n FROM x WHERE n = 1 UNION ALL SELECT k, t2, 2 FROM x WHERE n = 1),
best AS (SELECT e.t, e.r, e.iou, e.pa, e.ra FROM y JOIN rr ON rr.k = y.k AND rr.n = y.n JOIN e ON e.t = y.t AND e.r = rr.r WHERE e.iou >= 0.5::DOUBLE)"""
)


def _edges(spark, sf_dir):
    return matching.iou_edges(V.match_pred(spark, sf_dir), V.match_ref(spark, sf_dir), CELL)


@query("iou_edges_pred_ref", duck("SELECT t, r, round(iou, 6) AS iou FROM e", "match_pred", "match_ref", _EDGES))
def iou_edges_pred_ref(spark, sf_dir):
    return _edges(spark, sf_dir).select("t", "r", r6("iou").alias("iou"))


@query("assign_optimal", duck("SELECT t, r, round(iou, 6) AS iou FROM best", "match_pred", "match_ref", _BEST))
def assign_optimal(spark, sf_dir):
    return matching.matches(_edges(spark, sf_dir), 0.5).select("t", "r", r6("iou").alias("iou"))


@query(
    "precision_recall_f1",
    duck(
        """
SELECT m AS tp, np - m AS fp, nr - m AS fn, round(m / CAST(np AS DOUBLE), 6) AS precision, round(m / CAST(nr AS DOUBLE), 6) AS recall, round(2.0 * m / (np + nr), 6) AS f1
FROM (SELECT (SELECT count(*) FROM best) AS m, (SELECT count(*) FROM match_pred) AS np, (SELECT count(*) FROM match_ref) AS nr)""",
        "match_pred",
        "match_ref",
        _BEST,
    ),
)
def precision_recall_f1(spark, sf_dir):
    p, r = V.match_pred(spark, sf_dir), V.match_ref(spark, sf_dir)
    a = matching.accuracy(matching.matches(_edges(spark, sf_dir)), p, r)
    return a.select("tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "area_r2_rmse",
    duck(
        """
SELECT count(*) AS n, round(pow(covar_pop(ra, pa), 2) / (var_pop(ra) * var_pop(pa)), 6) AS r2, round(sqrt(avg(pow(pa - ra, 2))), 6) AS rmse FROM best""",
        "match_pred",
        "match_ref",
        _BEST,
    ),
)
def area_r2_rmse(spark, sf_dir):
    m = matching.with_areas(matching.matches(_edges(spark, sf_dir)), V.match_pred(spark, sf_dir), V.match_ref(spark, sf_dir))
    x, y = F.col("ref_area"), F.col("pred_area")
    return m.agg(F.count("*").alias("n"), r6(stats.r_squared(x, y)).alias("r2"), r6(stats.rmse(x, y)).alias("rmse"))


@query("mean_match_iou", duck("SELECT round(avg(iou), 6) AS ortalama_iou, sum(ra) AS referans_alan, sum(pa) AS tahmin_alan FROM best", "match_pred", "match_ref", _BEST))
def mean_match_iou(spark, sf_dir):
    m = matching.with_areas(matching.matches(_edges(spark, sf_dir)), V.match_pred(spark, sf_dir), V.match_ref(spark, sf_dir))
    return m.agg(r6(F.avg("iou")).alias("ortalama_iou"), F.sum("ref_area").alias("referans_alan"), F.sum("pred_area").alias("tahmin_alan"))


@query("match_lookup", duck("SELECT t AS tahmin_no, r AS referans_no, round(iou, 4) AS iou, pa AS tahmin_alan_m2, ra AS referans_alan_m2 FROM best", "match_pred", "match_ref", _BEST))
def match_lookup(spark, sf_dir):
    m = matching.with_areas(matching.matches(_edges(spark, sf_dir)), V.match_pred(spark, sf_dir), V.match_ref(spark, sf_dir))
    return m.select(F.col("t").alias("tahmin_no"), F.col("r").alias("referans_no"), F.round("iou", 4).alias("iou"), F.col("pred_area").alias("tahmin_alan_m2"), F.col("ref_area").alias("referans_alan_m2"))


# polygons, masks and model output


@query("polygon_overlap_area", duck("SELECT t, r, round(i, 6) AS alan FROM p WHERE i > 0", "match_pred", "match_ref", _EDGES))
def polygon_overlap_area(spark, sf_dir):
    from terraframe.functions.overlap import polygon_overlap

    p, r = V.polygons(V.match_pred(spark, sf_dir)), V.polygons(V.match_ref(spark, sf_dir))
    pairs = box_pairs(p, r, CELL)
    return pairs.select(F.col("l.id").alias("t"), F.col("r.id").alias("r"), r6(polygon_overlap(F.col("l.geom"), F.col("r.geom"))).alias("alan"))


@query("geojson_roundtrip", duck("SELECT id, round(xmin, 6) AS x, round(ymax, 6) AS y, round(area, 6) AS area FROM detections", "detections"))
def geojson_roundtrip(spark, sf_dir):
    d = V.polygons(V.detections(spark, sf_dir)).select("id", F.to_json(G.to_geojson(F.col("geom"))).alias("j"))
    back = F.from_json("j", "type string, coordinates array<array<array<double>>>")
    g = d.select("id", G.from_geojson(back["coordinates"]).alias("geom"))
    b = G.bbox(F.col("geom"))
    return g.select("id", r6(b["xmin"]).alias("x"), r6(b["ymax"]).alias("y"), r6(G.polygon_area(F.col("geom"))).alias("area"))


@query("crs_transform", duck("SELECT id, round(xmin + 500000, 4) AS x, round(ymin + 4500000, 4) AS y FROM detections", "detections"))
def crs_transform(spark, sf_dir):
    """UTM to geographic coordinates and back."""
    from terraframe.functions.crs import transform_polygon

    far = lambda r: G.shift(r, F.lit(500000.0), F.lit(4500000.0))
    d = V.polygons(V.detections(spark, sf_dir)).select("id", F.transform("geom", far).alias("geom"))
    d = d.withColumn("geom", transform_polygon(F.col("geom"), "EPSG:32635", "EPSG:4326")).withColumn("geom", transform_polygon(F.col("geom"), "EPSG:4326", "EPSG:32635"))
    first = F.element_at(F.element_at("geom", 1), 1)
    return d.select("id", F.round(first["x"], 4).alias("x"), F.round(first["y"], 4).alias("y"))


@query(
    "mask_sigmoid_product",
    "SELECT vec_id, round(1 / (1 + exp(-list_sum([CAST(embedding[i] AS DOUBLE) * ((i - 1) % 7 - 3) / 10.0::DOUBLE FOR i IN range(1, len(embedding) + 1)]))), 3) AS maske, 0.0::DOUBLE AS disi FROM embeddings",
)
def mask_sigmoid_product(spark, sf_dir):
    """Each vector as a detection's coefficients over flat prototypes: the mask inside its box and outside of it."""
    import numpy as np
    import pandas as pd

    from terraframe.operators.vision import instance_mask

    def run(batches):
        for pdf in batches:
            rows = []
            for v in pdf["embedding"]:
                protos = np.broadcast_to((((np.arange(len(v)) % 7) - 3) / 10)[:, None, None], (len(v), 8, 8))
                m = instance_mask(np.asarray(v, np.float64), protos, np.array([8.0, 8.0, 24.0, 24.0]), 32, 32, 32, 1.0, 0, 0)
                rows.append((float(m[16, 16]), float(m[2, 16])))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "maske": [r[0] for r in rows], "disi": [r[1] for r in rows]})

    e = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.mapInPandas(run, "vec_id long, maske double, disi double").select("vec_id", F.round("maske", 3).alias("maske"), "disi")


@query("tile_box_nms", duck("SELECT id FROM kept", "detections", _KEPT))
def tile_box_nms(spark, sf_dir):
    """Suppression inside each tile, as a worker does it."""
    from terraframe.operators.vision import box_nms

    def one(pdf):
        pdf = pdf.sort_values(["conf", "id"], ascending=[False, True], ignore_index=True)
        boxes = pdf[["xmin", "ymin", "xmax", "ymax"]].to_numpy()
        return pdf.loc[box_nms(boxes, pdf["conf"].to_numpy(), 0.5, pdf["area"].to_numpy()), ["id"]]

    return V.detections(spark, sf_dir).withColumn("tile", F.expr("k DIV 16")).groupBy("tile").applyInPandas(one, "id long")


@query("yolo_head_decode", duck("SELECT id, round(xmin, 4) AS x0, round(ymin, 4) AS y0, round(xmax, 4) AS x1, round(ymax, 4) AS y1, round(conf, 6) AS conf FROM detections WHERE conf >= 0.4::DOUBLE", "detections"))
def yolo_head_decode(spark, sf_dir):
    """Boxes written as a model's head and read back."""
    import numpy as np
    import pandas as pd

    from terraframe.operators.vision import decode_head

    def one(pdf):
        b = pdf[["xmin", "ymin", "xmax", "ymax"]].to_numpy().T
        head = np.vstack([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1], pdf["conf"], np.tile(pdf["id"], (32, 1))])
        boxes, scores, coefficients = decode_head(head, 0.4)
        return pd.DataFrame({"id": coefficients[:, 0].astype("int64"), **{c: boxes[:, i] for i, c in enumerate(("x0", "y0", "x1", "y1"))}, "conf": scores})

    d = V.detections(spark, sf_dir).withColumn("tile", F.expr("k DIV 16")).groupBy("tile").applyInPandas(one, "id long, x0 double, y0 double, x1 double, y1 double, conf double")
    return d.select("id", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")], r6("conf").alias("conf"))


@query("mask_to_polygon", duck("SELECT id, round(area - 0.5, 6) AS alan FROM detections", "detections"))
def mask_to_polygon(spark, sf_dir):
    """Each box as a mask and its outer contour: a rectangle with its four corners cut."""
    import numpy as np
    import pandas as pd

    from terraframe.operators.vision import outer, signed

    def run(batches):
        for pdf in batches:
            area = [abs(signed(outer(np.ones((int(round(h)), int(round(w))), np.float32)))) for w, h in zip(pdf["w"], pdf["h"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "alan": area})

    d = V.detections(spark, sf_dir).select("id", (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"))
    return d.mapInPandas(run, "id long, alan double").withColumn("alan", r6("alan"))


@query(
    "letterbox",
    """
WITH s AS (SELECT p_partkey, p_size + 10 AS w, p_partkey % 40 + 10 AS h FROM part),
t AS (SELECT *, least(64.0::DOUBLE / w, 64.0::DOUBLE / h) AS scale FROM s), n AS (SELECT *, floor(w * scale + 0.5) AS nw, floor(h * scale + 0.5) AS nh FROM t)
SELECT p_partkey, round(scale, 6) AS olcek, CAST(floor((64 - nw) / 2) AS INTEGER) AS pad_x, CAST(floor((64 - nh) / 2) AS INTEGER) AS pad_y, round((nw * nh * 51 / 255.0 + (4096 - nw * nh) * 114 / 255.0) / 4096, 4) AS ortalama FROM n""",
)
def letterbox_query(spark, sf_dir):
    import numpy as np
    import pandas as pd

    from terraframe.operators.vision import letterbox

    def run(batches):
        for pdf in batches:
            got = [letterbox(np.full((h, w, 3), 51, np.uint8), 64) for w, h in zip(pdf["w"], pdf["h"], strict=True)]
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "olcek": [g[1] for g in got], "pad_x": [g[2] for g in got], "pad_y": [g[3] for g in got], "ortalama": [float(g[0].astype("float64").mean()) for g in got]})

    p = V.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 10).cast("int").alias("w"), (F.col("p_partkey") % 40 + 10).cast("int").alias("h"))
    return p.mapInPandas(run, "p_partkey long, olcek double, pad_x int, pad_y int, ortalama double").select("p_partkey", r6("olcek").alias("olcek"), "pad_x", "pad_y", F.round("ortalama", 4).alias("ortalama"))


@query(
    "blank_tile_filter",
    duck("SELECT r, c FROM (SELECT row // 2 AS r, col // 2 AS c, bool_and(v = 0) AS siyah, bool_and(v = 255) AS beyaz FROM (SELECT row, col, CASE WHEN z < 30 THEN 0 WHEN z > 50 THEN 255 ELSE z END AS v FROM dsm_cells) GROUP BY 1, 2) WHERE NOT siyah AND NOT beyaz", "dsm_cells"),
)
def blank_tile_filter(spark, sf_dir):
    """Tiles of two by two cells through the test that a worker makes of a tile's samples."""
    import numpy as np

    from terraframe.operators.vision import is_blank

    v = F.when(F.col("z") < 30, F.lit(0.0)).when(F.col("z") > 50, F.lit(255.0)).otherwise(F.col("z"))
    tiles = V.dsm_cells(spark, sf_dir).withColumn("v", v).groupBy(F.expr("row DIV 2").alias("r"), F.expr("col DIV 2").alias("c")).agg(F.collect_list("v").alias("v"))

    def run(batches):
        for pdf in batches:
            yield pdf.loc[[not is_blank(np.asarray(x)) for x in pdf["v"]], ["r", "c"]]

    return tiles.mapInPandas(run, "r long, c long")


@query("xml_escape", """SELECT p_partkey, replace(replace(replace(replace(p_name || ' <&"' || p_brand || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS metin FROM part""")
def xml_escape(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", escaped(F.concat("p_name", F.lit(' <&"'), "p_brand", F.lit(">"))).alias("metin"))


@query("head_listing", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 5")
def head_listing(spark, sf_dir):
    return sampling.head(V.table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 5)


@query("conf_filter_commutes_with_nms", duck("SELECT id FROM kept WHERE conf >= 0.5::DOUBLE", "detections", _KEPT))
def conf_filter_commutes_with_nms(spark, sf_dir):
    """Suppression above the filter equals the filter above suppression."""
    return greedy_nms(V.detections(spark, sf_dir).where("conf >= 0.5D"), 0.5, CELL).select("id")


@query("polygon_validity", duck("SELECT id, id % 2 = 1 AS gecerli, round(CASE WHEN id % 2 = 1 THEN area ELSE area / 2 END, 6) AS alan FROM detections", "detections"))
def polygon_validity(spark, sf_dir):
    """Boxes and bow ties: rings that cross themselves are told apart, and their area goes by the even-odd rule."""
    from terraframe.functions.overlap import polygon_overlap, polygon_valid

    x0, y0, x1, y1 = box()
    tie = F.array(G.point(x0, y0), G.point(x1, y1), G.point(x1, y0), G.point(x0, y1), G.point(x0, y0))
    d = V.detections(spark, sf_dir).select("id", F.array(F.when(F.col("id") % 2 == 1, G.box_ring(x0, y0, x1, y1)).otherwise(tie)).alias("geom"))
    return d.select("id", polygon_valid("geom").alias("gecerli"), r6(polygon_overlap("geom", "geom")).alias("alan"))
