"""Golden cases and properties of the geospatial operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.config import MatchConfig
from terraframe.functions import crs, overlap, stats
from terraframe.functions import geometry as G
from terraframe.functions.prng import draws
from terraframe.operators import assignment, matching, raster_ops, sampling, vision
from terraframe.operators.components import connected_components
from terraframe.operators.nms import greedy_nms
from terraframe.operators.spatial_join import box_pairs, within_any
from terraframe.operators.sweep import threshold_sweep
from terraframe.operators.tiling import stride, tile_windows

BOX = "id long, xmin double, ymin double, xmax double, ymax double, conf double"


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def boxes(n, seed=1, span=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.random() * span, r.random() * span
        out.append((i, x, y, x + 4 + r.random() * 6, y + 4 + r.random() * 6, round(r.random(), 1)))
    return out


def iou(a, b):
    w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
    i = max(0, w) * max(0, h)
    return i / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - i)


def test_tiles(spark):
    go = lambda w, h: sorted(tuple(r) for r in tile_windows(spark.createDataFrame([(w, h)], "width int, height int")).select("y_off", "x_off", "w", "h").collect())
    assert go(3000, 2000) == [(0, 0, 1280, 1280), (0, 1024, 1280, 1280), (0, 2048, 952, 1280), (1024, 0, 1280, 976), (1024, 1024, 1280, 976), (1024, 2048, 952, 976)]
    assert len(go(1343, 1280)) == 1 and go(1344, 1280)[1] == (0, 1024, 320, 1280) and go(300, 5000) == [] and go(0, 0) == []
    with pytest.raises(ValueError):
        stride(1280, 1.0)


def test_draws_and_squares(spark):
    want = [0.6011037519201636, 0.44829055899754167, 0.8524657934904099, 0.6697340414393693, 0.17481389874592423, 0.5265925421845168]
    assert [r.u for r in draws(spark, 6).orderBy("k").collect()] == want
    s = sampling.accept(sampling.candidates(spark, 0, 0, 200, 150), 3).orderBy("square_id").collect()
    assert [(r.square_id, r.xmin, r.ymin) for r in s] == [(1, 102.18763782642782, 53.794867079705), (2, 144.91918489336967, 80.36808497272432), (3, 29.71836278680712, 63.191105062142015)]
    with pytest.raises(ValueError):
        sampling.candidates(spark, 0, 0, 20, 150)


def test_geometry(spark):
    t = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (0.5, 0.0, 100.0, 0.0, -0.5, 200.0), strict=True)])
    p = one(spark, G.pixel_to_map(F.lit(10), F.lit(20), t))
    assert (p.x, p.y) == (105.25, 189.75)
    ring = lambda a, b, c, d: G.box_ring(*[F.lit(float(v)) for v in (a, b, c, d)])
    assert one(spark, G.ring_area(ring(0, 0, 2, 3))) == 6
    holed = F.array(ring(0, 0, 4, 4), ring(0, 0, 2, 2))
    assert one(spark, G.polygon_area(holed)) == 12
    c = one(spark, G.centroid(holed))
    assert abs(c.x - (16 * 2 - 4) / 12) < 1e-12 and abs(c.y - c.x) < 1e-12
    assert abs(one(spark, G.equivalent_diameter(F.lit(math.pi))) - 2) < 1e-12
    b = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert abs(one(spark, G.box_iou(b(0, 0, 2, 2), b(1, 0, 3, 2))) - 1 / 3) < 1e-12
    assert one(spark, G.box_iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0
    unit = F.array(ring(0, 0, 1, 1))
    assert [one(spark, G.point_in_polygon(unit, F.lit(x), F.lit(y))) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.5))] == [True, False, False, True]
    j = one(spark, F.to_json(G.to_geojson(unit)))
    assert j == '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,1.0],[0.0,0.0]]]}'


def test_overlap():
    sq = lambda x, y, s=2.0: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]
    assert overlap.overlap_area(sq(0, 0), sq(1, 1)) == 1 and overlap.iou(sq(0, 0), sq(0, 0)) == 1 and overlap.overlap_area(sq(0, 0), sq(2, 0)) == 0
    tri = [[(0, 0), (4, 0), (0, 4), (0, 0)]]
    assert abs(overlap.overlap_area(tri, sq(0, 0, 4.0)) - 8) < 1e-12 and abs(overlap.overlap_area(tri, sq(1, 1)) - 2) < 1e-12
    holed = [*sq(0, 0, 4.0), *sq(1, 1)]
    assert overlap.even_odd_area(holed) == 12 and overlap.overlap_area(holed, sq(1, 1)) == 0
    assert overlap.is_simple(sq(0, 0)[0]) and not overlap.is_simple([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])
    r = random.Random(4)
    star = lambda cx, cy: [[(cx + q * math.cos(a), cy + q * math.sin(a)) for a, q in ((k * math.pi / 6, 1 + r.random()) for k in range(12))]]
    for _ in range(20):
        a, b = star(0, 0), star(r.random() * 2, r.random() * 2)
        i = overlap.overlap_area(a, b)
        assert abs(i - overlap.overlap_area(b, a)) < 1e-9 and i <= min(overlap.even_odd_area(a), overlap.even_odd_area(b)) + 1e-9
        shoelace = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a[0], a[0][1:] + a[0][:1], strict=True))) / 2
        assert abs(overlap.even_odd_area(a) - shoelace) < 1e-9


def test_crs():
    x, y = crs.to_utm(np.array([27.0, 29.5]), np.array([0.0, 41.0]), 35, False)
    assert abs(x[0] - 500000) < 1e-6 and abs(y[0]) < 1e-6
    # a quarter meridian arc is known to the millimetre
    assert abs(crs.to_utm(27.0, 45.0, 35, False)[1] - 0.9996 * 4984944.378) < 0.01
    lon, lat = crs.from_utm(x, y, 35, False)
    assert np.allclose(lon, [27.0, 29.5], atol=1e-10) and np.allclose(lat, [0.0, 41.0], atol=1e-10)
    east, north = crs.transform(x, y, "EPSG:32635", "EPSG:32636")
    back = crs.transform(east, north, "EPSG:32636", "EPSG:32635")
    assert np.allclose(back[0], x, atol=1e-5) and np.allclose(back[1], y, atol=1e-5)
    assert crs.to_utm(27.0, -10.0, 35, True)[1] < 1e7
    with pytest.raises(ValueError):
        crs.zone("EPSG:3857")


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(900, 900), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {n: n for e in edges if None not in e for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_nms(rows, t):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[0])):
        if all(iou(r, k) <= t for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


@pytest.mark.parametrize("fold", [1024, 2])
def test_nms(spark, fold):
    rows = boxes(150)
    df = spark.createDataFrame(rows, BOX)
    want = brute_nms(rows, 0.3)
    assert {r.id for r in greedy_nms(df, 0.3, 8.0, fold=fold).collect()} == want
    # a lower bound on the score commutes with suppression
    assert {r.id for r in greedy_nms(df.where("conf >= 0.5"), 0.3, 8.0, fold=fold).collect()} == {r[0] for r in rows if r[0] in want and r[5] >= 0.5}


def test_nms_edges(spark):
    # IoU equal to the threshold keeps both; a chain keeps its ends
    pair = [(1, 0.0, 0.0, 2.0, 2.0, 0.9), (2, 1.0, 0.0, 3.0, 2.0, 0.8)]
    assert greedy_nms(spark.createDataFrame(pair, BOX), 1 / 3, 8.0).count() == 2
    chain = [(1, 0.0, 0.0, 4.0, 1.0, 0.9), (2, 1.0, 0.0, 5.0, 1.0, 0.8), (3, 2.0, 0.0, 6.0, 1.0, 0.7)]
    assert {r.id for r in greedy_nms(spark.createDataFrame(chain, BOX), 0.5, 8.0).collect()} == {1, 3}
    assert greedy_nms(spark.createDataFrame([], BOX), 0.5, 8.0).count() == 0


def test_pairs(spark):
    rows = boxes(80)
    df = spark.createDataFrame(rows, BOX)
    got = sorted((r.l.id, r.r.id) for r in box_pairs(df, df, 3.0, F.col("l.id") < F.col("r.id")).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and iou(a, b) > 0)
    sq = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 20.0, 10.0)], "xmin double, ymin double, xmax double, ymax double")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 25.0, 5.0), (4, 19.0, 9.0)], "id long, x double, y double")
    assert {r.id for r in within_any(pts, sq, "x", "y", 4.0).collect()} == {1, 4}


def test_assignment(spark):
    trap = spark.createDataFrame([(0, 0, 0.50), (0, 1, 0.45), (1, 0, 0.49)], "t long, r long, iou double")
    assert sorted((x.t, x.r) for x in assignment.assign(trap).collect()) == [(0, 1), (1, 0)]
    assert matching.matches(trap, 0.5).count() == 0
    assert matching.matches(spark.createDataFrame([(0, 0, 0.5)], trap.schema), 0.5).count() == 1
    with pytest.raises(ValueError):
        MatchConfig(0.0)


def test_assignment_ties():
    """Against every matching: the largest total, then the smallest predictions in order of the references; equal gains are frequent."""
    from itertools import product

    def brute(g):
        best = None
        for choice in product(range(g.shape[0] + 1), repeat=g.shape[1]):
            used = [a for a in choice if a < g.shape[0]]
            if len(set(used)) < len(used) or any(a < g.shape[0] and not g[a, b] for b, a in enumerate(choice)):
                continue
            key = (-sum(g[a, b] for b, a in enumerate(choice) if a < g.shape[0]), choice)
            best = key if best is None or key < best else best
        return {(a, b) for b, a in enumerate(best[1]) if a < g.shape[0]}

    def found(g):
        t, r = np.nonzero(g)
        return {(int(t[k]), int(r[k])) for k in assignment.best_pairs(t, r, g[t, r])} if len(t) else set()

    rng = np.random.default_rng(3)
    for k in range(400):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 5))
        g = rng.integers(0, 4, (n, m)) / 4 if k % 4 else np.where(rng.random((n, m)) < 0.6, rng.random((n, m)), 0)
        assert found(g) == brute(g)
    # far beyond any dense threshold, and in a chain that a dense matrix would not hold
    assert found(np.full((60, 60), 0.5)) == {(i, i) for i in range(60)}
    assert found(np.full((30, 50), 0.5)) == {(i, i) for i in range(30)}
    n = 20_000
    t, r, w = np.repeat(np.arange(n), 2)[1:], np.repeat(np.arange(n), 2)[:-1], np.full(2 * n - 1, 0.5)
    assert assignment.best_pairs(t, r, w) == list(range(0, 2 * n - 1, 2))


def test_accuracy(spark):
    ids = lambda n: spark.createDataFrame([(i, 1.0 + i) for i in range(n)], "id long, area double")
    pairs = spark.createDataFrame([(i, i, 0.6) for i in range(3)], "t long, r long, iou double")
    f = matching.accuracy(pairs, ids(4), ids(5)).first()
    assert (f.tp, f.fp, f.fn) == (3, 1, 2) and (f.precision, f.recall) == (0.75, 0.6) and abs(f.f1 - 2 / 3) < 1e-9
    e = matching.accuracy(pairs.where("false"), ids(0), ids(5)).first()
    assert (e.precision, e.recall, e.f1, e.r2) == (0.0, 0.0, 0.0, None)
    xy = lambda rows: spark.createDataFrame(rows, "x double, y double").agg(stats.r_squared(F.col("x"), F.col("y")).alias("r"), stats.rmse(F.col("x"), F.col("y")).alias("e")).first()
    assert abs(xy([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]).r - 1) < 1e-12 and abs(xy([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]).e - math.sqrt(14 / 3)) < 1e-9
    assert xy([(1.0, 5.0), (2.0, 5.0)]).r == 0 and xy([(1.0, 5.0)]).r is None


def test_stats(spark):
    v = lambda xs: spark.createDataFrame([(x,) for x in xs], "v double")
    assert stats.measure_stats(v([1.0]), "v").first().std == 0 and stats.measure_stats(v([1.0, 2.0, 3.0]), "v").first().std == 1
    assert stats.measure_stats(v([]), "v").first().std is None
    assert abs(v([1.0, 2.0, 4.0]).agg(stats.percentile(F.col("v"), 0.95).alias("p")).first().p - 3.8) < 1e-12
    hist = lambda xs, n: [r.n for r in stats.histogram(v(xs), "v", n).orderBy("k").collect()]
    assert hist([0.0, 2.0, 10.0], 5) == [1, 1, 0, 0, 1] and hist([7.0] * 3, 3) == [3, 0, 0] and hist([], 3) == []
    assert one(spark, stats.nice_ticks(F.lit(0.0), F.lit(97.0))) == [0, 20, 40, 60, 80, 100]
    assert [r.r for r in v([1.005, 2.675, 0.125]).select(stats.exact_round(2)("v").alias("r")).collect()] == [1.0, 2.67, 0.13]
    nan = stats.nan_stats(v([1.0, float("nan"), 3.0, None]), "v").first()
    assert (nan.en_kucuk, nan.en_buyuk, nan.ortalama, nan.gecerli) == (1, 3, 2, 2)


def test_sweep(spark):
    kept = spark.createDataFrame([(0.3, 2.0), (0.5, 4.005)], "conf double, area double")
    rows = threshold_sweep(kept, (0.25, 0.5, 0.9)).orderBy("esik").collect()
    assert [(r.tespit_sayisi, r.toplam_alan_m2) for r in rows][::2] == [(2, 6.0), (0, 0.0)] or rows[0].tespit_sayisi == 2
    assert tuple(rows[2]) == (0.9, 0, 0.0, 0.0)


def test_rasters(spark):
    cells = [(0, 0, -9999.0, 1.0), (0, 1, 5.0, 6.0), (0, 2, 60.0, 5.0), (0, 3, 12.0, 2.0), (0, 4, 52.0, 2.0)]
    dsm = spark.createDataFrame([c[:3] for c in cells], "row int, col int, z double")
    dtm = spark.createDataFrame([(r, c, g) for r, c, _, g in cells], "row int, col int, z double")
    assert [r.v for r in raster_ops.chm(dsm, dtm, -9999.0).orderBy("col").collect()] == [None, 0.0, None, 10.0, 50.0]
    half = spark.createDataFrame([(float(i % 2),) for i in range(64)], "v double")
    assert half.agg(raster_ops.empty_ratio(F.col("v"), None).alias("e")).first().e == 0.5
    plane = spark.createDataFrame([(r, c, 2.0 * r + 3.0 * c) for r in range(4) for c in range(4)], "row int, col int, z double")
    fine = spark.createDataFrame([(r, c) for r in range(16) for c in range(16)], "row int, col int")
    for r in raster_ops.bilinear(fine, plane, 4).where("row between 2 and 13 and col between 2 and 13").collect():
        assert abs(r.ground - (2 * ((r.row + 0.5) / 4 - 0.5) + 3 * ((r.col + 0.5) / 4 - 0.5))) < 1e-9


def test_vision():
    chw, scale, px, py = vision.letterbox(np.full((10, 20, 3), 200, np.uint8), 40)
    assert scale == 2 and (px, py) == (0, 10) and np.allclose(chw[:, 10:30], 200 / 255) and np.allclose(chw[:, :10], 114 / 255)
    assert vision.is_blank(np.zeros((2, 2, 3))) and vision.is_blank(np.full((2, 2, 3), 255)) and not vision.is_blank(np.array([0, 255]))
    head = np.zeros((37, 3), np.float32)
    head[:5] = [[5, 5, 20], [5, 5, 20], [4, 4, 2], [4, 4, 2], [0.9, 0.4, 0.3]]
    boxes_, scores, coefficients = vision.decode_head(head, 0.4)
    assert len(scores) == 2 and boxes_[0].tolist() == [3, 3, 7, 7] and coefficients.shape == (2, 32)  # float32 0.4 passes 0.4
    assert vision.box_nms(boxes_, scores, 0.5).tolist() == [0]
    mask = np.zeros((9, 9), np.float32)
    mask[2:6, 3:8] = 1
    mask[3, 4] = 0
    mask[8, 0] = 1
    rings = vision.contours(mask)
    assert len(rings) == 3 and abs(abs(vision.signed(vision.outer(mask))) - 19.5) < 1e-9
    assert vision.outer(np.zeros((3, 3))) is None
    ring = vision.outer(mask)
    assert ring[:, 0].min() == 3 and ring[:, 0].max() == 8 and ring[:, 1].min() == 2 and ring[:, 1].max() == 6
    protos = np.full((32, 10, 10), 0.1, np.float32)
    m = vision.instance_mask(np.ones(32), protos, np.array([8.0, 8, 32, 32]), 40, 40, 40, 1.0, 0, 0)
    assert m[20, 20] > 0.9 and m[2, 2] == 0 and m[38, 20] == 0


def test_charts_and_text(spark):
    from terraframe.sources import charts
    from terraframe.sources.documents import shortest

    assert charts.ticks(0, 97) == [0, 20, 40, 60, 80, 100] and charts.ticks(0, 2, whole=True) == [0, 1, 2]
    assert "no data" in charts.histogram([], None, "t", "x", "y") and "&lt;" in charts.page("<", [])
    assert charts.scatter([1, 2], [1, 2], "t", "x", "y", "a\nb").count("<circle") == 2 and charts.line([0.2, 0.3], [5, 3], "t", "x", "y").count("<circle") == 2
    got = [r.s for r in spark.createDataFrame([(12345678.9,), (100.0,), (0.1,), (None,), (-2.5,)], "v double").select(shortest(F.col("v")).alias("s")).collect()]
    assert got == ["12345678.9", "100", "0.1", "", "-2.5"]


def test_exact_rounding(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from terraframe.functions import stats

    vs = [1.005, 2.5, -2.5, 0.125, 1.115, 2.675, -1.005, 0.0, -0.001, 1e18, 123456.785, 0.615, None, 3.0, 1e-9]
    got = [r.v for r in spark.createDataFrame([(v,) for v in vs], "v double").select(stats.exact_round(2)("v").alias("v")).collect()]
    assert got == [None if v is None else float(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) + 0.0 for v in vs] and got[0] == 1.0


def test_within_turned_square(spark):
    """A square that is turned admits what is inside of it, not of its bounding box."""
    ring = [(5.0, 0.0), (10.0, 5.0), (5.0, 10.0), (0.0, 5.0), (5.0, 0.0)]
    sq = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, [ring])], "xmin double, ymin double, xmax double, ymax double, geom array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 9.0, 6.5), (4, 7.0, 6.0)], "id int, x double, y double")
    assert {r.id for r in within_any(pts, sq, "x", "y", 3.0, "geom").collect()} == {1, 4}
    assert {r.id for r in within_any(pts, sq, "x", "y", 3.0).collect()} == {1, 2, 3, 4}


def test_fit_cell(spark):
    from terraframe.operators.spatial_join import fit_cell

    df = spark.createDataFrame([(0.0, 0.0, float(i % 4 + 1), 2.0) for i in range(100)], "xmin double, ymin double, xmax double, ymax double")
    assert fit_cell(df) == 8.0 and fit_cell(df.where("false")) > 0


def test_regridded(spark, tmp_path):
    """A plane comes back as it is; what lies outside or is no-data leaves its weight to the others."""
    from terraframe.sources import geotiff

    fine, coarse = str(tmp_path / "f.tif"), str(tmp_path / "c.tif")
    geotiff.write(fine, np.ones((40, 30), np.float32), (0.5, 0.0, 100.0, 0.0, -0.5, 200.0), 32635, tile=16)
    z = np.array([[2.0 * r + 3.0 * c for c in range(7)] for r in range(10)], np.float32)
    z[9, 6] = -1
    geotiff.write(coarse, z, (2.0, 0.0, 100.0, 0.0, -2.0, 200.0), 32635, nodata=-1)
    got = {(r.row, r.col): r.ground for r in geotiff.regridded(spark, fine, coarse, 16).collect()}
    assert len(got) == 1200
    at = lambda i: (i + 0.5) / 4 - 0.5
    assert all(abs(got[r, c] - (2 * at(r) + 3 * at(c))) < 1e-6 for r in range(2, 33) for c in range(2, 21))
    assert got[0, 0] == 0 and got[39, 27] is None and got[39, 29] is None and abs(got[0, 10] - 3 * at(10)) < 1e-6


def test_listings_and_tables(spark, tmp_path):
    from terraframe.functions import stats
    from terraframe.functions.text import xml, xml_escape
    from terraframe.operators import sampling
    from terraframe.plans import jobs, report
    from terraframe.sources import documents

    for name, n in (("train", 5), ("valid", 2)):
        (tmp_path / name / "images").mkdir(parents=True)
        for i in range(n):
            (tmp_path / name / "images" / f"{i}.jpg").write_bytes(b"x")
    (tmp_path / "train" / "notes.txt").write_text("no image")
    (tmp_path / "empty").mkdir()
    got = documents.image_counts(spark, {k: str(tmp_path / k) for k in ("train", "valid", "empty")}).collect()
    assert {(r.split, r.n, r.percent) for r in got} == {("train", 5, 71), ("valid", 2, 28), ("empty", 0, 0)}
    df = spark.range(50)
    some = [r.id for r in sampling.seeded(df, "id", 4).collect()]
    assert some == [r.id for r in sampling.seeded(df.repartition(7), "id", 4).collect()] and len(set(some)) == 4
    assert [r.id for r in sampling.head(df, "id", 3).collect()] == [0, 1, 2]
    jobs.write_metrics([("mAP50", 0.812345, 0.7)], spark, str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_text("utf-8-sig") == "Metrik,Box,Mask\nmAP50,0.8123,0.7\n"
    text = "a<b>&\"'"
    assert spark.createDataFrame([(text,)], "t string").select(xml_escape(F.col("t"))).first()[0] == xml(text) == "a&lt;b&gt;&amp;&quot;'"
    pairs = spark.createDataFrame([(1.0, 2.0), (1.001, 2.001), (9.0, 10.0), (None, 1.0)], "a double, b double")
    assert sorted((round(r.x, 2), r.n) for r in stats.binned(pairs, "a", "b", 16).collect()) == [(1.0, 2), (9.0, 1)]
    assert "Trees: 0" in report.detections({"n": 0})
