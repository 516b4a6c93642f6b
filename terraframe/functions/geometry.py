"""Geometry as Catalyst expressions over rings (arrays of {x, y}) and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed counter-clockwise ring from the lower left corner."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _cross(ring: Column, term) -> Column:
    """Sum over the ring's edges of term(p, q)."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), term)
    return F.aggregate(edges, F.lit(0.0), lambda a, v: a + v)


def _about(ring: Column, o: Column) -> Column:
    return F.transform(ring, lambda p: point(p["x"] - o["x"], p["y"] - o["y"]))


def signed_area(ring: Column) -> Column:
    """About the ring's first point: products of far coordinates would cancel digits."""
    return _signed(_about(ring, F.get(ring, F.lit(0))))


def _signed(ring: Column) -> Column:
    return _cross(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, without sign."""
    return F.abs(signed_area(ring))


def polygon_area(geom: Column) -> Column:
    """The outer ring's area less the holes'."""
    holes = F.slice(geom, F.lit(2), F.greatest(F.size(geom) - 1, F.lit(0)))
    return ring_area(F.element_at(geom, 1)) - F.aggregate(F.transform(holes, ring_area), F.lit(0.0), lambda a, v: a + v)


def _moment(ring: Column, axis: str) -> Column:
    return _cross(ring, lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])) / 6


def centroid(geom: Column) -> Column:
    """Area-weighted centroid {x, y}; holes weigh against the outer ring. Null for an area of zero."""
    o = F.get(F.get(geom, F.lit(0)), F.lit(0))
    total = F.aggregate(F.transform(geom, lambda r, i: _weighted(_about(r, o), i)), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, v: F.struct((s["a"] + v["a"]).alias("a"), (s["x"] + v["x"]).alias("x"), (s["y"] + v["y"]).alias("y")))
    return F.struct((o["x"] + F.try_divide(total["x"], total["a"])).alias("x"), (o["y"] + F.try_divide(total["y"], total["a"])).alias("y"))


def _weighted(ring: Column, i: Column) -> Column:
    # each ring counts by its own orientation: outer rings for, holes against
    sign = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.when(_signed(ring) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.struct((_signed(ring) * sign).alias("a"), (_moment(ring, "x") * sign).alias("x"), (_moment(ring, "y") * sign).alias("y"))


def bbox(geom: Column) -> Column:
    """{xmin, ymin, xmax, ymax} of the outer ring."""
    xs, ys = F.transform(F.element_at(geom, 1), lambda p: p["x"]), F.transform(F.element_at(geom, 1), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def box_intersection(a: tuple, b: tuple) -> Column:
    """Area shared by boxes (x0, y0, x1, y1); zero if they don't overlap."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: tuple) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def box_iou(a: tuple, b: tuple, areas: tuple | None = None) -> Column:
    """Intersection over union of boxes; 0 if the union isn't positive. ``areas``, if known, spare the rounding of corner differences."""
    i = box_intersection(a, b)
    u = (areas[0] + areas[1] if areas else box_area(a) + box_area(b)) - i
    return F.when(u > 0, F.try_divide(i, u)).otherwise(F.lit(0.0))


def pixel_to_map(col: Column, row: Column, t: Column, offset: float = 0.5) -> Column:
    """Map coordinates of a pixel position, ``offset`` added to it first."""
    c, r = col + F.lit(offset), row + F.lit(offset)
    return point(t["a"] * c + t["b"] * r + t["c"], t["d"] * c + t["e"] * r + t["f"])


def ring_to_map(ring: Column, t: Column, offset: float = 0.5) -> Column:
    return F.transform(ring, lambda p: pixel_to_map(p["x"], p["y"], t, offset))


def shift(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: point(p["x"] + dx, p["y"] + dy))


def pixel_window(box: tuple, t: Column, width: Column, height: Column) -> Column:
    """Cells {c0, r0, c1, r1} that a map box touches on a north-up grid, clamped to it; ends included."""
    c0, c1 = (F.floor((x - t["c"]) / t["a"]) if k == 0 else F.ceil((x - t["c"]) / t["a"]) for k, x in ((0, box[0]), (1, box[2])))
    r0, r1 = (F.floor((y - t["f"]) / t["e"]) if k == 0 else F.ceil((y - t["f"]) / t["e"]) for k, y in ((0, box[3]), (1, box[1])))
    clamp = lambda v, hi: F.greatest(F.lit(0), F.least(v, hi - 1)).cast("int")
    return F.struct(clamp(c0, width).alias("c0"), clamp(r0, height).alias("r0"), clamp(c1, width).alias("c1"), clamp(r1, height).alias("r1"))


def point_in_polygon(geom: Column, x: Column, y: Column) -> Column:
    """Even-odd rule across all rings; an edge owns its lower end, so points on left and lower sides are inside."""
    def crossings(ring):
        hit = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"])
        return _cross(ring, lambda p, q: F.when(hit(q, p), F.lit(1.0)).otherwise(F.lit(0.0)))

    return F.aggregate(F.transform(geom, crossings), F.lit(0.0), lambda a, v: a + v) % 2 == 1


def in_box(x: Column, y: Column, box: tuple) -> Column:
    """Strictly inside."""
    return (x > box[0]) & (x < box[2]) & (y > box[1]) & (y < box[3])


def equivalent_diameter(area: Column) -> Column:
    """Diameter of the circle of that area."""
    return F.lit(2.0) * F.sqrt(area / F.pi())


def from_geojson(coordinates: Column) -> Column:
    """Polygon coordinates [[[x, y], ...], ...] as rings."""
    return F.transform(coordinates, lambda r: F.transform(r, lambda p: point(p[0], p[1])))


def to_geojson(geom: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.transform(geom, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
