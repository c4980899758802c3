"""Points, quads and polygons as column expressions.

point: struct<x,y>; quad: struct<hg,hd,bd,bg: point>, clockwise from top-left;
polygon: array<point> with an implicit closing edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(hg: Column, hd: Column, bd: Column, bg: Column) -> Column:
    return F.struct(hg.alias("hg"), hd.alias("hd"), bd.alias("bd"), bg.alias("bg"))


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Axis-aligned quad."""
    return quad(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def width(q: Column) -> Column:
    """Mean of top and bottom side."""
    return (distance(q["hg"], q["hd"]) + distance(q["bg"], q["bd"])) / 2


def height(q: Column) -> Column:
    return (distance(q["hg"], q["bg"]) + distance(q["hd"], q["bd"])) / 2


def corners(q: Column) -> Column:
    return F.array(q["hg"], q["hd"], q["bd"], q["bg"])


def centre_x(q: Column) -> Column:
    return (q["hg"]["x"] + q["hd"]["x"] + q["bd"]["x"] + q["bg"]["x"]) / 4


def centre_y(q: Column) -> Column:
    return (q["hg"]["y"] + q["hd"]["y"] + q["bd"]["y"] + q["bg"]["y"]) / 4


def angle(q: Column) -> Column:
    """Degrees of the top and bottom edges together; positive slopes down to the right."""
    dx = (q["hd"]["x"] - q["hg"]["x"]) + (q["bd"]["x"] - q["bg"]["x"])
    dy = (q["hd"]["y"] - q["hg"]["y"]) + (q["bd"]["y"] - q["bg"]["y"])
    return F.atan2(dy, dx) * 180 / F.pi()


def bottom(q: Column) -> Column:
    """The lower of the two bottom corners."""
    return F.greatest(q["bg"]["y"], q["bd"]["y"])


def bounds(points: Column) -> Column:
    """struct<x0,y0,x1,y1> of an array of points; null members for none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def bounding_quad(quads: Column) -> Column:
    """Axis-aligned box around all corners of an array of quads."""
    b = bounds(F.flatten(F.transform(quads, corners)))
    return rectangle(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])


def centroid(points: Column) -> Column:
    """Mean of the vertices; (0, 0) for none."""
    n = F.size(points)
    total = lambda name: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[name])
    mean = lambda name: F.when(n > 0, total(name) / n).otherwise(F.lit(0.0))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def contains(points: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast; the boundary is undefined, fewer than three points contain nothing."""
    n = F.size(points)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(points, i), F.element_at(points, F.when(i == 1, n).otherwise(i - 1))
        across = (a["y"] > y) != (b["y"] > y)
        return across & F.when(across, x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"]).otherwise(F.lit(False))

    inside = F.aggregate(F.sequence(F.lit(1), n), F.lit(False), lambda acc, i: acc != crosses(i))
    return F.when(F.coalesce(n, F.lit(0)) < 3, F.lit(False)).otherwise(inside)


def usable(points: Column) -> Column:
    """A bubble counts from three points on."""
    return F.coalesce(F.size(points) >= 3, F.lit(False))


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """From a point to the segment a-b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(length > 0, length).otherwise(F.lit(1.0))))).otherwise(F.lit(0.0))
    return distance(F.struct(x.alias("x"), y.alias("y")), F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y")))


def relabelled(points: Column) -> Column:
    """Quad of four points in any order: the two highest are the top, each pair from left to right."""
    by_y = F.transform(F.array_sort(F.transform(points, lambda p, i: F.struct(p["y"].alias("k"), i.alias("i"), p.alias("p")))), lambda s: s["p"])
    pair = lambda a, b: F.array_sort(F.transform(F.array(a, b), lambda p, i: F.struct(p["x"].alias("k"), i.alias("i"), p.alias("p"))))
    top, low = pair(by_y[0], by_y[1]), pair(by_y[2], by_y[3])
    return quad(top[0]["p"], top[1]["p"], low[1]["p"], low[0]["p"])


def overlap(a: Column, b: Column) -> Column:
    """Intersection of two boxes struct<x,y,w,h> over the smaller area; 0 if that is empty."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    small = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when((small > 0) & (w > 0) & (h > 0), w * h / F.when(small > 0, small)).otherwise(F.lit(0.0))


def covers(points: Column, box: Column, share: float = 0.8) -> Column:
    """Whether the polygon's bounds reach `share` of the box on both axes."""
    b = bounds(points)
    return F.coalesce((b["x1"] - b["x0"] >= share * box["w"]) & (b["y1"] - b["y0"] >= share * box["h"]), F.lit(False))


def expanded(box: Column, page_w: Column, page_h: Column, by: int = 12) -> Column:
    """The box grown on each side, within the page, one pixel at least."""
    x0, y0 = F.greatest(F.lit(0), box["x"] - by), F.greatest(F.lit(0), box["y"] - by)
    x1, y1 = F.least(page_w, box["x"] + box["w"] + by), F.least(page_h, box["y"] + box["h"] + by)
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(F.lit(1), x1 - x0).alias("w"), F.greatest(F.lit(1), y1 - y0).alias("h"))
