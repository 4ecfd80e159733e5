"""Detected text polygons as Column expressions.

A polygon is a list of struct(x, y) with four points or more; a page has a list of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions.text import let
from sheafline.operators.ocr import median

POLYS = "array<array<struct<x:double,y:double>>>"


def _edges(poly: Column) -> Column:
    """dx, dy and length of each side, the closing one last."""
    def side(p: Column, q: Column, k: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        return F.struct(F.hypot(dx, dy).alias("length"), (-k).alias("first"), dx.alias("dx"), dy.alias("dy"))

    return F.transform(poly, lambda p, k: let(poly[(k + 1) % F.size(poly)], lambda q: side(p, q, k)))


def long_axis_angle(poly: Column) -> Column:
    """The direction of the longest side, the first of equals, in degrees above -90 up to 90."""
    turned = lambda a: F.when(a > 90, a - 180).when(a <= -90, a + 180).otherwise(a)
    angle = let(F.array_max(_edges(poly)), lambda side: F.degrees(F.atan2(side["dy"], side["dx"])))
    return F.when(F.size(poly) >= 4, let(angle, turned))


def elongation(poly: Column) -> Column:
    """Longest over shortest side; 1 for fewer than four points."""
    lengths = F.transform(_edges(poly), lambda e: e["length"])
    ratio = let(lengths, lambda of: F.array_max(of) / F.greatest(F.array_min(of), F.lit(1e-6)))
    return F.when(F.size(poly) >= 4, ratio).otherwise(F.lit(1.0))


def _span(poly: Column, axis: str) -> tuple[Column, Column]:
    values = F.transform(poly, lambda p: p[axis])
    return F.array_min(values), F.array_max(values)


def height(poly: Column) -> Column:
    low, high = _span(poly, "y")
    return high - low


def area(poly: Column) -> Column:
    """The area inside a polygon."""
    cross = F.transform(poly, lambda p, k: let(poly[(k + 1) % F.size(poly)], lambda q: p["x"] * q["y"] - q["x"] * p["y"]))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2


def median_text_height(polys: Column) -> Column:
    """The median height of a page's polygons; null without any."""
    return median(F.transform(polys, height))


def slender(polys: Column, least: float) -> Column:
    return F.filter(polys, lambda p: (elongation(p) >= least) & (F.size(p) >= 4))


def vertical_ratio(polys: Column, least: float = 1.5) -> Column:
    """The share of slender polygons that stand rather than lie; 0 for fewer than three."""
    return let(slender(polys, least), standing_ratio)


def standing_ratio(of: Column) -> Column:
    """vertical_ratio of polygons that are known to be slender."""
    standing = F.filter(of, lambda p: F.abs(long_axis_angle(p)) > 45)
    return F.when(F.size(of) >= 3, F.size(standing) / F.size(of)).otherwise(F.lit(0.0))


def circular_median(angles: Column) -> Column:
    """Of axis angles in degrees, the first that is nearest to all in the circle of doubled angles; 0 for none."""
    apart = lambda a, b: F.abs(let(F.radians(2 * (a - b)), lambda d: F.atan2(F.sin(d), F.cos(d))))
    # Sums are rounded, so that equal distances tie and the first angle is taken.
    tagged = lambda of: F.transform(of, lambda a, k: F.struct(F.round(F.aggregate(of, F.lit(0.0), lambda s, b: s + apart(a, b)), 9).alias("d"), k.alias("k"), a.alias("a")))
    return let(angles, lambda of: F.when(F.size(of) > 0, F.array_min(tagged(of))["a"]).otherwise(F.lit(0.0)))


def tilt(polys: Column, least: float = 2.0, samples: int = 3) -> Column:
    """A page's tilt in degrees by its slender polygons; null for too few."""
    return let(slender(polys, least), lambda of: F.when(F.size(of) >= samples, circular_median(F.transform(of, long_axis_angle))))


def union_box(polys: Column, width: Column, height_: Column, padding: int = 0) -> Column:
    """struct(x1, y1, x2, y2) around all points, padded and cut to the page; lower ends truncated, upper ones raised."""
    points = F.flatten(polys)
    of = lambda axis, end: end(F.transform(points, lambda p: p[axis]))
    low = lambda axis: F.greatest(F.lit(0), of(axis, F.array_min).cast("int") - padding)
    high = lambda axis, most: F.least(most, F.ceil(of(axis, F.array_max)).cast("int") + padding)
    return F.struct(low("x").alias("x1"), low("y").alias("y1"), high("x", width).alias("x2"), high("y", height_).alias("y2"))


def crop_box(poly: Column, width: Column, height_: Column, least: int = 10) -> Column:
    """The box to cut a polygon out by, or null where a side is under least pixels."""
    (x1, x2), (y1, y2) = _span(poly, "x"), _span(poly, "y")
    box = F.struct(F.greatest(F.lit(0), x1.cast("int")).alias("x1"), F.greatest(F.lit(0), y1.cast("int")).alias("y1"), F.least(width, x2.cast("int")).alias("x2"), F.least(height_, y2.cast("int")).alias("y2"))
    return F.when((box["x2"] - box["x1"] >= least) & (box["y2"] - box["y1"] >= least), box)


def shift(polys: Column, x: Column, y: Column) -> Column:
    """Polygons as seen from a crop that starts at x, y."""
    return F.transform(polys, lambda poly: F.transform(poly, lambda p: F.struct((p["x"] - x).alias("x"), (p["y"] - y).alias("y"))))


def rotate_quarters(polys: Column, quarters: Column, width: Column, height_: Column) -> Column:
    """Polygons after as many quarter turns counter-clockwise of a page of width by height."""
    q = F.pmod(quarters, F.lit(4))

    def turn(p: Column) -> Column:
        x = F.when(q == 1, p["y"]).when(q == 2, width - 1 - p["x"]).when(q == 3, height_ - 1 - p["y"]).otherwise(p["x"])
        y = F.when(q == 1, width - 1 - p["x"]).when(q == 2, height_ - 1 - p["y"]).when(q == 3, p["x"]).otherwise(p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(polys, lambda poly: F.transform(poly, turn))


def rotate_free(polys: Column, degrees: Column, width: Column, height_: Column) -> Column:
    """Polygons after a turn about the page's centre onto a canvas that holds the whole page."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    wide = F.floor(height_ * F.abs(sin) + width * F.abs(cos))
    high = F.floor(height_ * F.abs(cos) + width * F.abs(sin))
    cx, cy = width / 2, height_ / 2

    def turn(p: Column) -> Column:
        x, y = p["x"] - cx, p["y"] - cy
        return F.struct((cos * x + sin * y + wide / 2).alias("x"), (-sin * x + cos * y + high / 2).alias("y"))

    return F.transform(polys, lambda poly: F.transform(poly, turn))


def top_by_area(polys: Column, k: int) -> Column:
    """The k largest polygons, larger first, earlier first among equals."""
    tagged = F.array_sort(F.transform(polys, lambda p, i: F.struct((-area(p)).alias("a"), i.alias("i"), p.alias("p"))))
    return F.slice(F.transform(tagged, lambda t: t["p"]), 1, k)


def aspect(width: Column, height_: Column) -> Column:
    return F.when((width > 0) & (height_ > 0), F.greatest(width, height_) / F.greatest(F.lit(1), F.least(width, height_))).otherwise(F.lit(1.0))


def enough(polys: Column, least: int = 3) -> Column:
    """Polygons, or null where there are too few to be evidence."""
    return F.when(F.size(polys) >= least, polys)


def merge_spans(spans: Column, page: Column, least: float = 3.0) -> Column:
    """Gaps of least pixels or more between the union of spans struct(y0, y1), from 0 to the page's end."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["y0"].cast("double").alias("y0"), s["y1"].cast("double").alias("y1"))))
    start = F.struct(F.array().cast("array<struct<y0:double,y1:double>>").alias("gaps"), F.lit(0.0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["y0"] - acc["end"] >= least, F.concat(acc["gaps"], F.array(F.struct(acc["end"].alias("y0"), s["y0"].alias("y1"))))).otherwise(acc["gaps"])
        return F.struct(gap.alias("gaps"), F.greatest(acc["end"], s["y1"]).alias("end"))

    tail = lambda acc: F.when(page - acc["end"] >= least, F.concat(acc["gaps"], F.array(F.struct(acc["end"].alias("y0"), page.cast("double").alias("y1"))))).otherwise(acc["gaps"])
    return F.aggregate(ordered, start, step, tail)


def safe_splits(spans: Column, page: Column, columns: int, reach: float = 0.2) -> Column:
    """Heights at which to cut a page into columns, in gaps between lines near the even cuts; null if there are none."""
    def nearest(gaps: Column, target: Column) -> Column:
        at = lambda g: F.least(F.greatest(target, g["y0"] + 1), g["y1"] - 1)
        spots = F.transform(gaps, lambda g, i: let(at(g), lambda y: F.when((y > g["y0"]) & (y < g["y1"]), F.struct(F.abs(y - target).alias("d"), i.alias("i"), y.alias("y")))))
        return F.array_min(F.filter(spots, lambda s: s["d"] <= page * reach))["y"]

    def cut(cuts: Column, best: Column) -> Column:
        # A cut that is too near the one before makes a column too small to use.
        last = F.element_at(cuts, -1)
        return F.concat(cuts, F.array(F.bround(F.when((F.size(cuts) == 0) | (best - last >= page / (2 * columns)), best), 0)))

    none = F.array().cast("array<double>")
    bests = let(merge_spans(spans, page), lambda gaps: F.array(*(nearest(gaps, page * k / columns).cast("double") for k in range(1, columns))).cast("array<double>"))
    made = F.aggregate(bests, none, cut, lambda cuts: F.transform(cuts, lambda c: c.cast("int")))
    return let(made, lambda m: F.when(~F.exists(m, lambda c: c.isNull()), m))
