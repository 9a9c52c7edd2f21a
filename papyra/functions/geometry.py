"""Rectangles as structs (x0, y0, x1, y1) of doubles, and the arithmetic of page coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def area(r: Column) -> Column:
    """0 for an empty rectangle."""
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def pad(r: Column, by: float) -> Column:
    return rect(r["x0"] - by, r["y0"] - by, r["x1"] + by, r["y1"] + by)


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (inner["x1"] <= outer["x1"]) & (inner["y1"] <= outer["y1"])


def intersects(a: Column, b: Column) -> Column:
    return area(intersection(a, b)) > 0


def covered_share(inner: Column, cover: Column) -> Column:
    """Share of ``inner`` under ``cover``; null where ``inner`` is empty."""
    return F.when(area(inner) > 0, area(intersection(inner, cover)) / area(inner))


def flip(r: Column, height: Column) -> Column:
    """From y downwards to y upwards, or back."""
    return rect(r["x0"], height - r["y1"], r["x1"], height - r["y0"])


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot((a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2, (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def transform_point(m: Column, x: Column, y: Column) -> Column:
    """(x, y) under the matrix [a, b, c, d, e, f]."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def invert_2x2(m: Column) -> Column:
    """Inverse of the linear part [a, b, c, d]; null where it has none."""
    det = m[0] * m[3] - m[1] * m[2]
    return F.when(det != 0, F.array(m[3] / det, -m[1] / det, -m[2] / det, m[0] / det))


def rotation(degrees: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Matrix that brings a page box rotated by a multiple of 90 degrees to the origin."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return (
        F.when(degrees == 90, F.array(zero, -one, one, zero, -y0, x1))
        .when(degrees == 180, F.array(-one, zero, zero, -one, x1, y1))
        .when(degrees == 270, F.array(zero, one, -one, zero, y1, -x0))
        .otherwise(F.array(one, zero, zero, one, -x0, -y0))
    )


def fitted(height: Column, width: Column, target: int, stride: int) -> Column:
    """Height and width of an image scaled into ``target`` and padded to a multiple of ``stride``."""
    ratio = F.least(F.lit(float(target)) / height, F.lit(float(target)) / width)
    h, w = F.bround(height * ratio).cast("int"), F.bround(width * ratio).cast("int")
    up = lambda v: (v + F.pmod(F.lit(target) - v, F.lit(stride))).cast("int")
    return F.struct(up(h).alias("height"), up(w).alias("width"), ratio.alias("ratio"))


def rescaled(box: Column, height: Column, width: Column, to_height: Column, to_width: Column) -> Column:
    """A box of the fitted image in the coordinates of the original, its padding taken off."""
    gain = F.least(height / to_height, width / to_width)
    px, py = F.bround((width - to_width * gain) / 2 - 0.1), F.bround((height - to_height * gain) / 2 - 0.1)
    return rect((box["x0"] - px) / gain, (box["y0"] - py) / gain, (box["x1"] - px) / gain, (box["y1"] - py) / gain)
