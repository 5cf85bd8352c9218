"""Plane geometry as column expressions; a ring is array<struct<x: double, y: double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
METRES_PER_DEGREE = 111320.0


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def mercator(lon: Column, lat: Column) -> Column:
    """Web Mercator metres of degrees; latitudes are clamped to 89.9."""
    lat = F.greatest(F.lit(-89.9), F.least(F.lit(89.9), lat))
    return point(EARTH * F.radians(lon), EARTH * F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)))


def lon_lat(x: Column, y: Column) -> Column:
    return point(F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - F.pi() / 2))


def closed(ring: Column) -> Column:
    """ring with its first point again at its end, unless it is there."""
    first = F.element_at(ring, 1)
    return F.when((F.size(ring) > 0) & (first != F.element_at(ring, -1)), F.array_append(ring, first)).otherwise(ring)


def _edges(ring: Column, value) -> Column:
    """The sum of value(point, next point) over a closed ring."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + value(e["a"], e["b"]))


def cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(ring: Column) -> Column:
    return _edges(ring, cross) / 2


def perimeter(ring: Column) -> Column:
    return _edges(ring, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


def box(ring: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def centroid(ring: Column) -> Column:
    """By moments; of rings without area the middle of the box."""
    area, around = signed_area(ring), box(ring)
    part = lambda c: _edges(ring, lambda a, b: (a[c] + b[c]) * cross(a, b)) / (6 * area)
    middle = lambda c: (around[f"min_{c}"] + around[f"max_{c}"]) / 2
    return F.struct(*(F.when(area == 0, middle(c)).otherwise(part(c)).alias(c) for c in "xy"))


def translated(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: point(p["x"] + dx, p["y"] + dy))


def unit_square(ring: Column) -> Column:
    """ring moved and scaled into the unit square, its proportions kept, the shorter side in the middle."""
    around = box(ring)
    w, h = around["max_x"] - around["min_x"], around["max_y"] - around["min_y"]
    side = F.when(F.greatest(w, h) == 0, 1.0).otherwise(F.greatest(w, h))
    return F.transform(ring, lambda p: point((p["x"] - around["min_x"] + (side - w) / 2) / side, (p["y"] - around["min_y"] + (side - h) / 2) / side))


def circle(lon: Column, lat: Column, metres: Column, steps: int = 32) -> Column:
    """A closed ring of steps points around a place."""
    turn = lambda k: 2 * F.pi() * k / steps
    around = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda k: point(lon + metres / (METRES_PER_DEGREE * F.cos(F.radians(lat))) * F.cos(turn(k)), lat + metres / METRES_PER_DEGREE * F.sin(turn(k))),
    )
    return closed(around)


def is_upright_rectangle(ring: Column) -> Column:
    """Four corners with two distinct values in either direction, to a millionth."""
    distinct = lambda c: F.size(F.array_distinct(F.transform(ring, lambda p: F.round(p[c], 6))))
    corners = F.size(F.array_distinct(F.transform(ring, lambda p: point(F.round(p["x"], 6), F.round(p["y"], 6)))))
    return (corners == 4) & (distinct("x") == 2) & (distinct("y") == 2)


def inside(inner: Column, outer: Column) -> Column:
    """Whether a box lies within another, edges included."""
    return (inner["min_x"] >= outer["min_x"]) & (inner["max_x"] <= outer["max_x"]) & (inner["min_y"] >= outer["min_y"]) & (inner["max_y"] <= outer["max_y"])


def overlap(one: Column, two: Column) -> Column:
    """The area that two boxes share."""
    side = lambda c: F.greatest(F.lit(0.0), F.least(one[f"max_{c}"], two[f"max_{c}"]) - F.greatest(one[f"min_{c}"], two[f"min_{c}"]))
    return side("x") * side("y")


def default_bounds(width: Column, height: Column) -> Column:
    """A box 16 degrees high around 0, 0 in the proportions of an image; square where they are unknown."""
    half = F.when((width > 0) & (height > 0), 8.0 * width / height).otherwise(F.lit(8.0))
    return F.struct((-half).alias("min_x"), F.lit(-8.0).alias("min_y"), half.alias("max_x"), F.lit(8.0).alias("max_y"))
