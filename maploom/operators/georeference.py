"""From pixels to places: fits, snapping to a coastline, and choice of keypoints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maploom.functions import geometry, kernels
from maploom.operators import polygons
from maploom.operators.scratch import written

RING = "array<struct<x: double, y: double>>"


def affine_fit(pairs: DataFrame, by: str, x: str = "x", y: str = "y", gx: str = "gx", gy: str = "gy") -> DataFrame:
    """Least-squares affine parameters of each group: gx = a x + b y + c, gy = d x + e y + f, their pairs and RMSE.

    Sums are taken about the group's means. Groups of fewer than three pairs, or of pairs in one line, have none.
    """
    means = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"_m{k}") for k, c in enumerate((x, y, gx, gy))))
    off = pairs.join(means, by).select(by, *((F.col(c) - F.col(f"_m{k}")).alias(f"d{k}") for k, c in enumerate((x, y, gx, gy))))
    sums = off.groupBy(by).agg(*(F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"s{i}{j}") for i in range(4) for j in range(i, 4)))
    c = F.col
    det = c("s00") * c("s11") - c("s01") * c("s01")
    slopes = {}
    for name, g in (("a", "2"), ("d", "3")):
        second = {"a": "b", "d": "e"}[name]
        slopes[name] = (c(f"s0{g}") * c("s11") - c(f"s1{g}") * c("s01")) / c("det")
        slopes[second] = (c(f"s1{g}") * c("s00") - c(f"s0{g}") * c("s01")) / c("det")
    fitted = sums.withColumn("det", det).join(means, by).where((c("n") >= 3) & (c("det") > 1e-9)).withColumns(slopes)
    left = lambda p, q, g: c(f"s{g}{g}") - c(p) * c(f"s0{g}") - c(q) * c(f"s1{g}")
    rmse = F.when(c("n") > 3, F.sqrt(F.greatest(F.lit(0.0), left("a", "b", 2) + left("d", "e", 3)) / (2 * c("n"))))
    offset = lambda p, q, m: c(m) - c(p) * c("_m0") - c(q) * c("_m1")
    return fitted.select(by, "n", "a", "b", offset("a", "b", "_m2").alias("c"), "d", "e", offset("d", "e", "_m3").alias("f"), rmse.alias("rmse"))


def affine_apply(rows: DataFrame, fits: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """rows with X and Y; rows of groups without a fit are left out."""
    c = F.col
    return rows.join(fits.select(by, *"abcdef"), by).withColumns({"X": c("a") * c(x) + c("b") * c(y) + c("c"), "Y": c("d") * c(x) + c("e") * c(y) + c("f")}).drop(*"abcdef")


def metres_per_pixel(a: Column, b: Column, d: Column, e: Column) -> Column:
    return (F.sqrt(a * a + d * d) + F.sqrt(b * b + e * e)) / 2


def snap_tolerance(diagonal: Column, metres: Column) -> Column:
    """A hundredth of the diagonal (8 pixels where it is unknown), within 3 to 40 pixels and 200 to 50,000 metres."""
    pixels = F.greatest(F.lit(3.0), F.least(F.lit(40.0), F.coalesce(diagonal * 0.01, F.lit(8.0))))
    return F.greatest(F.lit(200.0), F.least(F.lit(50000.0), pixels * metres))


#: Cells of points with tolerances of their own: the powers of two from 256 to 65,536 cover 200 to 50,000 metres.
LEVELS = (8, 16)


def snap_to_lines(points: DataFrame, segments: DataFrame, tolerance: float | str, key: str) -> DataFrame:
    """points (key, x, y) with the nearest place on segments (sid, x1, y1, x2, y2) at most tolerance away, else as they are.

    Both sides are dealt to square cells of the tolerance: a segment to all cells its box touches or borders on,
    so that only neighbours meet; they are merged, as a long segment is many rows. tolerance may name a column of points, up to 65,536: then cells are powers of two, and
    segments are dealt to each size. Returns key, x, y, moved.
    """
    c = F.col
    if isinstance(tolerance, str):
        low, high = LEVELS
        level = F.greatest(F.lit(low), F.ceil(F.log2(c(tolerance)))).cast("int")
        points = points.withColumns({"level": level, "reach": c(tolerance).cast("double")})
        segments = segments.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(high))))
        side = F.pow(F.lit(2.0), c("level"))
    else:
        points, segments = points.withColumns({"level": F.lit(0), "reach": F.lit(float(tolerance))}), segments.withColumn("level", F.lit(0))
        side = F.lit(float(tolerance))
    cell = lambda v: F.floor(v / side).cast("long")
    span = lambda p, q: F.sequence(cell(F.least(p, q)) - 1, cell(F.greatest(p, q)) + 1)
    spread = segments.select("*", F.explode(span(c("x1"), c("x2"))).alias("cx")).select("*", F.explode(span(c("y1"), c("y2"))).alias("cy"))
    met = points.select(key, "x", "y", "reach", "level", cell(c("x")).alias("cx"), cell(c("y")).alias("cy")).join(spread.hint("merge"), ["level", "cx", "cy"])
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    size = dx * dx + dy * dy
    along = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c("x") - c("x1")) * dx + (c("y") - c("y1")) * dy) / size)))
    placed = met.withColumn("t", along).select(key, "x", "y", "reach", "sid", (c("x1") + c("t") * dx).alias("nx"), (c("y1") + c("t") * dy).alias("ny"))
    away = placed.withColumn("d2", (c("nx") - c("x")) * (c("nx") - c("x")) + (c("ny") - c("y")) * (c("ny") - c("y"))).where(c("d2") <= c("reach") * c("reach"))
    best = away.groupBy(key).agg(F.min(F.struct("d2", "sid", "nx", "ny")).alias("best"))
    return points.select(key, "x", "y").join(best.hint("merge"), key, "left").select(key, F.coalesce("best.nx", "x").alias("x"), F.coalesce("best.ny", "y").alias("y"), c("best").isNotNull().alias("moved"))


def spaced_keypoints(points: DataFrame, by: str, apart: float = 10.0, most: int = 10) -> DataFrame:
    """Of each group at most `most` points (x, y, response, id), strongest first, each at least apart from those chosen.

    The fold goes on from the strongest; a group's candidates are a sorted list, as an image has few.
    """
    listed = points.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("response")).alias("r"), "id", "x", "y"))).alias("ps"))

    def take(acc, p):
        near = F.exists(acc, lambda q: (q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]) < apart * apart)
        return F.when((F.size(acc) >= most) | near, acc).otherwise(F.array_append(acc, p))

    chosen = listed.select(by, F.aggregate("ps", F.slice("ps", 1, 0), take).alias("chosen"))
    return chosen.select(by, F.posexplode("chosen").alias("rank", "p")).select(by, "rank", "p.id", "p.x", "p.y", (-F.col("p.r")).alias("response"))


def keypoints_with_fallback(points: DataFrame, more: DataFrame, by: str, apart: float = 10.0, most: int = 10) -> DataFrame:
    """spaced_keypoints of points, and where a group has fewer than `most` of them those of `more` in their place.

    points are what was found with a coast alone, more what was found with lakes as well; used_lakes says which. Groups of
    either are returned, if they have a keypoint.
    """
    first = written(spaced_keypoints(points, by, apart, most))
    enough = first.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most).select(by)
    rest = spaced_keypoints(more.join(enough, by, "left_anti"), by, apart, most)
    return first.join(enough, by, "left_semi").withColumn("used_lakes", F.lit(False)).unionByName(rest.withColumn("used_lakes", F.lit(True)))


def rasterised(lines: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int, by: list[str]) -> DataFrame:
    """by, px, py of the pixels of a picture of bounds (west, south, east, north) that lines (by, points) touch.

    points is an array of x, y. Those beyond the bounds are left out and their neighbours joined; a line of one point that is
    left has no pixels. A pixel is touched no more than a pixel and a half from a line's way between the pixels of its
    points, in whole numbers throughout. Each segment's pixels are steps along its longer side and a few across.
    """
    c = F.col
    west, south, east, north = bounds
    whole = lambda v, n: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), v.cast("long")))
    inside = F.filter("points", lambda p: p["x"].between(west, east) & p["y"].between(south, north))
    drawn = F.transform(inside, lambda p: F.struct(whole((p["x"] - west) / (east - west) * width, width).alias("x"), whole((north - p["y"]) / (north - south) * height, height).alias("y")))
    rows = lines.select(*by, drawn.alias("_d")).where(F.size("_d") > 1)
    pairs = F.arrays_zip(F.slice("_d", 1, F.size("_d") - 1).alias("a"), F.slice("_d", 2, F.size("_d") - 1).alias("b"))
    ends = rows.select(*by, F.explode(F.array_distinct(pairs)).alias("e")).select(*by, *(c(f"e.{e}.{d}").alias(f"{d}{n}") for e, n in (("a", 1), ("b", 2)) for d in "xy")).distinct()
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    flat = F.abs(dx) >= F.abs(dy)
    long, first, other, run, rise = (F.when(flat, p).otherwise(q) for p, q in ((F.abs(dx), F.abs(dy)), (c("x1"), c("y1")), (c("y1"), c("x1")), (dx, dy), (dy, dx)))
    steps = ends.withColumn("_k", F.explode(F.sequence(F.lit(-2).cast("long"), long + 2))).withColumn("_o", F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))))
    along = first + F.when(run >= 0, c("_k")).otherwise(-c("_k"))
    across = other + F.when(long > 0, F.rint(rise * c("_k") / long)).otherwise(0).cast("long") + c("_o")
    # by way of inline, so that the place is computed once and not wherever it is named
    place = F.struct(F.when(flat, along).otherwise(across).alias("px"), F.when(flat, across).otherwise(along).alias("py"))
    at = steps.select(*by, "x1", "y1", "x2", "y2", F.inline(F.array(place)))
    square = lambda u, v: u * u + v * v
    wx, wy = c("px") - c("x1"), c("py") - c("y1")
    size, dot, cross = square(dx, dy), wx * dx + wy * dy, wx * dy - wy * dx
    near = F.when(dot <= 0, 4 * square(wx, wy) <= 9).when(dot >= size, 4 * square(c("px") - c("x2"), c("py") - c("y2")) <= 9).otherwise(4 * cross * cross <= 9 * size)
    return at.where(near & c("px").between(0, width - 1) & c("py").between(0, height - 1)).select(*by, "px", "py").distinct()


def _points(ring) -> np.ndarray:
    """The corners of a closed ring."""
    return np.array([(p["x"], p["y"]) for p in ring[:-1]]).reshape(-1, 2)


def snapped_rings(shapes: DataFrame, segments: DataFrame, tolerance: float, key: str) -> DataFrame:
    """shapes (key, ring) with the corners of their closed rings on the nearest segment, and how many of them moved.

    A ring that would cross or touch itself keeps its place and counts none; a corner that stands where the one before it
    does is no touch. key is one column, unique.
    """
    c = F.col
    corners = shapes.select(c(key), F.posexplode(F.slice("ring", 1, F.size("ring") - 1)).alias("n", "p")).select(F.struct(c(key).alias("k"), "n").alias("corner"), "p.x", "p.y")
    moved = snap_to_lines(corners, segments, tolerance, "corner").where("moved")
    placed = moved.groupBy(c("corner.k").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("corner.n", geometry.point(c("x"), c("y"))))).alias("to"))
    at = lambda n, p: F.coalesce(F.try_element_at("to", n), p)
    new = geometry.closed(F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda p, n: at(n, p)))
    rows = shapes.join(placed.hint("merge"), key, "left").withColumn("new", F.when(c("to").isNotNull(), new)).withColumn("fits", _simple(c("new")))
    return rows.withColumns({"ring": F.when(c("fits"), c("new")).otherwise(c("ring")), "snapped": F.when(c("fits"), F.size("to")).otherwise(0)}).drop("to", "new", "fits")


@F.pandas_udf(T.BooleanType())
def _simple(rings: pd.Series) -> pd.Series:
    once = lambda ring: ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)]
    return pd.Series([r is not None and kernels.is_simple(once(_points(r))) for r in rings], dtype=bool)


def georeferenced(features: DataFrame, pairs: DataFrame, by: str, key: str, segments: DataFrame | None = None, tolerance: float = 200.0) -> DataFrame:
    """features (by, key, ring in pixels) in degrees, with what a georeferenced feature says of itself.

    pairs (by, x, y, gx, gy) are pixels and their Web Mercator metres; features of a group without a fit of three pairs
    or more are left out. Corners no further than tolerance metres from segments go there (snapped_rings). key is unique.
    """
    c = F.col
    fits = affine_fit(pairs, by).select(by, *"abcdef", "rmse")
    to = lambda p: geometry.point(c("a") * p["x"] + c("b") * p["y"] + c("c"), c("d") * p["x"] + c("e") * p["y"] + c("f"))
    rows = features.join(fits.hint("merge"), by).withColumn("ring", F.transform(geometry.closed(c("ring")), to)).drop(*"abcdef")
    rows = rows.withColumn("snapped", F.lit(0)) if segments is None else snapped_rings(rows, segments, tolerance, key)
    says = {"is_pixel_space": F.lit(False), "is_georeferenced": F.lit(True), "crs": F.lit("EPSG:4326"), "transform_method": F.lit("affine"), "rmse_meters": F.round(F.coalesce("rmse", F.lit(0.0)), 2)}
    return rows.withColumns({"ring": F.transform("ring", lambda p: geometry.lon_lat(p["x"], p["y"])), **says}).drop("rmse")


def georeferenced_polygons(
    features: DataFrame, pairs: DataFrame, by: str, key: str, segments: DataFrame | None = None, land: DataFrame | None = None, diagonal_share: float = 0.01, least: float = 0.01, side: float = 100_000.0
) -> DataFrame:
    """features (by, key, polygons in pixels and others) in degrees, holes with them, and what each says of itself.

    As georeferenced; but corners snap within a tolerance of their own collection, diagonal_share of the diagonal around
    its shells in pixels, held within 3 to 40 pixels and 200 to 50,000 metres (snap_tolerance), and with land (polygons in
    metres) each feature is clipped to it. Features of which less than `least` is on land are left out. key is unique.
    """
    c = F.col
    fits = affine_fit(pairs, by).select(by, *"abcdef", "rmse")
    around = features.select(by, polygons.box(c("polygons")).alias("box")).groupBy(by).agg(*(f(f"box.{n}_{d}").alias(f"{n}_{d}") for n, f in (("min", F.min), ("max", F.max)) for d in "xy"))
    w, h = c("max_x") - c("min_x"), c("max_y") - c("min_y")
    reach = snap_tolerance(F.sqrt(w * w + h * h) * (diagonal_share / 0.01), metres_per_pixel(*map(F.col, "abde")))
    fits = fits.join(around, by).withColumn("reach", reach).drop("min_x", "min_y", "max_x", "max_y")
    mapped = lambda to: F.transform("polygons", lambda p: F.struct(F.transform(p["shell"], to).alias("shell"), F.transform(p["holes"], lambda r: F.transform(r, to)).alias("holes")))
    to = lambda p: geometry.point(c("a") * p["x"] + c("b") * p["y"] + c("c"), c("d") * p["x"] + c("e") * p["y"] + c("f"))
    rows = features.join(fits.hint("merge"), by).withColumn("polygons", mapped(to)).drop(*"abcdef")
    rows = rows.withColumn("snapped", F.lit(0)) if segments is None else polygons.snapped(rows, segments, "reach", key)
    if land is not None:
        rows = rows.drop("polygons").join(polygons.clipped_to_land(rows.select(key, "polygons"), land, key, least, side).drop("land_share").hint("merge"), key)
    says = {"is_pixel_space": F.lit(False), "is_georeferenced": F.lit(True), "crs": F.lit("EPSG:4326"), "transform_method": F.lit("affine"), "rmse_meters": F.round(F.coalesce("rmse", F.lit(0.0)), 2)}
    return rows.withColumns({"polygons": mapped(lambda p: geometry.lon_lat(p["x"], p["y"])), **says}).drop("rmse", "reach")
