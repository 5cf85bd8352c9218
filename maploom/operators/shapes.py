"""Shapes after their outlines are found: filters, duplicates, ideal forms and their features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maploom.functions import geometry, kernels, overlay
from maploom.operators import polygons
from maploom.operators.scratch import written


def area_filter(shapes: DataFrame, area: str, points: str, image_area: float, least: float = 50.0, most: float = 5000.0) -> DataFrame:
    """Shapes of three points at least, of an area from least to most, that fill half of the image at most."""
    return shapes.where(F.col(area).between(least, most) & (F.col(area) / image_area <= 0.5) & (F.col(points) >= 3))


def circle_points(x: Column, y: Column, radius: Column) -> Column:
    """A closed ring around x, y: a point for every 3 pixels of the circumference, 32 to 360 of them, radius 2 at least."""
    r = F.greatest(radius, F.lit(2.0))
    n = F.least(F.lit(360), F.greatest(F.lit(32), F.ceil(2 * F.pi() * r / 3))).cast("int")
    turn = lambda k: 2 * F.pi() * k / n
    return geometry.closed(F.transform(F.sequence(F.lit(0), n - 1), lambda k: geometry.point(F.round(x + r * F.cos(turn(k)), 3), F.round(y + r * F.sin(turn(k)), 3))))


#: The outline of what is neither circle nor rectangle keeps within this share of its perimeter.
APPROXIMATION = 0.001
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_MEASURES = pa.struct([*((c, pa.float64()) for c in ("area", "perimeter", "min_x", "min_y", "max_x", "max_y", "x", "y")), ("hull_area", pa.float64()), ("rect_area", pa.float64()), ("rect", pa.list_(_POINT)), ("circle", pa.struct([("x", pa.float64()), ("y", pa.float64()), ("r", pa.float64())])), ("outline", pa.list_(_POINT))])
MEASURES = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("area", "perimeter", "min_x", "min_y", "max_x", "max_y", "x", "y", "hull_area", "rect_area")]
    + [T.StructField("rect", polygons.RING)]
    + [T.StructField("circle", T.StructType([T.StructField(c, T.DoubleType()) for c in "xyr"])), T.StructField("outline", polygons.RING)]
)


def _listed(rings: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros((0, 2)), *rings])
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(_POINT))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]), pa.int32()), points)


def _measured(rings: list[np.ndarray]) -> pa.StructArray:
    """The measures of rings of a point or more; sums over sides for all rings at once."""
    sizes = np.array([len(r) for r in rings], np.int64)
    first, after = overlay.round_trips(sizes)
    flat = np.concatenate(rings)
    low, high = np.minimum.reduceat(flat, first), np.maximum.reduceat(flat, first)
    d = flat - np.repeat(low, sizes, axis=0)
    cross = d[:, 0] * d[after, 1] - d[after, 0] * d[:, 1]
    total, moments = np.add.reduceat(cross, first), np.add.reduceat((d + d[after]) * cross[:, None], first)
    length = np.add.reduceat(np.sqrt(((flat[after] - flat) ** 2).sum(axis=1)), first)
    flatten = total == 0
    middle = low + np.where(flatten[:, None], (high - low) / 2, moments / np.where(flatten, 1, 3 * total)[:, None])
    hulls = [kernels.hull(r) for r in rings]
    corners, circles = [kernels.rectangle_around(h) for h in hulls], np.array([kernels.circle_around(h) for h in hulls])
    outlines = [kernels.simplified_ring(r, APPROXIMATION * t) for r, t in zip(rings, length.tolist(), strict=True)]
    around = lambda shapes: overlay.area_each([[(r, [])] for r in shapes])
    numbers = [np.abs(total) / 2, length, low[:, 0], low[:, 1], high[:, 0], high[:, 1], middle[:, 0], middle[:, 1], around(hulls), around(corners)]
    circle = pa.StructArray.from_arrays([pa.array(circles[:, k]) for k in range(3)], fields=list(_MEASURES.field("circle").type))
    return pa.StructArray.from_arrays([*map(pa.array, numbers), _listed(corners), circle, _listed(outlines)], fields=list(_MEASURES))


@polygons.kernel(MEASURES)
def _measures(rings: pa.Array) -> pa.Array:
    rings = rings.combine_chunks() if isinstance(rings, pa.ChunkedArray) else rings
    own = polygons.rings_of(rings)
    some = [r for r in own if len(r)]
    if not some:
        return pa.nulls(len(own), _MEASURES)
    place = np.cumsum([len(r) > 0 for r in own]) - 1
    return _measured(some).take(pa.array(place, mask=np.array([not len(r) for r in own])))


def measures(ring: Column) -> Column:
    """Of a closed ring: area, perimeter, its box (min_x, min_y, max_x, max_y), its centroid (x, y; the middle of the box of a
    ring without area); hull_area; rect_area and rect, the least rectangle around it; circle, the least circle around it;
    outline, its points without those within a thousandth of its perimeter. Null for empty rings."""
    return _measures(ring)


def described(shapes: DataFrame, ring: str = "ring") -> DataFrame:
    """shapes with what is measured on their closed ring of pixels: area, perimeter, bounding_box, center, aspect_ratio,
    extent, solidity, rect_score, num_vertices, and measures. Boxes count their last pixels in."""
    c, m = F.col, lambda n: F.col(f"measures.{n}")
    w, h = m("max_x") - m("min_x") + 1, m("max_y") - m("min_y") + 1
    whole = lambda v: F.floor(v).cast("int")
    rows = shapes.withColumn("measures", measures(c(ring)))
    share = lambda a, b, n: F.round(F.when(b > 0, a / b).otherwise(0.0), n)
    return rows.withColumns({
        "area": m("area"), "perimeter": m("perimeter"),
        "bounding_box": F.struct(whole(m("min_x")).alias("x"), whole(m("min_y")).alias("y"), whole(w).alias("width"), whole(h).alias("height")),
        "center": F.struct(m("x").cast("int").alias("x"), m("y").cast("int").alias("y")),
        "aspect_ratio": share(w, h, 2), "extent": share(m("area"), w * h, 3), "solidity": share(m("area"), m("hull_area"), 3),
        "rect_score": share(m("area"), m("rect_area"), 3), "num_vertices": F.size("measures.outline"),
    })


def classified(shapes: DataFrame, circles: DataFrame, by: str, key: str, near: float = 15.0) -> DataFrame:
    """Described shapes (by, key, area, perimeter, center, rect_score) with shape_type.

    A circle is rounder than 0.85 and has a given circle (by, x, y) less than near pixels from its centre in both
    directions; a rectangle fills more than 0.85 of the least rectangle around it; all else is unknown. Centres meet
    the circles of their cell and those around it, cells of that size, in one join: shapes are measured once.
    """
    c = F.col
    cell = lambda v: F.floor(v / near).cast("long")
    around = lambda v: F.explode(F.sequence(cell(v) - 1, cell(v) + 1))
    spots = circles.select(by, c("x").alias("hx"), c("y").alias("hy")).withColumn("gx", around(c("hx"))).withColumn("gy", around(c("hy")))
    listed = spots.groupBy(by, "gx", "gy").agg(F.collect_set(F.struct("hx", "hy")).alias("_spots"))
    close = lambda s: (F.abs(s["hx"] - c("center.x")) < near) & (F.abs(s["hy"] - c("center.y")) < near)
    round_ = F.when(c("perimeter") > 0, 4 * F.pi() * c("area") / (c("perimeter") * c("perimeter"))).otherwise(0.0)
    kind = F.when((round_ > 0.85) & F.coalesce(F.exists("_spots", close), F.lit(False)), "Circle").when(c("rect_score") > 0.85, "Rectangle").otherwise("Shape unknown")
    placed = shapes.withColumns({"gx": cell(c("center.x")), "gy": cell(c("center.y"))})
    return placed.join(listed.hint("merge"), [by, "gx", "gy"], "left").withColumn("shape_type", kind).drop("_spots", "gx", "gy")


def idealised(kind: Column, measured: Column) -> Column:
    """The points (not closed) of a shape of this kind, of its measures: for a rectangle the corners of the least one
    around it, for a circle points on the least circle around it, else its outline. 3 decimals."""
    circle = measured["circle"]
    round_ = lambda ring: F.transform(ring, lambda p: geometry.point(F.round(p["x"], 3), F.round(p["y"], 3)))
    points = circle_points(circle["x"], circle["y"], circle["r"])
    return F.when(kind == "Circle", F.slice(points, 1, F.size(points) - 1)).when(kind == "Rectangle", round_(measured["rect"])).otherwise(round_(measured["outline"]))


def post_filtered(shapes: DataFrame, by: str, key: str, legend: Column | None = None, unknown: tuple[float, float] = (80.0, 3000.0), coverage: float = 0.9, overlap: float = 0.7, similar: float = 0.95) -> DataFrame:
    """Described and classified shapes without unknown ones of an area beyond `unknown`, those whose centre lies in the
    legend (a box of min_x, min_y, max_x, max_y, or null) and which fill `coverage` of it or more, and duplicates of
    larger ones (deduplicated)."""
    c = F.col
    noise = (c("shape_type") == "Shape unknown") & ~c("area").between(*unknown)
    rows = shapes.where(~noise)
    if legend is not None:
        size = (legend["max_x"] - legend["min_x"]) * (legend["max_y"] - legend["min_y"])
        within = c("center.x").between(legend["min_x"], legend["max_x"]) & c("center.y").between(legend["min_y"], legend["max_y"])
        sized = (legend["max_x"] > legend["min_x"]) & (legend["max_y"] > legend["min_y"])
        rows = rows.where(~F.coalesce(sized & within & (c("area") / size >= coverage), F.lit(False)))
    return deduplicated(rows, by, key, similar=similar, overlap=overlap)


def synchronised(shapes: DataFrame) -> DataFrame:
    """Shapes with shape_type and measures: their ideal points, ring (these points on whole pixels, halves to even) and all
    that described says, measured on the ring again; num_vertices counts the points."""
    c = F.col
    whole = lambda p: geometry.point(F.rint(p["x"]), F.rint(p["y"]))
    rows = shapes.withColumn("points", idealised(c("shape_type"), c("measures")))
    again = rows.withColumn("ring", geometry.closed(F.transform("points", whole)))
    return described(again.drop("measures")).withColumn("num_vertices", F.size("points"))


def extracted(
    outlines: DataFrame, circles: DataFrame, by: str, key: str, image_area: float, legend: Column | None = None, area: tuple[float, float] = (50.0, 5000.0), unknown: tuple[float, float] = (500.0, 4000.0), overlap: float = 0.6, similar: float = 0.6
) -> DataFrame:
    """From outlines (by, key, closed ring) of images of image_area pixels to shapes: of the right size, described,
    classified by given circles (by, x, y), made ideal and measured again, filtered, with is_legend for those whose centre
    lies in the legend box. Text is taken away before, as are the outlines found (filters, masks)."""
    c = F.col
    sized = area_filter(outlines.withColumns({"_area": F.abs(geometry.signed_area(c("ring"))), "_points": F.size("ring") - 1}), "_area", "_points", image_area, *area).drop("_area", "_points")
    whole = written(synchronised(classified(described(sized), circles, by, key)))  # read three times by what follows
    kept = post_filtered(whole, by, key, legend, unknown, overlap=overlap, similar=similar)
    within = F.lit(False) if legend is None else c("center.x").between(legend["min_x"], legend["max_x"]) & c("center.y").between(legend["min_y"], legend["max_y"])
    return kept.withColumn("is_legend", within)


def properties(number: Column, normalised: bool, colour: Column, colour_name: Column) -> Column:
    """What the feature of a described and classified shape says of itself; colour is a struct of r, g, b."""
    c = F.col
    hex_ = F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(colour[v]), 2, "0")) for v in "rgb"))
    return F.struct(
        number.alias("shape_id"), *(c(n) for n in ("area", "perimeter", "aspect_ratio", "solidity", "extent", "num_vertices")), colour.alias("color_rgb"), colour_name.alias("color_name"),
        F.when(colour.isNotNull(), hex_).alias("color_hex"), F.lit(0.5).alias("opacity"), colour.alias("stroke_color"), F.lit(2).alias("stroke_width"), F.lit(1.0).alias("stroke_opacity"),
        F.lit("shape").alias("mapElementType"), F.concat_ws(" ", F.coalesce(c("shape_type"), F.lit("Shape")), number.cast("string")).alias("name"), F.lit(normalised).alias("is_normalized"),
    )


def feature(points: Column, props: Column) -> Column:
    """A GeoJSON polygon of points, closed; null for fewer than three."""
    ring = F.transform(geometry.closed(points), lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.when(F.size(points) >= 3, F.struct(F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry")))


def deduplicated(shapes: DataFrame, by: str, key: str, ring: str = "ring", similar: float = 0.6, overlap: float = 0.6, side: float = 64.0, most: int = 1_000_000) -> DataFrame:
    """Per group (by) the shapes that stay when, from the largest down, each goes that is like one that stayed.

    Alike are two rings (of any form) whose areas' ratio is at least similar and whose common area is at least overlap
    of the smaller. Pairs meet over the cells of a grid that their boxes touch, and overlaps are computed for these
    alone. The choice is a fold over a group's pairs in one task, where they are no more than `most`; in a larger group it
    goes by rounds, in which a shape none of whose larger likes is still open is decided, and no group is gathered.
    """
    c = F.col
    # read by both sides: what makes the rings runs once
    rows = written(shapes.select(by, key, F.col(ring).alias("ring"), F.abs(geometry.signed_area(F.col(ring))).alias("area"), geometry.box(F.col(ring)).alias("box")))
    side_of = lambda n: rows.select(by, *(c(x).alias(f"{x}{n}") for x in (key, "ring", "area", "box")))
    larger = (c("area1") > c("area2")) | ((c("area1") == c("area2")) & (c(f"{key}1") < c(f"{key}2")))
    met = polygons.pairs_that_meet(side_of(1), side_of(2), [by], side).where(larger & (c("area2") / c("area1") >= similar) & (geometry.overlap(c("box1"), c("box2")) >= overlap * c("area2")))
    shared = polygons.common_area(polygons.polygon(c("ring1")), polygons.polygon(c("ring2")))
    likes = written(met.where(shared >= overlap * c("area2")).select(by, c(f"{key}1").alias("larger"), c(f"{key}2").alias("smaller"), c("area2").alias("area")))
    many = likes.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(c("n") > most).select(by)
    gone = _folded(likes.join(many, by, "left_anti"), by, key)
    by_rounds = _in_rounds(likes.join(many, by, "left_semi"), by, key)
    return shapes.join((gone if by_rounds is None else gone.unionByName(by_rounds)).hint("merge"), [by, key], "left_anti")


def _folded(likes: DataFrame, by: str, key: str) -> DataFrame:
    """by and key of what goes: a group's pairs in one task, from the largest smaller one down."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        order = frame.sort_values(["area", "smaller"], ascending=[False, True])
        for smaller, pairs in order.groupby("smaller", sort=False):
            if not gone.issuperset(pairs["larger"]):
                gone.add(smaller)
        return pd.DataFrame({by: pd.Series([frame[by].iloc[0]] * len(gone), dtype=frame[by].dtype), key: pd.Series(list(gone), dtype=frame["smaller"].dtype)})

    kinds = {f.name: f.dataType.simpleString() for f in likes.schema}
    return likes.groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, `{key}` {kinds['smaller']}")


def _in_rounds(likes: DataFrame, by: str, key: str) -> DataFrame | None:
    """As _folded, for groups of any size: each round decides all that wait for no other, as many rounds as chains are long."""
    c = F.col
    open_rows, gone = likes.select(by, F.explode(F.array("larger", "smaller")).alias(key)).distinct(), None
    while not open_rows.isEmpty():
        left = likes.join(open_rows.withColumnRenamed(key, "smaller"), [by, "smaller"], "left_semi").join(open_rows.withColumnRenamed(key, "larger"), [by, "larger"], "left_semi")
        stays = written(open_rows.join(left.select(by, c("smaller").alias(key)), [by, key], "left_anti"))
        goes = written(left.join(stays.withColumnRenamed(key, "larger"), [by, "larger"], "left_semi").select(by, c("smaller").alias(key)).distinct())
        gone = goes if gone is None else gone.unionByName(goes)
        open_rows = written(open_rows.join(stays, [by, key], "left_anti").join(goes, [by, key], "left_anti"))
    return gone
