"""Colour zones of images, from pixels to features: preparation, layers of given colours, their masks, outlines and features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maploom.functions import colour, geometry, kernels
from maploom.functions.css_colours import CSS_COLOURS
from maploom.operators import colours, filters, gazetteer, masks, polygons
from maploom.operators.scratch import written

CHANNELS = colours.CHANNELS


def prepared(pixels: DataFrame, by: str, linear: bool = True, denoise: bool = True, stretch: bool = True, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """by, x, y and channels from 0 to 1 of pixels (by, x, y, bytes r, g, b and, if there is one, opaque).

    To linear light, smoothed as bytes, stretched between percentiles of the opaque pixels, and back; each step can be
    left out. Images have all their pixels. opaque stays as it is.
    """
    keys = [by, "x", "y"]
    share = lambda c: F.col(c) / 255.0
    byte = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255.0 + 0.5).cast("int")
    rows = pixels.select(*keys, *((byte(colour.to_linear(share(c))) if linear else F.col(c)).alias(c) for c in CHANNELS))
    rows = filters.denoised(rows, by, list(CHANNELS)).withColumns({c: F.col(c).cast("int") for c in CHANNELS}) if denoise else rows
    marked = pixels.select(*keys, "opaque") if "opaque" in pixels.columns else None
    if stretch:
        rows = written(rows)
        known = rows if marked is None else rows.join(marked.where("opaque"), keys, "left_semi")
        rows = colours.stretched(rows, by, low=low, high=high, known=known)
    else:
        rows = rows.select(*keys, *(share(c).alias(c) for c in CHANNELS))
    back = (lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), colour.to_srgb(v)))) if linear else (lambda v: v)
    rows = rows.select(*keys, *(back(F.col(c)).alias(c) for c in CHANNELS))
    return rows if marked is None else rows.join(marked, keys)


def layers(pixels: DataFrame, centres: DataFrame, by: str, most: float = colours.NEAR) -> DataFrame:
    """by, x, y, layer of opaque pixels (channels from 0 to 1): of their image's centres (by, layer, lab) the nearest by
    CIEDE2000, the first of equals, if it is no further than `most`. Each colour of an image is compared once."""
    c = F.col
    opaque = pixels.where("opaque") if "opaque" in pixels.columns else pixels
    known = colours.with_lab(opaque.select(by, *((c(v) * 255).alias(v) for v in CHANNELS)).distinct())
    met = known.select(by, *CHANNELS, c("lab.L").alias("l1"), c("lab.A").alias("a1"), c("lab.B").alias("b1")).join(centres.select(by, "layer", c("lab.L").alias("l2"), c("lab.A").alias("a2"), c("lab.B").alias("b2")), by)
    away = colour.with_ciede2000(met, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "d").withColumn("d", F.round("d", 9))
    best = away.groupBy(by, *CHANNELS).agg(F.min(F.struct("d", "layer")).alias("best")).where(c("best.d") <= most)
    rows = opaque.select(by, "x", "y", *((c(v) * 255).alias(v) for v in CHANNELS))
    return rows.join(best, [by, *CHANNELS]).select(by, "x", "y", c("best.layer").alias("layer"))


@polygons.kernel(T.ArrayType(polygons.RING))
def _simplified(lists: pa.Array, tolerance: pa.Array) -> pa.Array:
    near = tolerance.to_pylist()[0] if len(tolerance) else 0.0
    out = []
    for rings in lists.to_pylist():
        whole = []
        for ring in rings or []:
            points = np.array([(p["x"], p["y"]) for p in ring[:-1]])
            less = kernels.simplified_ring(points, near)
            points = less if len(less) > 2 and kernels.is_simple(less) else points
            whole.append([{"x": x, "y": y} for x, y in [*points.tolist(), points[0].tolist()]])
        out.append(whole)
    return pa.array(out, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def _feature(name: Column, shown: Column, rgb: Column, rings: Column, flag: str) -> Column:
    """A zone's feature; its geometry is a polygon, or several as one."""
    listed = F.array(*(rgb[c] for c in CHANNELS))
    says = F.struct(
        name.alias("color_name"), listed.alias("color_rgb"), colour.hex_of(*(rgb[c] for c in CHANNELS)).alias("color_hex"), F.lit("zone").alias("mapElementType"), shown.alias("name"),
        F.lit(True).alias(flag), F.lit(0.5).alias("opacity"), listed.alias("stroke_color"), F.lit(2).alias("stroke_width"), F.lit(1.0).alias("stroke_opacity"),
    )
    several = F.transform(rings, lambda r: F.array(F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    shape = F.struct(F.when(F.size(rings) == 1, "Polygon").otherwise("MultiPolygon").alias("type"), several.alias("polygons"))
    return F.struct(F.lit("Feature").alias("type"), says.alias("properties"), shape.alias("geometry"))


def zones(found: DataFrame, centres: DataFrame, sizes: DataFrame, by: str, opening: int = 1, closing: int = 3, tolerance: float = 0.5, side: int = masks.SIDE) -> DataFrame:
    """Layers of pixels (by, x, y, layer) to one row for each layer that is not empty once it is smoothed and filled.

    centres (by, layer, r, g, b, and user_name or null) name them: by the user's name made safe, else by the nearest CSS
    colour and the number among the layers that are left; a name that an image has already gets _2, _3 and so on.
    Returns by, layer, name, cells, rings (simplified within tolerance where they stay simple), pixel_feature and
    normalized_feature (scaled into the unit square, proportions kept). sizes has by, width, height.
    """
    c = F.col
    key = F.concat_ws("/", c(by).cast("string"), c("layer").cast("string"))
    mask = written(found.select(key.alias("_zone"), "x", "y"))
    named = centres.withColumn("_zone", key)
    areas = named.join(sizes, by).select("_zone", "width", "height").join(mask.select("_zone").distinct(), "_zone", "left_semi")
    solid = written(masks.layer(mask, areas, "_zone", opening, closing, side))
    cells = solid.groupBy("_zone").agg(F.count(F.lit(1)).alias("cells"))
    shapes = masks.to_geometry(solid, "_zone").select("_zone", _simplified(c("polygons"), F.lit(float(tolerance))).alias("rings"))
    rows = named.join(cells, "_zone").join(shapes, "_zone")
    number = F.row_number().over(Window.partitionBy(by).orderBy("layer"))
    css = colours.nearest_name(c("r"), c("g"), c("b"), CSS_COLOURS)
    rows = rows.withColumn("name", F.when(F.length("user_name") > 0, gazetteer.safe_name(c("user_name"))).otherwise(F.concat_ws("-", css, number.cast("string"))))
    again = F.row_number().over(Window.partitionBy(by, "name").orderBy("layer"))
    rows = rows.withColumn("name", F.when(again > 1, F.concat_ws("_", "name", again.cast("string"))).otherwise(c("name")))
    # the unit square around all rings together
    box = geometry.box(F.flatten("rings"))
    w, h = c("_box.max_x") - c("_box.min_x"), c("_box.max_y") - c("_box.min_y")
    scale = F.when(F.greatest(w, h) > 0, F.greatest(w, h)).otherwise(1.0)
    unit = lambda p: geometry.point((p["x"] - c("_box.min_x") + (scale - w) / 2) / scale, (p["y"] - c("_box.min_y") + (scale - h) / 2) / scale)
    rows = rows.withColumn("_box", box)
    rgb = F.struct(*CHANNELS)
    features = {
        "pixel_feature": _feature(c("name"), c("name"), rgb, c("rings"), "is_pixel_space"),
        "normalized_feature": _feature(c("name"), F.concat(F.lit("Zone "), c("name")), rgb, F.transform("rings", lambda r: F.transform(r, unit)), "is_normalized"),
    }
    return rows.withColumns(features).select(by, "layer", "name", "cells", "rings", *features)


def extracted(pixels: DataFrame, clicks: DataFrame, by: str = "image_id", most: float = colours.NEAR, opening: int = 1, closing: int = 3, tolerance: float = 0.5, side: int = masks.SIDE) -> DataFrame:
    """From pixels (by, x, y, bytes r, g, b and, if there is one, opaque) and clicks to zones, in one job.

    clicks: (by, click, x, y from 0 to 1, radius or null, name or null), in the order of click. The images are prepared,
    each click samples its colour from the prepared image (radius 20 by default, 1 to 200), pixels go to the nearest of
    these colours, and each layer becomes a zone. Clicks beside an image make no layer.
    """
    c = F.col
    ready = written(prepared(pixels, by))
    sizes = written(ready.groupBy(by).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")))
    bytes_ = ready.select(c(by).alias("image_id"), c("x").alias("px"), c("y").alias("py"), *(F.floor(c(v) * 255.0 + 0.5).cast("int").alias(v) for v in CHANNELS))
    radius = F.greatest(F.lit(1), F.least(F.lit(200), F.coalesce(c("radius").cast("int"), F.lit(20))))
    asked = clicks.join(sizes, by).select(c(by).alias("image_id"), "click", "x", "y", "width", "height", radius.alias("radius"))
    taken = colours.sampled(bytes_, asked).join(clicks.select(c(by).alias("image_id"), "click", c("name").alias("user_name")), ["image_id", "click"])
    layer = F.row_number().over(Window.partitionBy("image_id").orderBy("click")) - 1
    centres = colours.with_lab(taken).select(c("image_id").alias(by), layer.alias("layer"), *CHANNELS, "user_name", "lab")
    centres = written(centres)
    return zones(layers(ready, centres, by, most), centres, sizes, by, opening, closing, tolerance, side)
