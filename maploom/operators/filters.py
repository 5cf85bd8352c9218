"""Filters over the pixels of images that are dealt to tiles: an image takes as many tasks as it has tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.functions import colour, kernels
from maploom.operators.scratch import written

SIDE = 256


def tiled(pixels: DataFrame, by: str, values: list[str], results: list[str], kernel: Callable[[np.ndarray], np.ndarray], halo: int, border: str = "symmetric") -> DataFrame:
    """by, x, y and results: what kernel makes of values around each pixel.

    pixels hold one row a place of each image, from 0 to its largest x and y; places that are missing count as 0. The
    kernel takes a (height, width, values) array and returns one of results that is halo smaller at each side. A tile
    takes its halo from its neighbours; beyond an image's edge it goes on by numpy's padding mode `border`.
    """
    side = max(SIDE, 2 * halo)
    sizes = pixels.groupBy(by).agg((F.max("x") + 1).cast("long").alias("_w"), (F.max("y") + 1).cast("long").alias("_h"))
    last = lambda n: F.floor((F.col(n) - 1) / side)
    reach = lambda c, n: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - halo) / side)), F.least(last(n), F.floor((F.col(c) + halo) / side)))
    rows = pixels.select(by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *(F.col(v).cast("double").alias(v) for v in values)).join(sizes, by)
    dealt = rows.withColumn("_tx", F.explode(reach("x", "_w"))).withColumn("_ty", F.explode(reach("y", "_h")))

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        w, h, tx, ty = (int(tile[c].iloc[0]) for c in ("_w", "_h", "_tx", "_ty"))
        (x0, x1), (y0, y1) = ((t * side, min(n, (t + 1) * side)) for t, n in ((tx, w), (ty, h)))
        (l, r), (t, b) = ((max(0, p - halo), min(n, q + halo)) for p, q, n in ((x0, x1, w), (y0, y1, h)))
        area = np.zeros((b - t, r - l, len(values)))
        area[tile["y"].to_numpy() - t, tile["x"].to_numpy() - l] = tile[values].to_numpy()
        padded = np.pad(area, ((halo - y0 + t, halo - b + y1), (halo - x0 + l, halo - r + x1), (0, 0)), mode=border)
        out = kernel(padded)
        own = tile[(tile["x"] >= x0) & (tile["x"] < x1) & (tile["y"] >= y0) & (tile["y"] < y1)]
        found = out[own["y"].to_numpy() - y0, own["x"].to_numpy() - x0]
        return pd.DataFrame({by: own[by], "x": own["x"], "y": own["y"], **{c: found[:, k] for k, c in enumerate(results)}})

    kind = pixels.schema[by].dataType.simpleString()
    return dealt.groupBy(by, "_tx", "_ty").applyInPandas(run, f"`{by}` {kind}, x long, y long, " + ", ".join(f"`{c}` double" for c in results))


def binarised(pixels: DataFrame, by: str, grey: str = "grey", threshold: int = 127, levels: int = 3, window: int = 31, below: float = 6.0) -> DataFrame:
    """by, x, y, set: beyond threshold in images of few levels, else darker than the weighted mean around by `below`."""
    few = pixels.groupBy(by).agg((F.size(F.collect_set(F.col(grey).cast("int"))) <= levels).alias("_few"))
    weights = kernels.bell(0.3 * ((window - 1) * 0.5 - 1) + 0.8, window // 2)
    around = tiled(pixels, by, [grey], ["_own", "_mean"], lambda a: np.concatenate([a[len(weights) // 2 : len(a) - len(weights) // 2, len(weights) // 2 : a.shape[1] - len(weights) // 2], kernels.blurred(a, weights)], axis=2), window // 2, "edge")
    dark = F.col("_own") <= F.round(F.round("_mean", 6)) - below
    return around.join(few, by).select(by, "x", "y", F.when(F.col("_few"), F.col("_own") > threshold).otherwise(dark).alias("set"))


def denoised(pixels: DataFrame, by: str, channels: list[str], radius: int = 5, alike: float = 75.0, near: float = 75.0) -> DataFrame:
    """Bytes smoothed over disks of radius, where likeness is the sum of the channels' differences; edges are mirrored without repeating them."""
    kernel = lambda a: np.rint(np.round(kernels.bilateral(a, radius, alike, near, True, lambda d: np.abs(d).sum(axis=2)), 6))
    return tiled(pixels, by, channels, channels, kernel, radius, "reflect")


def denoised_floats(pixels: DataFrame, by: str, channels: list[str], alike: float = 0.05, near: float = 2.0) -> DataFrame:
    """Values from 0 to 1 smoothed over squares that reach three times near, likeness by Euclidean distance; 0 beyond the edges."""
    radius = max(2, int(np.ceil(3 * near)))
    return tiled(pixels, by, channels, channels, lambda a: kernels.bilateral(a, radius, alike, near, False, lambda d: np.sqrt((d * d).sum(axis=2))), radius, "constant")


def locally_normalised(pixels: DataFrame, by: str, light: str = "light", window: int = 15) -> DataFrame:
    """by, x, y and light less its mean around and over its deviation there, scaled to 0 to 100 within each image."""
    sigma = window / 6.0
    radius = int(4 * sigma + 0.5)
    weights = kernels.bell(sigma, radius)

    def kernel(a: np.ndarray) -> np.ndarray:
        off = a[radius:-radius, radius:-radius] - kernels.blurred(a, weights)
        return off[radius:-radius, radius:-radius] / (np.sqrt(kernels.blurred(off * off, weights)) + 1e-5)

    found = tiled(pixels, by, [light], [light], kernel, 2 * radius)
    ends = found.groupBy(by).agg(F.min(light).alias("_low"), F.max(light).alias("_high"))
    spread = F.col("_high") - F.col("_low")
    return found.join(ends, by).select(by, "x", "y", F.when(spread > 0, (F.col(light) - F.col("_low")) / spread * 100).otherwise(0.0).alias(light))


def flat_field(pixels: DataFrame, by: str, channels: tuple[str, str, str] = ("r", "g", "b"), sigma: float = 100.0) -> DataFrame:
    """Linear channels from 0 to 1 over the wide mean of their luminance, then over the image's largest value."""
    radius = int(4 * sigma + 0.5)
    weights = kernels.bell(sigma, radius)
    luma = 0.2126 * F.col(channels[0]) + 0.7152 * F.col(channels[1]) + 0.0722 * F.col(channels[2])
    ground = tiled(pixels.withColumn("_luma", luma), by, ["_luma"], ["_ground"], lambda a: kernels.blurred(a, weights) + 1e-6, radius)
    whole = ground.groupBy(by).agg(F.avg("_ground").alias("_mean"))
    luma_ratio = luma / F.col("_ground") * F.col("_mean") / (luma + 1e-6)
    flat = pixels.join(ground, [by, "x", "y"]).join(whole, by).select(by, "x", "y", *((F.col(c) * luma_ratio).alias(c) for c in channels))
    most = flat.groupBy(by).agg(F.max(F.greatest(*channels)).alias("_most"))
    level = F.when(F.col("_most") > 1e-8, F.col("_most")).otherwise(1.0)
    return flat.join(most, by).select(by, "x", "y", *(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / level)).alias(c) for c in channels))


def _levels(clip: float):
    """Arrays of struct(v, n), the grey values of tiles and how many pixels have them, and the tiles' areas to the 256 bytes that
    the values become. What exceeds the limit is dealt back to all bins alike, as OpenCV deals it: an equal share to each, and
    what is left one by one to every so many-th bin."""

    @F.arrow_udf("array<double>")
    def run(counts: pa.Array, areas: pa.Array) -> pa.Array:
        ends, pairs, area = counts.offsets.to_numpy(), counts.flatten(), areas.to_numpy()[:, None]
        tile, value = np.repeat(np.arange(len(counts)), np.diff(ends)), pairs.field("v").to_numpy()
        bins = np.zeros((len(counts), 256), np.int64)
        bins[tile, value] = pairs.field("n").to_numpy()
        if clip > 0:
            limit = np.maximum(1, np.floor(clip * area / 256)).astype(np.int64)
            share, rest = np.divmod(np.maximum(bins - limit, 0).sum(axis=1, keepdims=True), 256)
            # bins 0, step, 2 step and so on get one more, until nothing is left
            step, k = 256 // np.maximum(1, rest), np.arange(256)
            bins = np.minimum(bins, limit) + share + ((k % step == 0) & (k // step < rest))
        level = np.minimum(255.0, np.rint(np.cumsum(bins, axis=1) * 255.0 / area))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * 256, pa.int32()), pa.array(level.ravel()))

    return run


def equalised(pixels: DataFrame, by: str, grey: str = "grey", clip: float = 2.0, tiles: tuple[int, int] = (64, 64)) -> DataFrame:
    """by, x, y and grey as bytes, equalised by contrast-limited histograms of tiles (columns, rows of them) of each image.

    Images have all their pixels. Where a side is no multiple of its tiles the image goes on mirrored, its edge not
    repeated, until it is. A tile's histogram has no bin above clip times the mean one (1 at least); what exceeds it is
    dealt back. A pixel takes its grey through the cumulated histograms of the four nearest tiles, by its distances from
    their middles. A tile is a row, with the grey values that it has, and then with what each of 256 becomes.
    """
    c = F.col
    sizes = pixels.groupBy(by).agg((F.max("x") + 1).cast("long").alias("_w"), (F.max("y") + 1).cast("long").alias("_h"))
    # both sides are extended if one must be, each then by a whole number of pixels a tile
    even = (c("_w") % tiles[0] == 0) & (c("_h") % tiles[1] == 0)
    wide = lambda n, k: F.when(even, c(n)).otherwise(c(n) + k - c(n) % k)
    sizes = sizes.withColumns({"_tw": (wide("_w", tiles[0]) / tiles[0]).cast("long"), "_th": (wide("_h", tiles[1]) / tiles[1]).cast("long")})
    rows = pixels.select(by, c("x").cast("long").alias("x"), c("y").cast("long").alias("y"), c(grey).cast("int").alias("_v")).join(sizes, by)
    # the places at which a pixel stands, once as itself and once mirrored at the far edge
    places = lambda d, n, t, k: F.filter(F.array(c(d), 2 * (c(n) - 1) - c(d)), lambda p: (p == c(d)) | ((p >= c(n)) & (p < c(t) * k)))
    spread = rows.withColumn("_x", F.explode(F.array_distinct(places("x", "_w", "_tw", tiles[0])))).withColumn("_y", F.explode(F.array_distinct(places("y", "_h", "_th", tiles[1]))))
    counted = spread.groupBy(by, F.floor(c("_x") / c("_tw")).alias("_tx"), F.floor(c("_y") / c("_th")).alias("_ty"), "_v").agg(F.count(F.lit(1)).alias("n"), F.first(c("_tw") * c("_th")).alias("_area"))
    listed = counted.where(c("_v").between(0, 255)).groupBy(by, "_tx", "_ty").agg(F.collect_list(F.struct(c("_v").alias("v"), "n")).alias("_n"), F.first("_area").alias("_area"))
    maps = listed.select(by, c("_tx").alias("_kx"), c("_ty").alias("_ky"), _levels(clip)("_n", "_area").alias("_to"))
    # a pixel's four tiles and their shares
    at = lambda d, t: c(d) / c(t) - 0.5
    ends = lambda d, t, k: F.array(
        F.struct(F.greatest(F.lit(0).cast("long"), F.floor(at(d, t))).alias("k"), (1 - (at(d, t) - F.floor(at(d, t)))).alias("s")),
        F.struct(F.least(F.lit(k - 1).cast("long"), F.floor(at(d, t)) + 1).alias("k"), (at(d, t) - F.floor(at(d, t))).alias("s")),
    )
    four = rows.withColumn("_i", F.explode(ends("x", "_tw", tiles[0]))).withColumn("_j", F.explode(ends("y", "_th", tiles[1])))
    asked = four.select(by, "x", "y", "_v", c("_i.k").alias("_kx"), c("_j.k").alias("_ky"), (c("_i.s") * c("_j.s")).alias("_s"))
    met = asked.where(c("_v").between(0, 255)).join(maps.hint("merge"), [by, "_kx", "_ky"])
    found = met.select(by, "x", "y", (F.element_at("_to", c("_v") + 1) * c("_s")).alias("_part")).groupBy(by, "x", "y").agg(F.sum("_part").alias("_sum"))
    return found.select(by, "x", "y", F.least(F.lit(255), F.rint(F.round("_sum", 6)).cast("int")).alias(grey))


def min_max(pixels: DataFrame, by: str, grey: str = "grey") -> DataFrame:
    """by, x, y and grey stretched to all bytes; images of one level become 0."""
    ends = pixels.groupBy(by).agg(F.min(grey).alias("_low"), F.max(grey).alias("_high"))
    spread = F.col("_high") - F.col("_low")
    value = F.when(spread > 0, F.rint(F.round((F.col(grey) - F.col("_low")) * 255.0 / spread, 6))).otherwise(0).cast("int")
    return pixels.join(ends, by).select(by, "x", "y", value.alias(grey))


def contour_mask(pixels: DataFrame, by: str, channels: tuple[str, str, str] = ("r", "g", "b"), tiles: tuple[int, int] = (64, 64), threshold: int = 127) -> DataFrame:
    """by, x, y, set: what outlines are drawn around, of pixels (by, x, y, byte channels). The image is smoothed, its lightness
    stretched to all bytes, equalised and binarised; each step is a table that the next reads."""
    smooth = written(denoised(pixels, by, list(channels)))
    light = smooth.withColumn("lab", colour.lab(*map(F.col, channels))).select(by, "x", "y", F.rint(F.round(F.col("lab.L") * 2.55, 6)).cast("int").alias("grey"))
    even = written(equalised(written(min_max(light, by)), by, tiles=tiles))
    return binarised(even, by, threshold=threshold)
