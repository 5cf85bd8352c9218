"""Aggregates and assignments over tables of pixels (image_id, r, g, b)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maploom.functions import kernels
from maploom.functions.colour import bin_of, lab, with_ciede2000
from maploom.operators import polygons

CHANNELS = ("r", "g", "b")
#: CIEDE2000 differences up to which a pixel belongs to a layer, and to the paper.
NEAR, PAPER = 5.0, 10.0


def dominant(pixels: DataFrame, *by: str, order: tuple[str, ...] = CHANNELS) -> DataFrame:
    """The most frequent colour of each group; of equally frequent ones the least, channels compared in order."""
    counts = pixels.groupBy(*by, *CHANNELS).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(*CHANNELS, "n"), F.struct(-F.col("n"), *order)).alias("c")
    return counts.groupBy(*by).agg(best).select(*by, "c.*")


def sampled(pixels: DataFrame, clicks: DataFrame, side: int = 64) -> DataFrame:
    """The most frequent colour around each click; of equally frequent ones the least r, g, b. Returns image_id, click, r, g, b, n, hex.

    pixels: (image_id, px, py, r, g, b). clicks: (image_id, click, x, y, width, height, radius): places from 0 to 1 of an
    image of so many pixels, and half the side of the square around the pixel that they round to (halves to even); a null
    radius is 20, one below 0 is 0. Clicks outside 0 to 1, and squares without pixels, have no colour. Pixels and squares
    meet over cells of side pixels.
    """
    c = F.col
    near = clicks.where(c("x").between(0, 1) & c("y").between(0, 1) & (c("width") > 0) & (c("height") > 0))
    middle = lambda d, size: F.rint(c(d) * (c(size) - 1)).cast("long")
    radius = F.greatest(F.lit(0), F.coalesce(c("radius").cast("int"), F.lit(20)))
    squares = near.select("image_id", "click", middle("x", "width").alias("cx"), middle("y", "height").alias("cy"), radius.alias("reach"))
    cells = lambda d: F.explode(F.sequence(F.floor((c(f"c{d}") - c("reach")) / side), F.floor((c(f"c{d}") + c("reach")) / side)))
    dealt = squares.withColumn("gx", cells("x")).withColumn("gy", cells("y"))
    met = pixels.withColumns({"gx": F.floor(c("px") / side), "gy": F.floor(c("py") / side)}).join(dealt, ["image_id", "gx", "gy"])
    found = dominant(met.where((F.abs(c("px") - c("cx")) <= c("reach")) & (F.abs(c("py") - c("cy")) <= c("reach"))), "image_id", "click")
    return found.withColumn("hex", F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(v), 2, "0")) for v in CHANNELS)))


_SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in ("y", "first", "last")]))


@polygons.kernel(T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("y", "first", "last")])))
def _spans(rings: pa.Array) -> pa.Array:
    rows = [None if r is None else kernels.spans(np.trunc([(p["x"], p["y"]) for p in r])) if r else np.zeros((0, 3), np.int64) for r in rings.to_pylist()]
    return pa.array([None if s is None else [dict(zip(("y", "first", "last"), v, strict=True)) for v in s.tolist()] for s in rows], _SPANS)


def of_legends(pixels: DataFrame, legends: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, r, g, b of legend shapes (by, key, ring, box): the most frequent colour of the pixels (by, px, py) in the
    ring or on it, of equally frequent ones the least b, g, r; where ring is null or empty, the medians of the box
    (x, y, width, height), halves to even. Points of rings lose their fractions.

    A ring becomes spans of pixels, one or a few for each row it crosses, and pixels meet those of their row. Shapes without
    a pixel, or with neither ring nor box, have no colour.
    """
    c = F.col
    drawn = legends.where(F.size("ring") > 0).select(by, key, F.explode(_spans(c("ring"))).alias("s")).select(by, key, c("s.y").alias("py"), "s.first", "s.last")
    inside = pixels.join(drawn, [by, "py"]).where(c("px").between(c("first"), c("last")))
    modes = dominant(inside, by, key, order=("b", "g", "r")).drop("n")
    boxed = legends.where(F.coalesce(F.size("ring") <= 0, F.lit(True)) & c("box").isNotNull()).select(by, key, "box", F.explode(F.sequence(c("box.y").cast("long"), (c("box.y") + c("box.height") - 1).cast("long"))).alias("py"))
    framed = pixels.join(boxed.where("box.width > 0 AND box.height > 0"), [by, "py"]).where((c("px") >= c("box.x")) & (c("px") < c("box.x") + c("box.width")))
    medians = framed.groupBy(by, key).agg(*(F.bround(F.percentile(v, F.lit(0.5))).cast("int").alias(v) for v in CHANNELS))
    return modes.select(by, key, *CHANNELS).unionByName(medians)


def dominant_bin(pixels: DataFrame, *by: str) -> DataFrame:
    """The middle of the fullest cell of an 8 by 8 by 8 grid; of equally full ones the least."""
    counts = pixels.groupBy(*by, bin_of(*map(F.col, CHANNELS)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.min_by("bin", F.struct(-F.col("n"), F.col("bin"))).alias("bin"))
    middle = lambda c: (c * 32 + 16).cast("int")
    return best.select(*by, middle(F.floor(F.col("bin") / 64)).alias("r"), middle(F.floor(F.col("bin") / 8) % 8).alias("g"), middle(F.col("bin") % 8).alias("b"))


def stretched(pixels: DataFrame, *by: str, low: float = 0.01, high: float = 0.99, known: DataFrame | None = None) -> DataFrame:
    """Channels scaled by exact percentiles of their group, of the pixels in known if it is given; distinct values are counted
    first, 256 at most. Groups without a known pixel are left out."""
    long = (pixels if known is None else known).select(*by, F.posexplode(F.array(*CHANNELS)).alias("channel", "v")).groupBy(*by, "channel", "v").agg(F.count(F.lit(1)).alias("n"))
    ends = long.groupBy(*by, "channel").agg(F.percentile("v", F.array(F.lit(low), F.lit(high)), F.col("n")).alias("p"))
    wide = ends.groupBy(*by).agg(*(F.max(F.when(F.col("channel") == k, F.col("p"))).alias(f"_{c}") for k, c in enumerate(CHANNELS)))
    scaled = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - F.col(f"_{c}")[0]) / (F.col(f"_{c}")[1] - F.col(f"_{c}")[0] + 1e-8)))
    rest = [c for c in pixels.columns if c not in (*by, *CHANNELS)]
    return pixels.join(wide, list(by)).select(*by, *rest, *(scaled(c).alias(c) for c in CHANNELS))


def gains(pixels: DataFrame, *by: str) -> DataFrame:
    """Gray-world gains: what brings each channel's mean to their common mean."""
    means = pixels.groupBy(*by).agg(*(F.avg(c).alias(c) for c in CHANNELS))
    common = (F.col("r") + F.col("g") + F.col("b")) / 3
    return means.select(*by, *(F.when(F.col(c) == 0, 1.0).otherwise(common / F.col(c)).alias(f"gain_{c}") for c in CHANNELS))


def nearest_centres(pixels: DataFrame, centres: list[tuple[float, float, float]], most: float = NEAR) -> DataFrame:
    """pixels with layer: the index of the LAB centre nearest by CIEDE2000, the first of equals; null beyond most.

    Each distinct colour is compared once, and comes back to its pixels over its bytes.
    """
    listed = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(float(v)).alias(n) for v, n in zip(c, ("l2", "a2", "b2"), strict=True))) for k, c in enumerate(centres)))
    known = with_lab(pixels.select(*CHANNELS).distinct()).select(*CHANNELS, F.col("lab.L").alias("l1"), F.col("lab.A").alias("a1"), F.col("lab.B").alias("b1"), F.inline(listed))
    away = with_ciede2000(known, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "d").withColumn("d", F.round("d", 9))
    best = away.groupBy(*CHANNELS).agg(F.min(F.struct("d", "k")).alias("best"))
    return pixels.join(best, list(CHANNELS)).withColumn("layer", F.when(F.col("best.d") <= most, F.col("best.k"))).drop("best")


def nearest_name(r: Column, g: Column, b: Column, names: dict[str, tuple[int, int, int]]) -> Column:
    """The name of the nearest colour by squared distance, the first of equals."""
    listed = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), *(F.lit(int(x)).alias(c) for x, c in zip(v, CHANNELS, strict=True))) for k, (n, v) in enumerate(names.items())))
    square = lambda x: x * x
    away = F.transform(listed, lambda v: F.struct((square(r - v["r"]) + square(g - v["g"]) + square(b - v["b"])).alias("d"), v["k"].alias("k"), v["n"].alias("n")))
    return F.array_min(away)["n"]


def with_lab(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("lab", lab(*map(F.col, CHANNELS)))
