"""Outlines over tile borders and at image borders; filters over tiles against the same filter over whole images."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maploom.functions import geometry, kernels
from maploom.operators import filters, masks


def _mask(spark, places):
    return spark.createDataFrame([("a", x, y) for x, y in places], "image string, x long, y long")


def test_rings_go_over_tiles(spark):
    block = {(x, y) for x in range(200, 600) for y in range(250, 260)} - {(x, y) for x in range(255, 258) for y in range(254, 258)}
    found = masks.nested(masks.rings(_mask(spark, block | {(256, 256)}), "image"), "image")
    rows = found.select(geometry.signed_area(F.col("ring")).alias("area"), "depth", F.size("ring").alias("n"), F.col("parent").isNull().alias("top"), (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed")).orderBy("depth").collect()
    assert [r.depth for r in rows] == [0, 1, 2]
    # corners take an eighth of a pixel off outlines and holes alike
    assert [r.area for r in rows] == [400 * 10 - 0.5, -(12 - 0.5), 0.5]
    assert rows[0].n == 2 * (400 + 10) + 1 and all(r.closed for r in rows)
    assert [r.top for r in rows] == [True, False, False]
    assert masks.to_geometry(_mask(spark, block), "image").select(F.size("polygons")).first()[0] == 1


def test_outlines_end_at_the_border(spark):
    found = masks.rings(_mask(spark, {(x, y) for x in range(3, 7) for y in range(3)}), "image", size=(10, 10))
    ring = found.select("ring", geometry.signed_area(F.col("ring")).alias("area")).first()
    assert abs(ring.area) == 4 * 2.5 - 0.25
    assert (min(p.y for p in ring.ring), max(p.y for p in ring.ring)) == (0.0, 2.5)
    full = masks.rings(_mask(spark, {(x, y) for x in range(4) for y in range(4)}), "image", size=(4, 4))
    assert full.count() == 0


def test_no_pixels_repeated_pixels_and_corners(spark):
    assert masks.rings(_mask(spark, []).where("false"), "image").count() == 0
    twice = _mask(spark, [(0, 0), (0, 0), (1, 1)])
    assert masks.rings(twice, "image").count() == 2


def test_tiles_are_filtered_like_the_whole(spark):
    rng = np.random.default_rng(5)
    image = rng.random((300, 530))
    rows = spark.createDataFrame([(1, x, y, float(image[y, x])) for y in range(300) for x in range(530)], "image long, x long, y long, v double").repartition(5)
    weights = kernels.bell(2.0, 8)
    out = filters.tiled(rows, "image", ["v"], ["v"], lambda a: kernels.blurred(a, weights), 8).toPandas()
    assert len(out) == image.size
    whole = kernels.blurred(np.pad(image, 8, mode="symmetric")[:, :, None], weights)[:, :, 0]
    got = np.zeros_like(image)
    got[out["y"], out["x"]] = out["v"]
    assert got == pytest.approx(whole)


def test_halo_wider_than_the_image(spark):
    rows = spark.createDataFrame([(1, x, 0, 0.5, 0.5, 0.5) for x in range(3)], "image long, x long, y long, r double, g double, b double")
    out = filters.flat_field(rows, "image").collect()
    assert [round(r.r, 4) for r in out] == [1.0] * 3


def test_equalised_by_many_tiles_as_by_plain_loops(spark):
    """An image of 64 by 64 tiles of four pixels: each tile is one row of work, not one of 256 times 256 steps."""
    rng, n = np.random.default_rng(5), 128
    grey = rng.integers(0, 256, (n, n))
    rows = spark.createDataFrame([(1, x, y, int(grey[y, x])) for y in range(n) for x in range(n)], "image long, x long, y long, grey int")
    start = time.monotonic()
    found = {(r.x, r.y): r.grey for r in filters.equalised(rows, "image").collect()}
    assert time.monotonic() - start < 120
    maps = {}
    for ty in range(64):
        for tx in range(64):
            bins = np.bincount(grey[2 * ty : 2 * ty + 2, 2 * tx : 2 * tx + 2].ravel(), minlength=256)
            over, bins = int(np.maximum(bins - 1, 0).sum()), np.minimum(bins, 1)
            for k in range(over):
                bins[k * (256 // over)] += 1
            maps[tx, ty] = np.minimum(255, np.rint(np.cumsum(bins) * 255.0 / 4))
    for x, y in rng.integers(0, n, (300, 2)).tolist():
        ax, ay = x / 2 - 0.5, y / 2 - 0.5
        total = 0.0
        for kx, sx in ((max(0, int(np.floor(ax))), 1 - ax % 1), (min(63, int(np.floor(ax)) + 1), ax % 1)):
            for ky, sy in ((max(0, int(np.floor(ay))), 1 - ay % 1), (min(63, int(np.floor(ay)) + 1), ay % 1)):
                total += maps[kx, ky][grey[y, x]] * sx * sy
        assert found[x, y] == min(255, int(np.rint(round(total, 6))))


def test_contour_mask_of_many_tiles(spark):
    """64 by 64 tiles by default: a flat picture with dark lines keeps the lines, and in bounded time."""
    n = 70
    rows = spark.createDataFrame([(1, x, y, v, v, v) for y in range(n) for x in range(n) for v in [20 if x % 23 == 11 else 220 - (x + y) % 9]], "image long, x long, y long, r int, g int, b int")
    start = time.monotonic()
    found = {(r.x, r.y): r.set for r in filters.contour_mask(rows, "image").collect()}
    assert time.monotonic() - start < 120 and len(found) == n * n
    assert all(found[x, y] for x in (11, 34, 57) for y in range(n)) and 0 < sum(found.values()) < n * n
