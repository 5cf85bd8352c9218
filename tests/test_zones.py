"""Masks over tiles against whole images, and colour zones from pixels to features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maploom.functions import kernels
from maploom.operators import masks, zones


def spiral(n):
    """Walls that wind inward with a way out, and beside it a closed ring with an island: holes over many tiles."""
    m = np.zeros((n, n), bool)
    m[2, 2 : n - 2] = m[2 : n - 2, n - 3] = m[n - 3, 6 : n - 2] = m[6 : n - 2, 6] = m[6, 6 : n - 7] = True
    m[10 : n - 8, 10] = m[10 : n - 8, n - 9] = m[10, 10 : n - 8] = m[n - 9, 10 : n - 8] = True
    m[n // 2, n // 2] = True
    return m


def test_labels_and_filling_without_tiles():
    rng = np.random.default_rng(4)
    for density in (0.3, 0.6, 0.9):
        m = rng.random((23, 31)) < density
        labels = kernels.labelled(m)
        assert ((labels >= 0) == m).all()
        for y, x in np.argwhere(m):
            for b, a in ((y, x + 1), (y + 1, x)):
                if b < 23 and a < 31 and m[b, a]:
                    assert labels[y, x] == labels[b, a]
        outside, todo = np.zeros_like(m), [(y, x) for y in range(23) for x in range(31) if (y in (0, 22) or x in (0, 30)) and not m[y, x]]
        while todo:
            y, x = todo.pop()
            if 0 <= y < 23 and 0 <= x < 31 and not m[y, x] and not outside[y, x]:
                outside[y, x] = True
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert (kernels.filled(m) == ~outside).all()


def test_tiles_equal_the_whole_image(spark):
    rng = np.random.default_rng(9)
    images = {1: spiral(32), 2: rng.random((29, 32)) < 0.55, 3: np.zeros((8, 8), bool), 4: np.ones((17, 9), bool)}
    rows = [(i, int(x), int(y)) for i, m in images.items() for y, x in np.argwhere(m)]
    mask = spark.createDataFrame(rows, "image long, x long, y long").repartition(3)
    sizes = spark.createDataFrame([(i, m.shape[1], m.shape[0]) for i, m in images.items()], "image long, width int, height int")
    places = lambda df: {(r.image, r.x, r.y) for r in df.collect()}
    whole = lambda f: {(i, int(x), int(y)) for i, m in images.items() for y, x in np.argwhere(f(m))}
    assert places(masks.filled(mask, sizes, "image", 8)) == whole(kernels.filled)
    assert places(masks.smoothed(mask, sizes, "image", 1, 3, 8)) == whole(lambda m: kernels.closed(kernels.opened(m, 1), 3))
    assert places(masks.layer(mask, sizes, "image", 1, 2, 16)) == whole(lambda m: kernels.filled(kernels.closed(kernels.opened(m, 1), 2)))


def test_pixels_to_zones(spark):
    red, blue = (200, 30, 40), (20, 60, 180)
    rng, pixels = np.random.default_rng(1), []
    for y in range(40):
        for x in range(48):
            c = red if 4 <= x < 20 and 5 <= y < 30 and not (10 <= x < 13 and 15 <= y < 18) else blue if 26 <= x < 44 and 8 <= y < 36 else (245, 244, 240)
            pixels.append((7, x, y, *(int(v) for v in np.clip(np.array(c) + rng.integers(-1, 2, 3), 0, 255)), not (x < 2)))
    frame = spark.createDataFrame(pixels, "image_id long, x long, y long, r int, g int, b int, opaque boolean")
    clicks = [(7, 0, 6 / 47, 8 / 39, 2, None), (7, 1, 30 / 47, 20 / 39, 3, " sea/coast "), (7, 2, 1.5, 0.5, 2, None), (7, 3, 31 / 47, 21 / 39, 3, "sea-coast")]
    found = zones.extracted(frame, spark.createDataFrame(clicks, "image_id long, click int, x double, y double, radius int, name string"), side=16)
    rows = {r.layer: r for r in found.collect()}
    # the third click is beside the image; the fourth takes the second's colour, which the first of equals keeps
    assert set(rows) == {0, 1}
    assert rows[1].name == "sea-coast" and rows[0].name.endswith("-1")
    assert rows[0].cells == pytest.approx(16 * 25, abs=30) and rows[1].cells == pytest.approx(18 * 28, abs=30)
    says, shape = rows[1].pixel_feature.properties, rows[1].pixel_feature.geometry
    assert (says.mapElementType, says.is_pixel_space, says.stroke_width, shape.type) == ("zone", True, 2, "Polygon")
    assert says.color_hex == "#%02x%02x%02x" % tuple(says.color_rgb)
    unit = np.array(rows[1].normalized_feature.geometry.polygons[0][0])
    assert unit.min() == pytest.approx(0) and unit.max() == pytest.approx(1) and (unit[0] == unit[-1]).all()
    assert rows[1].normalized_feature.properties.name == "Zone sea-coast"
    assert zones.extracted(frame, spark.createDataFrame([], "image_id long, click int, x double, y double, radius int, name string"), side=16).count() == 0


def test_preparation_leaves_steps_out(spark):
    rows = [(1, x, 0, 10 * x, 5 * x, 255 - x) for x in range(20)]
    frame = spark.createDataFrame(rows, "image_id long, x long, y long, r int, g int, b int")
    plain = {r.x: r for r in zones.prepared(frame, "image_id", linear=False, denoise=False, stretch=False).collect()}
    assert plain[10].r == pytest.approx(100 / 255) and plain[19].b == pytest.approx(236 / 255)
    wide = zones.prepared(frame, "image_id", denoise=False).agg(F.min("r").alias("a"), F.max("r").alias("b")).first()
    assert wide.a == pytest.approx(0) and wide.b == pytest.approx(1)
