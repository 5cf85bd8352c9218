"""Rings on a coast, clipped to land that is not convex, and collections in degrees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maploom.functions import kernels
from maploom.operators import georeference, polygons

RINGS = "k long, ring array<struct<x: double, y: double>>"


def _closed(*points):
    return [*points, points[0]]


def test_simple_rings():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert kernels.is_simple(square) and kernels.is_simple(square[::-1])
    assert not kernels.is_simple(square[[0, 2, 1, 3]])
    assert not kernels.is_simple(np.array([(0, 0), (4, 0), (2, 0)], float))
    assert not kernels.is_simple(np.array([(0, 0), (4, 0), (4, 4), (4, 2), (4, 5)], float))
    rng = np.random.default_rng(3)
    turn = np.sort(rng.random(300)) * 2 * np.pi
    assert kernels.is_simple(np.column_stack([np.cos(turn), np.sin(turn)]) * rng.uniform(0.5, 1, (300, 1)))


def test_rings_that_would_cross_keep_their_place(spark):
    near, flat, far = _closed((0.0, 0.5), (9.0, 0.4), (9.0, 9.0), (0.0, 9.0)), _closed((0.0, 0.5), (9.0, 0.4), (5.0, 0.9)), _closed((50.0, 50.0), (59.0, 50.0), (59.0, 59.0))
    shapes = spark.createDataFrame([(1, near), (2, flat), (3, far)], RINGS)
    coast = spark.createDataFrame([(1, -20.0, 0.0, 20.0, 0.0)], "sid long, x1 double, y1 double, x2 double, y2 double")
    rows = {r.k: r for r in georeference.snapped_rings(shapes, coast, 1.0, "k").collect()}
    assert {k: r.snapped for k, r in rows.items()} == {1: 2, 2: 0, 3: 0}
    assert [tuple(p) for p in rows[1].ring] == _closed((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0))
    assert [tuple(p) for p in rows[2].ring] == flat and [tuple(p) for p in rows[3].ring] == far


def test_rings_with_a_corner_twice_in_a_row_snap(spark):
    twice, all_one = _closed((0.0, 0.5), (9.0, 0.4), (9.0, 9.0), (9.0, 9.0), (0.0, 9.0)), _closed((0.0, 0.5), (0.0, 0.5), (0.0, 0.4))
    shapes = spark.createDataFrame([(1, twice), (2, all_one)], RINGS)
    coast = spark.createDataFrame([(1, -20.0, 0.0, 20.0, 0.0)], "sid long, x1 double, y1 double, x2 double, y2 double")
    rows = {r.k: r for r in georeference.snapped_rings(shapes, coast, 1.0, "k").collect()}
    assert {k: r.snapped for k, r in rows.items()} == {1: 2, 2: 0}
    assert [tuple(p) for p in rows[1].ring] == _closed((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (9.0, 9.0), (0.0, 9.0)) and [tuple(p) for p in rows[2].ring] == all_one


def test_land_that_is_not_convex(spark):
    land = spark.createDataFrame([(1, _closed((0.0, 0.0), (200.0, 0.0), (200.0, 10.0), (0.0, 10.0))), (2, _closed((0.0, 10.0), (10.0, 10.0), (10.0, 200.0), (0.0, 200.0)))], RINGS.replace("k ", "part_id "))
    shapes = spark.createDataFrame([(1, _closed((0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0))), (2, _closed((20.0, 20.0), (90.0, 20.0), (90.0, 90.0))), (3, _closed((5.0, 20.0), (15.0, 20.0), (15.0, 30.0), (5.0, 30.0)))], RINGS)
    as_polygons = lambda rows: rows.withColumn("polygons", polygons.polygon(F.col("ring")))
    rows = {r.k: r for r in polygons.clipped_to_land(as_polygons(shapes), as_polygons(land), "k").collect()}
    assert set(rows) == {1, 3}
    # both pieces of land and their tiles, put together without seams
    assert rows[1].land_share == pytest.approx(0.19) and len(rows[1].polygons) == 1
    assert rows[3].land_share == pytest.approx(0.5)


def test_collections_without_enough_pairs_are_left_out(spark):
    pairs = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 1000.0, 0.0), (1, 0.0, 1.0, 0.0, -1000.0), (2, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 5.0, 0.0)], "image long, x double, y double, gx double, gy double")
    shapes = spark.createDataFrame([(i, i, _closed((0.0, 0.0), (2.0, 0.0), (2.0, 2.0))) for i in (1, 2)], "image long, " + RINGS)
    (row,) = georeference.georeferenced(shapes, pairs, "image", "k").collect()
    assert (row.k, row.snapped, row.crs, row.rmse_meters, row.is_pixel_space) == (1, 0, "EPSG:4326", 0.0, False)
    assert (row.ring[1].x, row.ring[2].y) == (pytest.approx(2000 / 111319.49, rel=1e-6), pytest.approx(-2000 / 111319.49, rel=1e-6))


def test_query_snaps_some(spark):
    from maploom.plans import registry

    found = registry.QUERIES["georeference_collection"](spark, "/root/testdata/sf0.01")
    assert found.agg(F.sum("snapped")).first()[0] > 0
