"""Documents by key: round trips, replacing, empty collections, refused pictures."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from maploom.operators import shapes
from maploom.sinks import documents


def test_texts_round_trip_and_replace_their_own(spark, tmp_path):
    rows = [("a", "one\n\ntwo\n"), ("b/c é", ""), ("d", None)]
    documents.write_texts(spark.createDataFrame(rows, "name string, text string"), f"{tmp_path}/t", "name")
    read = lambda: {r.name: r.text for r in documents.read(spark, f"{tmp_path}/t", "name").collect()}
    assert read() == {"a": "one\n\ntwo\n", "b/c é": "", "d": ""}
    documents.write_texts(spark.createDataFrame([("a", "new")], "name string, text string"), f"{tmp_path}/t", "name")
    assert read() == {"a": "new", "b/c é": "", "d": ""}


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    documents.write_texts(spark.createDataFrame([("a", "old")], "name string, text string"), f"{tmp_path}/t", "name")
    bad = spark.createDataFrame([("a", "new"), ("b", "new")], "name string, text string").withColumn("text", F.when(F.col("name") == "b", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        documents.write_texts(bad.select("name", F.col("text").cast("string").alias("text")), f"{tmp_path}/t", "name")
    assert [(r.name, r.text) for r in documents.read(spark, f"{tmp_path}/t", "name").collect()] == [("a", "old")]


def test_reports(spark):
    at = F.lit(datetime.datetime(2024, 3, 5, 7, 8, 9))
    row = spark.range(1).select(documents.extraction_report(F.lit("my.map.png"), F.array(F.lit("Paris"), F.lit("Lyon")), at).alias("text"), documents.report_name(F.lit("my.map.png"), at).alias("name")).first()
    assert row.name == "20240305_070809_my.map"
    assert row.text == "=== OCR EXTRACTION  ===\nSource File: my.map.png\nDate extraction: 2024-03-05 07:08:09\n\n=== TEXTE EXTRAIT ===\n\nParis\nLyon"


def test_collections_in_order(spark, tmp_path):
    rows = [(k % 3, k, (k * 1.5, "né")) for k in range(50)]
    features = spark.createDataFrame(rows, "image long, n long, feature struct<x: double, name: string>").repartition(4)
    documents.write_collections(features, f"{tmp_path}/c", "image", "n", keys=spark.range(5).withColumnRenamed("id", "image"))
    found = {int(r.image): json.loads(r.text) for r in documents.read(spark, f"{tmp_path}/c", "image").collect()}
    assert {k: v["type"] for k, v in found.items()} == dict.fromkeys(range(5), "FeatureCollection")
    assert [f["x"] for f in found[1]["features"]] == [k * 1.5 for k in range(1, 50, 3)] and found[4]["features"] == []


def test_shapes_metadata(spark, tmp_path):
    ring = [(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    rows = shapes.described(spark.createDataFrame([(1, 5, ring), (1, 3, ring), (2, 9, ring)], "image long, k long, ring array<struct<x: double, y: double>>"))
    documents.write_shapes_metadata(rows, f"{tmp_path}/m", "image", "k", 720.0)
    found = {int(r.image): json.loads(r.text) for r in documents.read(spark, f"{tmp_path}/m", "image").collect()}
    assert [s["shape_id"] for s in found[1]] == [1, 2] and found[2][0]["morphology"]["relative_size"] == 0.05
    assert found[2][0]["bounding_box"] == {"x": 0, "y": 0, "width": 10, "height": 5} and len(found[2][0]["geometry"]["pixel_coords"]["contour_points"]) == 4


def test_thumbnails(spark):
    projects = spark.createDataFrame([(1, 7, None), (2, 8, b"old")], "project_id long, user_id long, image binary")
    uploads = [(1, 7, "image/png", b"x", 1), (1, 7, "image/png", b"y", 2), (1, 7, "text/plain", b"z", 3), (2, 7, "image/png", b"z", 4), (2, 8, "image/png", b"", 5), (2, 8, "image/jpeg", b"12345", 6), (9, 8, "image/png", b"z", 7), (2, 8, None, None, 8)]
    saved, results = documents.with_thumbnails(projects, spark.createDataFrame(uploads, "project_id long, user_id long, content_type string, content binary, at long"), most=4)
    assert {r.project_id: bytes(r.image) for r in saved.collect()} == {1: b"y", 2: b"old"}
    assert [r.status for r in results.orderBy("at").collect()] == ["ok", "ok", "unsupported type", "project not found", "empty image", "image too large", "project not found", "unsupported type"]
