import json
import struct
import zlib

from pyspark.sql import functions as F

from maploom.operators import documents
from maploom.sources import geojson, images


def png(width, height, rows=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + r for r in rows) if rows else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg(width, height):
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"J" * 14
    return b"\xff\xd8" + app + b"\xff\xff\xc2" + struct.pack(">HBHH", 11, 8, height, width) + b"\1\1\1\0"


def test_sizes_come_from_headers(spark, tmp_path):
    for name, data in (("a.png", png(640, 480)), ("b.JPG", jpeg(1024, 768)), ("c.txt", png(1, 1)), ("d.png", b"not"), ("e.png", b""), ("f.jpeg", jpeg(0, 5)), ("g.jpg", b"\xff\xd8\xff\xc0\0")):
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in images.scan(spark, str(tmp_path)).collect()}
    assert found == {"a.png": (640, 480), "b.JPG": (1024, 768), "d.png": (None, None), "f.jpeg": (None, None), "g.jpg": (None, None)}


def test_pixels_of_a_picture(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(png(2, 2, [bytes([255, 0, 1, 255, 9, 8, 7, 0]), bytes([1, 2, 3, 255, 4, 5, 6, 255])]))
    got = sorted((r.y, r.x, r.r, r.g, r.b, r.opaque) for r in images.pixels(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 255, 0, 1, True), (0, 1, 9, 8, 7, False), (1, 0, 1, 2, 3, True), (1, 1, 4, 5, 6, True)]


def test_geojson_of_every_depth(spark, tmp_path):
    line = [[0.0, 0.0], [3.0, 4.0], [3.0, 0.0]]
    geometries = [("Point", [1.0, 2.0]), ("LineString", line), ("Polygon", [line]), ("MultiPolygon", [[line], [line]]), ("Point", "bad"), ("Odd", [])]
    features = [{"type": "Feature", "id": str(k), "geometry": {"type": t, "coordinates": c}, "properties": {"k": k}} for k, (t, c) in enumerate(geometries)] + [{"type": "Feature", "geometry": None}]
    (tmp_path / "all.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "one.geojson").write_text(json.dumps(features[1] | {"id": "lone"}))
    rows = {r.feature_id: r for r in geojson.read(spark, str(tmp_path)).collect()}
    assert set(rows) == {"0", "1", "2", "3", "lone"}
    assert rows["0"].rings == [[[[1.0, 2.0]]]] or rows["0"].rings == [[[1.0, 2.0]]]
    assert rows["2"].rings == [[line]] and rows["3"].rings == [[line], [line]] and rows["1"].properties == {"k": "1"}
    parts = geojson.segments(geojson.read(spark, str(tmp_path), ("LineString", "MultiPolygon")))
    assert parts.count() == 2 + 2 + 4


def test_features_written_are_read(spark, tmp_path):
    rows = spark.range(5).select(F.struct(F.lit("Point").alias("type"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("coordinates")).alias("geometry"), F.struct(F.col("id").alias("n")).alias("properties"))
    geojson.write(rows, f"{tmp_path}/out")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(x["geometry"]["coordinates"][0] for x in lines) == [0, 1, 2, 3, 4] and {x["type"] for x in lines} == {"Feature"}
    assert documents.AUDIT
