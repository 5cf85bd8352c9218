"""Drawn layers, features, strokes and matches, with their geometry."""

import datetime

from pyspark.sql import functions as F

from maploom.operators import drawing

POINTS = "array<array<array<struct<lat: double, lng: double>>>>"
LAYERS = f"id long, project_id long, map_id long, shape string, parts {POINTS}, radius double, text string, created_at timestamp, name string, kept_type string, size_px int, color_name string, color_rgb array<int>, fill_opacity double, stroke_color array<int>, stroke_width int, stroke_opacity double"
AT = datetime.datetime(2024, 1, 2)


def row(k, shape, parts, project=1, radius=None, text=None, **more):
    rest = {c: None for c in ("created_at", "name", "kept_type", "size_px", "color_name", "color_rgb", "fill_opacity", "stroke_color", "stroke_width", "stroke_opacity")} | more
    return (k, project, None, shape, parts, radius, text, *rest.values())


def test_layers_to_features_and_back(spark):
    p, tri = [[[(1.0, 2.0)]]], [(0.0, 0.0), (0.0, 5.0), (5.0, 0.0)]
    rows = [
        row(1, "text", p, text="  Lyon "), row(2, "text", p, text="  "), row(3, "marker", p), row(4, "circle", p, radius=1000.0), row(5, "line", [[tri]]), row(6, "polygon", [[tri, [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0)]]]),
        row(7, "polygon", [[tri], [tri]], color_rgb=[1, 2, 3], stroke_width=0), row(8, "rectangle", [[tri]], kept_type="zone"), row(9, "star", p), row(10, "marker", p, project=None), row(11, "marker", []), row(12, "freehand", [[tri]]),
    ]
    found = drawing.drawn_features(spark.createDataFrame(rows, LAYERS), F.lit(AT))
    got = {r.id: r for r in found.collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7, 8, 12}
    assert {k: r.geometry.type for k, r in got.items()} == {1: "Point", 3: "Point", 4: "Polygon", 5: "LineString", 6: "Polygon", 7: "MultiPolygon", 8: "Polygon", 12: "LineString"}
    assert {k: r.properties.map_element_type for k, r in got.items()} == {1: "label", 3: "point", 4: "shape", 5: "polyline", 6: "zone", 7: "zone", 8: "zone", 12: "polyline"}
    assert got[1].geometry.parts == [[[[2.0, 1.0]]]] and (got[1].properties.label_text, got[1].properties.size_px) == ("Lyon", 12)
    assert got[6].geometry.parts[0][1] == [[1.0, 1.0], [2.0, 1.0], [1.0, 2.0], [1.0, 1.0]] and len(got[4].geometry.parts[0][0]) == 33
    back = {r.id: r for r in drawing.layers_of(found).collect()}
    assert back[1].layer == "text" and back[1].text == "Lyon" and back[3].layer == "marker" and back[7].layer == "polygon"
    assert [tuple(q) for q in back[5].parts[0][0]] == tri
    assert (back[7].style.weight, back[7].style.fill_color, back[6].style.stroke_color) == (2, "rgb(1, 2, 3)", "rgb(0, 0, 0)")


def test_strokes(spark):
    kinds = ["move", "down", "move", "move", "up", "move", "down", "up", "down", "move", "down", "move", "up", "up", "down", "move"]
    rows = [(7, k, kind, float(k), -float(k)) for k, kind in enumerate(kinds)]
    got = drawing.strokes(spark.createDataFrame(rows, "user long, n long, kind string, lat double, lng double"), "user", "n").orderBy("stroke").collect()
    assert [(r.stroke, [q.lat for q in r.points]) for r in got] == [(1, [1.0, 2.0, 3.0]), (2, [10.0, 11.0])]


def test_polygonal_members_matches_and_boxes(spark):
    g = "struct<type: string, parts: array<array<array<array<double>>>>>"
    ring = [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]]
    rows = [(1, [("Point", [[[[1.0, 1.0]]]]), ("Polygon", [ring])]), (2, [("MultiPolygon", [ring, ring]), ("Polygon", [ring])]), (3, [("LineString", [ring])]), (4, [])]
    got = {r.k: r.p for r in spark.createDataFrame(rows, f"k long, m array<{g}>").select("k", drawing.polygonal(F.col("m")).alias("p")).collect()}
    assert got[1].type == "Polygon" and got[2].type == "MultiPolygon" and len(got[2].parts) == 3 and got[3] is None and got[4] is None
    df = lambda rows: spark.createDataFrame(rows, "image long, keypoint long")
    points = df([(i, k) for i in (1, 2, 3) for k in range(5)])
    found = drawing.next_unmatched(points, df([(1, 3), (2, 4), (2, 3)] + [(3, k) for k in range(5)]), df([(1, 2), (2, 2), (3, 0)]), "image", "keypoint")
    assert {(r.image, r.keypoint) for r in found.collect()} == {(1, 4), (2, 0)}
    box = F.struct(*(F.lit(v).alias(n) for n, v in (("x1", 1), ("y1", 2), ("x2", 3), ("y2", 4))))
    assert tuple(spark.range(1).select(drawing.moved(box, F.lit(10), F.lit(-1)).alias("b")).first().b) == (11, 1, 13, 3)
