"""Drawn layers to features and back, strokes of a pencil, cities and matches: geometry as well as types.

A geometry is struct(type, parts): parts holds polygons of rings of points, a line is the one ring of one part, a point its
one point; each point is an array of lng and lat. A drawn layer's points are structs of lat and lng.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maploom.functions import geometry
from maploom.operators import editing

BLACK = (0, 0, 0)


def _coordinates(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["lng"].cast("double"), p["lat"].cast("double")))


def drawn_geometry(shape: Column, parts: Column, radius: Column) -> Column:
    """The geometry of a layer of this shape with parts (polygons of rings of points); null for unknown shapes and without points.

    text and marker are points, a circle is a polygon around its point of a radius in metres, line and freehand are lines,
    rectangle and polygon are polygons with their rings closed, or several of them as one.
    """
    first = F.get(F.get(F.get(parts, F.lit(0)), F.lit(0)), F.lit(0))
    made = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("parts"))
    around = F.transform(geometry.circle(first["lng"].cast("double"), first["lat"].cast("double"), radius.cast("double")), lambda p: F.array(p["x"], p["y"]))
    line = _coordinates(F.get(F.get(parts, F.lit(0)), F.lit(0)))
    areas = F.transform(parts, lambda rings: F.transform(rings, lambda r: geometry.closed(_coordinates(r))))
    return (
        F.when(first.isNull(), None).when(shape.isin("text", "marker"), made("Point", F.array(F.array(_coordinates(F.array(first))))))
        .when(shape == "circle", made("Polygon", F.array(F.array(around)))).when(shape.isin("line", "freehand"), made("LineString", F.array(F.array(line))))
        .when(shape.isin("rectangle", "polygon") & (F.size(parts) == 1), made("Polygon", areas)).when(shape.isin("rectangle", "polygon"), made("MultiPolygon", areas))
    )


def drawn_features(layers: DataFrame, at: Column) -> DataFrame:
    """Features of layers: id, project_id, map_id, geometry, properties, created_at, updated_at, name.

    layers: id, project_id, map_id, shape, parts, radius, text, created_at, and what a feature that a layer had already said,
    or null: name, kept_type, size_px, color_name, color_rgb, fill_opacity, stroke_color, stroke_width, stroke_opacity.
    Labels without text, layers of no project, and those without a geometry make no feature.
    """
    c = F.col
    text = F.when(c("shape") == "text", F.trim(F.coalesce("text", F.lit(""))))
    kind = F.coalesce(c("kept_type"), F.when(c("shape") == "freehand", "polyline").otherwise(editing.drawn_type(c("shape"))))
    black = F.array(*map(F.lit, BLACK))
    or_ = lambda name, value: F.coalesce(c(name), value).alias(name)
    says = F.struct(
        F.coalesce("name", F.lit("")).alias("name"), text.alias("label_text"), F.when(c("shape") == "text", F.coalesce("size_px", F.lit(12))).alias("size_px"), or_("color_name", F.lit("black")), or_("color_rgb", black),
        or_("fill_opacity", F.lit(0.5)), F.coalesce("stroke_color", "color_rgb").alias("stroke_color"), or_("stroke_width", F.lit(2)), or_("stroke_opacity", F.lit(0.5)), kind.alias("map_element_type"),
    )
    rows = layers.withColumn("geometry", drawn_geometry(c("shape"), c("parts"), c("radius")))
    rows = rows.where(c("geometry").isNotNull() & c("project_id").isNotNull() & F.coalesce(text != "", F.lit(True)))
    return rows.select("id", "project_id", "map_id", "geometry", says.alias("properties"), F.coalesce("created_at", at).alias("created_at"), at.alias("updated_at"), F.coalesce("name", F.lit("")).alias("name"))


def layers_of(features: DataFrame) -> DataFrame:
    """id, layer, parts (points of lat and lng again), text and style of features; those without a geometry are left out.

    A label is a text, any other point a marker. A weight or fill opacity of 0 counts as not given.
    """
    c, p = F.col, lambda n: F.col(f"properties.{n}")
    kind = c("geometry.type")
    layer = F.when((kind == "Point") & (p("map_element_type") == "label"), "text").when(kind == "Point", "marker").when(kind == "LineString", "line").when(kind.isin("Polygon", "MultiPolygon"), "polygon")
    back = F.transform("geometry.parts", lambda rings: F.transform(rings, lambda r: F.transform(r, lambda q: F.struct(q[1].alias("lat"), q[0].alias("lng")))))
    css = lambda v: F.when(v.isNotNull(), F.concat(F.lit("rgb("), F.array_join(F.transform(v, lambda n: n.cast("string")), ", "), F.lit(")")))
    fill = F.coalesce(css(p("color_rgb")), F.lit("#000000"))
    given = lambda v, other: F.coalesce(F.when(v != 0, v), F.lit(other))
    style = F.struct(given(p("stroke_width"), 2).alias("weight"), fill.alias("fill_color"), given(p("fill_opacity"), 0.5).alias("fill_opacity"), F.coalesce(css(p("stroke_color")), fill).alias("stroke_color"), F.coalesce(p("stroke_opacity"), F.lit(0.5)).alias("stroke_opacity"))
    return features.where(layer.isNotNull()).select("id", layer.alias("layer"), back.alias("parts"), F.when(layer == "text", F.coalesce(p("label_text"), F.lit(""))).alias("text"), style.alias("style"))


def strokes(moves: DataFrame, by: str, *order: str) -> DataFrame:
    """by, stroke (from 1) and points of the strokes of a pencil, from rows (by, order, kind, lat, lng).

    A stroke begins where the button goes down and takes each move until it comes up again; moves at other times are none.
    A second press begins anew, and what was drawn until then is lost with it, as are strokes of one point and open ones.
    Points are in order; a stroke's are one array, as its feature holds them.
    """
    c = F.col
    window = Window.partitionBy(by).orderBy(*order)
    rows = moves.where(c("kind").isin("down", "move", "up")).withColumn("press", F.sum((c("kind") == "down").cast("int")).over(window)).where("press > 0")
    # within a press, what comes before the first release
    inside = Window.partitionBy(by, "press").orderBy(*order)
    rows = rows.withColumn("ups", F.sum((c("kind") == "up").cast("int")).over(inside))
    listed = rows.groupBy(by, "press").agg(
        F.array_sort(F.collect_list(F.when((c("kind") != "up") & (c("ups") == 0), F.struct(F.struct(*order).alias("o"), F.struct("lat", "lng").alias("p"))))).alias("points"), F.max("ups").alias("ups")
    )
    drawn = listed.where((c("ups") > 0) & (F.size("points") > 1))
    return drawn.select(by, F.row_number().over(Window.partitionBy(by).orderBy("press")).alias("stroke"), F.transform("points", lambda q: q["p"]).alias("points"))


def polygonal(members: Column) -> Column:
    """What is left of a collection's geometries (structs of type and parts) once only polygons stay: a polygon, several as
    one, or null."""
    parts = F.flatten(F.transform(F.filter(members, lambda m: m["type"].isin("Polygon", "MultiPolygon")), lambda m: m["parts"]))
    return F.when(F.size(parts) > 0, F.struct(F.when(F.size(parts) > 1, "MultiPolygon").otherwise("Polygon").alias("type"), parts.alias("parts")))


def next_unmatched(keypoints: DataFrame, matched: DataFrame, current: DataFrame, by: str, keypoint: str) -> DataFrame:
    """by and keypoint: the next one after current (by, keypoint) without a match, going on from the first after the last; none if all have one."""
    c = F.col
    open_ = keypoints.select(by, keypoint).join(matched.select(by, keypoint), [by, keypoint], "left_anti")
    met = open_.join(current.select(by, c(keypoint).alias("_now")), by)
    return met.groupBy(by).agg(F.min(F.struct(c(keypoint) <= c("_now"), keypoint)).alias("k")).select(by, c(f"k.{keypoint}").alias(keypoint))


def moved(box: Column, dx: Column, dy: Column) -> Column:
    """A picture's box (x1, y1, x2, y2) as far to the right and down."""
    return F.struct(*((box[n] + (dx if n[0] == "x" else dy)).alias(n) for n in ("x1", "y1", "x2", "y2")))
