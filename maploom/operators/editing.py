"""What users draw and edit: layers to features, boxes, matches, and rows as they are stored and sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.operators.documents import AUDIT, latest


def stored(text: Column) -> Column:
    """JSON text of a feature to its members as they are stored: without audit members, properties an object at least."""
    members = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: ~k.isin(*AUDIT))
    return F.transform_values(members, lambda k, v: F.when((k == "properties") & ~F.coalesce(v, F.lit("")).startswith("{"), F.lit("{}")).otherwise(v))


def first_feature(text: Column) -> Column:
    """The first feature of a collection's JSON text; null where there is none or the text is no collection."""
    return F.get_json_object(text, "$.features[0]")


def without_dates(text: Column) -> Column:
    """The members of an object's JSON text but createdAt and updatedAt; null for what is no object."""
    return F.map_filter(F.from_json(F.when(F.ltrim(text).startswith("{"), text), "map<string,string>"), lambda k, _: ~k.isin("createdAt", "updatedAt"))


def sent(rows: DataFrame) -> DataFrame:
    """Rows (id, project_id, map_id, data, created_at, updated_at, image, mime) as they are sent; rows without data drop out."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    image = F.when(F.col("image").isNotNull(), F.base64("image"))
    return rows.where("data IS NOT NULL").select(
        "id", "project_id", "map_id", "data", iso("created_at").alias("created_at"), iso("updated_at").alias("updated_at"), image.alias("image"),
        F.when(image.isNotNull(), F.coalesce("mime", F.lit("image/png"))).alias("mime"),
    )


def gate(state: Column) -> Column:
    """The answer code of a task: 200 with a result, 500 for a failure, 202 while it runs."""
    return F.when(state == "SUCCESS", 200).when(state == "FAILURE", 500).otherwise(202)


def parsed_bounds(text: Column) -> Column:
    """struct(west, south, east, north) of [[S, W], [N, E]] or [W, S, E, N]; null for other texts."""
    pairs, flat = F.from_json(text, "array<array<double>>"), F.from_json(text, "array<double>")
    box = lambda w, s, e, n: F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    corner = lambda i, j: F.get(F.get(pairs, F.lit(i)), F.lit(j))
    nested = (F.size(pairs) == 2) & (F.size(F.get(pairs, F.lit(0))) == 2) & (F.size(F.get(pairs, F.lit(1))) == 2)
    return F.when(nested, box(corner(0, 1), corner(0, 0), corner(1, 1), corner(1, 0))).when((F.size(flat) == 4) & F.get(flat, F.lit(0)).isNotNull(), box(*(F.get(flat, F.lit(k)) for k in range(4))))


def drawn_type(shape: Column, kept: Column | None = None) -> Column:
    """The element type of a drawn layer; a type it has already wins."""
    types = {"text": "label", "marker": "point", "circle": "shape", "line": "polyline", "rectangle": "shape", "polygon": "zone"}
    known = F.element_at(F.create_map(*(F.lit(x) for pair in types.items() for x in pair)), shape)
    return known if kept is None else F.coalesce(kept, known)


def layer_type(element: Column) -> Column:
    """The layer that shows an element type; null for unknown ones."""
    return F.when(element == "label", "text").when(element == "point", "marker").when(element == "polyline", "line").when(element.isin("zone", "shape"), "polygon")


def finalised_labels(edits: DataFrame, layer: str, text: str, *order: str) -> DataFrame:
    """Per layer the first text that is not blank, trimmed."""
    rows = edits.withColumn(text, F.trim(text)).where(F.length(text) > 0)
    return rows.groupBy(layer).agg(F.min_by(text, F.struct(*order)).alias("name"))


def view_bounds(lon: Column, lat: Column, height: Column, aspect: Column) -> Column:
    """A box of a height in degrees around a place whose sides look as aspect (width by height) says at its latitude."""
    half = height * aspect / F.cos(F.radians(lat)) / 2
    return F.struct((lon - half).alias("west"), (lat - height / 2).alias("south"), (lon + half).alias("east"), (lat + height / 2).alias("north"))


def dragged_box(x1: Column, y1: Column, x2: Column, y2: Column, least: float = 2.0) -> Column:
    """The box between two corners; null where a side is shorter than least."""
    w, h = F.abs(x2 - x1), F.abs(y2 - y1)
    return F.when((w >= least) & (h >= least), F.struct(F.least(x1, x2).alias("x"), F.least(y1, y2).alias("y"), w.alias("width"), h.alias("height")))


def matches(clicks: DataFrame, by: str, keypoint: str, *order: str, least: int = 4) -> DataFrame:
    """The last match of each keypoint, of those groups that have at least `least`."""
    last = clicks.groupBy(by, keypoint).agg(F.max_by(F.struct(*clicks.columns), F.struct(*order)).alias("_last")).select("_last.*")
    enough = last.groupBy(by).agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") >= least)
    return last.join(enough, by)


def resized(west: Column, north: Column, width: Column, aspect: Column, least: float = 10.0) -> Column:
    """A picture's box in pixels of the screen (y grows downwards) that keeps its upper left corner and its proportions."""
    w = F.greatest(width, F.lit(least))
    return F.struct(west.alias("x1"), north.alias("y1"), (west + w).alias("x2"), (north + w / aspect).alias("y2"))


def polygonal(types: Column) -> Column:
    """What is left of a collection of geometries, by their types, once only polygons stay."""
    n = F.size(F.filter(types, lambda t: t == "Polygon"))
    return F.when(n > 1, "MultiPolygon").when(n == 1, "Polygon")


def saved(before: DataFrame, sent_rows: DataFrame, pending: DataFrame, key: str, *order: str) -> DataFrame:
    """What a project holds after a save: rows that were there, replaced by those sent, without those pending deletion."""
    every = before.withColumn("_sent", F.lit(0)).unionByName(sent_rows.withColumn("_sent", F.lit(1)))
    return latest(every, key, "_sent", *order).drop("_sent").join(pending.select(key), key, "left_anti")
