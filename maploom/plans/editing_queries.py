"""Queries of edits and of rows as they are stored and sent, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.operators import documents, drawing, editing
from maploom.plans.views import tables, view


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables(spark, sf_dir, [name])[name]


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as feature texts, of which some have a list or nothing for properties."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    props = F.when(k % 3 == 0, F.lit("[]")).when(k % 3 == 1, F.to_json(F.struct(F.col("p_size").alias("size"))))
    text = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"map_id":7,"created_at":"x","project_id":'), F.col("p_size").cast("string"), F.lit(',"properties":'), F.coalesce(props, F.lit("null")), F.lit("}"))
    stored = p.select("p_partkey", editing.stored(text).alias("m"))
    return stored.select("p_partkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("members"), F.element_at("m", "properties").alias("properties"), F.element_at("m", "project_id").cast("int").alias("project_id"))


def first_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    one = lambda n: F.format_string('{"n":%d}', n)
    text = F.when(k % 4 == 0, F.lit("[1]")).when(k % 4 == 1, F.lit('{"features":[]}')).otherwise(F.concat(F.lit('{"features":['), one(k), F.lit(","), one(k + 1), F.lit("]}")))
    return p.select("p_partkey", editing.first_feature(text).alias("feature"))


def without_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.when(k % 5 == 0, F.lit('"text"')).otherwise(F.to_json(F.struct(F.col("p_size").alias("size"), F.lit("a").alias("createdAt"), F.lit("b").alias("updatedAt"), F.col("p_brand").alias("brand"))))
    m = editing.without_dates(text)
    return p.select("p_partkey", F.to_json(m).alias("kept"))


def sent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        k.alias("id"), F.col("o_custkey").alias("project_id"), F.when(k % 3 > 0, k).alias("map_id"), F.when(k % 7 > 0, F.col("o_orderpriority")).alias("data"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.when(k % 2 == 0, F.encode("o_orderstatus", "UTF-8")).alias("image"), F.when(k % 4 == 0, "image/jpeg").alias("mime"),
    )
    return editing.sent(rows)


def inserted_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New projects are private unless they say otherwise."""
    rows = view(spark, sf_dir, "v_projects").where("project_id % 2 = 1")
    return rows.select("project_id", "user_id", "title", F.coalesce("is_private", F.lit(True)).alias("is_private"))


def result_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_id") % 4 == 0, "SUCCESS").when(F.col("event_id") % 4 == 1, "FAILURE").when(F.col("event_id") % 4 == 2, "PROGRESS")
    code = editing.gate(state)
    return _t(spark, sf_dir, "events").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum(F.when(code == 200, F.col("value"))), 3).alias("result"))


def parsed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    nested = F.format_string("[[%d, %d], [%d, %d]]", F.col("p_size"), k, F.col("p_size") + 1, k + 2)
    flat = F.format_string("[%d, %d, %d, %d]", k, F.col("p_size"), k + 2, F.col("p_size") + 1)
    text = F.when(k % 4 == 0, nested).when(k % 4 == 1, flat).when(k % 4 == 2, F.lit("[1, 2, 3]")).otherwise(F.lit("here"))
    return p.select("p_partkey", editing.parsed_bounds(text).alias("b")).select("p_partkey", "b.*")


SHAPES = ("text", "marker", "circle", "line", "rectangle", "polygon", "freehand")


def drawn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn layers to features: labels without text and layers of no known kind drop out, styles get defaults."""
    e, k = _t(spark, sf_dir, "events"), F.col("event_id")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (k % 7 + 1).cast("int"))
    rows = e.select(k, shape.alias("shape"), F.when(k % 11 == 0, "zone").alias("kept"), F.when(k % 5 > 0, F.trim("event_type")).otherwise("").alias("text"), F.when(k % 3 == 0, F.lit("#123456")).alias("colour"))
    typed = rows.withColumn("element_type", editing.drawn_type(F.col("shape"), F.col("kept"))).where("element_type IS NOT NULL AND NOT (element_type = 'label' AND text = '')")
    return typed.select("event_id", "element_type", F.coalesce("colour", F.lit("#000000")).alias("colour"), editing.layer_type(F.col("element_type")).alias("layer"))


def finalised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select((F.col("event_id") % 300).alias("layer"), "ts", "event_id", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("  "), "event_type", F.lit(" "))).otherwise("  ").alias("text"))
    return editing.finalised_labels(e, "layer", "text", "ts", "event_id")


def added_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities added in a year: black points that live in it."""
    p = _t(spark, sf_dir, "part")
    year = 1990 + F.col("p_size")
    return p.select("p_partkey", F.trim("p_name").alias("name"), F.make_date(year, F.lit(1), F.lit(1)).alias("start_date"), F.make_date(year, F.lit(12), F.lit(31)).alias("end_date"), F.lit("#000000").alias("colour")).where("name <> ''")


def freehand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes of each user's pencil: every fifth event presses, some others release, the rest move."""
    e, k = _t(spark, sf_dir, "events"), F.col("event_id") % 5
    moves = e.select("user_id", "ts", "event_id", F.when(k == 0, "down").when(k == 3, "up").otherwise("move").alias("kind"), F.floor("value").cast("double").alias("lat"), (F.col("event_id") % 360).cast("double").alias("lng"))
    found = drawing.strokes(moves, "user_id", "ts", "event_id")
    total = lambda c: F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p[c])
    return found.select("user_id", "stroke", F.size("points").alias("points"), total("lat").alias("lat"), total("lng").alias("lng"))


def drawn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers drawn around each part's place to features with their geometry, and back to layers."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    at = lambda dy, dx: F.struct((k % 60 + dy).cast("double").alias("lat"), (k % 90 + dx).cast("double").alias("lng"))
    ring = F.array(at(0, 0), at(0, 4), at(3, 4), at(3, 0))
    parts = F.when(k % 14 == 5, F.array(F.array(ring), F.array(ring))).when(k % 14 == 12, F.array(F.array(ring, F.array(at(1, 1), at(1, 2), at(2, 1))))).otherwise(F.array(F.array(ring)))
    none = {"created_at": "timestamp", "name": "string", "kept_type": "string", "size_px": "int", "color_name": "string", "color_rgb": "array<int>", "fill_opacity": "double", "stroke_color": "array<int>", "stroke_width": "int", "stroke_opacity": "double"}
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (k % 7 + 1).cast("int"))
    layers = p.select(k.alias("id"), F.when(k % 29 > 0, k % 10).alias("project_id"), F.lit(None).cast("long").alias("map_id"), shape.alias("shape"), parts.alias("parts"), F.lit(1000.0).alias("radius"), F.when(k % 3 > 0, F.lit(" a ")).otherwise(" ").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()))
    features = drawing.drawn_features(layers, F.lit("2024-01-02").cast("timestamp"))
    back = drawing.layers_of(features).select("id", "layer", F.col("parts")[0][0][0]["lat"].alias("lat"))
    count = F.aggregate("geometry.parts", F.lit(0), lambda n, rings: n + F.aggregate(rings, F.lit(0), lambda m, r: m + F.size(r)))
    said = features.select("id", F.col("geometry.type").alias("type"), F.col("properties.map_element_type").alias("element_type"), count.alias("points"))
    return said.join(back, "id").select("id", "type", "element_type", "points", "layer", F.round("lat", 6).alias("lat"))


def project_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_features").select("feature_id", "project_id", "x", "r", "line")
    new = f.where("r % 3 = 0").withColumn("x", F.col("x") + 1)
    kept = editing.saved(f.where("r % 2 = 0"), new, f.where("line = 6"), "feature_id", "x")
    return kept.groupBy("project_id").agg(F.count(F.lit(1)).alias("features"), F.sum("x").alias("sum_x"))


def view_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    lat = ((F.col("p_partkey") * 7) % 120 - 60).cast("double")
    b = editing.view_bounds((F.col("p_partkey") % 180).cast("double"), lat, F.lit(4.0), (F.col("p_size") + 10) / 20)
    return p.select("p_partkey", b.alias("b")).select("p_partkey", *(F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")))


def dragged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    corner = lambda c: c.cast("double")
    return p.select("p_partkey", editing.dragged_box(corner(k % 50), corner(k % 40), corner(F.col("p_size")), corner((k * 3) % 40)).alias("b")).select("p_partkey", "b.*")


def keypoint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _t(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("image"), (F.col("event_id") % 13).alias("keypoint"), "ts", "event_id", F.col("value").alias("place"))
    return editing.matches(clicks.where("event_id % 5 <> 2"), "image", "keypoint", "ts", "event_id").select("image", "keypoint", "event_id", "pairs")


def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    b = editing.resized(F.lit(100.0), F.lit(50.0), (F.col("p_size") - 5).cast("double"), 1 + (F.col("p_partkey") % 3) / 2)
    return p.select("p_partkey", b.alias("b")).select("p_partkey", *(F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


def polygonal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.when(F.col("kind") == "A", "Point").when(F.col("kind") == "N", "LineString").otherwise("Polygon")
    listed = view(spark, sf_dir, "v_features").groupBy("source_id").agg(F.collect_list(types).alias("t"))
    return listed.select(editing.polygonal(F.col("t")).alias("geometry")).groupBy("geometry").agg(F.count(F.lit(1)).alias("collections"))


def extracted_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row to write for each extracted feature, a collection of its own; rows of maps that their project lacks are set aside."""
    f, maps = view(spark, sf_dir, "v_features"), view(spark, sf_dir, "v_maps").select("map_id", F.col("project_id").alias("owner"))
    joined = f.join(maps, "map_id", "left")
    valid = F.col("map_id").isNull() | F.col("owner").eqNullSafe(F.col("project_id"))
    one = documents.collection(documents.feature(F.col("x"), F.col("y"), F.struct("kind")))
    return joined.select(valid.alias("written"), F.size(one["features"]).alias("n")).groupBy("written").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("long").alias("features"))


def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded pictures of allowed types as features: a name, a type, bounds, and a point in their middle."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    mime = F.element_at(F.array(*map(F.lit, ("image/png", "image/jpeg", "image/jpg", "text/html"))), (k % 4 + 1).cast("int"))
    half = F.when(k % 5 > 0, 8.0 * F.col("p_size") * 40 / 800).otherwise(8.0)
    rows = p.select("p_partkey", F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), F.lit("Image")).alias("name"), mime.alias("mime"), F.round(-half, 6).alias("west"), F.round(half, 6).alias("east"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return rows.where(F.col("mime").isin("image/png", "image/jpeg", "image/jpg"))


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of languages that the list of codes lacks."""
    return _t(spark, sf_dir, "documents").where(~F.col("lang").isin("en", "fr")).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))


LAYER = "CASE WHEN event_id % 11 = 0 THEN 'zone' ELSE CASE event_id % 7 WHEN 0 THEN 'label' WHEN 1 THEN 'point' WHEN 2 THEN 'shape' WHEN 3 THEN 'polyline' WHEN 4 THEN 'shape' WHEN 5 THEN 'zone' END END"

QUERIES = {
    "stored_features": (
        stored_features,
        """SELECT p_partkey, 'project_id,properties' AS members, CASE WHEN p_partkey % 3 = 1 THEN '{"size":' || p_size || '}' ELSE '{}' END AS properties, cast(p_size AS INT) AS project_id FROM {part}""",
    ),
    "first_features": (first_features, """SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 THEN '{"n":' || p_partkey || '}' END AS feature FROM {part}"""),
    "without_dates": (without_dates, """SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN '{"size":"' || p_size || '","brand":"' || p_brand || '"}' END AS kept FROM {part}"""),
    "sent_rows": (
        sent_rows,
        """SELECT o_orderkey AS id, o_custkey AS project_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS map_id, o_orderpriority AS data, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, NULL::VARCHAR AS updated_at,
                  CASE WHEN o_orderkey % 2 = 0 THEN base64(encode(o_orderstatus)) END AS image, CASE WHEN o_orderkey % 4 = 0 THEN 'image/jpeg' WHEN o_orderkey % 2 = 0 THEN 'image/png' END AS mime FROM {orders} WHERE o_orderkey % 7 > 0""",
    ),
    "inserted_projects": (inserted_projects, "SELECT project_id, user_id, title, coalesce(is_private, TRUE) AS is_private FROM v_projects WHERE project_id % 2 = 1"),
    "result_gate": (
        result_gate,
        "SELECT cast(CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 500 ELSE 202 END AS INT) AS code, count(*) AS tasks, round(sum(CASE WHEN event_id % 4 = 0 THEN value END), 3) AS result FROM {events} GROUP BY 1",
    ),
    "parsed_bounds": (
        parsed_bounds,
        "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_partkey END::DOUBLE AS west, CASE WHEN p_partkey % 4 < 2 THEN p_size END::DOUBLE AS south, CASE WHEN p_partkey % 4 < 2 THEN p_partkey + 2 END::DOUBLE AS east, CASE WHEN p_partkey % 4 < 2 THEN p_size + 1 END::DOUBLE AS north FROM {part}",
    ),
    "drawn_features": (
        drawn_features,
        f"""WITH d AS (SELECT event_id, {LAYER} AS element_type, CASE WHEN event_id % 3 = 0 THEN '#123456' ELSE '#000000' END AS colour FROM {{events}})
            SELECT *, CASE WHEN element_type = 'label' THEN 'text' WHEN element_type = 'point' THEN 'marker' WHEN element_type = 'polyline' THEN 'line' ELSE 'polygon' END AS layer FROM d WHERE element_type IS NOT NULL AND NOT (element_type = 'label' AND event_id % 5 = 0)""",
    ),
    "finalised_labels": (finalised_labels, "SELECT event_id % 300 AS layer, arg_min(event_type, struct_pack(t := ts, e := event_id)) AS name FROM {events} WHERE event_id % 3 > 0 GROUP BY 1"),
    "added_cities": (added_cities, "SELECT p_partkey, trim(p_name) AS name, make_date(1990 + p_size, 1, 1) AS start_date, make_date(1990 + p_size, 12, 31) AS end_date, '#000000' AS colour FROM {part} WHERE trim(p_name) <> ''"),
    "freehand_lines": (
        freehand_lines,
        """WITH m AS (SELECT user_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'down' WHEN 3 THEN 'up' ELSE 'move' END AS kind, floor(value) AS lat, (event_id % 360)::DOUBLE AS lng FROM {events}),
           p AS (SELECT *, sum(CASE WHEN kind = 'down' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS press FROM m),
           u AS (SELECT *, sum(CASE WHEN kind = 'up' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, press ORDER BY ts, event_id) AS ups FROM p WHERE press > 0),
           g AS (SELECT user_id, press, max(ups) AS ups, count(*) FILTER (ups = 0) AS points, sum(lat) FILTER (ups = 0) AS lat, sum(lng) FILTER (ups = 0) AS lng FROM u GROUP BY ALL)
           SELECT user_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY press) AS INT) AS stroke, cast(points AS INT) AS points, lat, lng FROM g WHERE ups > 0 AND points > 1""",
    ),
    "drawn_shapes": (
        drawn_shapes,
        """WITH l AS (SELECT p_partkey AS id, p_partkey % 7 AS s, p_partkey % 14 AS f, (p_partkey % 60)::DOUBLE AS lat FROM {part} WHERE p_partkey % 29 > 0 AND NOT (p_partkey % 7 = 0 AND p_partkey % 3 = 0))
           SELECT id, CASE WHEN s < 2 THEN 'Point' WHEN s = 2 THEN 'Polygon' WHEN s IN (3, 6) THEN 'LineString' WHEN f = 5 THEN 'MultiPolygon' ELSE 'Polygon' END AS type,
                  CASE s WHEN 0 THEN 'label' WHEN 1 THEN 'point' WHEN 2 THEN 'shape' WHEN 4 THEN 'shape' WHEN 5 THEN 'zone' ELSE 'polyline' END AS element_type,
                  cast(CASE WHEN s < 2 THEN 1 WHEN s = 2 THEN 33 WHEN s IN (3, 6) THEN 4 WHEN f = 5 THEN 10 WHEN f = 12 THEN 9 ELSE 5 END AS INT) AS points,
                  CASE WHEN s = 0 THEN 'text' WHEN s = 1 THEN 'marker' WHEN s IN (3, 6) THEN 'line' ELSE 'polygon' END AS layer, lat FROM l""",
    ),
    "project_save": (
        project_save,
        "SELECT project_id, count(*) AS features, sum(CASE WHEN r % 3 = 0 THEN x + 1 ELSE x END) AS sum_x FROM v_features WHERE (r % 2 = 0 OR r % 3 = 0) AND line <> 6 GROUP BY project_id",
    ),
    "view_bounds": (
        view_bounds,
        """WITH p AS (SELECT p_partkey, (p_partkey % 180)::DOUBLE AS lon, ((p_partkey * 7) % 120 - 60)::DOUBLE AS lat, (p_size + 10) / 20.0 AS a FROM {part})
           SELECT p_partkey, round(lon - 2 * a / cos(radians(lat)), 6) AS west, round(lat - 2, 6) AS south, round(lon + 2 * a / cos(radians(lat)), 6) AS east, round(lat + 2, 6) AS north FROM p""",
    ),
    "dragged_boxes": (
        dragged_boxes,
        """WITH p AS (SELECT p_partkey, (p_partkey % 50)::DOUBLE AS x1, (p_partkey % 40)::DOUBLE AS y1, p_size::DOUBLE AS x2, ((p_partkey * 3) % 40)::DOUBLE AS y2 FROM {part}), b AS (SELECT *, abs(x2 - x1) >= 2 AND abs(y2 - y1) >= 2 AS ok FROM p)
           SELECT p_partkey, CASE WHEN ok THEN least(x1, x2) END AS x, CASE WHEN ok THEN least(y1, y2) END AS y, CASE WHEN ok THEN abs(x2 - x1) END AS width, CASE WHEN ok THEN abs(y2 - y1) END AS height FROM b""",
    ),
    "keypoint_matches": (
        keypoint_matches,
        """WITH l AS (SELECT event_id % 97 AS image, event_id % 13 AS keypoint, event_id FROM {events} WHERE event_id % 5 <> 2 QUALIFY row_number() OVER (PARTITION BY event_id % 97, event_id % 13 ORDER BY ts DESC, event_id DESC) = 1),
           n AS (SELECT *, count(*) OVER (PARTITION BY image) AS pairs FROM l) SELECT * FROM n WHERE pairs >= 4""",
    ),
    "resized_images": (
        resized_images,
        "SELECT p_partkey, 100.0::DOUBLE AS x1, 50.0::DOUBLE AS y1, round(100 + greatest(p_size - 5, 10), 6)::DOUBLE AS x2, round(50 + greatest(p_size - 5, 10) / (1 + (p_partkey % 3) / 2.0), 6)::DOUBLE AS y2 FROM {part}",
    ),
    "polygonal_parts": (
        polygonal_parts,
        "WITH n AS (SELECT count(*) FILTER (kind NOT IN ('A', 'N')) AS n FROM v_features GROUP BY source_id) SELECT CASE WHEN n > 1 THEN 'MultiPolygon' WHEN n = 1 THEN 'Polygon' END AS geometry, count(*) AS collections FROM n GROUP BY 1",
    ),
    "extracted_feature_rows": (
        extracted_feature_rows,
        "SELECT f.map_id IS NULL OR m.project_id IS NOT DISTINCT FROM f.project_id AS written, count(*) AS rows, count(*) AS features FROM v_features f LEFT JOIN v_maps m ON m.map_id = f.map_id GROUP BY 1",
    ),
    "image_features": (
        image_features,
        """WITH p AS (SELECT p_partkey, trim(p_name) AS name, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/jpg' END AS mime, CASE WHEN p_partkey % 5 > 0 THEN 8.0 * p_size * 40 / 800 ELSE 8.0 END::DOUBLE AS half FROM {part} WHERE p_partkey % 4 < 3)
           SELECT p_partkey, name, mime, round(-half, 6) AS west, round(half, 6) AS east, 0.0::DOUBLE AS lon, 0.0::DOUBLE AS lat FROM p""",
    ),
    "language_codes": (language_codes, "SELECT lang, count(*) AS documents FROM {documents} WHERE lang NOT IN ('en', 'fr') GROUP BY lang"),
}
