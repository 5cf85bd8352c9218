"""Queries of geometry and georeferencing, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions import geometry
from maploom.operators import georeference, polygons
from maploom.operators.scratch import dealt
from maploom.plans.views import tables, view


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadrilateral for each part."""
    p = tables(spark, sf_dir, ["part"])["part"]
    x, y, w, h = F.col("p_partkey") % 900, F.col("p_partkey") % 700, F.col("p_size") + 3, F.col("p_partkey") % 37 + 2
    ring = F.array(geometry.point(x, y), geometry.point(x + w, y + F.col("p_partkey") % 3), geometry.point(x + w, y + h), geometry.point(x, y + h))
    return p.select("p_partkey", geometry.closed(ring).alias("ring"), "p_size", "p_type")


RING = "r AS (SELECT p_partkey, p_size, p_type, (p_partkey % 900)::DOUBLE AS x, (p_partkey % 700)::DOUBLE AS y, (p_size + 3)::DOUBLE AS w, (p_partkey % 37 + 2)::DOUBLE AS h, (p_partkey % 3)::DOUBLE AS t FROM {part})"
AREA = "(w * h - w * t / 2)"
EDGES = "(sqrt(w*w + t*t) + (h - t) + w + h)"


def mercator_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir, ["part"])["part"].select("p_partkey", (F.col("p_partkey") % 361 - 180).alias("lon"), ((F.col("p_partkey") * 7) % 181 - 90).alias("lat"))
    return s.select("p_partkey", geometry.mercator(F.col("lon"), F.col("lat")).alias("m")).select("p_partkey", (F.round("m.x", 3) + 0.0).alias("x"), (F.round("m.y", 3) + 0.0).alias("y"))


def mercator_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir, ["part"])["part"]
    return p.select("p_partkey", geometry.lon_lat(F.col("p_partkey") * 1000.0, F.col("p_size") * 100000.0 - 2000000).alias("g")).select("p_partkey", F.round("g.x", 8).alias("lon"), F.round("g.y", 8).alias("lat"))


def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = georeference.affine_fit(view(spark, sf_dir, "v_control"), "image_id")
    return fits.select("image_id", "n", *(F.round(c, 6).alias(c) for c in "abde"), *(F.round(c, 4).alias(c) for c in "cf"), F.round("rmse", 6).alias("rmse"))


def affine_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = view(spark, sf_dir, "v_control")
    found = georeference.affine_apply(control, georeference.affine_fit(control, "image_id"), "image_id")
    return found.groupBy("image_id").agg(F.round(F.avg("X"), 3).alias("mean_x"), F.round(F.avg("Y"), 3).alias("mean_y"), F.round(F.max(F.abs(F.col("X") - F.col("gx"))), 3).alias("worst"))


def pixel_diagonal_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = view(spark, sf_dir, "v_features").groupBy("image_id").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"))
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    diagonal = F.sqrt(w * w + h * h)
    fits = georeference.affine_fit(view(spark, sf_dir, "v_control"), "image_id")
    scale = georeference.metres_per_pixel(*map(F.col, "abde"))
    return features.join(fits, "image_id").select("image_id", F.round(diagonal, 4).alias("diagonal"), F.round(scale, 6).alias("metres_per_pixel"), F.round(georeference.snap_tolerance(F.when(diagonal > 0, diagonal), scale), 4).alias("tolerance"))


def snap_nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features snapped to a coast that zigzags between the suppliers."""
    s = tables(spark, sf_dir, ["supplier"])["supplier"]
    k = F.col("s_suppkey")
    coast = s.select(k.alias("sid"), (k * 20.0).alias("x1"), ((k * 137) % 2000 * 1.0).alias("y1"), (k * 20.0 + 20).alias("x2"), (((k + 1) * 137) % 2000 * 1.0).alias("y2"))
    points = view(spark, sf_dir, "v_features").select(F.col("feature_id").alias("id"), "x", "y")
    return georeference.snap_to_lines(points, coast, 15.0, "id").groupBy("moved").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("x"), 2).alias("sum_x"), F.round(F.sum("y"), 2).alias("sum_y"))


def keypoint_spacing_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_features").where("x > 20 AND x < 1004 AND y > 20 AND y < 1980")
    points = f.select("project_id", "x", "y", F.col("price").alias("response"), F.col("feature_id").alias("id"))
    return georeference.spaced_keypoints(points, "project_id", 120.0, 10).select("project_id", "rank", "id", "x", "y", "response")


def pixel_to_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_features")
    lon, lat = -80.0 + F.col("x") / 1024 * 20, 52.0 - F.col("y") / 2000 * 10
    return f.groupBy("image_id").agg(F.round(F.avg(lon), 6).alias("lon"), F.round(F.avg(lat), 6).alias("lat"))


def circle_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir, ["part"])["part"]
    ring = geometry.circle(F.col("p_partkey") % 360 - 180.0, F.col("p_partkey") % 120 - 60.0, F.col("p_size") * 100.0)
    rows = p.select("p_partkey", ring.alias("ring"))
    return rows.select("p_partkey", F.size("ring").alias("points"), F.round(F.element_at("ring", 9)["y"], 8).alias("top"), F.round(F.element_at("ring", 1)["x"], 8).alias("right"), F.round(F.abs(geometry.signed_area(F.col("ring"))), 6).alias("area"))


def box_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = F.struct(F.lit(100.0).alias("min_x"), F.lit(50.0).alias("min_y"), F.lit(600.0).alias("max_x"), F.lit(500.0).alias("max_y"))
    return _rings(spark, sf_dir).withColumn("box", geometry.box(F.col("ring"))).where(geometry.inside(F.col("box"), around)).select("p_partkey", "box.*")


def shape_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rings(spark, sf_dir)
    ring = F.col("ring")
    measured = rows.select("p_partkey", F.abs(geometry.signed_area(ring)).alias("area"), geometry.perimeter(ring).alias("perimeter"), geometry.box(ring).alias("box"), geometry.centroid(ring).alias("centre"))
    w, h = F.col("box.max_x") - F.col("box.min_x") + 1, F.col("box.max_y") - F.col("box.min_y") + 1
    return measured.select(
        "p_partkey", F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"), F.round(w / h, 2).alias("aspect_ratio"), F.round(F.col("area") / (w * h), 3).alias("extent"),
        F.col("centre.x").cast("int").alias("cx"), F.col("centre.y").cast("int").alias("cy"), F.round(F.col("area") / (1000.0 * 800.0) + 1e-12, 6).alias("relative_size"),
    )


def text_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of which no text box covers half of the box."""
    shapes = _rings(spark, sf_dir).select("p_partkey", geometry.box(F.col("ring")).alias("box"))
    k = F.col("s_suppkey")
    x, y = ((k * 53) % 900).cast("double"), ((k * 29) % 700).cast("double")
    texts = tables(spark, sf_dir, ["supplier"])["supplier"].select(F.struct(x.alias("min_x"), y.alias("min_y"), (x + 60).alias("max_x"), (y + 25).alias("max_y")).alias("text"))
    cell = lambda v: F.floor(v / 64).cast("long")
    cells = lambda b, c: F.explode(F.sequence(cell(b[f"min_{c}"]), cell(b[f"max_{c}"])))
    deal = lambda rows, b: rows.select("*", cells(F.col(b), "x").alias("gx")).select("*", cells(F.col(b), "y").alias("gy"))
    area = (F.col("box.max_x") - F.col("box.min_x")) * (F.col("box.max_y") - F.col("box.min_y"))
    covered = deal(shapes, "box").join(deal(texts, "text"), ["gx", "gy"]).where(geometry.overlap(F.col("box"), F.col("text")) / area >= 0.5).select("p_partkey").distinct()
    return shapes.join(covered, "p_partkey", "left_anti").select("p_partkey", "box.*")


def legend_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rings(spark, sf_dir).select("p_partkey", "p_type", geometry.centroid(F.col("ring")).alias("c"))
    inside = F.col("c.x").between(700, 900) & F.col("c.y").between(500, 700)
    return rows.groupBy("p_type", inside.alias("in_legend")).agg(F.count(F.lit(1)).alias("shapes"), F.min("p_partkey").alias("first"))


def normalise_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rings(spark, sf_dir).select("p_partkey", geometry.unit_square(F.col("ring")).alias("ring")).select("p_partkey", geometry.box(F.col("ring")).alias("b"))
    return rows.select("p_partkey", *(F.round(f"b.{c}", 9).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def default_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir, ["part"])["part"]
    rows = p.select("p_partkey", geometry.default_bounds(F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 40.0), F.lit(800.0)).alias("b"))
    return rows.select("p_partkey", F.round("b.min_x", 6).alias("west"), "b.min_y", F.round("b.max_x", 6).alias("east"), "b.max_y")


def upright_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).groupBy(geometry.is_upright_rectangle(F.col("ring")).alias("upright")).agg(F.count(F.lit(1)).alias("shapes"))


def translate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rings(spark, sf_dir).select("p_partkey", geometry.translated(F.col("ring"), F.lit(12.5), F.lit(-3.0)).alias("ring"))
    return rows.select("p_partkey", F.element_at("ring", 1)["x"].alias("x"), F.element_at("ring", 1)["y"].alias("y"), F.round(F.abs(geometry.signed_area(F.col("ring"))), 4).alias("area"))


def stage_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on a 1200 by 800 stage to pixels of a 1000 by 500 image in a letterbox, zoomed by 1.5 and moved by 10, 20."""
    f = view(spark, sf_dir, "v_features")
    fit = 1.8  # 1.2 by the letterbox, 1.5 by the zoom
    u, v = (F.col("x") - 10) / (1000 * fit), (F.col("y") - 20 - 100 * 1.5) / (500 * fit)
    on = u.between(0, 1) & v.between(0, 1)
    return f.groupBy("image_id").agg(F.count_if(on).alias("on_image"), F.round(F.avg(F.when(on, u * 999)), 4).alias("mean_column"), F.round(F.avg(F.when(on, v * 499)), 4).alias("mean_row"))


def georeference_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals of ten images in degrees, their corners on a coast from north to south where they are near it."""
    shapes = _rings(spark, sf_dir).select("p_partkey", (F.col("p_partkey") % 10).alias("image_id"), "ring")
    metre = lambda v: F.lit(float(v))
    coast = spark.range(1).select(F.lit(1).alias("sid"), metre(1500).alias("x1"), metre(-300).alias("y1"), metre(1500).alias("x2"), metre(3000).alias("y2"))
    found = georeference.georeferenced(shapes, view(spark, sf_dir, "v_control"), "image_id", "p_partkey", coast, 1.0)
    total = lambda c: F.round(F.aggregate("ring", F.lit(0.0), lambda acc, p: acc + p[c]), 8)
    return found.select("image_id", "p_partkey", "snapped", total("x").alias("lon"), total("y").alias("lat"), "is_georeferenced", "crs", "transform_method", "rmse_meters")


def land_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the parts on land that is cut into boxes."""
    p, k = tables(spark, sf_dir, ["part"])["part"], F.col("s_suppkey")
    box = lambda x, y, w, h: F.array(geometry.point(x, y), geometry.point(x + w, y), geometry.point(x + w, y + h), geometry.point(x, y + h), geometry.point(x, y))
    boxes = dealt(p.select("p_partkey", "p_size"), "p_partkey").select("p_partkey", box(F.col("p_partkey") % 900, F.col("p_partkey") % 700, F.col("p_size") + 3, F.col("p_partkey") % 37 + 2).alias("ring"))
    land = tables(spark, sf_dir, ["supplier"])["supplier"].select(k.alias("part_id"), box(k % 10 * 90, F.floor(k / 10) * 70, F.lit(60), F.lit(50)).alias("ring"))
    as_polygons = lambda rows: rows.withColumn("polygons", polygons.polygon(F.col("ring")))
    return polygons.clipped_to_land(as_polygons(boxes), as_polygons(land), "p_partkey").select("p_partkey", F.size("polygons").alias("parts"), F.round("land_share", 6).alias("land_share"))


def coast_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through the features of each order, drawn on one picture of 40 by 30 pixels for each kind of priority."""
    f = view(spark, sf_dir, "v_features")
    lines = f.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line", "feature_id", "x", "y"))).alias("points"))
    drawn = georeference.rasterised(lines.select((F.col("source_id") % 7).alias("sheet"), "points"), (100.0, 200.0, 1500.0, 1800.0), 40, 30, ["sheet"])
    return drawn.groupBy("sheet", "py").agg(F.count(F.lit(1)).alias("pixels"), F.min("px").alias("first"), F.max("px").alias("last"))


def lakes_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_features")
    points = f.select("project_id", "x", "y", F.col("price").alias("response"), F.col("feature_id").alias("id"), "kind")
    found = georeference.keypoints_with_fallback(points.where("kind <> 'N'"), points, "project_id", 120.0, 10)
    return found.groupBy("project_id", "used_lakes").agg(F.count(F.lit(1)).alias("keypoints"), F.min("id").alias("first"))


def _spaced(name: str, where: str) -> str:
    return f"""{name}_o AS (SELECT project_id, feature_id AS id, x, y, row_number() OVER (PARTITION BY project_id ORDER BY price DESC, feature_id) AS n FROM v_features WHERE {where}),
      {name}_f AS (SELECT project_id, n, [struct_pack(id := id, x := x, y := y)] AS chosen FROM {name}_o WHERE n = 1
        UNION ALL SELECT o.project_id, o.n, CASE WHEN len(chosen) >= 10 OR len(list_filter(chosen, lambda q: pow(q.x - o.x, 2) + pow(q.y - o.y, 2) < 14400)) > 0 THEN chosen ELSE list_append(chosen, struct_pack(id := o.id, x := o.x, y := o.y)) END
        FROM {name}_f f JOIN {name}_o o ON o.project_id = f.project_id AND o.n = f.n + 1),
      {name} AS (SELECT project_id, len(chosen) AS n, list_min(list_transform(chosen, lambda q: q.id)) AS first FROM {name}_f QUALIFY {name}_f.n = max({name}_f.n) OVER (PARTITION BY project_id))"""


PAIR_SUMS = """m AS (SELECT image_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(gx) AS mg, avg(gy) AS mh FROM v_control GROUP BY image_id),
  d AS (SELECT image_id, x - mx AS x, y - my AS y, gx - mg AS g, gy - mh AS h FROM v_control JOIN m USING (image_id)),
  s AS (SELECT image_id, sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, sum(x*g) AS xg, sum(y*g) AS yg, sum(x*h) AS xh, sum(y*h) AS yh, sum(g*g) AS gg, sum(h*h) AS hh FROM d GROUP BY image_id),
  k AS (SELECT *, xx * yy - xy * xy AS det FROM s JOIN m USING (image_id)),
  l AS (SELECT *, (xg*yy - yg*xy) / det AS a, (yg*xx - xg*xy) / det AS b, (xh*yy - yh*xy) / det AS d, (yh*xx - xh*xy) / det AS e FROM k WHERE n >= 3 AND det > 1e-9),
  fit AS (SELECT image_id, n, a, b, mg - a * mx - b * my AS c, d, e, mh - d * mx - e * my AS f, CASE WHEN n > 3 THEN sqrt(greatest(0, gg - a*xg - b*yg + hh - d*xh - e*yh) / (2 * n)) END AS rmse FROM l)"""
SEGMENT = """c AS (SELECT s_suppkey AS sid, s_suppkey * 20.0::DOUBLE AS x1, ((s_suppkey * 137) % 2000)::DOUBLE AS y1, s_suppkey * 20.0::DOUBLE + 20 AS x2, (((s_suppkey + 1) * 137) % 2000)::DOUBLE AS y2 FROM {supplier}),
  t AS (SELECT feature_id, x, y, x1, y1, x2, y2, sid, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)))) AS t FROM v_features JOIN c ON x BETWEEN x1 - 15 AND x2 + 15),
  n AS (SELECT feature_id, sid, x1 + t * (x2 - x1) AS nx, y1 + t * (y2 - y1) AS ny, pow(x1 + t * (x2 - x1) - x, 2) + pow(y1 + t * (y2 - y1) - y, 2) AS d2 FROM t),
  b AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY d2, sid) AS k FROM n WHERE d2 <= 225)"""

QUERIES = {
    "georeference_collection": (
        georeference_collection,
        f"""WITH {RING}, {PAIR_SUMS}, v AS (SELECT p_partkey, p_partkey % 10 AS image_id, unnest([0, 1, 2, 3, 0]) AS n, unnest([x, x + w, x + w, x, x]) AS px, unnest([y, y + t, y + h, y + h, y]) AS py, unnest([1, 1, 1, 1, 0]) AS own FROM r),
            m1 AS (SELECT *, a * px + b * py + c AS gx, d * px + e * py + f AS gy FROM v JOIN fit USING (image_id)), m2 AS (SELECT *, abs(gx - 1500) <= 1 AND gy BETWEEN -300 AND 3000 AS near FROM m1)
            SELECT image_id, p_partkey, cast(sum(CASE WHEN near THEN own ELSE 0 END) AS INT) AS snapped, round(sum(degrees(CASE WHEN near THEN 1500 ELSE gx END / 6378137.0::DOUBLE)), 8) AS lon, round(sum(degrees(2 * atan(exp(gy / 6378137.0::DOUBLE)) - pi() / 2)), 8) AS lat,
                   true AS is_georeferenced, 'EPSG:4326' AS crs, 'affine' AS transform_method, round(coalesce(any_value(rmse), 0), 2) AS rmse_meters FROM m2 GROUP BY image_id, p_partkey""",
    ),
    "land_clip": (
        land_clip,
        f"""WITH {RING}, l AS (SELECT (s_suppkey % 10 * 90)::DOUBLE AS lx, (s_suppkey // 10 * 70)::DOUBLE AS ly FROM {{supplier}}),
            o AS (SELECT p_partkey, greatest(0, least(x + w, lx + 60) - greatest(x, lx)) * greatest(0, least(y + h, ly + 50) - greatest(y, ly)) / (w * h) AS share FROM r, l)
            SELECT p_partkey, cast(count(*) AS INT) AS parts, round(sum(share), 6) AS land_share FROM o WHERE share > 0 GROUP BY p_partkey HAVING sum(share) >= 0.01""",
    ),
    "mercator_forward": (
        mercator_forward,
        "SELECT p_partkey, round(6378137.0 * radians(p_partkey % 361 - 180), 3) + 0.0::DOUBLE AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(greatest(-89.9, least(89.9, (p_partkey * 7) % 181 - 90))) / 2)), 3) + 0.0::DOUBLE AS y FROM {part}",
    ),
    "mercator_inverse": (mercator_inverse, "SELECT p_partkey, round(degrees(p_partkey * 1000.0::DOUBLE / 6378137.0), 8) AS lon, round(degrees(2 * atan(exp((p_size * 100000.0::DOUBLE - 2000000) / 6378137.0)) - pi() / 2), 8) AS lat FROM {part}"),
    "affine_fit": (affine_fit, f"WITH {PAIR_SUMS} SELECT image_id, n, round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS d, round(e, 6) AS e, round(c, 4) AS c, round(f, 4) AS f, round(rmse, 6) AS rmse FROM fit"),
    "affine_apply": (
        affine_apply,
        f"WITH {PAIR_SUMS} SELECT image_id, round(avg(a*x + b*y + c), 3) AS mean_x, round(avg(d*x + e*y + f), 3) AS mean_y, round(max(abs(a*x + b*y + c - gx)), 3) AS worst FROM v_control JOIN fit USING (image_id) GROUP BY image_id",
    ),
    "pixel_diagonal_tolerance": (
        pixel_diagonal_tolerance,
        f"""WITH {PAIR_SUMS}, g AS (SELECT image_id, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS dg FROM v_features GROUP BY image_id), q AS (SELECT image_id, dg, (sqrt(a*a + d*d) + sqrt(b*b + e*e)) / 2 AS mpp FROM g JOIN fit USING (image_id))
            SELECT image_id, round(dg, 4) AS diagonal, round(mpp, 6) AS metres_per_pixel, round(greatest(200, least(50000, mpp * greatest(3, least(40, CASE WHEN dg > 0 THEN dg * 0.01 ELSE 8 END)))), 4) AS tolerance FROM q""",
    ),
    "snap_nearest_segment": (
        snap_nearest_segment,
        f"WITH {SEGMENT} SELECT b.feature_id IS NOT NULL AS moved, count(*) AS points, round(sum(coalesce(nx, x)), 2) AS sum_x, round(sum(coalesce(ny, y)), 2) AS sum_y FROM v_features f LEFT JOIN b ON b.feature_id = f.feature_id AND k = 1 GROUP BY 1",
    ),
    "keypoint_spacing_topk": (
        keypoint_spacing_topk,
        """WITH RECURSIVE o AS (SELECT project_id, feature_id AS id, x, y, price, row_number() OVER (PARTITION BY project_id ORDER BY price DESC, feature_id) AS n FROM v_features WHERE x > 20 AND x < 1004 AND y > 20 AND y < 1980),
           f AS (SELECT project_id, n, [struct_pack(id := id, x := x, y := y, response := price)] AS chosen FROM o WHERE n = 1
                 UNION ALL
                 SELECT o.project_id, o.n, CASE WHEN len(chosen) >= 10 OR len(list_filter(chosen, lambda q: pow(q.x - o.x, 2) + pow(q.y - o.y, 2) < 14400)) > 0 THEN chosen ELSE list_append(chosen, struct_pack(id := o.id, x := o.x, y := o.y, response := o.price)) END
                 FROM f JOIN o ON o.project_id = f.project_id AND o.n = f.n + 1),
           l AS (SELECT project_id, chosen FROM f QUALIFY n = max(n) OVER (PARTITION BY project_id))
           SELECT project_id, cast(i - 1 AS INT) AS rank, chosen[i].id AS id, chosen[i].x AS x, chosen[i].y AS y, chosen[i].response AS response FROM (SELECT project_id, chosen, unnest(range(1, len(chosen) + 1)) AS i FROM l)""",
    ),
    "pixel_to_place": (pixel_to_place, "SELECT image_id, round(avg(-80.0::DOUBLE + x / 1024 * 20), 6) AS lon, round(avg(52.0::DOUBLE - y / 2000 * 10), 6) AS lat FROM v_features GROUP BY image_id"),
    "circle_polygon": (
        circle_polygon,
        """WITH c AS (SELECT p_partkey, p_partkey % 360 - 180.0::DOUBLE AS lon, p_partkey % 120 - 60.0::DOUBLE AS lat, p_size * 100.0::DOUBLE AS m FROM {part})
           SELECT p_partkey, 33 AS points, round(lat + m / 111320.0 * sin(2 * pi() * 8 / 32), 8) AS top, round(lon + m / (111320.0 * cos(radians(lat))), 8) AS right, round(16 * (m / 111320.0) * (m / (111320.0 * cos(radians(lat)))) * sin(2 * pi() / 32), 6) AS area FROM c""",
    ),
    "box_selection": (box_selection, f"WITH {RING} SELECT p_partkey, x AS min_x, y AS min_y, x + w AS max_x, y + h AS max_y FROM r WHERE x >= 100 AND x + w <= 600 AND y >= 50 AND y + h <= 500"),
    "shape_metrics": (
        shape_metrics,
        f"""WITH {RING}, q AS (SELECT *, {AREA} AS area, {EDGES} AS p FROM r)
            SELECT p_partkey, round(area, 4) AS area, round(p, 4) AS perimeter, round((w + 1) / (h + 1), 2) AS aspect_ratio, round(area / ((w + 1) * (h + 1)), 3) AS extent,
                   cast(trunc(round(x + (w*h*w/2 - w*t/2*w*2/3) / area, 9)) AS INT) AS cx, cast(trunc(round(y + (w*h*h/2 - w*t/2*t/3) / area, 9)) AS INT) AS cy, round(area / 800000.0 + 1e-12, 6) AS relative_size FROM q""",
    ),
    "text_overlap_filter": (
        text_overlap_filter,
        f"""WITH {RING}, s AS (SELECT ((s_suppkey * 53) % 900)::DOUBLE AS tx, ((s_suppkey * 29) % 700)::DOUBLE AS ty FROM {{supplier}})
            SELECT p_partkey, x AS min_x, y AS min_y, x + w AS max_x, y + h AS max_y FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE greatest(0, least(x + w, tx + 60) - greatest(x, tx)) * greatest(0, least(y + h, ty + 25) - greatest(y, ty)) / (w * h) >= 0.5)""",
    ),
    "legend_membership": (
        legend_membership,
        f"WITH {RING}, q AS (SELECT *, x + (w*h*w/2 - w*t/2*w*2/3) / {AREA} AS cx, y + (w*h*h/2 - w*t/2*t/3) / {AREA} AS cy FROM r) SELECT p_type, cx BETWEEN 700 AND 900 AND cy BETWEEN 500 AND 700 AS in_legend, count(*) AS shapes, min(p_partkey) AS first FROM q GROUP BY ALL",
    ),
    "normalise_polygon": (
        normalise_polygon,
        f"WITH {RING}, q AS (SELECT *, greatest(w, h) AS s FROM r) SELECT p_partkey, round((s - w) / 2 / s, 9) AS min_x, round((s - h) / 2 / s, 9) AS min_y, round((w + (s - w) / 2) / s, 9) AS max_x, round((h + (s - h) / 2) / s, 9) AS max_y FROM q",
    ),
    "default_bounds": (
        default_bounds,
        "WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 8.0::DOUBLE * p_size * 40 / 800 ELSE 8.0::DOUBLE END AS h FROM {part}) SELECT p_partkey, round(-h, 6) AS west, -8.0::DOUBLE AS min_y, round(h, 6) AS east, 8.0::DOUBLE AS max_y FROM q",
    ),
    "upright_rectangles": (upright_rectangles, f"WITH {RING} SELECT t = 0 AS upright, count(*) AS shapes FROM r GROUP BY 1"),
    "translate_shapes": (translate_shapes, f"WITH {RING} SELECT p_partkey, x + 12.5 AS x, y - 3.0 AS y, round({AREA}, 4) AS area FROM r"),
    "stage_to_image": (
        stage_to_image,
        """WITH q AS (SELECT image_id, (x - 10) / (1000 * 1.8::DOUBLE) AS u, (y - 20 - 150) / (500 * 1.8::DOUBLE) AS v FROM v_features)
           SELECT image_id, count(CASE WHEN u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 THEN 1 END) AS on_image, round(avg(CASE WHEN u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 THEN u * 999 END), 4) AS mean_column, round(avg(CASE WHEN u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 THEN v * 499 END), 4) AS mean_row FROM q GROUP BY image_id""",
    ),
    "coast_lines": (
        coast_lines,
        """WITH p AS (SELECT source_id, line, feature_id, cast(greatest(0, least(39, trunc((x - 100) / 1400 * 40))) AS BIGINT) AS x, cast(greatest(0, least(29, trunc((1800 - y) / 1600 * 30))) AS BIGINT) AS y FROM v_features WHERE x BETWEEN 100 AND 1500 AND y BETWEEN 200 AND 1800),
           s AS (SELECT DISTINCT source_id % 7 AS sheet, x AS x1, y AS y1, x2, y2 FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY source_id ORDER BY line, feature_id)) WHERE x2 IS NOT NULL),
           g AS (SELECT sheet, x1, y1, x2, y2, px, py, px - x1 AS wx, py - y1 AS wy, x2 - x1 AS dx, y2 - y1 AS dy FROM s JOIN range(40) a(px) ON px BETWEEN least(x1, x2) - 2 AND greatest(x1, x2) + 2 JOIN range(30) b(py) ON py BETWEEN least(y1, y2) - 2 AND greatest(y1, y2) + 2),
           h AS (SELECT DISTINCT sheet, px, py FROM g WHERE CASE WHEN wx * dx + wy * dy <= 0 THEN 4 * (wx * wx + wy * wy) <= 9 WHEN wx * dx + wy * dy >= dx * dx + dy * dy THEN 4 * ((px - x2) * (px - x2) + (py - y2) * (py - y2)) <= 9 ELSE 4 * (wx * dy - wy * dx) * (wx * dy - wy * dx) <= 9 * (dx * dx + dy * dy) END)
           SELECT sheet, py, count(*) AS pixels, min(px) AS first, max(px) AS last FROM h GROUP BY ALL""",
    ),
    "lakes_fallback": (
        lakes_fallback,
        f"""WITH RECURSIVE {_spaced("a", "kind <> 'N'")}, {_spaced("b", "true")}
            SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.n, 0) < 10 AS used_lakes, cast(CASE WHEN a.n >= 10 THEN a.n ELSE b.n END AS BIGINT) AS keypoints, CASE WHEN a.n >= 10 THEN a.first ELSE b.first END AS first FROM b LEFT JOIN a ON a.project_id = b.project_id""",
    ),
}
