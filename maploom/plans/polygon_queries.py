"""Queries of polygons with holes: cuts, repair, clipping, snapping and overlaps, with SQL that adds up areas of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions import geometry
from maploom.operators import georeference, polygons, shapes
from maploom.operators.scratch import dealt
from maploom.plans.views import tables, view

K = "p_partkey"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place and a size for each part: x, y, w, h."""
    k = F.col(K)
    sizes = {"image": k % 25, "x": (k * 37 % 900).cast("double"), "y": (k * 53 % 700).cast("double"), "w": (F.col("p_size") + 20).cast("double"), "h": (k % 31 + 24).cast("double")}
    return dealt(tables(spark, sf_dir, ["part"])["part"].select(K, "p_size"), K).select(K, *(v.alias(n) for n, v in sizes.items()))


def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*(geometry.point(x, y) for x, y in corners))


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return _ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def _forms(rows: DataFrame) -> DataFrame:
    """polygons by the key's remainder: an L, a U, or a frame around a hole; all arms are 8 wide."""
    x, y, w, h = map(F.col, "xywh")
    a = F.lit(8.0)
    el = polygons.polygon(_ring((x, y), (x + w, y), (x + w, y + a), (x + a, y + a), (x + a, y + h), (x, y + h)))
    u = polygons.polygon(_ring((x, y), (x + w, y), (x + w, y + h), (x + w - a, y + h), (x + w - a, y + a), (x + a, y + a), (x + a, y + h), (x, y + h)))
    frame = polygons.polygon(_box(x, y, w, h), F.array(_box(x + a, y + a, w - 2 * a, h - 2 * a)))
    return rows.withColumn("polygons", F.when(F.col(K) % 3 == 0, el).when(F.col(K) % 3 == 1, u).otherwise(frame))


#: The same forms as boxes that do not overlap: base, left arm, right arm, top.
FORMS = f"""p AS (SELECT {K}, {K} % 25 AS image, ({K} * 37 % 900)::DOUBLE AS x, ({K} * 53 % 700)::DOUBLE AS y, (p_size + 20)::DOUBLE AS w, ({K} % 31 + 24)::DOUBLE AS h FROM {{part}}),
  f AS (SELECT {K}, image, x AS x0, y AS y0, w AS bw, 8.0::DOUBLE AS bh FROM p UNION ALL SELECT {K}, image, x, y + 8, 8, h - 8 FROM p
        UNION ALL SELECT {K}, image, x + w - 8, y + 8, 8, h - 8 FROM p WHERE {K} % 3 > 0 UNION ALL SELECT {K}, image, x + 8, y + h - 8, w - 16, 8 FROM p WHERE {K} % 3 = 2)"""
OVER = "greatest(0, least(x0 + bw, cx + cw) - greatest(x0, cx)) * greatest(0, least(y0 + bh, cy + ch) - greatest(y0, cy))"


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes drawn on images, apart from each other."""
    s, k = tables(spark, sf_dir, ["supplier"])["supplier"], F.col("s_suppkey")
    cut = _box((k * 60 % 900).cast("double"), F.floor(k / 15) * 40.0, F.lit(50.0), F.lit(32.0))
    return s.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("image"), polygons.polygon(cut).alias("polygons"))


def cut_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L, U and frame shapes cut by boxes: what is left of those that a cut reaches."""
    found = polygons.cut_results(_forms(_parts(spark, sf_dir)), _cuts(spark, sf_dir), "image", K)
    return found.select("image", K, "action", (F.round(polygons.area(F.col("polygons")), 4) + 0.0).alias("area"))


def repaired_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow ties, spikes, repeated points, holes across their shell, rings that go around twice; repaired, with their parts and areas."""
    x, y, w, h = map(F.col, "xywh")
    corners = lambda *at: _ring(*((x + w * i, y + h * j) for i, j in at))
    kinds = [
        polygons.polygon(corners((0, 0), (1, 1), (1, 0), (0, 1))),
        polygons.polygon(corners((0, 0), (1, 0), (2, 0), (1, 0), (1, 1), (0, 1))),
        polygons.polygon(corners((0, 0), (0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 1))),
        polygons.polygon(corners((0, 0), (1, 0), (1, 1), (0, 1)), F.array(corners((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)))),
        polygons.polygon(corners((0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (1, 0), (1, 1), (0, 1))),
        polygons.polygon(corners((0, 0), (1, 1), (2, 2))),
    ]
    rows = _parts(spark, sf_dir).withColumn("polygons", F.element_at(F.array(*kinds), (F.col(K) % len(kinds) + 1).cast("int")))
    rows = rows.withColumn("was_valid", polygons.is_valid(F.col("polygons"))).withColumn("polygons", polygons.repaired(F.col("polygons")))
    every = polygons.is_valid(F.slice("polygons", 1, 1)) & polygons.is_valid(F.slice("polygons", 2, 1))
    return rows.select(K, "was_valid", F.size("polygons").alias("parts"), (F.round(polygons.area(F.col("polygons")), 4) + 0.0).alias("area"), every.alias("valid"))


def land_with_lakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L, U and frame shapes on islands with a lake in each."""
    s, k = tables(spark, sf_dir, ["supplier"])["supplier"], F.col("s_suppkey")
    x, y = k % 10 * 90.0, F.floor(k / 10) * 70.0
    land = s.select(polygons.polygon(_box(x, y, F.lit(70.0), F.lit(60.0)), F.array(_box(x + 20, y + 20, F.lit(30.0), F.lit(20.0)))).alias("polygons"))
    found = polygons.clipped_to_land(_forms(_parts(spark, sf_dir)), land, K, least=0.05)
    return found.select(K, F.round(F.col("land_share") + 1e-12, 6).alias("land_share"), F.round(polygons.area(F.col("polygons")), 4).alias("area"))


def golden_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L, U and frame shapes against the same shapes moved by up to three: whether they match by nine tenths of their union."""
    rows = _forms(_parts(spark, sf_dir))
    moved = _forms(_parts(spark, sf_dir).withColumn("x", F.col("x") + (F.col(K) % 4) * 0.125)).select(K, F.col("polygons").alias("golden"))
    iou = polygons.overlap_ratio(F.col("polygons"), F.col("golden"))
    return rows.join(moved.hint("merge"), K).select(K, iou.alias("iou")).select(K, F.round("iou", 6).alias("iou"), (F.col("iou") > 0.9).alias("matched"))


def concave_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L shapes that lie in each other's notch, in pairs: their boxes overlap, they do not, and all stay; but where one
    covers another, the larger alone does."""
    k = F.col(K)
    x, y = (F.floor(k / 2) % 300 * 60.0), (F.floor(k / 600) * 60.0)
    el = lambda s: _ring((x, y), (x + s, y), (x + s, y + 10), (x + 10, y + 10), (x + 10, y + s), (x, y + s))
    notch = _ring((x + 40, y + 40), (x + 12, y + 40), (x + 12, y + 30), (x + 30, y + 30), (x + 30, y + 12), (x + 40, y + 12))
    ring = F.when(k % 2 == 0, el(F.lit(40.0))).when(F.floor(k / 2) % 3 == 0, el(F.lit(38.0))).otherwise(notch)
    rows = dealt(tables(spark, sf_dir, ["part"])["part"].select(K), K).select(K, (F.floor(k / 2) % 20).alias("image"), geometry.closed(ring).alias("ring"))
    return shapes.deduplicated(rows, "image", K).select("image", K)


def georeferenced_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of ten images in degrees: shells and holes on coasts from north to south, clipped to land east of a line."""
    x, y, w, h = map(F.col, "xywh")
    frame = polygons.polygon(_box(x, y, w, h), F.array(_box(x + 8, y + 8, w - 16, h - 16)))
    zones = _parts(spark, sf_dir).select(K, (F.col(K) % 10).alias("image_id"), frame.alias("polygons"))
    # upright and not turned, so that boxes stay boxes
    control = view(spark, sf_dir, "v_control").select("image_id", "x", "y", (F.col("x") * 1000 + 5000).alias("gx"), (F.col("y") * -1000 + 2000).alias("gy"))
    metre = lambda v: F.lit(float(v))
    coast = spark.range(1).select(F.lit(1).alias("sid"), metre(250_000).alias("x1"), metre(-3e6).alias("y1"), metre(250_000).alias("x2"), metre(3e6).alias("y2"))
    land = spark.range(1).select(polygons.polygon(_box(metre(200_000), metre(-9e5), metre(1e6), metre(2e6))).alias("polygons"))
    found = georeference.georeferenced_polygons(zones, control, "image_id", K, coast, land, least=0.0)
    points = F.flatten(F.transform("polygons", lambda p: F.concat(p["shell"], F.flatten(p["holes"]))))
    edge = lambda f, c: F.round(f(F.transform("points", lambda p: p[c])), 7)
    return found.withColumn("points", points).select(
        "image_id", K, "snapped", edge(F.array_min, "x").alias("west"), edge(F.array_max, "x").alias("east"), edge(F.array_min, "y").alias("south"), edge(F.array_max, "y").alias("north"),
        F.aggregate("polygons", F.lit(0), lambda n, p: n + F.size(p["holes"])).alias("holes"), "crs",
    )


def _outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape for each part, each in an image of its own: a box, a rectangle turned by the angle of 3 and 4, a polygon of
    24 corners, or a right triangle."""
    k = F.col(K)
    x, y = (k * 37 % 900 + 100).cast("double"), (k * 53 % 700 + 100).cast("double")
    w, h, a, b = (F.col("p_size") + 20).cast("double"), (k % 31 + 24).cast("double"), (F.col("p_size") % 10 + 5).cast("double"), (k % 7 + 4).cast("double")
    turn = lambda n: 2 * F.pi() * n / 24
    many = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda n: geometry.point(x + 0.5 + w * F.cos(turn(n)), y + 0.5 + w * F.sin(turn(n))))
    turned = _ring((x, y), (x + 4 * a, y + 3 * a), (x + 4 * a - 3 * b, y + 3 * a + 4 * b), (x - 3 * b, y + 4 * b))
    ring = F.when(k % 4 == 0, _box(x, y, w, h)).when(k % 4 == 1, turned).when(k % 4 == 2, many).otherwise(_ring((x, y), (x + w, y), (x, y + h)))
    return dealt(tables(spark, sf_dir, ["part"])["part"].select(K, "p_size"), K).select(K, k.alias("image"), x.alias("x"), y.alias("y"), geometry.closed(ring).alias("ring"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the polygons of 24 corners every other one has a circle 15 pixels from its centre, which is too far; the others nearer."""
    rows = shapes.described(_outlines(spark, sf_dir))
    circles = _outlines(spark, sf_dir).select("image", (F.col("x") + F.when(F.col(K) % 8 == 2, 14).otherwise(15)).alias("x"), (F.col("y") - 14).alias("y"))
    return shapes.classified(rows, circles, "image", K)


def shape_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select(K, "shape_type", "rect_score", "num_vertices", F.col("center.x").alias("cx"), F.col("center.y").alias("cy"))


def ideal_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideal points and what is measured on them again."""
    rows = _classified(spark, sf_dir).select(K, "shape_type", shapes.idealised(F.col("shape_type"), F.col("measures")).alias("points"))
    again = shapes.described(rows.withColumn("ring", geometry.closed(F.col("points"))))
    return again.select(K, "shape_type", F.size("points").alias("points"), F.round("area", 1).alias("area"), F.round("perimeter", 1).alias("perimeter"), "aspect_ratio", "solidity")


def shape_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in pixels of the shapes in and outside a legend box, numbered from 1 in each of twenty groups."""
    from pyspark.sql import Window

    c, k = F.col, F.col(K)
    rows = _classified(spark, sf_dir).withColumn("legend", c("center.x").between(400, 900) & c("center.y").between(300, 700))
    number = F.row_number().over(Window.partitionBy(k % 20, "legend").orderBy(K))
    colour = F.struct((k % 256).alias("r"), (k % 7).alias("g"), (k % 11).alias("b"))
    rows = rows.withColumn("number", number).withColumn("f", shapes.feature(shapes.idealised(c("shape_type"), c("measures")), shapes.properties(c("number"), False, colour, F.lit("Plain"))))
    p = "f.properties."
    kept = ["shape_id", "name", "num_vertices", "color_hex", "opacity", "stroke_width", "stroke_opacity", "mapElementType", "is_normalized"]
    return rows.select(K, "legend", *(c(p + n) for n in kept), *(F.round(p + n, 3).alias(n) for n in ("area", "perimeter", "solidity")), F.size(c("f.geometry.coordinates")[0]).alias("corners"), (c("f.geometry.coordinates")[0][0] == F.element_at(c("f.geometry.coordinates")[0], -1)).alias("closed"))


def extracted_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines to shapes, end to end: sized, classified, ideal, measured again, filtered, in or outside the legend."""
    c = F.col
    circles = _outlines(spark, sf_dir).select("image", (c("x") + F.when(c(K) % 8 == 2, 14).otherwise(15)).alias("x"), (c("y") - 14).alias("y"))
    legend = F.struct(*(F.lit(v).alias(n) for n, v in (("min_x", 400.0), ("min_y", 300.0), ("max_x", 460.0), ("max_y", 340.0))))
    found = shapes.extracted(_outlines(spark, sf_dir).drop("x", "y"), circles, "image", K, 1000.0 * 800.0, legend)
    box = [c(f"bounding_box.{n}").alias(n) for n in ("x", "y", "width", "height")]
    return found.select(K, "shape_type", "num_vertices", "is_legend", *box, F.round("area", 1).alias("area"), F.round("perimeter", 1).alias("perimeter"))


#: The outlines with their areas, and perimeters, boxes, kinds, by formula.
OUTLINES = f"""o AS (SELECT {K}, {K} % 4 AS kind, ({K} * 37 % 900 + 100)::DOUBLE AS x, ({K} * 53 % 700 + 100)::DOUBLE AS y, (p_size + 20)::DOUBLE AS w, ({K} % 31 + 24)::DOUBLE AS h, (p_size % 10 + 5)::DOUBLE AS a, ({K} % 7 + 4)::DOUBLE AS b FROM {{part}}),
  m AS (SELECT *, CASE kind WHEN 0 THEN w * h WHEN 1 THEN 25 * a * b WHEN 2 THEN 12 * w * w * sin(pi() / 12) ELSE w * h / 2 END AS area, CASE kind WHEN 0 THEN 2 * (w + h) WHEN 1 THEN 10 * (a + b) WHEN 2 THEN 48 * w * sin(pi() / 24) ELSE w + h + sqrt(w * w + h * h) END AS perimeter,
         CASE kind WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 24 ELSE 3 END::INT AS corners, CASE kind WHEN 0 THEN x + w / 2 WHEN 1 THEN x + (4 * a - 3 * b) / 2 WHEN 2 THEN x + 0.5 ELSE x + w / 3 END AS gx, CASE kind WHEN 0 THEN y + h / 2 WHEN 1 THEN y + (3 * a + 4 * b) / 2 WHEN 2 THEN y + 0.5 ELSE y + h / 3 END AS gy FROM o),
  t AS (SELECT *, CASE WHEN kind = 2 AND {K} % 8 = 2 THEN 'Circle' WHEN kind < 2 THEN 'Rectangle' ELSE 'Shape unknown' END AS shape_type, CASE kind WHEN 2 THEN round(3 * sin(pi() / 12) / pow(cos(pi() / 24), 2), 3) WHEN 3 THEN 0.5 ELSE 1 END AS rect_score, cast(trunc(round(gx, 9)) AS INT) AS cx, cast(trunc(round(gy, 9)) AS INT) AS cy FROM m)"""

QUERIES = {
    "cut_results": (
        cut_results,
        f"""WITH {FORMS}, c AS (SELECT (s_suppkey * 60 % 900)::DOUBLE AS cx, (s_suppkey // 15 * 40)::DOUBLE AS cy, 50.0::DOUBLE AS cw, 32.0::DOUBLE AS ch FROM {{supplier}}),
            o AS (SELECT image, {K}, sum(bw * bh) AS own FROM f GROUP BY ALL), g AS (SELECT {K}, sum({OVER}) AS gone FROM f, c GROUP BY {K})
            SELECT image, {K}, CASE WHEN gone >= own THEN 'deleted' ELSE 'updated' END AS action, round(own - gone, 4) + 0.0 AS area FROM o JOIN g USING ({K}) WHERE gone > 0""",
    ),
    "repaired_rings": (
        repaired_rings,
        f"""WITH {FORMS} SELECT {K}, false AS was_valid, cast(CASE {K} % 6 WHEN 0 THEN 2 WHEN 5 THEN 0 ELSE 1 END AS INT) AS parts,
            round(w * h * CASE {K} % 6 WHEN 0 THEN 0.5 WHEN 3 THEN 0.75 WHEN 5 THEN 0 ELSE 1 END, 4) + 0.0 AS area, true AS valid FROM p""",
    ),
    "land_with_lakes": (
        land_with_lakes,
        f"""WITH {FORMS}, i AS (SELECT (s_suppkey % 10 * 90)::DOUBLE AS x, (s_suppkey // 10 * 70)::DOUBLE AS y FROM {{supplier}}),
            c AS (SELECT x AS cx, y AS cy, 70.0::DOUBLE AS cw, 60.0::DOUBLE AS ch, 1 AS sign FROM i UNION ALL SELECT x + 20, y + 20, 30, 20, -1 FROM i),
            o AS (SELECT {K}, sum(bw * bh) AS own FROM f GROUP BY {K}), l AS (SELECT {K}, sum(sign * {OVER}) AS land FROM f, c GROUP BY {K})
            SELECT {K}, round(land / own + 1e-12, 6) AS land_share, round(land, 4) AS area FROM o JOIN l USING ({K}) WHERE land / own >= 0.05""",
    ),
    "golden_matches": (
        golden_matches,
        f"""WITH {FORMS}, m AS (SELECT {K}, x0 + ({K} % 4) * 0.125 AS cx, y0 AS cy, bw AS cw, bh AS ch FROM f), o AS (SELECT {K}, sum(bw * bh) AS own FROM f GROUP BY {K}),
            l AS (SELECT f.{K}, sum({OVER}) AS shared FROM f JOIN m ON m.{K} = f.{K} GROUP BY f.{K}) SELECT {K}, round(shared / (2 * own - shared), 6) AS iou, shared / (2 * own - shared) > 0.9 AS matched FROM o JOIN l USING ({K})""",
    ),
    "concave_duplicates": (concave_duplicates, f"SELECT {K} // 2 % 20 AS image, {K} FROM {{part}} WHERE NOT ({K} % 2 = 1 AND {K} // 2 % 3 = 0 AND EXISTS (SELECT 1 FROM {{part}} q WHERE q.{K} = part.{K} - 1))"),
    "georeferenced_zones": (
        georeferenced_zones,
        f"""WITH {FORMS}, d AS (SELECT {K} % 10 AS image_id, sqrt(pow(max(x + w) - min(x), 2) + pow(max(y + h) - min(y), 2)) AS dg FROM p GROUP BY 1),
            t AS (SELECT image_id, greatest(200, least(50000, 1000 * greatest(3, least(40, dg * 0.01)))) AS reach FROM d WHERE image_id IN (SELECT image_id FROM v_control GROUP BY image_id HAVING count(*) >= 3)),
            s AS (SELECT {K}, image_id, reach, x, y, w, h, unnest([x, x + w, x + 8, x + w - 8]) * 1000.0::DOUBLE + 5000 AS gx, unnest([1, 2, 3, 4]) AS n FROM p JOIN t ON image_id = {K} % 10),
            v AS (SELECT *, CASE WHEN abs(gx - 250000) <= reach THEN 250000 ELSE gx END AS nx, CASE WHEN abs(gx - 250000) <= reach THEN 2 ELSE 0 END AS moved FROM s),
            q AS (SELECT {K}, image_id, sum(moved) AS moved, max(nx) FILTER (n = 1) = max(nx) FILTER (n = 2) AS flat, [max(nx) FILTER (n = 1), max(nx) FILTER (n = 2), max(nx) FILTER (n = 3), max(nx) FILTER (n = 4)] AS near,
                  [max(gx) FILTER (n = 1), max(gx) FILTER (n = 2), max(gx) FILTER (n = 3), max(gx) FILTER (n = 4)] AS far, any_value(2000 - y * 1000) AS top, any_value(2000 - (y + h) * 1000) AS bottom FROM v GROUP BY {K}, image_id),
            r AS (SELECT *, CASE WHEN flat THEN far ELSE near END AS c FROM q), o AS (SELECT * FROM r WHERE c[2] > 200000)
            SELECT image_id, {K}, cast(CASE WHEN flat THEN 0 ELSE moved END AS INT) AS snapped, round(degrees(greatest(c[1], 200000) / 6378137.0::DOUBLE), 7) AS west, round(degrees(c[2] / 6378137.0::DOUBLE), 7) AS east,
                   round(degrees(2 * atan(exp(bottom / 6378137.0::DOUBLE)) - pi() / 2), 7) AS south, round(degrees(2 * atan(exp(top / 6378137.0::DOUBLE)) - pi() / 2), 7) AS north,
                   CASE WHEN c[1] < c[3] AND c[3] < c[4] AND c[4] < c[2] AND c[3] > 200000 THEN 1 ELSE 0 END AS holes, 'EPSG:4326' AS crs FROM o""",
    ),
    "shape_classify": (shape_classify, f"WITH {OUTLINES} SELECT {K}, shape_type, rect_score, corners AS num_vertices, cx, cy FROM t"),
    "ideal_shapes": (
        ideal_shapes,
        f"""WITH {OUTLINES}, n AS (SELECT *, least(360, greatest(32, ceil(2 * pi() * w / 3)))::INT AS n FROM t),
            p AS (SELECT *, CASE WHEN shape_type = 'Circle' THEN list_transform(range(0, n + 1), lambda k: round(gx + w * cos(2 * pi() * (k % n) / n), 3)) WHEN kind = 2 THEN list_transform(range(0, 25), lambda k: round(gx + w * cos(2 * pi() * (k % 24) / 24), 3))
                    WHEN kind = 0 THEN [x, x + w, x + w, x, x] WHEN kind = 1 THEN [x, x + 4 * a, x + 4 * a - 3 * b, x - 3 * b, x] ELSE [x, x + w, x, x] END AS xs,
                  CASE WHEN shape_type = 'Circle' THEN list_transform(range(0, n + 1), lambda k: round(gy + w * sin(2 * pi() * (k % n) / n), 3)) WHEN kind = 2 THEN list_transform(range(0, 25), lambda k: round(gy + w * sin(2 * pi() * (k % 24) / 24), 3))
                    WHEN kind = 0 THEN [y, y, y + h, y + h, y] WHEN kind = 1 THEN [y, y + 3 * a, y + 3 * a + 4 * b, y + 4 * b, y] ELSE [y, y, y + h, y] END AS ys FROM n)
            SELECT {K}, shape_type, cast(len(xs) - 1 AS INT) AS points, round(abs(list_sum(list_transform(range(1, len(xs)), lambda k: xs[k] * ys[k + 1] - xs[k + 1] * ys[k]))) / 2, 1) AS area,
                   round(list_sum(list_transform(range(1, len(xs)), lambda k: sqrt(pow(xs[k + 1] - xs[k], 2) + pow(ys[k + 1] - ys[k], 2)))), 1) AS perimeter,
                   round((list_max(xs) - list_min(xs) + 1) / (list_max(ys) - list_min(ys) + 1) + 1e-9, 2) AS aspect_ratio, 1.0::DOUBLE AS solidity FROM p""",
    ),
    "shape_features": (
        shape_features,
        f"""WITH {OUTLINES}, l AS (SELECT *, cx BETWEEN 400 AND 900 AND cy BETWEEN 300 AND 700 AS legend FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY {K} % 20, legend ORDER BY {K}) AS shape_id FROM l),
            c AS (SELECT *, CASE WHEN shape_type = 'Circle' THEN least(360, greatest(32, ceil(2 * pi() * w / 3)))::INT ELSE corners END AS ideal FROM n)
            SELECT {K}, legend, shape_id, shape_type || ' ' || shape_id AS name, corners AS num_vertices, printf('#%02x%02x%02x', {K} % 256, {K} % 7, {K} % 11) AS color_hex, 0.5::DOUBLE AS opacity, 2 AS stroke_width, 1.0::DOUBLE AS stroke_opacity, 'shape' AS mapElementType, false AS is_normalized,
                   round(area, 3) AS area, round(perimeter, 3) AS perimeter, 1.0::DOUBLE AS solidity, cast(ideal + 1 AS INT) AS corners, true AS closed FROM c""",
    ),
    "extracted_shapes": (
        extracted_shapes,
        f"""WITH {OUTLINES}, n AS (SELECT *, least(360, greatest(32, ceil(2 * pi() * w / 3)))::INT AS n FROM t WHERE area BETWEEN 50 AND 5000),
            p AS (SELECT *, CASE WHEN shape_type = 'Circle' THEN list_transform(range(0, n + 1), lambda k: round_even(round(gx + w * cos(2 * pi() * (k % n) / n), 3), 0)) WHEN kind = 2 THEN list_transform(range(0, 25), lambda k: round_even(round(gx + w * cos(2 * pi() * (k % 24) / 24), 3), 0))
                    WHEN kind = 0 THEN [x, x + w, x + w, x, x] WHEN kind = 1 THEN [x, x + 4 * a, x + 4 * a - 3 * b, x - 3 * b, x] ELSE [x, x + w, x, x] END AS xs,
                  CASE WHEN shape_type = 'Circle' THEN list_transform(range(0, n + 1), lambda k: round_even(round(gy + w * sin(2 * pi() * (k % n) / n), 3), 0)) WHEN kind = 2 THEN list_transform(range(0, 25), lambda k: round_even(round(gy + w * sin(2 * pi() * (k % 24) / 24), 3), 0))
                    WHEN kind = 0 THEN [y, y, y + h, y + h, y] WHEN kind = 1 THEN [y, y + 3 * a, y + 3 * a + 4 * b, y + 4 * b, y] ELSE [y, y, y + h, y] END AS ys FROM n),
            e AS (SELECT {K}, shape_type, kind, gx, gy, cast(len(xs) - 1 AS INT) AS num_vertices, cast(list_min(xs) AS INT) AS x, cast(list_min(ys) AS INT) AS y, cast(list_max(xs) - list_min(xs) + 1 AS INT) AS width, cast(list_max(ys) - list_min(ys) + 1 AS INT) AS height,
                    list_sum(list_transform(range(1, len(xs)), lambda k: (xs[k] - xs[1]) * (ys[k + 1] - ys[1]) - (xs[k + 1] - xs[1]) * (ys[k] - ys[1]))) / 2 AS area, list_sum(list_transform(range(1, len(xs)), lambda k: sqrt(pow(xs[k + 1] - xs[k], 2) + pow(ys[k + 1] - ys[k], 2)))) AS perimeter,
                    list_sum(list_transform(range(1, len(xs)), lambda k: (xs[k] + xs[k + 1]) * (xs[k] * ys[k + 1] - xs[k + 1] * ys[k]))) AS mx, list_sum(list_transform(range(1, len(xs)), lambda k: (ys[k] + ys[k + 1]) * (xs[k] * ys[k + 1] - xs[k + 1] * ys[k]))) AS my FROM p),
            l AS (SELECT *, trunc(round(mx / (6 * area), 9)) BETWEEN 400 AND 460 AND trunc(round(my / (6 * area), 9)) BETWEEN 300 AND 340 AS is_legend FROM e)
            SELECT {K}, shape_type, num_vertices, is_legend, x, y, width, height, round(area, 1) AS area, round(perimeter, 1) AS perimeter FROM l
            WHERE NOT (shape_type = 'Shape unknown' AND area NOT BETWEEN 500 AND 4000) AND NOT (is_legend AND area / 2400 >= 0.9)""",
    ),
}
