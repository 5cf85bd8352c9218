"""Queries over pixels, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions import colour
from maploom.functions.css_colours import CSS_COLOURS
from maploom.operators import colours
from maploom.plans.views import view

#: LAB centres of a legend: paper, sea, forest, road.
CENTRES = [(92.0, 2.0, 8.0), (55.0, -5.0, -30.0), (45.0, -35.0, 30.0), (50.0, 60.0, 40.0)]
CODE = "format_string('#%02x%02x%02x', r, g, b)"


def srgb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = view(spark, sf_dir, "v_pixels").select("r").distinct()
    linear = colour.to_linear(F.col("r") / 255.0)
    return values.select("r", F.round(linear, 9).alias("linear"), F.round(colour.to_srgb(linear) * 255, 6).alias("back"))


def percentile_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = colours.stretched(view(spark, sf_dir, "v_pixels"), "image_id")
    return scaled.groupBy("image_id").agg(*(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in colours.CHANNELS))


def rgb_to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "v_pixels").select("r", "g", "b").distinct()
    return colours.with_lab(pixels).select("r", "g", "b", *(F.round(F.col(f"lab.{c}"), 5).alias(n) for c, n in zip("LAB", ("l_star", "a_star", "b_star"), strict=True)))


def nearest_palette_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = colours.nearest_centres(view(spark, sf_dir, "v_pixels"), CENTRES)
    return pixels.groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("pixels"))


def layer_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = colours.nearest_centres(view(spark, sf_dir, "v_pixels"), CENTRES)
    return pixels.groupBy("image_id").agg(*(F.round(F.count_if(F.col("layer") == k) / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias(f"ratio_{k}") for k in range(len(CENTRES))))


def paper_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = colours.nearest_centres(view(spark, sf_dir, "v_pixels"), [(100.0, 0.0, 0.0)], colours.PAPER)
    return pixels.groupBy("image_id").agg(F.count("layer").alias("paper"), F.count(F.lit(1)).alias("pixels"))


def dominant_colour_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colours.dominant(view(spark, sf_dir, "v_pixels"), "image_id")


def sampled_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of a square around clicks on each image, some of them beside it, some with a radius of their own."""
    images = view(spark, sf_dir, "v_pixels").select("image_id").distinct()
    k = F.col("image_id") * 31 + F.col("click") * 17
    size = {"width": F.lit(2000), "height": F.lit(51)}
    clicks = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("click")).withColumns({"x": k % 103 / 100.0, "y": k % 101 / 100.0, **size, "radius": F.when(F.col("click") > 0, F.col("click") * 30 - 31)})
    return colours.sampled(view(spark, sf_dir, "v_pixels"), clicks)


def dominant_colour_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colours.dominant_bin(view(spark, sf_dir, "v_pixels"), "image_id")


def nearest_css_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "v_pixels").groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    named = pixels.select(colours.nearest_name(F.col("r"), F.col("g"), F.col("b"), CSS_COLOURS).alias("name"), "n")
    return named.groupBy("name").agg(F.sum("n").alias("pixels"))


def gray_world_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = colours.gains(view(spark, sf_dir, "v_pixels"), "image_id")
    return found.select("image_id", *(F.round(f"gain_{c}", 6).alias(f"gain_{c}") for c in colours.CHANNELS))


def white_patch_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lambda c: F.round(1 / (F.percentile(F.col(c) / 255.0, F.lit(0.995)) + 1e-8), 6).alias(f"gain_{c}")
    return view(spark, sf_dir, "v_pixels").groupBy("image_id").agg(*map(top, colours.CHANNELS))


def gamma_on_lightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = colours.with_lab(view(spark, sf_dir, "v_pixels").select("r", "g", "b").distinct())
    light = F.col("lab.L") / 100
    return rows.select("r", "g", "b", F.round(100 * (0.4 * light + 0.6 * F.pow(light, F.lit(1.5))), 5).alias("lightness"))


def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "v_pixels").select("r", "g", "b").distinct().withColumn("code", F.expr(CODE))
    return pixels.select("code", colour.rgb_of(F.col("code")).alias("back")).select("code", "back.*")


def picked_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of picked colours in order those whose code no earlier one of the image has."""
    return view(spark, sf_dir, "v_features").withColumn("code", F.expr(CODE)).groupBy("image_id", "code").agg(F.min(F.struct("line", "feature_id")).alias("first")).select("image_id", "code", F.col("first.line").alias("line"))


LINEAR = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
LIN = ", ".join(f"{LINEAR.replace('{c}', c)} AS l{c}" for c in "rgb")
XYZ = ", ".join(f"({row[0]} * lr + {row[1]} * lg + {row[2]} * lb) / {w}::DOUBLE AS {n}" for row, w, n in zip(colour.RGB_TO_XYZ, colour.WHITE, "xyz", strict=True))
FXYZ = ", ".join(f"CASE WHEN {n} > 0.008856 THEN pow({n}, 1.0::DOUBLE / 3) ELSE 7.787 * {n} + 16.0::DOUBLE / 116 END AS f{n}" for n in "xyz")
LAB = f"c0 AS (SELECT DISTINCT r, g, b FROM v_pixels), c1 AS (SELECT *, {LIN} FROM c0), c2 AS (SELECT *, {XYZ} FROM c1), c3 AS (SELECT *, {FXYZ} FROM c2), lab AS (SELECT r, g, b, 116 * fy - 16 AS l1, 500 * (fx - fy) AS a1, 200 * (fy - fz) AS b1 FROM c3)"


def _delta(centres) -> str:
    """CTEs that end in best (r, g, b, d, k): the nearest centre of each colour."""
    values = ", ".join(f"({k}, {c[0]}::DOUBLE, {c[1]}::DOUBLE, {c[2]}::DOUBLE)" for k, c in enumerate(centres))
    return f"""{LAB}, cs(k, l2, a2, b2) AS (VALUES {values}),
      e1 AS (SELECT *, (sqrt(a1*a1 + b1*b1) + sqrt(a2*a2 + b2*b2)) / 2 AS cm FROM lab, cs),
      e2 AS (SELECT *, 0.5 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + 6103515625.0::DOUBLE))) AS grow FROM e1),
      e3 AS (SELECT *, (1 + grow) * a1 AS p1, (1 + grow) * a2 AS p2 FROM e2),
      e4 AS (SELECT *, sqrt(p1*p1 + b1*b1) AS k1, sqrt(p2*p2 + b2*b2) AS k2, CASE WHEN p1 = 0 AND b1 = 0 THEN 0 ELSE (degrees(atan2(b1, p1)) + 360) % 360 END AS h1, CASE WHEN p2 = 0 AND b2 = 0 THEN 0 ELSE (degrees(atan2(b2, p2)) + 360) % 360 END AS h2 FROM e3),
      e5 AS (SELECT *, CASE WHEN k1 * k2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
                    CASE WHEN k1 * k2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (l1 + l2) / 2 AS lm, (k1 + k2) / 2 AS pm FROM e4),
      e6 AS (SELECT *, 2 * sqrt(k1 * k2) * sin(radians(dh / 2)) AS bh, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS t,
                    -sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * 2 * sqrt(pow(pm, 7) / (pow(pm, 7) + 6103515625.0::DOUBLE)) AS rot FROM e5),
      e7 AS (SELECT *, (l2 - l1) / (1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) AS x, (k2 - k1) / (1 + 0.045 * pm) AS y, bh / (1 + 0.015 * pm * t) AS z FROM e6),
      e8 AS (SELECT r, g, b, k, round(sqrt(greatest(0, x*x + y*y + z*z + rot*y*z)), 9) AS d FROM e7),
      best AS (SELECT r, g, b, min(d) AS d, arg_min(k, (d, k)) AS k FROM e8 GROUP BY r, g, b)"""


CSS = ", ".join(f"({k}, '{n}', {v[0]}, {v[1]}, {v[2]})" for k, (n, v) in enumerate(CSS_COLOURS.items()))
STRETCH = ", ".join(
    f"round(avg(least(1.0, greatest(0.0, ({c} - p{c}[1]) / (p{c}[2] - p{c}[1] + 1e-8)))), 6) AS mean_{c}" for c in "rgb"
)
MODE = "SELECT image_id, r, g, b, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, %s) AS k FROM (SELECT image_id, r, g, b, count(*) AS n FROM v_pixels %s GROUP BY ALL)) WHERE k = 1"

QUERIES = {
    "srgb_roundtrip": (srgb_roundtrip, f"WITH l AS (SELECT DISTINCT r, {LINEAR.replace('{c}', 'r')} AS v FROM v_pixels) SELECT r, round(v, 9) AS linear, round(255 * CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4::DOUBLE) - 0.055 END, 6) AS back FROM l"),
    "percentile_normalise": (
        percentile_normalise,
        "WITH e AS (SELECT image_id, " + ", ".join(f"quantile_cont({c}::DOUBLE, [0.01, 0.99]) AS p{c}" for c in "rgb") + f" FROM v_pixels GROUP BY image_id) SELECT image_id, {STRETCH} FROM v_pixels JOIN e USING (image_id) GROUP BY image_id",
    ),
    "rgb_to_lab": (rgb_to_lab, f"WITH {LAB} SELECT r, g, b, round(l1, 5) AS l_star, round(a1, 5) AS a_star, round(b1, 5) AS b_star FROM lab"),
    "nearest_palette_assignment": (nearest_palette_assignment, f"WITH {_delta(CENTRES)} SELECT image_id, CASE WHEN d <= 5 THEN k END AS layer, count(*) AS pixels FROM v_pixels JOIN best USING (r, g, b) GROUP BY ALL"),
    "layer_ratio": (
        layer_ratio,
        f"WITH {_delta(CENTRES)} SELECT image_id, " + ", ".join(f"round(count(CASE WHEN d <= 5 AND k = {k} THEN 1 END) / count(*)::DOUBLE, 6) AS ratio_{k}" for k in range(4)) + " FROM v_pixels JOIN best USING (r, g, b) GROUP BY image_id",
    ),
    "paper_background": (paper_background, f"WITH {_delta([(100.0, 0.0, 0.0)])} SELECT image_id, count(CASE WHEN d <= 10 THEN 1 END) AS paper, count(*) AS pixels FROM v_pixels JOIN best USING (r, g, b) GROUP BY image_id"),
    "dominant_colour_mode": (dominant_colour_mode, MODE % ("r, g, b", "")),
    "sampled_colour": (
        sampled_colour,
        """WITH i AS (SELECT image_id, click, ((image_id * 31 + click * 17) % 103) / 100.0::DOUBLE AS x, ((image_id * 31 + click * 17) % 101) / 100.0::DOUBLE AS y, CASE WHEN click > 0 THEN greatest(0, click * 30 - 31) ELSE 20 END AS reach
                      FROM (SELECT DISTINCT image_id FROM v_pixels), (SELECT unnest([0, 1, 2, 3])::INT AS click)),
           c AS (SELECT image_id, click, reach, round_even(x * 1999, 0) AS cx, round_even(y * 50, 0) AS cy FROM i WHERE x <= 1 AND y <= 1),
           n AS (SELECT p.image_id, click, r, g, b, count(*) AS n FROM v_pixels p JOIN c ON c.image_id = p.image_id AND abs(px - cx) <= reach AND abs(py - cy) <= reach GROUP BY ALL)
           SELECT image_id, click, r, g, b, n, printf('#%02x%02x%02x', r, g, b) AS hex FROM n QUALIFY row_number() OVER (PARTITION BY image_id, click ORDER BY n DESC, r, g, b) = 1""",
    ),
    "dominant_colour_bins": (
        dominant_colour_bins,
        """WITH n AS (SELECT image_id, (r // 32) * 64 + (g // 32) * 8 + b // 32 AS bin, count(*) AS n FROM v_pixels GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bin) AS k FROM n)
           SELECT image_id, cast(bin // 64 * 32 + 16 AS INT) AS r, cast(bin // 8 % 8 * 32 + 16 AS INT) AS g, cast(bin % 8 * 32 + 16 AS INT) AS b FROM k WHERE k = 1""",
    ),
    "nearest_css_name": (
        nearest_css_name,
        f"""WITH n(k, name, nr, ng, nb) AS (VALUES {CSS}), p AS (SELECT r, g, b, count(*) AS n FROM v_pixels GROUP BY ALL),
            m AS (SELECT r, g, b, any_value(n) AS n, arg_min(name, ((r - nr) * (r - nr) + (g - ng) * (g - ng) + (b - nb) * (b - nb)) * 1000 + k) AS name FROM p, n AS names GROUP BY r, g, b)
            SELECT name, cast(sum(n) AS BIGINT) AS pixels FROM m GROUP BY name""",
    ),
    "gray_world_gains": (
        gray_world_gains,
        "WITH m AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM v_pixels GROUP BY image_id) SELECT image_id, " + ", ".join(f"round(CASE WHEN {c} = 0 THEN 1.0 ELSE (r + g + b) / 3 / {c} END, 6) AS gain_{c}" for c in "rgb") + " FROM m",
    ),
    "white_patch_gains": (white_patch_gains, "SELECT image_id, " + ", ".join(f"round(1 / (quantile_cont({c} / 255.0::DOUBLE, 0.995) + 1e-8), 6) AS gain_{c}" for c in "rgb") + " FROM v_pixels GROUP BY image_id"),
    "gamma_on_lightness": (gamma_on_lightness, f"WITH {LAB} SELECT r, g, b, round(100 * (0.4 * l1 / 100 + 0.6 * pow(l1 / 100, 1.5)), 5) AS lightness FROM lab"),
    "hex_roundtrip": (hex_roundtrip, "SELECT DISTINCT printf('#%02x%02x%02x', r, g, b) AS code, r, g, b FROM v_pixels"),
    "picked_colours": (picked_colours, "SELECT image_id, printf('#%02x%02x%02x', r, g, b) AS code, min(line) AS line FROM v_features GROUP BY ALL"),
}
