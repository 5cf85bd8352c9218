"""Queries of the timeline's days, of colours put to use and of shapes after their outlines, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions import colour, geometry
from maploom.operators import colours, shapes, timeline
from maploom.operators.scratch import dealt
from maploom.plans.timeline_queries import BOUNDS, PERIODS
from maploom.plans.views import tables, view


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables(spark, sf_dir, [name])[name]


def lane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = view(spark, sf_dir, "v_maps")
    found = timeline.lanes(maps).groupBy("project_id").agg((F.max("lane") + 1).alias("lanes"))
    every = maps.select("project_id").distinct().join(found, "project_id", "left")
    return every.select("project_id", F.coalesce("lanes", F.lit(1)).cast("int").alias("lanes"))


def periods_in_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps whose period touches the year that is zoomed into."""
    maps = view(spark, sf_dir, "v_maps")
    return maps.where((F.year("start_date") <= 1998) & (F.year("end_date") >= 1998)).groupBy("project_id").agg(F.count(F.lit(1)).alias("maps"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct exact dates of 1998 and the window around them, per project."""
    maps = view(spark, sf_dir, "v_maps").where("exact_date")
    dates = maps.select("project_id", F.explode(F.array("start_date", "end_date")).alias("date")).where("year(date) = 1998").distinct()
    return dates.join(timeline.day_window(dates, "project_id"), "project_id").where("span > 0")


def day_tick_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.tick_lanes(_days(spark, sf_dir), "project_id")


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of exact periods in their project's window: days from its first day, none below 0, and a share of the span."""
    window = _days(spark, sf_dir).select("project_id", "first_day", "span").distinct()
    maps = view(spark, sf_dir, "v_maps").where("exact_date").join(window, "project_id")
    day = lambda c: F.greatest(F.lit(0), F.datediff(c, "first_day"))
    left, right = timeline.position(day("start_date"), F.lit(0), F.col("span")), timeline.position(day("end_date"), F.lit(0), F.col("span"))
    return maps.select("map_id", F.round(left, 6).alias("left_percent"), F.round(F.greatest(F.lit(0.8), right - left), 6).alias("width_percent"))


def first_zoom_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a zoom into days begins: at the present date if it is a stop, else at the last going backward, the first going on."""
    stops = _days(spark, sf_dir).groupBy("project_id").agg(F.array_sort(F.collect_list("date")).alias("dates"))
    now, backward = F.make_date(F.lit(1998), (F.col("project_id") % 12 + 1).cast("int"), F.lit(15)), F.col("project_id") % 2 == 0
    stop = F.when(F.array_contains("dates", now), now).when(backward, F.element_at("dates", -1)).otherwise(F.element_at("dates", 1))
    return stops.select("project_id", stop.alias("stop"))


def snap_to_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).withColumn("day", F.datediff("date", "first_day")).groupBy("project_id").agg(F.collect_list("day").alias("days"), F.first("span").alias("span"))
    wanted = F.least(F.col("span"), F.greatest(F.lit(0), (F.col("project_id") % 400).cast("int")))
    return days.select("project_id", timeline.nearest(wanted, F.col("days")).alias("day"))


def legend_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that show in 1998 and are not switched off."""
    placed = timeline.with_periods(view(spark, sf_dir, "v_features"), view(spark, sf_dir, "v_maps"))
    zones = placed.where(timeline.alive_in_year(F.lit(1998)) & (F.col("kind") == "R") & (F.col("state") == "O") & (F.col("line") != 1))
    hidden = view(spark, sf_dir, "v_features").where("r % 4 = 1").select("feature_id", F.lit(False).alias("shown"))
    shown = zones.join(hidden, "feature_id", "left").where(F.coalesce("shown", F.lit(True)))
    return shown.groupBy("project_id").agg(F.count(F.lit(1)).alias("entries"))


def render_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features of each kind a project renders."""
    kind = F.when(F.col("line") == 1, "image").when(F.col("kind") == "N", "polyline").when(F.col("kind") == "A", F.when(F.col("state") == "F", "label").otherwise("point")).otherwise(F.when(F.col("state") == "F", "shape").otherwise("zone"))
    kinds = ("point", "label", "polyline", "zone", "shape", "image")
    return view(spark, sf_dir, "v_features").withColumn("t", kind).groupBy("project_id").agg(*(F.count_if(F.col("t") == k).alias(f"{k}s") for k in kinds))


def imposed_dominants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicked colours by position as named centres in LAB; without clicks those of the legend; without either none."""
    clicks = view(spark, sf_dir, "v_pixels").where("image_id % 3 <> 0 AND px % 97 < 5")
    legend = view(spark, sf_dir, "v_pixels").where("image_id % 5 = 0 AND px % 89 < 5")
    listed = lambda rows, rank: rows.groupBy("image_id").agg(F.array_sort(F.collect_set(F.struct("px", "py", "r", "g", "b"))).alias("found"), F.lit(rank).alias("rank"))
    used = listed(clicks, 0).unionByName(listed(legend, 1)).groupBy("image_id").agg(F.min_by("found", "rank").alias("found"), F.min("rank").alias("rank"))
    each = used.select("image_id", "rank", F.posexplode("found").alias("n", "c")).select("image_id", "rank", "n", "c.r", "c.g", "c.b")
    labs = colours.with_lab(each)
    return labs.select("image_id", F.format_string("imposed_%02d", F.col("n") + 1).alias("name"), F.when(F.col("rank") == 0, "click").otherwise("legend").alias("source"), F.round("lab.L", 5).alias("l_star"), F.round("lab.A", 5).alias("a_star"), F.round("lab.B", 5).alias("b_star"))


def legend_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each image's legend shapes: a triangle, an arrow with a notch, and one that is a box alone."""
    point = lambda x, y: geometry.point(F.lit(x), F.lit(y))
    images = view(spark, sf_dir, "v_pixels").select("image_id").distinct()
    triangle = F.array(point(50, 5), point(800, 10), point(300, 45))
    arrow = F.array(point(100, 4), point(1700, 4), point(1700, 44), point(900, 14), point(100, 44))
    box = F.struct(F.lit(50).alias("x"), F.lit(5).alias("y"), F.lit(751).alias("width"), F.lit(41).alias("height"))
    legends = images.select("image_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("shape")).withColumns({"ring": F.when(F.col("shape") == 0, triangle).when(F.col("shape") == 1, arrow), "box": box})
    return colours.of_legends(view(spark, sf_dir, "v_pixels"), legends, "image_id", "shape")


def balanced_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray-world gains put to the pixels, none above 1."""
    pixels = view(spark, sf_dir, "v_pixels").select("image_id", *((F.col(c) / 255).alias(c) for c in colours.CHANNELS))
    even = pixels.join(colours.gains(pixels, "image_id"), "image_id")
    return even.groupBy("image_id").agg(*(F.round(F.avg(F.least(F.lit(1.0), F.col(c) * F.col(f"gain_{c}"))), 6).alias(f"mean_{c}") for c in colours.CHANNELS))


def lab_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours to LAB and back to bytes."""
    labs = colours.with_lab(view(spark, sf_dir, "v_pixels").select("r", "g", "b").distinct())
    back = colour.rgb_of_lab(F.col("lab.L"), F.col("lab.A"), F.col("lab.B"))
    return labs.select("r", "g", "b", back.alias("c")).select("r", "g", "b", F.col("c.r").alias("r2"), F.col("c.g").alias("g2"), F.col("c.b").alias("b2"))


def click_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    radius = F.least(F.lit(200), F.greatest(F.lit(1), F.coalesce(F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") * 6 - 20), F.lit(20))))
    return p.select("p_partkey", radius.cast("int").alias("radius"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes within one of 20 images; neighbours by number often lie on each other."""
    k = F.col("p_partkey")
    x, y, w, h = ((k - k % 4) * 37 % 900 + k % 4).cast("double"), ((k - k % 4) * 53 % 700).cast("double"), (F.col("p_size") + 20).cast("double"), (40 + k % 4).cast("double")
    corner = lambda a, b: geometry.point(a, b)
    ring = F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h), corner(x, y))
    return dealt(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", ((k - k % 4) / 4 % 20).cast("int").alias("image"), ring.alias("ring"))


def area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("p_partkey", F.abs(geometry.signed_area(F.col("ring"))).alias("area"), (F.size("ring") - 1).alias("points"))
    return shapes.area_filter(rows, "area", "points", 1000.0 * 800.0, most=2000.0)


def duplicate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.deduplicated(_boxes(spark, sf_dir), "image", "p_partkey").select("image", "p_partkey")


def raster_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices within bounds as pixels of a picture of 1024 by 768; others are left out."""
    f = view(spark, sf_dir, "v_features").where("x BETWEEN 100 AND 1500 AND y BETWEEN 200 AND 1800")
    px = F.least(F.lit(1023), F.greatest(F.lit(0), ((F.col("x") - 100) / 1400 * 1024).cast("int")))
    py = F.least(F.lit(767), F.greatest(F.lit(0), ((1800 - F.col("y")) / 1600 * 768).cast("int")))
    return f.select(px.alias("px"), py.alias("py")).groupBy("px", "py").agg(F.count(F.lit(1)).alias("vertices"))


DAYS = """d AS (SELECT DISTINCT project_id, date FROM (SELECT project_id, unnest([start_date, end_date]) AS date FROM v_maps WHERE exact_date) WHERE year(date) = 1998),
    w0 AS (SELECT project_id, cast(date_trunc('month', min(date) - INTERVAL 1 MONTH) AS DATE) AS first_day, last_day(max(date) + INTERVAL 1 MONTH) AS last_day FROM d GROUP BY project_id HAVING count(*) >= 2),
    w AS (SELECT *, date_diff('day', first_day, last_day) AS span FROM w0), t AS (SELECT d.project_id, date, first_day, span, date_diff('day', first_day, date) AS day FROM d JOIN w USING (project_id) WHERE span > 0)"""
BOXES = """b AS (SELECT p_partkey, cast(p_partkey // 4 % 20 AS INT) AS image, ((p_partkey - p_partkey % 4) * 37 % 900 + p_partkey % 4)::DOUBLE AS x, ((p_partkey - p_partkey % 4) * 53 % 700)::DOUBLE AS y, (p_size + 20)::DOUBLE AS w, (40 + p_partkey % 4)::DOUBLE AS h FROM {part})"""
LINEAR = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"

QUERIES = {
    "lane_counts": (
        lane_counts,
        """WITH e AS (SELECT project_id, year(start_date) AS s, year(end_date) AS e FROM v_maps WHERE start_date IS NOT NULL AND end_date IS NOT NULL),
           n AS (SELECT a.project_id, a.s, count(*) AS n FROM (SELECT DISTINCT project_id, s FROM e) a JOIN e ON e.project_id = a.project_id AND e.s <= a.s AND e.e >= a.s GROUP BY ALL)
           SELECT p.project_id, cast(coalesce(max(n), 1) AS INT) AS lanes FROM (SELECT DISTINCT project_id FROM v_maps) p LEFT JOIN n USING (project_id) GROUP BY p.project_id""",
    ),
    "periods_in_zoom": (periods_in_zoom, "SELECT project_id, count(*) AS maps FROM v_maps WHERE 1998 BETWEEN year(start_date) AND year(end_date) GROUP BY project_id"),
    "day_tick_lanes": (
        day_tick_lanes,
        f"""WITH RECURSIVE {DAYS}, o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY day) AS n FROM (SELECT DISTINCT project_id, span, day FROM t WHERE day BETWEEN 0 AND span)),
            f AS (SELECT project_id, 0::BIGINT AS n, -100::DOUBLE AS percent, 0 AS lane, NULL::BIGINT AS day FROM (SELECT DISTINCT project_id FROM o)
                  UNION ALL SELECT o.project_id, o.n, o.day * 100.0 / o.span, CASE WHEN o.day * 100.0 / o.span - f.percent < 10 THEN 1 - f.lane ELSE 0 END, o.day FROM f JOIN o ON o.project_id = f.project_id AND o.n = f.n + 1)
            SELECT project_id, cast(day AS INT) AS day, cast(lane AS INT) AS lane, true AS is_exact FROM f WHERE n > 0
            UNION ALL SELECT project_id, cast(unnest([0, span]) AS INT), 0, false FROM (SELECT DISTINCT project_id, span FROM t)""",
    ),
    "day_bars": (
        day_bars,
        f"""WITH {DAYS}, p AS (SELECT map_id, least(100.0, greatest(0, date_diff('day', first_day, start_date)) / w.span * 100) AS l, least(100.0, greatest(0, date_diff('day', first_day, end_date)) / w.span * 100) AS r FROM v_maps m JOIN w ON w.project_id = m.project_id WHERE exact_date AND span > 0)
            SELECT map_id, round(l::DOUBLE, 6) AS left_percent, round(greatest(0.8, r - l)::DOUBLE, 6) AS width_percent FROM p""",
    ),
    "first_zoom_stops": (
        first_zoom_stops,
        f"""WITH {DAYS}, a AS (SELECT project_id, min(date) AS lo, max(date) AS hi, list(date) AS ds, make_date(1998, cast(project_id % 12 + 1 AS INT), 15) AS now FROM t GROUP BY project_id)
            SELECT project_id, CASE WHEN list_contains(ds, now) THEN now WHEN project_id % 2 = 0 THEN hi ELSE lo END AS stop FROM a""",
    ),
    "snap_to_day": (
        snap_to_day,
        f"""WITH {DAYS}, n AS (SELECT project_id, day, row_number() OVER (PARTITION BY project_id ORDER BY abs(day - least(span, project_id % 400)), day) AS k FROM t) SELECT project_id, cast(day AS INT) AS day FROM n WHERE k = 1""",
    ),
    "legend_entries": (
        legend_entries,
        f"WITH p AS ({PERIODS}) SELECT project_id, count(*) AS entries FROM p WHERE (map_id IS NULL OR sy IS NULL OR ey IS NULL OR 1998 BETWEEN sy AND ey) AND kind = 'R' AND state = 'O' AND line <> 1 AND r % 4 <> 1 GROUP BY project_id",
    ),
    "render_groups": (
        render_groups,
        """SELECT project_id, count(*) FILTER (line <> 1 AND kind = 'A' AND state <> 'F') AS points, count(*) FILTER (line <> 1 AND kind = 'A' AND state = 'F') AS labels, count(*) FILTER (line <> 1 AND kind = 'N') AS polylines,
                  count(*) FILTER (line <> 1 AND kind NOT IN ('A', 'N') AND state <> 'F') AS zones, count(*) FILTER (line <> 1 AND kind NOT IN ('A', 'N') AND state = 'F') AS shapes, count(*) FILTER (line = 1) AS images FROM v_features GROUP BY project_id""",
    ),
    "imposed_dominants": (
        imposed_dominants,
        f"""WITH u AS (SELECT DISTINCT image_id, px, py, r, g, b, 0 AS rank FROM v_pixels WHERE image_id % 3 <> 0 AND px % 97 < 5 UNION ALL SELECT DISTINCT image_id, px, py, r, g, b, 1 FROM v_pixels WHERE image_id % 5 = 0 AND px % 89 < 5),
            c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY px, py, r, g, b) AS n FROM (SELECT *, min(rank) OVER (PARTITION BY image_id) AS first FROM u) WHERE rank = first),
            l AS (SELECT *, {LINEAR.format('r')} AS lr, {LINEAR.format('g')} AS lg, {LINEAR.format('b')} AS lb FROM c),
            z AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.95047 AS fx, (0.212671 * lr + 0.715160 * lg + 0.072169 * lb) AS fy, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.08883 AS fz FROM l),
            f AS (SELECT *, CASE WHEN fx > 0.008856 THEN cbrt(fx) ELSE 7.787 * fx + 16.0 / 116 END AS gx, CASE WHEN fy > 0.008856 THEN cbrt(fy) ELSE 7.787 * fy + 16.0 / 116 END AS gy, CASE WHEN fz > 0.008856 THEN cbrt(fz) ELSE 7.787 * fz + 16.0 / 116 END AS gz FROM z)
            SELECT image_id, printf('imposed_%02d', n) AS name, CASE rank WHEN 0 THEN 'click' ELSE 'legend' END AS source, round(116 * gy - 16, 5) AS l_star, round(500 * (gx - gy), 5) AS a_star, round(200 * (gy - gz), 5) AS b_star FROM f""",
    ),
    "legend_colours": (
        legend_colours,
        """WITH c AS (SELECT * FROM (VALUES (0, 1, 50, 5, 800, 10), (0, 2, 800, 10, 300, 45), (0, 3, 300, 45, 50, 5), (1, 1, 100, 4, 1700, 4), (1, 2, 1700, 4, 1700, 44), (1, 3, 1700, 44, 900, 14), (1, 4, 900, 14, 100, 44), (1, 5, 100, 44, 100, 4)) v(shape, side, x1, y1, x2, y2)),
           p AS (SELECT DISTINCT px, py FROM v_pixels),
           h AS (SELECT shape, px, py, sum(CASE WHEN (y1 <= py) <> (y2 <= py) AND px < x1 + (py - y1) * (x2 - x1) / (y2 - y1)::DOUBLE THEN 1 ELSE 0 END) % 2 = 1
                        OR bool_or((x2 - x1) * (py - y1) = (y2 - y1) * (px - x1) AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2)) AS inside FROM p, c GROUP BY ALL),
           n AS (SELECT image_id, shape, r, g, b, count(*) AS n FROM v_pixels v JOIN h ON h.px = v.px AND h.py = v.py WHERE inside GROUP BY ALL)
           SELECT image_id, shape::INT AS shape, r, g, b FROM n QUALIFY row_number() OVER (PARTITION BY image_id, shape ORDER BY n DESC, b, g, r) = 1
           UNION ALL SELECT image_id, 2, cast(round_even(quantile_cont(r, 0.5), 0) AS INT), cast(round_even(quantile_cont(g, 0.5), 0) AS INT), cast(round_even(quantile_cont(b, 0.5), 0) AS INT) FROM v_pixels WHERE px BETWEEN 50 AND 800 AND py BETWEEN 5 AND 45 GROUP BY image_id""",
    ),
    "balanced_pixels": (
        balanced_pixels,
        """WITH p AS (SELECT image_id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM v_pixels), m AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM p GROUP BY image_id),
           k AS (SELECT image_id, CASE WHEN mr = 0 THEN 1 ELSE (mr + mg + mb) / 3 / mr END AS kr, CASE WHEN mg = 0 THEN 1 ELSE (mr + mg + mb) / 3 / mg END AS kg, CASE WHEN mb = 0 THEN 1 ELSE (mr + mg + mb) / 3 / mb END AS kb FROM m)
           SELECT image_id, round(avg(least(1.0, r * kr)), 6) AS mean_r, round(avg(least(1.0, g * kg)), 6) AS mean_g, round(avg(least(1.0, b * kb)), 6) AS mean_b FROM p JOIN k USING (image_id) GROUP BY image_id""",
    ),
    "lab_to_rgb": (lab_to_rgb, "SELECT DISTINCT r, g, b, r AS r2, g AS g2, b AS b2 FROM v_pixels"),
    "click_radii": (click_radii, "SELECT p_partkey, cast(least(200, greatest(1, CASE WHEN p_partkey % 3 > 0 THEN p_size * 6 - 20 ELSE 20 END)) AS INT) AS radius FROM {part}"),
    "area_filter": (area_filter, f"WITH {BOXES} SELECT p_partkey, w * h AS area, 4::INT AS points FROM b WHERE w * h BETWEEN 50 AND 2000"),
    "duplicate_shapes": (
        duplicate_shapes,
        f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, w * h AS area, row_number() OVER (PARTITION BY image ORDER BY w * h DESC, p_partkey) AS n FROM b),
            f AS (SELECT image, n, [struct_pack(k := p_partkey, x := x, y := y, w := w, h := h)] AS kept FROM o WHERE n = 1
                  UNION ALL SELECT o.image, o.n, CASE WHEN len(list_filter(f.kept, lambda q: o.area / (q.w * q.h) >= 0.6 AND greatest(0, least(q.x + q.w, o.x + o.w) - greatest(q.x, o.x)) * greatest(0, least(q.y + q.h, o.y + o.h) - greatest(q.y, o.y)) >= 0.6 * o.area)) > 0
                  THEN f.kept ELSE list_append(f.kept, struct_pack(k := o.p_partkey, x := o.x, y := o.y, w := o.w, h := o.h)) END FROM f JOIN o ON o.image = f.image AND o.n = f.n + 1),
            l AS (SELECT image, kept FROM f QUALIFY n = max(n) OVER (PARTITION BY image)), u AS (SELECT image, unnest(kept) AS q FROM l) SELECT image, q.k AS p_partkey FROM u""",
    ),
    "raster_vertices": (
        raster_vertices,
        """SELECT cast(least(1023, greatest(0, trunc((x - 100) / 1400 * 1024))) AS INT) AS px, cast(least(767, greatest(0, trunc((1800 - y) / 1600 * 768))) AS INT) AS py, count(*) AS vertices FROM v_features WHERE x BETWEEN 100 AND 1500 AND y BETWEEN 200 AND 1800 GROUP BY ALL""",
    ),
}
