"""Queries of the timeline, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.operators import timeline
from maploom.plans.views import tables, view

KIND = "CASE kind WHEN 'A' THEN 'Point' WHEN 'N' THEN 'LineString' ELSE 'Polygon' END"
TYPE = f"CASE WHEN line = 1 THEN 'image' WHEN {KIND} = 'LineString' THEN 'polyline' WHEN {KIND} = 'Point' THEN CASE WHEN state = 'F' THEN 'label' ELSE 'point' END ELSE CASE WHEN state = 'F' THEN 'shape' ELSE 'zone' END END"


def _typed(features: DataFrame) -> DataFrame:
    labelled = F.col("state") == "F"
    return features.withColumn("element_type", timeline.element_type(F.when(F.col("line") == 1, "image"), F.expr(KIND), labelled, labelled))


def maps_alive_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.alive_counts(view(spark, sf_dir, "v_maps").select(F.year("start_date").alias("first"), F.year("end_date").alias("last")), "maps")


def temporal_visible_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _typed(timeline.with_periods(view(spark, sf_dir, "v_features"), view(spark, sf_dir, "v_maps")))
    years = placed.select("element_type", "map_id", "start_year", "end_year", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    return years.where(timeline.alive_in_year(F.col("year"))).groupBy("year", "element_type").agg(F.count(F.lit(1)).alias("features"))


def visible_on_exact_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = timeline.with_periods(view(spark, sf_dir, "v_features"), view(spark, sf_dir, "v_maps"))
    return placed.where(timeline.alive_on(F.lit("1998-06-15").cast("date"))).groupBy("kind").agg(F.count(F.lit(1)).alias("features"), F.count("map_id").alias("on_maps"))


def timeline_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.bounds(view(spark, sf_dir, "v_maps"), "project_id")


def marker_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.marker_years(view(spark, sf_dir, "v_maps"), "project_id")


def lane_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.lanes(view(spark, sf_dir, "v_maps"))


def exact_date_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = view(spark, sf_dir, "v_maps").where("exact_date").select("project_id", F.explode(F.array("start_date", "end_date")).alias("date")).where("year(date) = 1998").distinct()
    return timeline.day_window(exact, "project_id")


def snap_to_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = view(spark, sf_dir, "v_maps")
    lists = timeline.marker_years(maps, "project_id").groupBy("project_id").agg(F.collect_set("year").alias("years"))
    return lists.select("project_id", timeline.nearest(F.lit(1997), F.col("years")).alias("year"))


def period_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = view(spark, sf_dir, "v_maps")
    rows = maps.join(timeline.bounds(maps, "project_id"), "project_id")
    left = timeline.position(F.year("start_date"), F.col("min_year"), F.col("max_year"))
    right = timeline.position(F.year("end_date"), F.col("min_year"), F.col("max_year"))
    return rows.select("map_id", F.round(left, 6).alias("left_percent"), F.round(F.greatest(F.lit(0.8), right - left), 6).alias("width_percent"))


def period_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("project_id").orderBy("start_date", "map_id")
    return view(spark, sf_dir, "v_maps").select("map_id", ((F.row_number().over(order) - 1) % timeline.PALETTE_SIZE).alias("colour_index"))


def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.search(view(spark, sf_dir, "v_projects"), "  MACHIN ", "title", "description")
    return found.where("created_at >= DATE '1995-06-01' AND created_at <= DATE '1999-12-31'").where("NOT is_private").select("project_id", "title", "description", "created_at")


def element_type_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(view(spark, sf_dir, "v_features")).withColumn("panel", timeline.panel(F.col("element_type")))
    return rows.groupBy("project_id", "panel").agg(F.count(F.lit(1)).alias("features"))


def visibility_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = view(spark, sf_dir, "v_features").select("feature_id", "r", "line")
    known = features.where("r % 2 = 0").select("feature_id", (F.col("line") % 3 != 0).alias("shown"))
    return features.join(known, "feature_id", "left").groupBy(F.coalesce("shown", F.lit(True)).alias("visible")).agg(F.count(F.lit(1)).alias("features"))


def style_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = view(spark, sf_dir, "v_features")
    fill = F.coalesce(F.when(F.col("line") > 2, F.format_string("#%02x%02x%02x", "r", "g", "b")), F.lit("#000000"))
    stroke = F.coalesce(F.when(F.col("line") > 5, F.lit("#ff0000")), fill)
    return features.groupBy(fill.alias("fill"), stroke.alias("stroke"), F.when(F.col("kind") == "N", 2).otherwise(1).alias("weight"), F.lit(0.5).alias("fill_opacity")).agg(F.count(F.lit(1)).alias("features"))


def removed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = view(spark, sf_dir, "v_features")
    return features.select("project_id", "feature_id").join(features.where("r % 4 <> 0").select("feature_id"), "feature_id", "left_anti").groupBy("project_id").agg(F.count(F.lit(1)).alias("removed"))


def pending_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    dashed = r"regexp_replace(feature_id, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')"
    rows = view(spark, sf_dir, "v_features").select("project_id", "r", F.expr(dashed).alias("uuid"))
    valid = rows.where(F.col("uuid").rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))
    return valid.join(rows.where("r % 4 <> 0").select("uuid"), "uuid", "left_anti").groupBy("project_id").agg(F.count(F.lit(1)).alias("pending"))


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables(spark, sf_dir, ["lineitem"])["lineitem"]
    text = F.format_string("%04d-%02d-%02d", 1700 + F.col("l_partkey") % 300, 1 + F.col("l_linenumber") % 12, 1 + F.col("l_suppkey") % 31)
    return lines.select(text.alias("iso")).distinct().select("iso", timeline.iso_year(F.col("iso")).alias("year"), timeline.iso_rollover(F.col("iso")).alias("date"))


def radius_by_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, ["part"])["part"].select((F.col("p_size") % 19).alias("zoom")).distinct().select("zoom", F.round(timeline.radius_at(F.col("zoom")), 6).alias("radius"))


def wizard_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables(spark, sf_dir, ["events"])["events"]
    status = F.element_at(F.array(*map(F.lit, ("Saving image", "Loading image", "Extracting text", "Cleaning up", "Done"))), (F.col("event_id") % 5 + 1).cast("int"))
    step = F.when(F.contains(status, F.lit("Saving")), 1).when(F.contains(status, F.lit("Loading")), 2).when(F.contains(status, F.lit("Extracting")), 3).when(F.contains(status, F.lit("Cleaning")), 4).otherwise(0)
    return events.groupBy("event_type", step.alias("step")).agg(F.count(F.lit(1)).alias("events"))


def period_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = view(spark, sf_dir, "v_maps")
    start = F.when(F.col("exact_date"), F.date_format("start_date", "yyyy-MM-dd")).otherwise(F.format_string("%04d-01-01", F.year("start_date")))
    end = F.when(F.col("exact_date"), F.date_format("end_date", "yyyy-MM-dd")).otherwise(F.format_string("%04d-12-31", F.year("end_date")))
    return maps.select("map_id", start.alias("start_iso"), end.alias("end_iso"), "exact_date").where("start_iso <= end_iso")


PERIODS = "SELECT f.*, year(m.start_date) AS sy, year(m.end_date) AS ey, m.start_date AS sd, m.end_date AS ed FROM v_features f LEFT JOIN v_maps m ON m.map_id = f.map_id"
BOUNDS = "SELECT project_id, cast(coalesce(min(year(start_date)), 1400) AS INT) AS min_year, cast(coalesce(max(year(end_date)), year(current_date)) AS INT) AS max_year FROM v_maps GROUP BY project_id"
MARKERS = "SELECT DISTINCT project_id, cast(unnest([year(start_date), year(end_date)]) AS INT) AS year FROM v_maps"

QUERIES = {
    "maps_alive_per_year": (maps_alive_per_year, "SELECT cast(year AS INT) AS year, count(*) AS maps FROM (SELECT unnest(range(year(start_date), year(end_date) + 1)) AS year FROM v_maps) GROUP BY year"),
    "temporal_visible_features": (
        temporal_visible_features,
        f"WITH p AS ({PERIODS}) SELECT cast(yr AS INT) AS year, {TYPE} AS element_type, count(*) AS features FROM p, (SELECT unnest(range(1995, 2002)) AS yr) WHERE map_id IS NULL OR sy IS NULL OR ey IS NULL OR yr BETWEEN sy AND ey GROUP BY ALL",
    ),
    "visible_on_exact_date": (visible_on_exact_date, f"WITH p AS ({PERIODS}) SELECT kind, count(*) AS features, count(map_id) AS on_maps FROM p WHERE map_id IS NULL OR sd IS NULL OR ed IS NULL OR DATE '1998-06-15' BETWEEN sd AND ed GROUP BY kind"),
    "timeline_bounds": (timeline_bounds, BOUNDS),
    "marker_years": (marker_years, MARKERS),
    "lane_packing": (
        lane_packing,
        """WITH RECURSIVE o AS (SELECT project_id, map_id, cast(year(start_date) AS INT) AS s, cast(year(end_date) AS INT) AS e, row_number() OVER (PARTITION BY project_id ORDER BY year(start_date), year(end_date), map_id) AS n FROM v_maps),
           f AS (SELECT project_id, map_id, s, e, n, 0 AS lane, [e] AS ends FROM o WHERE n = 1
                 UNION ALL
                 SELECT o.project_id, o.map_id, o.s, o.e, o.n, cast(x.free AS INT), CASE WHEN x.free < len(f.ends) THEN list_transform(f.ends, lambda v, i: CASE WHEN i = x.free + 1 THEN greatest(v, o.e) ELSE v END) ELSE list_append(f.ends, o.e) END
                 FROM f JOIN o ON o.project_id = f.project_id AND o.n = f.n + 1, LATERAL (SELECT coalesce(list_position(list_transform(f.ends, lambda v: v < o.s), TRUE) - 1, len(f.ends)) AS free) x)
           SELECT project_id, map_id, s AS start_year, e AS end_year, lane FROM f""",
    ),
    "exact_date_ticks": (
        exact_date_ticks,
        """WITH d AS (SELECT DISTINCT project_id, date FROM (SELECT project_id, unnest([start_date, end_date]) AS date FROM v_maps WHERE exact_date) WHERE year(date) = 1998),
           a AS (SELECT project_id, min(date) AS lo, max(date) AS hi FROM d GROUP BY project_id HAVING count(*) >= 2)
           SELECT project_id, cast(date_trunc('month', lo - INTERVAL 1 MONTH) AS DATE) AS first_day, last_day(hi + INTERVAL 1 MONTH) AS last_day, cast(date_diff('day', cast(date_trunc('month', lo - INTERVAL 1 MONTH) AS DATE), last_day(hi + INTERVAL 1 MONTH)) AS INT) AS span FROM a""",
    ),
    "snap_to_marker": (snap_to_marker, f"WITH m AS ({MARKERS}), n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY abs(year - 1997), year) AS n FROM m) SELECT project_id, year FROM n WHERE n = 1"),
    "period_positions": (
        period_positions,
        f"""WITH b AS ({BOUNDS}), p AS (SELECT map_id, CASE WHEN max_year <= min_year THEN 0.0 ELSE greatest(0.0, least(100.0, (year(start_date) - min_year) / (max_year - min_year) * 100)) END AS l,
             CASE WHEN max_year <= min_year THEN 0.0 ELSE greatest(0.0, least(100.0, (year(end_date) - min_year) / (max_year - min_year) * 100)) END AS r FROM v_maps JOIN b USING (project_id))
            SELECT map_id, round(cast(l AS DOUBLE), 6) AS left_percent, round(cast(greatest(0.8, r - l) AS DOUBLE), 6) AS width_percent FROM p""",
    ),
    "period_colours": (period_colours, "SELECT map_id, cast((row_number() OVER (PARTITION BY project_id ORDER BY start_date, map_id) - 1) % 8 AS INT) AS colour_index FROM v_maps"),
    "catalogue_search": (
        catalogue_search,
        "SELECT project_id, title, description, created_at FROM v_projects WHERE (contains(lower(title), 'machin') OR contains(lower(description), 'machin')) AND created_at BETWEEN DATE '1995-06-01' AND DATE '1999-12-31' AND NOT is_private",
    ),
    "element_type_panels": (element_type_panels, f"WITH t AS (SELECT project_id, {TYPE} AS t FROM v_features) SELECT project_id, CASE WHEN t IN ('point', 'zone', 'shape', 'image') THEN t ELSE 'other' END AS panel, count(*) AS features FROM t GROUP BY ALL"),
    "visibility_reconcile": (visibility_reconcile, "SELECT CASE WHEN r % 2 = 0 THEN line % 3 <> 0 ELSE TRUE END AS visible, count(*) AS features FROM v_features GROUP BY 1"),
    "style_projection": (
        style_projection,
        """WITH s AS (SELECT CASE WHEN line > 2 THEN printf('#%02x%02x%02x', r, g, b) ELSE '#000000' END AS fill, line, kind FROM v_features)
           SELECT fill, CASE WHEN line > 5 THEN '#ff0000' ELSE fill END AS stroke, CASE WHEN kind = 'N' THEN 2 ELSE 1 END AS weight, 0.5::DOUBLE AS fill_opacity, count(*) AS features FROM s GROUP BY ALL""",
    ),
    "removed_features": (removed_features, "SELECT project_id, count(*) AS removed FROM v_features WHERE r % 4 = 0 GROUP BY project_id"),
    "pending_deletions": (
        pending_deletions,
        "SELECT project_id, count(*) AS pending FROM v_features WHERE r % 4 = 0 AND regexp_matches(feature_id, '^[0-9a-f]{12}[1-5][0-9a-f]{3}[89ab][0-9a-f]{15}$') GROUP BY project_id",
    ),
    "iso_dates": (
        iso_dates,
        """WITH i AS (SELECT DISTINCT 1700 + l_partkey % 300 AS y, 1 + l_linenumber % 12 AS m, 1 + l_suppkey % 31 AS d FROM {lineitem})
           SELECT printf('%04d-%02d-%02d', y, m, d) AS iso, cast(y AS INT) AS year, cast(make_date(y, m, 1) + cast(d - 1 AS INT) AS DATE) AS date FROM i""",
    ),
    "radius_by_zoom": (radius_by_zoom, "SELECT DISTINCT p_size % 19 AS zoom, round(greatest(3.0, 3 * pow(1.5, p_size % 19 - 5)), 6) AS radius FROM {part}"),
    "wizard_steps": (wizard_steps, "SELECT event_type, cast(CASE WHEN event_id % 5 < 4 THEN event_id % 5 + 1 ELSE 0 END AS INT) AS step, count(*) AS events FROM {events} GROUP BY ALL"),
    "period_form": (
        period_form,
        """WITH p AS (SELECT map_id, CASE WHEN exact_date THEN strftime(start_date, '%Y-%m-%d') ELSE printf('%04d-01-01', year(start_date)) END AS start_iso, CASE WHEN exact_date THEN strftime(end_date, '%Y-%m-%d') ELSE printf('%04d-12-31', year(end_date)) END AS end_iso, exact_date FROM v_maps)
           SELECT * FROM p WHERE start_iso <= end_iso""",
    ),
}
