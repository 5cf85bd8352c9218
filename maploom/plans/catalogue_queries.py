"""Queries over users, projects, maps and features, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.operators import access
from maploom.plans.views import tables, view


def project_listing_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = access.project_listing(view(spark, sf_dir, "v_projects"), view(spark, sf_dir, "v_users"))
    return found.select("project_id", "title", "description", "username", "created_at", "updated_at")


def user_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = access.project_listing(view(spark, sf_dir, "v_projects"), view(spark, sf_dir, "v_users"), 3)
    return found.select("project_id", "title", "username", "is_private", "updated_at")


def project_access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = view(spark, sf_dir, "v_projects")
    viewer = F.explode(F.array(*(F.lit(u).cast("long") for u in (0, 3, 7))))
    rows = projects.select("project_id", "user_id", "is_private", viewer.alias("viewer"))
    return rows.groupBy("viewer").agg(
        F.count(F.lit(1)).alias("projects"), F.count_if(access.visible_to(F.col("viewer"), F.col("user_id"), F.col("is_private"))).alias("readable"), F.count_if(F.col("is_private").isNull()).alias("unknown")
    )


def owner_maps_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = view(spark, sf_dir, "v_projects").where("user_id = 3").select("project_id", F.col("title").alias("project"))
    return view(spark, sf_dir, "v_maps").join(owned, "project_id").select("map_id", "project_id", "project", "start_date", "end_date")


def project_maps_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.project_maps(view(spark, sf_dir, "v_maps")).select("project_id", "map_id", "start_date", "end_date", "exact_date", "position")


def project_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    readable = view(spark, sf_dir, "v_projects").where(access.visible_to(F.lit(3), F.col("user_id"), F.col("is_private"))).select("project_id")
    return view(spark, sf_dir, "v_features").join(readable, "project_id", "left_semi").groupBy("project_id").agg(F.count(F.lit(1)).alias("features"), F.count("map_id").alias("on_maps"))


def _edited(features: DataFrame) -> DataFrame:
    """Of every fifth feature a changed copy, of every seventh the same, and some new ones."""
    base = features.select("feature_id", "project_id", "map_id", "x", "y", "kind", "line", "r")
    changed = base.where("r % 5 = 0").withColumn("x", F.when(F.col("line") % 2 == 0, F.col("x") + 1).otherwise(F.col("x")))
    new = base.where("r % 7 = 0 AND r % 5 <> 0").withColumn("feature_id", F.md5("feature_id")).withColumn("map_id", F.lit(None).cast("long"))
    return changed.unionByName(new)


def feature_upsert_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = view(spark, sf_dir, "v_features")
    old = features.select("feature_id", "project_id", "map_id", "x", "y", "kind", "line", "r")
    after = access.upsert(old, _edited(features), "feature_id", ["x", "y", "kind"])
    return after.groupBy("action").agg(F.count(F.lit(1)).alias("features"), F.sum("x").alias("sum_x"), F.count("map_id").alias("on_maps"))


def bulk_delete_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = view(spark, sf_dir, "v_features").select("feature_id", "project_id", "r")
    doomed = features.where("r % 3 = 0 AND project_id % 2 = 0").select("feature_id")
    left, gone = access.bulk_delete(features, doomed, "feature_id")
    return left.agg(F.count(F.lit(1)).alias("features")).select(F.lit("left").alias("what"), "features").unionByName(gone.agg(F.count(F.lit(1)).alias("features")).select(F.lit("deleted").alias("what"), "features"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = view(spark, sf_dir, "v_projects").where("user_id = 3").select("project_id")
    count = lambda name: view(spark, sf_dir, name).join(doomed, "project_id", "left_anti").agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("relation"), "rows_left")
    return count("v_projects").unionByName(count("v_maps")).unionByName(count("v_features"))


def orphan_features_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = view(spark, sf_dir, "v_maps").where("NOT exact_date")
    return access.orphans(view(spark, sf_dir, "v_features"), kept, "map_id").groupBy("kind").agg(F.count(F.lit(1)).alias("features"))


def new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = tables(spark, sf_dir, ["events"])["events"].select("user_id").distinct()
    added = subjects.join(view(spark, sf_dir, "v_users"), "user_id", "left_anti")
    return added.select("user_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("username"))


def project_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.col("user_id") == 3
    return view(spark, sf_dir, "v_projects").select(
        "project_id",
        F.when(mine, F.concat(F.col("title"), F.lit(" (new)"))).otherwise(F.col("title")).alias("title"),
        F.when(mine, F.lit(False)).otherwise(F.col("is_private")).alias("is_private"),
        F.when(mine, F.lit("2024-02-01").cast("date")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def valid_map_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables(spark, sf_dir, ["lineitem"])["lineitem"]
    asked = lines.join(view(spark, sf_dir, "v_maps").select(F.col("map_id").alias("l_orderkey"), "project_id", "start_date"), "l_orderkey").select("project_id", "start_date", F.col("l_shipdate").cast("date").alias("end_date"))
    owned = view(spark, sf_dir, "v_projects").select("project_id", "user_id")
    return asked.where("start_date <= end_date").join(owned, "project_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("maps"), F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end"))


def task_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables(spark, sf_dir, ["events"])["events"]
    state = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "FAILURE").when(F.col("event_type") == "click", "PROGRESS").otherwise("PENDING")
    last = access.latest_state(events.select("user_id", "ts", "event_id", "value", state.alias("state")), "user_id", "ts", "event_id")
    return last.select("user_id", "event_id", "state", F.round(access.progress(F.col("state"), F.least("value", F.lit(100.0)), F.lit(100.0)), 2).alias("percent"))


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables(spark, sf_dir, ["lineitem"])["lineitem"]
    radius = F.greatest(F.lit(1), F.least(F.lit(200), F.coalesce(F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("int") * 5), F.lit(20))))
    inside = F.col("l_discount").between(0, 1) & (F.col("l_tax") * 20).between(0, 1)
    box = (F.col("l_quantity") - 10 > 0) & (F.col("l_extendedprice") > 0)
    checked = lines.select(F.when(~inside, "click outside").when(~box, "empty legend box").otherwise("accepted").alias("verdict"), radius.alias("radius"))
    return checked.groupBy("verdict").agg(F.count(F.lit(1)).alias("requests"), F.min("radius").alias("least_radius"), F.max("radius").alias("most_radius"))


SAME = """WITH edits AS (
    SELECT feature_id, map_id, CASE WHEN line % 2 = 0 THEN x + 1 ELSE x END AS x, y, kind FROM v_features WHERE r % 5 = 0
    UNION ALL SELECT md5(feature_id), NULL, x, y, kind FROM v_features WHERE r % 7 = 0 AND r % 5 <> 0),
  both_sides AS (SELECT o.feature_id AS old_id, n.feature_id AS new_id, o.x AS ox, n.x AS nx, o.map_id AS om, n.map_id AS nm,
                   CASE WHEN n.feature_id IS NULL THEN 'kept' WHEN o.feature_id IS NULL THEN 'inserted'
                        WHEN o.x IS NOT DISTINCT FROM n.x AND o.y IS NOT DISTINCT FROM n.y AND o.kind IS NOT DISTINCT FROM n.kind THEN 'unchanged' ELSE 'updated' END AS action
            FROM v_features o FULL OUTER JOIN edits n ON o.feature_id = n.feature_id)
SELECT action, count(*) AS features, sum(CASE WHEN action IN ('inserted', 'updated') THEN nx ELSE ox END) AS sum_x,
       count(CASE WHEN action IN ('inserted', 'updated') THEN nm ELSE om END) AS on_maps FROM both_sides GROUP BY action"""

QUERIES = {
    "project_listing_public": (project_listing_public, "SELECT project_id, title, description, username, created_at, updated_at FROM v_projects LEFT JOIN v_users USING (user_id) WHERE NOT is_private"),
    "user_projects": (user_projects, "SELECT project_id, title, username, is_private, updated_at FROM v_projects LEFT JOIN v_users USING (user_id) WHERE user_id = 3"),
    "project_access_matrix": (
        project_access_matrix,
        "SELECT viewer, count(*) AS projects, count(CASE WHEN user_id = viewer OR is_private IS FALSE THEN 1 END) AS readable, count(CASE WHEN is_private IS NULL THEN 1 END) AS unknown FROM v_projects, (SELECT cast(unnest([0, 3, 7]) AS BIGINT) AS viewer) GROUP BY viewer",
    ),
    "owner_maps_join": (owner_maps_join, "SELECT m.map_id, m.project_id, p.title AS project, m.start_date, m.end_date FROM v_maps m JOIN v_projects p ON p.project_id = m.project_id WHERE p.user_id = 3"),
    "project_maps_ordered": (project_maps_ordered, "SELECT project_id, map_id, start_date, end_date, exact_date, cast(row_number() OVER (PARTITION BY project_id ORDER BY start_date NULLS LAST, map_id NULLS LAST) AS INT) AS position FROM v_maps"),
    "project_features": (project_features, "SELECT project_id, count(*) AS features, count(map_id) AS on_maps FROM v_features WHERE project_id IN (SELECT project_id FROM v_projects WHERE user_id = 3 OR is_private IS FALSE) GROUP BY project_id"),
    "feature_upsert_diff": (feature_upsert_diff, SAME),
    "bulk_delete_survivors": (
        bulk_delete_survivors,
        "SELECT 'left' AS what, count(*) AS features FROM v_features WHERE NOT (r % 3 = 0 AND project_id % 2 = 0) UNION ALL SELECT 'deleted', count(*) FROM v_features WHERE r % 3 = 0 AND project_id % 2 = 0",
    ),
    "cascade_delete": (
        cascade_delete,
        "WITH d AS (SELECT project_id FROM v_projects WHERE user_id = 3) " + " UNION ALL ".join(f"SELECT '{v}' AS relation, count(*) AS rows_left FROM {v} WHERE project_id NOT IN (SELECT project_id FROM d)" for v in ("v_projects", "v_maps", "v_features")),
    ),
    "orphan_features_antijoin": (orphan_features_antijoin, "SELECT kind, count(*) AS features FROM v_features WHERE map_id IS NOT NULL AND map_id NOT IN (SELECT map_id FROM v_maps WHERE NOT exact_date) GROUP BY kind"),
    "new_users": (new_users, "SELECT DISTINCT user_id, 'user-' || cast(user_id AS VARCHAR) AS username FROM {events} WHERE user_id NOT IN (SELECT user_id FROM v_users)"),
    "project_update": (
        project_update,
        "SELECT project_id, CASE WHEN user_id = 3 THEN title || ' (new)' ELSE title END AS title, CASE WHEN user_id = 3 THEN FALSE ELSE is_private END AS is_private, CASE WHEN user_id = 3 THEN DATE '2024-02-01' ELSE updated_at END AS updated_at FROM v_projects",
    ),
    "valid_map_inserts": (
        valid_map_inserts,
        "SELECT user_id, count(*) AS maps, min(start_date) AS first_start, max(cast(l_shipdate AS DATE)) AS last_end FROM {lineitem} JOIN v_maps ON map_id = l_orderkey JOIN v_projects USING (project_id) WHERE start_date <= cast(l_shipdate AS DATE) GROUP BY user_id",
    ),
    "task_latest_state": (
        task_latest_state,
        """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {events})
           SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' WHEN 'click' THEN 'PROGRESS' ELSE 'PENDING' END AS state,
                  CASE event_type WHEN 'purchase' THEN 100.0::DOUBLE WHEN 'click' THEN round(least(value, 100.0) / 100.0 * 100, 2) ELSE 0.0::DOUBLE END AS percent FROM l WHERE n = 1""",
    ),
    "request_validation": (
        request_validation,
        """WITH c AS (SELECT CASE WHEN NOT (l_discount BETWEEN 0 AND 1 AND l_tax * 20 BETWEEN 0 AND 1) THEN 'click outside' WHEN NOT (l_quantity - 10 > 0 AND l_extendedprice > 0) THEN 'empty legend box' ELSE 'accepted' END AS verdict,
                  greatest(1, least(200, coalesce(CASE WHEN l_quantity > 5 THEN cast(l_quantity AS INT) * 5 END, 20))) AS radius FROM {lineitem})
           SELECT verdict, count(*) AS requests, min(radius) AS least_radius, max(radius) AS most_radius FROM c GROUP BY verdict""",
    ),
}
