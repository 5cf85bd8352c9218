"""Domain tables of users, projects, maps, features, pixels and control points over the given tables.

Each view is SQL that Spark and DuckDB read alike; {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_users": "SELECT cast(n_nationkey AS bigint) AS user_id, n_name AS username FROM {nation}",
    "v_projects": """
        SELECT c_custkey AS project_id, cast(c_nationkey AS bigint) AS user_id, c_name AS title, c_mktsegment AS description,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal < 0 END AS is_private, o.created_at, o.updated_at
        FROM {customer} LEFT JOIN (SELECT o_custkey, cast(min(o_orderdate) AS date) AS created_at, cast(max(o_orderdate) AS date) AS updated_at FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey""",
    "v_maps": """
        SELECT o_orderkey AS map_id, o_custkey AS project_id, cast(o_orderdate AS date) AS start_date,
               cast(greatest(o_orderdate, coalesce(s.last, o_orderdate)) AS date) AS end_date, o_orderstatus = 'F' AS exact_date, o_orderpriority AS title
        FROM {orders} LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM {lineitem} GROUP BY l_orderkey) s ON l_orderkey = o_orderkey""",
    # no column is a key of lineitem, all together are
    "v_features": """
        SELECT md5(concat_ws('|', cast(l_orderkey AS string), cast(l_partkey AS string), cast(l_suppkey AS string), cast(l_linenumber AS string), cast(cast(l_quantity AS bigint) AS string),
                             cast(cast(round(l_extendedprice * 100) AS bigint) AS string), cast(cast(round(l_discount * 100) AS bigint) AS string), cast(cast(round(l_tax * 100) AS bigint) AS string), cast(cast(l_shipdate AS date) AS string))) AS feature_id,
               o_custkey AS project_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS map_id, l_orderkey AS source_id, l_suppkey AS image_id,
               cast(l_partkey AS double) AS x, l_quantity * 40 AS y, l_returnflag AS kind, l_linestatus AS state, l_linenumber AS line, l_extendedprice AS price,
               cast(l_partkey % 256 AS int) AS r, cast((l_suppkey * 7) % 256 AS int) AS g, cast((cast(l_quantity AS int) * 5) % 256 AS int) AS b
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey""",
    "v_pixels": """
        SELECT l_suppkey AS image_id, cast(l_partkey AS bigint) AS px, cast(l_quantity AS bigint) AS py, cast(l_partkey % 256 AS int) AS r, cast((l_suppkey * 7) % 256 AS int) AS g, cast((cast(l_quantity AS int) * 5) % 256 AS int) AS b
        FROM {lineitem}""",
    "v_control": """
        SELECT l_suppkey AS image_id, cast(l_partkey AS double) AS x, l_quantity * 40 AS y,
               l_partkey * 3.0 + l_quantity * 10 + l_linenumber AS gx, l_quantity * 120.0 - l_partkey * 0.5 - l_linenumber AS gy
        FROM {lineitem}""",
    "v_words": r"SELECT doc_id, lang, text FROM {documents}",
}


def tables(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _with_views(sql: str) -> str:
    """Puts the views that sql names before it, as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    own = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {own}, {rest[15:]}"
    return f"WITH {own}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {own} {rest}"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = _with_views(sql)
    return spark.sql(text, **tables(spark, sf_dir, sorted(set(re.findall(r"\{([a-z_]+)\}", text)))))


def duckdb_sql(sql: str) -> str:
    return re.sub(r"\{([a-z_]+)\}", r"\1", _with_views(sql))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
