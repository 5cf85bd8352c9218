"""Queries over texts and documents, each with SQL of the same result where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.operators import documents, gazetteer
from maploom.plans.views import tables, view


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, ["documents"])["documents"]
    return docs.select("doc_id", F.size(gazetteer.tokens(F.col("text"))).alias("tokens"))


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded names of one to four words, from how benchmark items begin."""
    bench = tables(spark, sf_dir, ["benchmark"])["benchmark"]
    words = bench.select(gazetteer.folded_words(gazetteer.tokens(F.col("text"))).alias("w"))
    names = words.select("w", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n")).where(F.size("w") >= F.col("n"))
    return names.select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("name"), "n").where("n > 1 OR length(name) > 5").select("name").distinct()


def gazetteer_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, ["documents"])["documents"]
    found = gazetteer.longest_matches(docs, _gazetteer(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("names"), F.sum("words").cast("long").alias("words"), F.min("place").alias("first_place"))


def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names, and pieces of words, that are no part name, with the part names that contain them."""
    t = tables(spark, sf_dir, ["part"])["part"]
    words = t.select(F.explode(F.split(F.lower("p_name"), " ")).alias("name"))
    pieces = words.select(F.explode(F.array(F.substring("name", 2, 4), F.substring("name", 2, 2), F.concat(F.substring("name", -2, 2), F.lit(" ")))).alias("name"))
    names = words.unionByName(pieces).unionByName(t.select(F.lower("p_name").alias("name"))).distinct()
    places = t.groupBy(F.lower("p_name").alias("name")).agg(F.max("p_size").alias("population"))
    return gazetteer.containing(names, places).select("name", "candidate", "rank")


def city_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A black point feature for each asked name; it shows where a candidate was found, and lies at 0, 0 where not."""
    t = tables(spark, sf_dir, ["part", "nation"])
    places = t["part"].select(F.col("p_name").alias("name"), F.col("p_partkey").alias("place_id"), F.col("p_size").alias("population"), (F.col("p_partkey") % 90).cast("double").alias("lat"), (F.col("p_partkey") % 180).cast("double").alias("lon"))
    asked = t["nation"].select(F.col("n_name").alias("name")).unionByName(t["part"].where("p_partkey % 7 = 0").select(F.col("p_name").alias("name"))).distinct()
    found = gazetteer.best_candidates(asked, places)
    return found.select("name", F.col("found").alias("show"), documents.feature(F.col("lon"), F.col("lat"), F.struct(F.lit("#000000").alias("color"))).alias("f")).select("name", "show", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.color")


def gazetteer_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, ["part", "nation"])
    places = t["part"].select(F.col("p_name").alias("name"), (F.col("p_size") * 1000).cast("long").alias("population"), (F.col("p_partkey") % 90).cast("double").alias("lat"), (F.col("p_partkey") % 180).cast("double").alias("lon"), F.col("p_partkey").alias("place_id"))
    names = t["part"].select(F.col("p_name").alias("name")).distinct().unionByName(t["nation"].select(F.col("n_name").alias("name")))
    return gazetteer.best_candidates(names, places)


def sanitised_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir, ["part"])["part"]
    raw = F.concat(F.lit("  "), F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat_ws("/", "p_type", "p_brand")))
    return gazetteer.numbered(p.select("p_partkey", gazetteer.safe_name(raw).alias("name")), "name", "p_partkey")


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, ["documents"])["documents"]
    return docs.select("doc_id", F.explode(F.array_distinct(gazetteer.folded_words(gazetteer.tokens(F.col("text"))))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("documents"))


def json_property_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables(spark, sf_dir, ["events"])["events"]
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.groupBy("event_type").agg(F.count(k).alias("with_k"), F.sum(k).alias("sum_k"), F.count_if(k.isNull()).alias("without"))


def collection_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as GeoJSON text, read back and taken apart."""
    schema = "type string, features array<struct<type: string, geometry: struct<type: string, coordinates: array<double>>, properties: struct<line: int, kind: string>>>"
    written = view(spark, sf_dir, "v_features").select("project_id", F.to_json(documents.collection(documents.feature(F.col("x"), F.col("y"), F.struct("line", "kind")))).alias("data"))
    each = written.select("project_id", F.explode(F.from_json("data", schema)["features"]).alias("f"))
    return each.groupBy(F.col("f.properties.kind").alias("kind"), F.col("f.geometry.type").alias("type")).agg(F.count(F.lit(1)).alias("features"), F.sum(F.col("f.geometry.coordinates")[0]).alias("sum_x"), F.max("f.properties.line").alias("last_line"))


def latest_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables(spark, sf_dir, ["events"])["events"]
    edits = events.select((F.col("event_id") % 500).alias("layer"), "ts", "event_id", "event_type", "value")
    return documents.latest(edits, "layer", "ts", "event_id").select("layer", "event_id", "event_type", "value")


def property_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted properties win over the base's, also where they are unknown."""
    f = view(spark, sf_dir, "v_features")
    base = F.create_map(F.lit("kind"), F.col("kind"), F.lit("state"), F.col("state"))
    extracted = F.create_map(F.lit("kind"), F.when(F.col("line") > 3, F.lit("X")), F.lit("line"), F.col("line").cast("string"))
    keep = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extracted), k))
    merged = f.select(F.map_concat(keep, extracted).alias("p"))
    return merged.groupBy(F.element_at("p", "kind").alias("kind"), F.element_at("p", "state").alias("state")).agg(F.count(F.lit(1)).alias("features"), F.sum(F.element_at("p", "line").cast("int")).alias("lines"))


def image_data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir, ["supplier"])["supplier"]
    return s.select("s_suppkey", documents.data_uri(F.encode("s_name", "UTF-8"), F.when(F.col("s_suppkey") % 2 == 0, "image/jpeg")).alias("uri"))


def key_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir, ["part"])["part"]
    text = F.to_json(F.struct(F.col("p_partkey").alias("map_element_type"), F.struct(F.col("p_size").alias("colorRGB"), F.array(F.struct(F.col("p_brand").alias("start_date2"))).alias("fill_opacity")).alias("nested_part")))
    camel = p.select("p_partkey", documents.camel_keys(text).alias("camel"))
    return camel.select("p_partkey", "camel", documents.snake_keys(F.col("camel")).alias("snake"))


def snapshot_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_features").withColumns({c: F.col(c).cast("long") for c in "xy"})
    return documents.signature(rows, "project_id", "feature_id", "x", "y", "kind")


TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-'']*[\p{L}\p{N}_])?"
FOLD = "replace(strip_accents(lower(trim({0}))), 'ß', 'ss')"
WORDS = f"list_transform(regexp_extract_all(text, '{TOKEN}'), lambda t: {FOLD.format('t')})"

QUERIES = {
    "token_counts": (token_counts, f"SELECT doc_id, cast(len(regexp_extract_all(text, '{TOKEN}')) AS INT) AS tokens FROM {{documents}}"),
    "gazetteer_longest_match": (
        gazetteer_longest_match,
        f"""WITH b AS (SELECT {WORDS} AS w FROM {{benchmark}}), n AS (SELECT w, unnest([1, 2, 3, 4]) AS n FROM b), g AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS name FROM n WHERE len(w) >= n AND (n > 1 OR length(w[1]) > 5)),
            d AS (SELECT doc_id, {WORDS} AS w FROM {{documents}}),
            i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), s AS (SELECT *, unnest([1, 2, 3, 4]) AS n FROM i),
            h AS (SELECT doc_id, i - 1 AS place, n AS words FROM s WHERE i + n - 1 <= len(w) AND array_to_string(w[i:i + n - 1], ' ') IN (SELECT name FROM g)),
            l AS (SELECT doc_id, list(struct_pack(p := place, n := words) ORDER BY place, words DESC) AS hs FROM h GROUP BY doc_id),
            f AS (SELECT doc_id, list_reduce(hs, lambda a, x: CASE WHEN x.p >= a.free THEN struct_pack(free := x.p + x.n, names := a.names + 1, words := a.words + x.n, first := coalesce(a.first, x.p)) ELSE a END, struct_pack(free := 0::BIGINT, names := 0::BIGINT, words := 0::BIGINT, first := NULL::BIGINT)) AS r FROM l)
            SELECT doc_id, r.names AS names, r.words AS words, cast(r.first AS INT) AS first_place FROM f""",
    ),
    "fuzzy_candidates": (
        fuzzy_candidates,
        """WITH w AS (SELECT lower(p_name) AS p, max(p_size) AS size FROM {part} GROUP BY 1), u AS (SELECT DISTINCT unnest(string_split(p, ' ')) AS x FROM w),
           q AS (SELECT x AS name FROM u UNION SELECT substr(x, 2, 4) FROM u UNION SELECT substr(x, 2, 2) FROM u UNION SELECT right(x, 2) || ' ' FROM u)
           SELECT name, p AS candidate, cast(row_number() OVER (PARTITION BY name ORDER BY size DESC, p) AS INT) AS rank FROM q JOIN w ON contains(p, name) WHERE name <> '' AND name NOT IN (SELECT p FROM w) QUALIFY row_number() OVER (PARTITION BY name ORDER BY size DESC, p) <= 10""",
    ),
    "city_features": (
        city_features,
        """WITH n AS (SELECT n_name AS name FROM {nation} UNION SELECT p_name FROM {part} WHERE p_partkey % 7 = 0), c AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS k FROM {part})
           SELECT name, p_name IS NOT NULL AS show, coalesce(p_partkey % 180, 0)::DOUBLE AS lon, coalesce(p_partkey % 90, 0)::DOUBLE AS lat, '#000000' AS color FROM n LEFT JOIN c ON p_name = name AND k = 1""",
    ),
    "gazetteer_best_candidate": (
        gazetteer_best_candidate,
        """WITH n AS (SELECT DISTINCT p_name AS name FROM {part} UNION ALL SELECT n_name FROM {nation}), c AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS k FROM {part})
           SELECT name, p_name IS NOT NULL AS found, coalesce(p_size * 1000, 0)::BIGINT AS population, coalesce(p_partkey % 90, 0)::DOUBLE AS lat, coalesce(p_partkey % 180, 0)::DOUBLE AS lon FROM n LEFT JOIN c ON p_name = name AND k = 1""",
    ),
    "sanitised_unique_names": (
        sanitised_unique_names,
        """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'unnamed' ELSE replace(p_type || '/' || p_brand, '/', '-') END AS name FROM {part}), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS k FROM s)
           SELECT p_partkey, CASE WHEN k > 1 THEN name || '_' || k ELSE name END AS name FROM n""",
    ),
    "folded_names": (folded_names, f"SELECT name, count(*) AS documents FROM (SELECT doc_id, unnest(list_distinct({WORDS})) AS name FROM {{documents}}) GROUP BY name"),
    "json_property_extract": (
        json_property_extract,
        "WITH k AS (SELECT event_type, try_cast(props ->> '$.k' AS INT) AS k FROM {events}) SELECT event_type, count(k) AS with_k, cast(sum(k) AS BIGINT) AS sum_k, count(*) - count(k) AS without FROM k GROUP BY event_type",
    ),
    "collection_explode": (collection_explode, "SELECT kind, 'Point' AS type, count(*) AS features, sum(x) AS sum_x, max(line) AS last_line FROM v_features GROUP BY kind"),
    "latest_wins_merge": (
        latest_wins_merge,
        "SELECT layer, event_id, event_type, value FROM (SELECT event_id % 500 AS layer, *, row_number() OVER (PARTITION BY event_id % 500 ORDER BY ts DESC, event_id DESC) AS k FROM {events}) WHERE k = 1",
    ),
    "property_merge": (property_merge, "SELECT CASE WHEN line > 3 THEN 'X' END AS kind, state, count(*) AS features, cast(sum(line) AS BIGINT) AS lines FROM v_features GROUP BY ALL"),
    "image_data_uris": (image_data_uris, "SELECT s_suppkey, 'data:' || CASE WHEN s_suppkey % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END || ';base64,' || base64(encode(s_name)) AS uri FROM {supplier}"),
    "key_case": (
        key_case,
        """SELECT p_partkey, '{"mapElementType":' || p_partkey || ',"nestedPart":{"colorRGB":' || p_size || ',"fillOpacity":[{"startDate2":"' || p_brand || '"}]}}' AS camel,
                  '{"map_element_type":' || p_partkey || ',"nested_part":{"color_r_g_b":' || p_size || ',"fill_opacity":[{"start_date2":"' || p_brand || '"}]}}' AS snake FROM {part}""",
    ),
    "snapshot_signature": (
        snapshot_signature,
        """WITH m AS (SELECT project_id, md5(concat_ws('|', feature_id, cast(x AS BIGINT), cast(y AS BIGINT), kind)) AS m FROM v_features)
           SELECT project_id, count(*) AS rows, cast(sum(cast('0x' || substr(m, 1, 8) AS BIGINT)) AS BIGINT) AS low, cast(sum(cast('0x' || substr(m, 9, 8) AS BIGINT)) AS BIGINT) AS high FROM m GROUP BY project_id""",
    ),
}
