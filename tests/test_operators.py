import math
import random

from pyspark.sql import functions as F

from maploom.functions import colour, geometry
from maploom.operators import access, documents, gazetteer, georeference, history, timeline


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_visibility_of_unknown_flags(spark):
    rows = [(1, True), (2, True), (2, False), (2, None), (None, False), (None, None)]
    df = spark.createDataFrame(rows, "owner long, private boolean")
    seen = df.select(access.visible_to(F.lit(1), F.col("owner"), F.col("private")).alias("v")).collect()
    assert [r.v for r in seen] == [True, False, True, False, True, False]


def test_upsert_is_null_safe(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id long, v string")
    new = spark.createDataFrame([(1, None), (2, "c"), (4, None)], "id long, v string")
    assert sorted(map(tuple, access.upsert(old, new, "id", ["v"]).collect())) == [(1, None, "unchanged"), (2, "c", "updated"), (3, "b", "kept"), (4, None, "inserted")]


def test_dates_roll_over(spark):
    got = one(spark, a=timeline.iso_rollover(F.lit("1783-02-30")), b=timeline.iso_year(F.lit("1783-2-30")))
    assert str(got.a) == "1783-03-02" and got.b is None


def test_lanes_do_not_overlap(spark):
    rng = random.Random(1)
    rows = [(p, k, f"{y}-01-01", f"{y + rng.randrange(9)}-06-01") for p in range(5) for k, y in enumerate(rng.choices(range(1700, 1740), k=40))]
    maps = spark.createDataFrame(rows, "project_id long, map_id long, s string, e string").select("project_id", "map_id", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
    lanes = {}
    for r in timeline.lanes(maps).collect():
        lanes.setdefault((r.project_id, r.lane), []).append((r.start_year, r.end_year))
    assert sum(map(len, lanes.values())) == 200
    for periods in lanes.values():
        periods.sort()
        assert all(a[1] < b[0] for a, b in zip(periods, periods[1:], strict=False))


def test_mercator_inverts(spark):
    m = geometry.mercator(F.lit(-71.2), F.lit(46.8))
    got = one(spark, p=geometry.lon_lat(m["x"], m["y"])).p
    assert math.isclose(got.x, -71.2) and math.isclose(got.y, 46.8)


def test_ciede2000_of_published_pairs(spark):
    # fixed values: pairs of the data that the formula's authors published
    rows = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492), (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644)]
    df = spark.createDataFrame(rows, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    for r in colour.with_ciede2000(df, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "d").collect():
        assert abs(r.d - r.want) < 1e-4


def test_affine_fit_recovers_a_plane(spark):
    rng = random.Random(2)
    rows = [("g", x, y, 2 * x - y + 7, 0.5 * x + 3 * y - 1) for x, y in ((rng.random(), rng.random()) for _ in range(9))] + [("line", float(k), float(k), 1.0, 1.0) for k in range(5)]
    fits = georeference.affine_fit(spark.createDataFrame(rows, "k string, x double, y double, gx double, gy double"), "k").collect()
    assert [f.k for f in fits] == ["g"]
    assert all(abs(a - b) < 1e-9 for a, b in zip((fits[0][c] for c in "abcdef"), (2, -1, 7, 0.5, 3, -1), strict=True)) and fits[0].rmse < 1e-6


def test_snapping_equals_brute_force(spark):
    rng = random.Random(3)
    points = [(k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(200)]
    lines = [(k, *(rng.uniform(-50, 50) for _ in range(4))) for k in range(12)]
    got = georeference.snap_to_lines(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(lines, "sid long, x1 double, y1 double, x2 double, y2 double"), 4.0, "id")
    for r in got.collect():
        _, x, y = points[r.id]
        places = []
        for _, x1, y1, x2, y2 in lines:
            t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            places.append((math.hypot(x1 + t * (x2 - x1) - x, y1 + t * (y2 - y1) - y), x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
        d, nx, ny = min(places)
        assert r.moved == (d <= 4) and math.isclose(r.x, nx if r.moved else x, abs_tol=1e-9) and math.isclose(r.y, ny if r.moved else y, abs_tol=1e-9)


def test_longest_names_win(spark):
    docs = spark.createDataFrame([(1, "Trois-Rivières et Québec City, Québec"), (2, ""), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([("quebec",), ("quebec city",), ("trois-rivieres",)], "name string")
    assert sorted(map(tuple, gazetteer.longest_matches(docs, names).collect())) == [(1, 0, 1, "trois-rivieres"), (1, 2, 2, "quebec city"), (1, 4, 1, "quebec")]


def test_keys_change_case_at_every_depth(spark):
    got = one(spark, a=documents.camel_keys(F.lit('{"a_b":[{"c_d1":1}],"e_1":null}')), b=documents.snake_keys(F.lit('{"colorRGB":{"xY":"aB"}}')))
    assert got.a == '{"aB":[{"cD1":1}],"e_1":null}' and got.b == '{"color_r_g_b":{"x_y":"aB"}}'


def test_stream_of_edits_ends_where_the_fold_does(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(6), f"2024-01-{1 + k // 100:02d} 00:00:00", k, rng.choice(["commit", "commit", "undo", "redo", "reset"]), float(rng.randrange(5))) for k in range(400)]
    log = spark.createDataFrame(rows, "user_id long, t string, event_id long, action string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "event_id", "action", "value")
    for day in range(4):
        log.where(f"event_id >= {day * 100} AND event_id < {day * 100 + 100}").coalesce(1).write.parquet(f"{tmp_path}/in/{day}")
    source = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = history.stream(source).writeStream.outputMode("update").format("memory").queryName("edits").start()
    query.processAllAvailable()
    query.stop()
    last = {r.user_id: tuple(r) for r in sorted(spark.table("edits").collect(), key=lambda r: r.changes)}
    assert last == {r.user_id: tuple(r) for r in history.fold(log).collect()}


def test_ticks_lie_apart_by_percentages_in_doubles(spark):
    """Days 266 and 308 of 420 are a tenth apart, but 63.33 and 73.33 percent are a little less than 10."""
    rows = [(1, 266), (1, 308), (1, 350), (1, 400)]
    days = spark.createDataFrame(rows, "g long, day int").selectExpr("g", "date_add(DATE'1998-01-01', day) AS date", "DATE'1998-01-01' AS first_day", "420 AS span")
    found = {r.day: r.lane for r in timeline.tick_lanes(days, "g").where("is_exact").collect()}
    want, percent, lane = {}, -100.0, 0
    for _, day in rows:
        at = day * 100.0 / 420
        lane = 1 - lane if at - percent < 10 else 0
        want[day], percent = lane, at
    assert found == want and found[308] == 1
