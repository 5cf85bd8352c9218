import hashlib

import duckdb
import pandas as pd
import pytest

from maploom.llm import exact_dedup

ROWS = [(1, "Same Text"), (2, "same text"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "same text "), (8, "SAME TEXT"), (8, "SAME TEXT"), (None, "same text"), (9, "x" * 300_000), (10, "X" * 300_000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, 0, "k", "s") for i, t in rows], "doc_id long, text string, salt int, keep_id string, digest string").repartition(3)


def expected(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        keep = max((x for x in groups[lower(t)] if x is not None), default=None)
        out.append((i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_edges_match_a_plain_grouping(spark):
    assert got(exact_dedup.exact_duplicates(frame(spark))) == expected(ROWS)


@pytest.mark.parametrize("bits", [1, 0])
def test_colliding_digests_keep_texts_apart(spark, bits):
    weak = lambda t: exact_dedup.F.substring(exact_dedup.sha256(t), 1, bits)
    assert [x[:4] for x in got(exact_dedup.exact_duplicates(frame(spark), digest=weak).drop("text_digest"))] == sorted((x[:4] for x in expected(ROWS)), key=str)


def test_dropping_keeps_all_columns(spark):
    out = exact_dedup.drop_exact_duplicates(frame(spark))
    assert out.columns == ["doc_id", "text", "salt", "keep_id", "digest"]
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 6, 7, 8, 10]  # of two equal rows one


def test_empty_table(spark):
    assert got(exact_dedup.exact_duplicates(frame(spark, []))) == []


def test_sql_agrees(spark):
    rows = [(i, t) for i, t in ROWS[:8]]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.execute(exact_dedup.OP1_SQL).fetchall(), key=str) == got(exact_dedup.exact_duplicates(frame(spark, rows)))
