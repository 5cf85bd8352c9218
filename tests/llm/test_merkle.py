"""The Merkle manifest against plain code: lone leaves, short runs, nulls, repeated rows, empty tables."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from maploom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, id string, pos string, n long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def climb(nodes, fanout=3):
    """nodes: [(hash, members)] to the last one, with what stood beside each member at every level."""
    steps = {m: [] for _, own in nodes for m in own}
    while len(nodes) > 1:
        up = []
        for k in range(0, len(nodes), fanout):
            run = nodes[k : k + fanout]
            for j, (_, own) in enumerate(run):
                for m in own:
                    steps[m].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1 :])))
            up.append((h(*[x for x, _ in run]), [m for _, own in run for m in own]))
        nodes = up
    return nodes[0][0], steps


def plain(rows):
    by_source = {}
    for k, row in enumerate(rows):
        by_source.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), k))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    sub = {s: climb([(x[2], [x[3]]) for x in sorted(by_source[s])]) for s in order}
    root, upper = climb([(sub[s][0], [s]) for s in order])
    out = []
    for s in order:
        for _, _, own, k in by_source[s]:
            path = sub[s][1][k] + upper[s]
            row, acc = rows[k], own
            if row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None:
                acc = leaf(row, row[1].replace("\n", ""))
            for before, behind in path:
                acc = h(before, acc, behind)
            out.append((row[0], own, sub[s][0], root, h(*[b + c for b, c in path]), acc, acc == root))
    return sorted(out, key=str)


def rows_of(kind):
    rng = random.Random(3)
    row = lambda k, s: (k, rng.choice([None, "", "a\nb", "é\n\n", "plain"]) if k is None or k % 5 == 0 else f"text {k}\n", rng.choice(["en", None]), s, rng.choice([None, 7]), 1, "x", "y", 2)
    sizes = {"many": {"a": 28, None: 5, "": 1, "ä": 1, "z": 9, "hot": 200}, "one source": {"s": 10}, "one row": {"s": 1}, "lone leaves": {"a": 1, "b": 1, "c": 1, "d": 1}, "empty": {}}[kind]
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append(row(k, source))
            k += 1
    if kind == "many":
        rows += [rows[3]] * 4 + [row(None, "a"), row(None, "a"), (rows[1][0], "other", *rows[1][2:])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["many", "one source", "one row", "lone leaves", "empty"])
def test_query_equals_plain_code(spark, tmp_path, kind):
    rows = rows_of(kind)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    # rows that repeat each other swap places freely: their proofs go with the places
    assert sorted((tuple(r) for r in got.collect()), key=str) == (plain(rows) if rows else [])


def test_other_fanouts_and_kept_columns(spark):
    rows = spark.range(23).select(F.lit("s").alias("source"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"), (F.col("id") * 2).alias("twice"))
    for fanout in (2, 5):
        root, steps = climb([(h(str(k)), [k]) for k in range(23)], fanout)
        got = merkle.manifest(rows, fanout).collect()
        assert {r.id: [tuple(s) for s in r.path] for r in got} == steps
        assert all(r.root == root == r.subroot and r.twice == 2 * r.id for r in got)
    with pytest.raises(ValueError):
        merkle.manifest(rows, 1)
