import random
from hashlib import sha256

import numpy as np
import pytest

from maploom.llm import repeats


def brute(docs, length=50):
    order = lambda i: repeats.LAST if i is None else i
    first, out = {}, []
    for i, t in sorted(docs, key=lambda x: order(x[0])):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], order(i))
    for i, t in docs:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < order(i):
                covered[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if covered[k] and not (k and covered[k - 1]))
        out.append((i, len(b), sum(covered), spans, sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([10, 49, 50, 51, 60, 120, 300]))) for _ in range(30)]
    piece = lambda: rng.choice(passages)[rng.choice([0, 0, 5]) :] if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(rng.choice([1, 30, 80])))
    docs = [(i, "".join(piece() for _ in range(rng.choice([0, 1, 2, 5, 9])))) for i in range(150)]
    docs += [(1000 + i, "a" * rng.choice([10, 49, 50, 51, 200, 3000])) for i in range(12)]
    docs += [(2000, None), (None, passages[5] * 2), (7, passages[6] * 3), (7, passages[6] * 3), (7, passages[7] * 2), (2001, "ab" * 600_000 + passages[8])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, id string, h int").repartition(5)
    assert sorted(map(tuple, repeats.repeated_spans(df).drop("spans").collect()), key=str) == brute(docs)


def test_small_batches_equal_brute_force(spark):
    docs = corpus(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, repeats.repeated_spans(df).drop("spans").collect()), key=str) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suffix_ranks_order_and_part_suffixes():
    rng = np.random.default_rng(1)
    for length in (16, 33, 50, 64):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        data[200:300] = data[:100]
        rank = repeats.suffix_ranks(data, length)
        strings = [data[k : k + length].tobytes() for k in range(len(data) - length + 1)]
        names = sorted(set(strings))
        assert rank.tolist() == [names.index(x) for x in strings]


def test_small_blocks_and_many_rows_of_one_id(spark):
    docs = corpus(4)
    rng = random.Random(6)
    shared = "".join(rng.choice("abcd ") for _ in range(80))
    docs += [(None, f"{shared}{i}" + "x" * (i % 70)) for i in range(4000)] + [(3000, shared + " again")] * 1000 + [(-1, "first " + shared)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, repeats.repeated_spans(df, block_rows=3).drop("spans").collect()), key=str) == brute(docs)


def test_empty_table(spark):
    assert repeats.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
