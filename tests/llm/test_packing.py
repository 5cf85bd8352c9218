import random
from zlib import crc32

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from maploom.llm import packing  # noqa: E402
from maploom.llm.word_bpe import WordBpe  # noqa: E402

PATH = P.path("word_bpe_49k.json")
HARD = ["", "  ", "Don't THEY'RE <|endoftext|> x", "ΑΣ ΣΑΣ́ é é İstanbul ẞ ß", "a b c\x1cd 12½³ 中文字 \U0001f600!!! aaaaaaaaaaaaa aaaa", "ﬁ ǅ ŉ 'S 'Ll ''s", "...---...   hello_world\nNEW", "x" * 3000]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATH), WordBpe(PATH)
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice(["the ", "Q", "é", "'s", "1", " ", "\n", "!", "ing", "中", "\xa0"]) for _ in range(rng.randrange(40))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([6, 5, 4, 3, 2]), 10).tolist() == [0, 1, 0, 1, 1]
    sizes = np.random.default_rng(1).integers(1, 4097, 3000)
    filled = np.bincount(packing.best_fit(sizes, 4096), weights=sizes)
    assert filled.max() <= 4096 and filled.sum() == sizes.sum()


def no_two_fit(fills, capacity):
    fills = sorted(fills)
    return len(fills) < 2 or fills[0] + fills[1] > capacity


@pytest.mark.parametrize("block", [100_000, 7])
def test_sequences_hold_every_piece_once(spark, block):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.choice([0, 1, 5, 50, 64, 200]))) for i in range(300)] + [(300, None), (None, "x"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, piece string, fill int").repartition(20)
    found = packing.pack(docs, PATH, capacity=64, block=block).collect()
    own = WordBpe(PATH)
    want = []
    for i, t in rows:
        ids = own.encode([t])[0] + np.array([1], "<u4").tobytes()
        want += [(i, n, a, len(ids[4 * a : 4 * a + 256]) // 4, crc32(ids[4 * a : 4 * a + 256])) for n, a in enumerate(range(0, len(ids) // 4, 64))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(want, key=str)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(x[3] for x in want) // 64)
    assert len(bins) <= 1.05 * least + 1
    assert no_two_fit([sum(n for _, n in pieces) for pieces in bins.values()], 64)


def test_small_blocks_come_close_to_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(32)
    for block in (20, 7):
        found = packing.pack(docs, PATH, block=block).groupBy("sequence_id").sum("length").collect()
        fills = [r[1] for r in found]
        assert no_two_fit(fills, 4096) and len(fills) <= 1.02 * -(-sum(fills) // 4096) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
