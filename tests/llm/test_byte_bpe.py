import base64
import random
from hashlib import sha256

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from maploom.llm import byte_bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
PARTS = ["'", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", " ", "  ", "\n", "\t", "a", "S", "re", "é", "1", "½", "!", "?", "<|", "\xa0", "　", "中", "😀", "\x1c", "́", "٣", "ß", "'r", "l", "''"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30]))) for _ in range(n)]


def test_ids_equal_the_library_and_decode(library):
    own = byte_bpe.ByteBpe(PATH)
    texts = [*fuzz(1, 8000), "x" * 5000, " " * 3000, "ab" * 4000 + "'s", "\n" * 2000 + "a", "<|endoftext|>"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text)
        data, begin = own.decode(np.array(ids, np.int64))
        assert data == text.encode()
        assert [data[a:b] for a, b in zip(begin, [*begin[1:], len(data)][: len(ids)], strict=True)] == [library.decode_single_token_bytes(i) for i in ids]


def test_every_code_point_has_the_class_of_the_pattern(library):
    own = byte_bpe.ByteBpe(PATH)
    texts = ["a ".join(chr(c) for c in range(a, min(a + 256, 0x110000)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 256)]
    assert own.encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_query_columns(spark, library):
    rows = [*enumerate(fuzz(2, 200)), (None, "null id"), (7, None), (8, ""), (8, "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string").repartition(3)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.digests(df, PATH).collect()), key=str) == sorted(want, key=str)
    assert {tuple(r.ids) for r in byte_bpe.encoded(df, PATH).collect()} == {tuple(library.encode_ordinary(t or "")) for _, t in rows}


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
