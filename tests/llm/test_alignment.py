"""Alignment of tokenizers against plain code over small texts."""

import hashlib
import json
import random
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from maploom.llm import alignment  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "hello  world\n\nfoo", "a▁b", "<0x0A> </s> <|endoftext|> <unk>", "日本語テキスト and more", "x" * 3000, "\x00\x01", "don't stop 12345 ééé", "Zürich über Ähre",
    "  lead and trail  ", "🙂🙃 emoji", "\t\ttabs\r\nline", "Ω≈ç√∫˜µ≤≥÷", "hello  world\n\nfoo", "aaaa bbbb " * 50,
]


def plain(texts):
    """Pairs by sets of ends, one document after another."""
    one, two = alignment.side(A), alignment.side(B)
    token = lambda s, k: s.bytes[s.offsets[k] : s.offsets[k] + s.lengths[k]].tobytes()
    docs, held = [], Counter()
    for text in texts:
        a, b = (one.ids([text])[0], two.ids([text])[0]) if text else ([], [])
        if any(b"".join(token(s, k) for k in x) != (" " + (text or "")).encode() for s, x in ((one, a), (two, b))):
            a, b = [], []
        cut = []
        for s, x in ((one, a), (two, b)):
            at, ends = 0, []
            for k in x:
                at += len(token(s, k))
                ends.append(at)
            cut.append(ends)
        common = sorted(set(cut[0]) & set(cut[1]))
        groups = [([k for k, e in zip(a, cut[0]) if lo < e <= hi], [k for k, e in zip(b, cut[1]) if lo < e <= hi]) for lo, hi in zip([0, *common], common)]
        links = [(p, q) for x, y in groups for p in x for q in y]
        held.update(set(links))
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    return [(na, nb, g, len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), d) for na, nb, g, links, d in docs]


def found(spark, texts):
    rows = alignment.link_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), A, B).collect()
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_statistics_equal_plain_code(spark):
    rng = random.Random(5)
    words = [w for t in TEXTS if t for w in t.split()] + ["alignment", "of", "tokens", "naïve", "1,000.50"]
    texts = TEXTS + [rng.choice(["", " "]).join(rng.choice(words) + rng.choice([" ", "", "\n", ", "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    assert found(spark, texts) == plain(texts)


def test_crowded_groups_link_distinct_ids(spark, monkeypatch):
    block = alignment.Block(np.array([5, 5, 6]), np.array([1, 2, 1, 1]), np.array([3]), np.array([4]), np.array([0]), np.array([0]), np.array([0]), np.array([3]), np.array([4]))
    whole = alignment.linked(block, 100)
    monkeypatch.setattr(alignment, "CROWDED", 1)
    crowded = alignment.linked(block, 100)
    assert all((x == y).all() for x, y in zip(whole, crowded, strict=True))
    assert whole[1].tolist() == [501, 502, 601, 602] and whole[2].tolist() == [6, 2, 3, 1]


@pytest.mark.parametrize("seed", range(5))
def test_gallop_finds_what_a_binary_search_finds(seed):
    rng = np.random.default_rng(seed)
    ends = np.sort(rng.choice(10_000, 400, replace=False))
    values = np.sort(rng.choice(ends[-1] + 1, 300, replace=False))
    low, high = np.zeros(300, np.int64), np.full(300, 399)
    assert (alignment.gallop(values, ends, low, high, rng.integers(0, 400, 300)) == np.searchsorted(ends, values)).all()


def test_ids_nulls_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, "one two", 1), (3, None, 2), (3, "one two", 3)], "doc_id long, text string, `a.b` int")
    got = sorted(((r.doc_id, r.n_a, r.n_links == r.n_best) for r in alignment.link_statistics(rows, A, B).collect()), key=str)
    assert got == [(3, 0, True), (3, 2, True), (None, 2, True)]
    assert alignment.link_statistics(rows.limit(0), A, B).count() == 0


def test_spans_cover_both_sides(spark):
    rows = alignment.aligned(spark.createDataFrame([(1, "hello  world\n\nfoo"), (2, None)], "doc_id long, text string"), A, B).orderBy("doc_id").collect()
    assert sum(rows[0].a_tokens) == len(rows[0].a_ids) and sum(rows[0].b_tokens) == len(rows[0].b_ids)
    assert sum(rows[0].n_bytes) == len(" hello  world\n\nfoo") and rows[1].a_ids == []


def invented(seed, words):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 11))) for _ in range(100)) for _ in range(words // 100)]


def test_ids_are_those_of_the_library():
    one, rng = alignment.side(A), random.Random(6)
    assert one.ranked is not None
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}1" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    marks = ["'s", "'ll", "'L", "don't", " ", "  ", "\n", "\t ", "\u00a0", "\u2003", "\x1c", "\x85", "12", "½", "é", "日本", "🙂", "!?", "<|endoftext|>", "▁", "word", "Ünï"]
    texts += ["".join(rng.choices(marks, k=rng.randrange(1, 40))) for _ in range(5000)] + [t for t in TEXTS if t] + invented(7, 5000)
    texts += ["ab" * 20_000, "x" * 50_000, "a" + " " * 100_000 + "b"]
    assert one.ids(texts) == one.by_library(texts)


@pytest.mark.parametrize("run", [" " * 1_200_000 + "b", "a" + "\n " * 600_000])
def test_long_runs_of_white_space_are_encoded(run):
    assert alignment.side(A).ids(["x", run]) == alignment.side(A).by_library(["x", run])


def test_new_words_cost_less_than_by_the_library():
    one, texts, spent = alignment.side(A), invented(8, 100_000), []
    for encode in (one.ids, one.by_library):
        begin = time.process_time()
        encode(texts)
        spent.append(time.process_time() - begin)
    assert spent[0] < 0.7 * spent[1]


def _file(tmp_path, name, change):
    with open(A, encoding="utf-8") as file:
        spec = json.load(file)
    change(spec)
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(spec))
    return alignment.ByteLevel(str(path))


def _few_merges(merges):
    def change(spec):
        base = [t for t in spec["model"]["vocab"] if len(t) == 1]
        spec["model"]["merges"] = merges
        spec["model"]["vocab"] = {t: k for k, t in enumerate([*base, *("".join(m) for m in merges)])}
        spec["added_tokens"] = []

    return change


def test_files_that_tokens_alone_do_not_decide_stay_with_the_library(tmp_path):
    # no merge names a and bc, so abc is never made
    crossed = _file(tmp_path, "crossed", _few_merges([["b", "c"], ["a", "b"], ["ab", "c"]]))
    assert crossed.ranked is None and [len(x) for x in crossed.ids(["abc"])] == [3]
    assert _file(tmp_path, "plain", _few_merges([["a", "b"], ["ab", "c"]])).ranked is not None
    for name, change in {
        "normalised": lambda s: s.update(normalizer={"type": "Lowercase"}),
        "spaced": lambda s: s["pre_tokenizer"].update(add_prefix_space=True),
        "added": lambda s: s["added_tokens"].append(s["added_tokens"][0] | {"id": 50257, "content": "ordinary", "special": False}),
        "whole": lambda s: s["model"].update(ignore_merges=True),
    }.items():
        assert _file(tmp_path, name, change).ranked is None, name


def test_links_are_counted_for_each_text_in_large_blocks():
    rng = np.random.default_rng(9)
    n = 2000
    a, b, of = rng.integers(0, 50_000, n), rng.integers(0, 32_000, n), np.sort(rng.integers(0, 9_000, n))
    a[1::2], b[1::2], of[1::2] = a[::2], b[::2], of[::2]
    ones = np.ones(n, np.int64)
    doc, pair, times = alignment.linked(alignment.Block(a, b, ones, ones, of, np.arange(n), np.arange(n), ones, ones), 32_000)
    held = Counter(zip(of.tolist(), a.tolist(), b.tolist()))
    assert [(d, p // 32_000, p % 32_000, k) for d, p, k in zip(doc.tolist(), pair.tolist(), times.tolist())] == sorted((*x, k) for x, k in held.items())
