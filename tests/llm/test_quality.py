import random
import re

import numpy as np
import pytest

from maploom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a ", "b ", "é\n", "a\n", "\x85", "\xa0", "|# ", "\x1c", "word ", "\r\n", " \n"]) for _ in range(rng.choice([0, 1, 4, 12, 40, 200]))) for _ in range(400)]


def test_counts_equal_brute_force():
    for t in [*texts(1), None, "same five words in here " * 50]:
        assert quality.text_counts(t)[:5] == brute(t)


def corpus(seed, n=600):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 4, 5, 6, 8]))) for _ in range(4000)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 200]))]
        bad = i % 12 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in words), rng.choice(["en", "fr"]), f"s{i % 3}", bad))
    return rows


def test_outliers_go_and_clean_texts_stay(spark):
    rows = corpus(2)
    extra = [(9000, None, None, None, True), (9001, "", "en", "s0", True), (9002, "few words", "xx", "new", True), (9003, rows[1][1], None, "lone", False), (9003, rows[1][1], None, "lone", False), (None, rows[2][1], "en", "s1", False), (9004, "tra la la la lo " * 40, "en", "s1", True)]
    docs = spark.createDataFrame([(*r[:4], "clash", 1) for r in rows + extra], "doc_id long, text string, lang string, source string, grp string, n_words int").repartition(6)
    found = quality.judged(docs).collect()
    assert len(found) == len(rows) + len(extra)
    want = {r[0]: r for r in rows + extra}
    for r in found:
        assert r.kept == (not want[r.doc_id][4]), r
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(want[r.doc_id][1])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert (r.distance is None) == r.base_failed


def test_each_statistic_can_reject_alone(spark):
    rng = random.Random(4)
    rows = [(r[0], r[1], "en", "s") for r in corpus(3, 1500) if not r[4] and 40 < r[1].count(" ")]
    words = [w for r in rows for w in r[1].split()]
    lines = "\n".join(f"{w} {i}x{w}\nsame line" for i, w in enumerate(rng.sample(words, 60)))
    long = " ".join(w for w in (rng.choice(words) for _ in range(2000)) if len(w) > 5)
    once = [f"{i}{rng.choice(words)[1:]}" for i in range(160)]
    repeats = " ".join(once[:17] + once)  # 34 of 177 words: nearly what the base rule lets pass
    docs = spark.createDataFrame([*rows, (-1, lines, "en", "s"), (-2, long, "en", "s"), (-3, repeats, "en", "s")], "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in quality.judged(docs).collect()}
    bad = [found[i] for i in (-1, -2, -3)]
    assert not any(r.base_failed or r.kept for r in bad), bad
    assert found[-1].n_repeat_words == 0 < found[-3].n_repeat_words and found[-1].n_dup_lines == 59
    # clean texts are not quite normal: a few in a thousand may lie beyond the quantile
    assert sum(not found[r[0]].kept for r in rows) <= 5


@pytest.mark.parametrize("most", [10, 0])
def test_concentration_finds_the_clean_majority(spark, most):
    rng = np.random.default_rng(5)
    clean, dirt = rng.normal(0, 1, (900, 5)), rng.normal(8, 0.3, (180, 5))
    rows = [("g", k % 7, *map(float, x)) for k, x in enumerate(np.concatenate([clean, dirt]))]
    frame = spark.createDataFrame(rows, "grp string, salt int, " + ", ".join(f"{v} double" for v in quality.VECTOR))
    found = quality.estimates(frame, quality.Groups(frame, most), floors=(0.01,) * 5).first()
    assert np.allclose(found.mean, clean.mean(axis=0), atol=0.12)
    assert np.allclose([found.cov[k] for k, (i, j) in enumerate(quality.PAIRS) if i == j], 1, atol=0.25)


def test_small_groups_have_a_centre_of_their_own(spark):
    rows = [(r[0], r[1], "en", "s") for r in corpus(6) if not r[4]]
    rng = random.Random(8)
    # one word in six bears a sign: far from the rest, but all of them the same
    style = lambda i: " ".join(w + "#" if k % 6 == 0 else w for k, w in enumerate(rng.choice(rows)[1].split()[:40]))
    for n in (5, 200):
        own = [(10_000 + i, style(i), "en", "own") for i in range(n)]
        docs = spark.createDataFrame(rows + own, "doc_id long, text string, lang string, source string").repartition(4)
        found = {most: {r.doc_id: (r.kept, r.distance) for r in quality.judged(docs, most_broadcast=most).collect()} for most in (100, 0)}
        assert {k: v[0] for k, v in found[100].items()} == {k: v[0] for k, v in found[0].items()}
        away = np.median([found[0][r[0]][1] for r in own])
        if n == 5:
            few = away
    assert away < 10 and away < 0.7 * few


def test_empty_table(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
