import random
from zlib import crc32

import numpy as np

from maploom.llm import toxicity

INSULTS = ["moron", "idiot", "lowlifer", "lowlifes", "lowlifish"]


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.choice([3, 5, 7]))) for _ in range(900)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([10, 40, 120]))]
        toxic = int(rng.random() < 0.15)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        rows.append((i, " ".join(words), toxic))
    return rows


def tables(spark, rows, labelled=0.5):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, t, "x", "s", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, source string, score double").repartition(4)
    marks = [(i, 1, y) for i, _, y in rows if rng.random() < labelled]
    return docs, spark.createDataFrame(marks + marks[:20] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    truth = {i: y for i, _, y in rows}
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    test = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out]
    assert np.mean([p for p, y in test if y]) > 0.9 and np.mean([p for p, y in test if not y]) < 0.03


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus(400)
    docs, labels = tables(spark, rows)
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.bias, a.weights) == (b.bias, b.weights)


def test_risk_never_pays_for_memorising():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 400)).astype(np.float32)
    w, b = toxicity.fit_nnpu(x[:40], x[40:], 0.3, l2=0.0)
    scores = 1 / (1 + np.exp(-(x[40:] @ w + b)))
    rest = -np.log1p(-np.clip(scores, 0, 1 - 1e-9)).mean() - 0.3 * np.logaddexp(0, x[:40] @ w + b).mean()
    assert rest > -0.2


def test_edges(spark):
    docs, labels = tables(spark, [(0, None, 0), (1, "", 0), (2, "moron " * 100_000, 1), (3, "x", 0), (3, "x", 0)], 1.0)
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    nobody = labels.where("toxic = 0")
    assert {r.predicted for r in toxicity.scored(docs, toxicity.train(docs, nobody)).collect()} == {0}
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).collect() == []
    assert toxicity.drop_toxic(docs, toxicity.train(docs, nobody)).columns == docs.columns


def test_scores_of_a_batch_are_those_of_its_texts():
    rng = random.Random(5)
    words = ["moron", "idiots", "x", "lowlife", "and"]
    model = toxicity.Model(-2.0, {f: rng.uniform(-1, 2) for w in words[:4] for f in toxicity.word_features(w)})
    texts = [None, "", *(" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(50))]
    got = model.scores(texts)
    for text, score in zip(texts, got, strict=True):
        z = -2.0 + sum(model.weights.get(int(f), 0.0) for f in toxicity.text_features(text))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_confirmed_positives_alone_suffice(spark):
    rows = corpus(1200, 3)
    docs, labels = tables(spark, rows)
    out = toxicity.scored(docs, toxicity.train(docs, labels.where("toxic = 1"), prior=0.15)).collect()
    truth = {i: y for i, _, y in rows}
    test = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out]
    assert np.mean([p for p, y in test if y]) > 0.8 and np.mean([p for p, y in test if not y]) < 0.05
    assert any(r.predicted for r in toxicity.scored(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect())


def test_repeated_ids_do_not_outgrow_the_sample(spark, monkeypatch):
    """One labelled id on thousands of rows, of one text and of many: what reaches the driver stays within the bounds."""
    own = next(i for i in range(100) if crc32(str(i).encode()) % 5)
    texts = [(own, "moron " * 5)] * 2000 + [(own, f"moron number {k}") for k in range(2000)] + [(1000 + k, f"plain text {k}") for k in range(300)]
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda pos, unl, prior: seen.append((len(pos), len(unl))) or fit(pos, unl, prior))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(own, 1, 1)] + [(1000 + k, 1, 0) for k in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, labels, max_positive=50, max_unlabelled=5000)
    toxicity.train(docs.limit(2000), labels, max_positive=50, max_unlabelled=80)
    (pos, unl), (one, other) = seen
    assert pos == 50 and unl <= 5000 and one == 1 and other <= 80
