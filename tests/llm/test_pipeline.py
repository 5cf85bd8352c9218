import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from maploom.llm import toxicity  # noqa: E402
from tests.llm.test_simhash import brute_components, brute_print  # noqa: E402

KEY = "AKIA" + "MD62HKU6VBLCCCCE"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([3, 6, 14])))
    rows = []
    for i in range(240):
        words = [word() for _ in range(rng.choice([30, 90, 200]))]
        if i % 6 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["moron", "idiot"])
        elif i % 10 == 1:
            words.insert(5, KEY)
        rows.append((i, " ".join(words)))
        if i % 8 == 3:
            rows.append((1000 + i, " ".join(words).upper() if i % 16 == 3 else " ".join([*words[:-1], "other"])))
    rows += [(2000, None), (2001, ""), (2002, "x " * 30_000)]
    path = str(tmp_path_factory.mktemp("tables"))
    data = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(rows)


def test_stages_do_what_plain_code_does(spark, corpus):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    want = {i for i, t in texts.items() if model.score(t) < 0.5}
    assert not any(i in want for i in range(0, 240, 6)) and len(want) > 200
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    out = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        found = corpus_pipeline.written(out[name](spark, docs, path))
        return found, {r.doc_id: r for r in found.collect()}

    docs, rows = step("toxicity", docs)
    assert docs.columns == COLUMNS and set(rows) == want
    docs, rows = step("exact_dedup", docs)
    want = {max(j for j in want if lower(texts[j]) == lower(texts[i])) for i in want}
    assert docs.columns == COLUMNS and set(rows) == want
    docs, rows = step("simhash_near_dedup", docs)
    ids = sorted(want)
    want = set(brute_components(ids, [brute_print(texts[i]) for i in ids]))
    assert docs.columns == COLUMNS and set(rows) == want
    docs, rows = step("secret_scans", docs)
    assert docs.columns == COLUMNS and set(rows) == want
    for i, r in rows.items():
        assert r.text == (texts[i] and texts[i].replace(KEY, "[SECRET]").replace(KEY.lower(), KEY.lower()))
        assert r.n_chars == (None if r.text is None else len(r.text))
    docs, _ = step("best_fit_packing", docs)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == want


def test_run_applies_all_stages(spark, corpus):
    path, texts = corpus
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} < set(texts)
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 4096
