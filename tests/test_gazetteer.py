import random
import unicodedata

from pyspark.sql import functions as F

from maploom.operators import gazetteer

WORDS = [unicodedata.normalize("NFC", w) for w in ("Plzeň", "Győr", "Şile", "Čáslav", "Łódź", "İzmir", "Straße", "ﬁne", "Ｗｉｄｅ", "école", "plain", "New", "York", "City")]


def plain(word):
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).casefold()


def test_folding_strips_marks_and_compatibility_forms(spark):
    assert [gazetteer.fold(w) for w in WORDS[:3]] == ["plzen", "gyor", "sile"]
    rows = spark.createDataFrame([(WORDS,), (["Plain", "WORDS"],), ([],), (None,)], "w array<string>")
    got = [r.f for r in rows.select(gazetteer.folded_words(F.col("w")).alias("f")).collect()]
    assert got == [[plain(w) for w in WORDS], ["plain", "words"], [], None]


def test_longest_matches_equal_a_greedy_walk(spark):
    rng = random.Random(3)
    names = {"new", "new york", "new york city plain", "plzen", "gyor sile", "lodz straße".replace("ß", "ss")}
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for i in range(60)] + [(100, None), (101, "")]
    want = []
    for i, text in docs:
        words, at = [plain(w) for w in (text or "").split()], 0
        while at < len(words):
            n = next((n for n in (4, 3, 2, 1) if at + n <= len(words) and " ".join(words[at : at + n]) in names), 0)
            if n:
                want.append((i, at, n, " ".join(words[at : at + n])))
            at += n or 1
    table = spark.createDataFrame([(n,) for n in names], "name string")
    for most in (100, 0):
        got = gazetteer.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), table, most_broadcast=most)
        assert sorted(map(tuple, got.collect())) == sorted(want)
