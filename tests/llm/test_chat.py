import random
from hashlib import sha256

import pytest

P = pytest.importorskip("public_tokenizers")

from maploom.llm import chat  # noqa: E402

RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "word ", "\\", "<|", "<|im_end|>", "\n", "<", "|", "é", "<\\|", "\\n", "<|im_start|>assistant\n"]


def conversations(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 5, 40])))
    return {c: [(rng.choice(["user", "assistant", "system", "us\ner", ""]), text()) for _ in range(rng.choice([1, 2, 3, 9, 60]))] for c in range(n)}


def frame(spark, convs):
    rows = [(c, n, r, t, "clash", 7) for c, turns in convs.items() for n, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string, n_tokens int").repartition(5)


def test_escapes_are_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        role, text = ("".join(rng.choice(PARTS) for _ in range(rng.randrange(8))) for _ in range(2))
        assert chat.parse(chat.format_turn(role, text)) == [(role, text)]


@pytest.mark.parametrize("budget, history, block", [(60, 20, 5), (2048, 512, 1024), (300, 0, 7), (10, 5, 3)])
def test_every_turn_is_new_once_and_windows_keep_the_budget(spark, budget, history, block):
    convs = conversations(5, 40)
    count = chat.counter(RANKS, P.PATTERN)
    by = {}
    for w in chat.format_windows(frame(spark, convs), RANKS, P.PATTERN, budget, history, block).collect():
        by.setdefault(w.conv_id, []).append(w)
    for c, turns in convs.items():
        lead = next((n for n, t in enumerate(turns) if t[0] != "system"), len(turns))
        at = 0
        for w in sorted(by[c], key=lambda w: w.window):
            own = chat.parse(w.text)
            assert w.first_turn == at and own[w.n_repeated :] == turns[at : at + w.n_new]
            assert own[: lead if at else 0] == (turns[:lead] if at else [])
            shown = own[lead if at else 0 : w.n_repeated]
            assert shown == turns[at - len(shown) : at]
            assert sum(count(chat.format_turn(*t)) for t in shown) <= history
            assert w.n_tokens == sum(count(chat.format_turn(*t)) for t in own)
            assert w.n_tokens <= budget or w.n_new == 1 or at == 0 and w.n_new == lead + 1 or w.n_new == len(turns)
            spans = [chat.unescape(w.text[a:b]) for a, b in zip(w.loss_starts, w.loss_ends, strict=True)]
            assert spans == [t for r, t in own[w.n_repeated :] if r == "assistant"]
            at += w.n_new
        assert at == len(turns)


def test_read_back_digests(spark):
    convs = conversations(6, 30)
    out = chat.format_windows(frame(spark, convs), RANKS, P.PATTERN, 80, 20, 4).mapInArrow(chat.read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    rows = {r.conv_id: r for r in out.collect()}
    assert len(rows) == len(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert rows[c].n_turns == len(turns)
        assert rows[c].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (rows[c].loss_chars, rows[c].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())


def test_nulls_ties_and_empty(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {w.conv_id: chat.parse(w.text) for w in chat.format_windows(df, RANKS, P.PATTERN).collect()}
    assert found == {None: [("user", "x")], 1: [("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]}
    assert chat.format_windows(df.limit(0), RANKS, P.PATTERN).collect() == []


def test_very_long_turns_are_whole(spark):
    df = spark.createDataFrame([(1, 0, "user", "u " * 50_000), (1, 1, "assistant", "a " * 50_000), (1, 2, "user", "end")], "conv_id long, turn long, role string, text string")
    assert [w.n_new for w in chat.format_windows(df, RANKS, P.PATTERN).orderBy("window").collect()] == [1, 1, 1]
