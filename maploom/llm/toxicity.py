"""Toxicity by non-negative positive-unlabelled learning.

The learner gets confirmed toxic texts (P) and texts without any label (U, a sample of all). With class prior
pi it minimises pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)) over a linear model, stepping back on the second
part whenever it goes negative (Kiryo et al. 2017). The prior is a parameter; by default it is the share of toxic
rows among labels that may be learned from, and PRIOR where these are all toxic. Features are a text's words and their beginnings, hashed and counted, up to five times each (one
word that begins like an insult is chance, several are not); those that best part P from what U holds beside P
stay. Fitting is numpy on the driver over a bounded sample (max_positive,
max_unlabelled texts, as sparse feature lists); scoring covers every whole text in the tasks.

Ids choose the rows to learn from (crc32 of the id as text, modulo folds, 0 is held out) and the sample, and
are never features; neither are labels, language or source.

Defined results: null and empty texts score as texts without words; a null id is held out; several labels of
an id count as their maximum; without toxic examples every text scores 0; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W\d_]+")
SPACE = 1 << 20
CACHED = 200_000
MOST = 5
#: The class prior where no text is labelled as not toxic.
PRIOR = 0.05


def word_features(word: str) -> list[int]:
    """Hashed: the word, and its beginnings of 4 to 6 letters."""
    parts = [f"w {word}", *(f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [crc32(p.encode()) % SPACE for p in parts]


def text_features(text: str | None) -> np.ndarray:
    """The features of a text in ascending order, each as often as it occurs, MOST times at most."""
    counts: Counter[int] = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for f in word_features(word):
            counts[f] += n
    return np.array(sorted(f for f, n in counts.items() for _ in range(min(n, MOST))), dtype=np.int32)


@dataclass
class Model:
    bias: float
    weights: dict[int, float]
    words: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> tuple[int, ...]:
        """Those features of a word that have a weight."""
        if (found := self.words.get(word)) is None:
            if len(self.words) >= CACHED:
                self.words.clear()
            found = self.words[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def scores(self, texts) -> np.ndarray:
        """Scores of many texts: a table of words with their weighted features, then counts and sums by arrays."""
        row, found = [], []
        known = self.words
        for k, text in enumerate(texts):
            for word in WORD.findall((text or "").lower()):
                own = known.get(word)
                if own is None:
                    own = self.word(word)
                if own:
                    found.extend(own)
                    row.extend([k] * len(own))
        z = np.full(len(texts), self.bias)
        if found:
            key, n = np.unique(np.array(row, np.int64) * SPACE + np.array(found, np.int64), return_counts=True)
            weight = np.array([self.weights[f] for f in (key % SPACE).tolist()])
            np.add.at(z, key // SPACE, weight * np.minimum(n, MOST))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "words": {}}


def select_features(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, keep: int) -> np.ndarray:
    """The features whose mean in P most exceeds their mean in what U holds beside P, in standard errors."""

    def moments(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = [np.unique(r, return_counts=True) for r in rows]
        f, n = np.concatenate([x for x, _ in own]).astype(np.int64), np.concatenate([x for _, x in own])
        mean = np.bincount(f, n, minlength=SPACE) / len(rows)
        return mean, np.bincount(f, n * n, minlength=SPACE) / len(rows) - mean**2

    (p, vp), (u, vu) = moments(pos), moments(unl)
    n = np.maximum((u - prior * p) / (1 - prior), 0)
    z = (p - n) / np.sqrt((vp + 1 / len(pos)) / len(pos) + (vu + 1 / len(unl)) / len(unl))
    best = np.argsort(-z, kind="stable")[:keep]
    return best[z[best] > 2]


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model, by Adam on the logistic loss."""
    w, b = np.zeros(xp.shape[1]), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        own = w.astype(np.float32)
        zp, zu = (xp @ own).astype(float) + b, (xu @ own).astype(float) + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sp - 1) / len(sp), su / len(su)
        gn = -prior * sp / len(sp)
        tp, tu = (lambda g: xp.T @ g.astype(np.float32)), xu.T @ gu.astype(np.float32)
        if rest >= 0:
            grad = np.append(tp(gp + gn) + tu + l2 * w, (gp + gn).sum() + gu.sum())
        else:
            grad = -np.append(tp(gn) + tu - l2 * w, gn.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, keep: int = 1024) -> Model:
    if not pos or not unl or not 0 < prior < 1:
        return Model(-40.0, {})
    chosen = select_features(pos, unl, prior, keep)
    at = np.full(SPACE, -1, np.int32)
    at[chosen] = np.arange(len(chosen))

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(chosen)), np.float32)
        for i, row in enumerate(rows):
            own = at[row]
            np.add.at(x[i], own[own >= 0], 1)
        return x

    w, b = fit_nnpu(dense(pos), dense(unl), prior)
    return Model(b, {int(f): float(x) for f, x in zip(chosen, w, strict=True) if x})


def held_out(id_col: str | Column, folds: int = 5) -> Column:
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features(texts: pd.Series) -> pd.Series:
    return texts.map(text_features)


def _at_most(rows: DataFrame, most: int) -> DataFrame:
    """Distinct rows (id, text), and of these the first `most` by a hash."""
    one = rows.groupBy("id", F.xxhash64("text").alias("x")).agg(F.first("text").alias("text"))
    return one.orderBy(F.xxhash64("id", "x", F.lit("order")), "id", "x").limit(most).select("id", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, max_positive: int = 2000, max_unlabelled: int = 4000, prior: float | None = None) -> Model:
    """Fits on max_positive toxic and max_unlabelled other texts at most, chosen by a hash of their ids, then of their texts.

    A row that repeats an id and its text is one text of the sample, so that no number of repeats fills it, and however many
    texts one id bears, no more than these reach the driver.
    prior: the share of toxic texts among all; by default that among the labels, or PRIOR where all labels are toxic.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~held_out("id", folds))
    marked = labels.select(F.col("doc_id").alias("id"), "toxic").where(F.col("toxic").isNotNull() & ~held_out("id", folds)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marked.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not toxic:
        return Model(-40.0, {})
    prior = prior or (toxic / n if toxic < n else PRIOR)
    place = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30))
    cut = lambda most, of: int((1 << 30) * min(1.0, most / max(of, 1)))
    known = marked.where((F.col("toxic") == 1) & (place < cut(max_positive, toxic))).select("id")
    pos = _at_most(rows.join(F.broadcast(known), "id", "left_semi"), max_positive)
    unl = _at_most(rows.where(place < cut(max_unlabelled, rows.count())), max_unlabelled)
    sample = pos.select(F.lit(True).alias("p"), _features("text").alias("f")).unionByName(unl.select(F.lit(False).alias("p"), _features("text").alias("f")))
    found = sample.toArrow()
    lists = [row for chunk in found.column("f").chunks if len(chunk) for row in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]
    is_pos = found.column("p").to_pylist()
    order = sorted(range(len(lists)), key=lambda i: (len(lists[i]), crc32(lists[i].tobytes())))
    return fit([lists[i] for i in order if is_pos[i]], [lists[i] for i in order if not is_pos[i]], prior)


def score(model: Model, text: str | Column) -> Column:
    """The score of each text as a column."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()), texts.index, dtype="float64")

    return run(text)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    rows = docs.select(F.col(id_col), held_out(id_col, folds).alias("held_out"), score(model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score stays below 0.5, with all their columns."""
    return docs.where(score(model, text_col) < 0.5)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
