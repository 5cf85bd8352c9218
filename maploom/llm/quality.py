"""Quality rules: base counts of each text, and robust multivariate outliers per language and source.

Statistics. Each text gives counts (words, their letters, symbols, repeated lines, words in repeated five-word
windows), computed in the tasks over whole texts. Transformed, they are a vector of five numbers: log of
words, letters per word (drawn to 5 as if by 20 more words, for a few words tell little), square roots of
symbols per word and of the share of repeated lines, and the arcsine root of that of repeated words.

Centre and scatter. For each group (language, source) the minimum covariance determinant is sought by
concentration steps: from the mean and covariance of a subset, the share h of the group's rows nearest to it
makes the next subset, which never enlarges the determinant (Rousseeuw & Van Driessen 1999). Every step covers
all rows: they add up to sums and products per group, where a group's rows are dealt over salts, and the h-th
distance comes from exact counts over fine logarithmic bins, so that no group is sorted or gathered. A final
step reweights: rows within the 0.975 quantile of a chi-square make the estimate used. Two starts are tried, and
the one with the smaller determinant counts: the h rows nearest to the coordinatewise medians, scaled by median
absolute deviations, and the h rows nearest to them by the covariance of spatial signs.

A language, and all rows together, are groups as well. Mean and covariance of a group of n rows are averaged with those
of its language, at weights n and `prior`, and a language's with those of all. So even a group of five rows has a
centre of its own, one outlier alone in its group is still far from it, and what the language adds fades as the group grows.

Variances get a small floor (floors) that keeps the covariance from being singular: most texts have no symbols and no
repeated line, and there the floor stands for the variance. That of letters per word is larger, what chance alone
gives texts of about 20 words. A row is rejected when its squared Mahalanobis distance exceeds cut, by default the
0.9999 quantile of the same chi-square distribution.

Defined results: null texts count as empty and, like others of fewer than 10 words, fail the base rules; null
language or source is a group of its own; repeated rows count each; an empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import row_salt, salt_marks, salts_in, written

SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
VECTOR = ["x_words", "x_length", "x_symbols", "x_lines", "x_repeats"]
#: Least standard deviation of each number of VECTOR.
FLOORS = (0.1, 0.25, 0.03, 0.05, 0.05)
#: Quantiles of the chi-square distribution with 5 degrees of freedom.
CHI_9999, CHI_975, CHI_MEDIAN = 25.745, 12.833, 4.351
#: What a covariance loses by leaving out the rows beyond CHI_975: 0.975 / P(chi-square with 7 degrees <= CHI_975).
REWEIGHTED = 1.0555
BINS = 32


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words within a window of width words that occurs at least twice."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code = ids[:n]
    for k in range(1, width):  # each step numbers the distinct windows, so codes stay below the square of their number
        code = np.unique(code * np.int64(len(ids) + 1) + ids[k : k + n], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    step = np.zeros(len(ids) + 1, np.int64)
    step[:n] += twice
    step[width : width + n] -= twice
    return int((np.cumsum(step)[: len(ids)] > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode()
    words = data.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    solid = data.translate(None, b" \t\n\r\x0b\x0c")
    chars = len(solid) if text.isascii() else len(solid.decode())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(ids), len(lines)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, counts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([text_counts(t) for t in batch.column(3).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(c) for c in counts.T)], ["id", "lang", "source", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_vector(counts: DataFrame) -> DataFrame:
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    values = [F.log1p("n_words"), (F.col("word_chars") + 100) / (F.col("n_words") + 20), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / lines), F.asin(F.sqrt(F.col("n_repeat_words") / n))]
    return counts.withColumns(dict(zip(VECTOR, values, strict=True)))


PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """The squared distance of a row's vector from mean, by the upper triangle of inverse."""
    d = [F.col(v) - F.get(mean, F.lit(i)) for i, v in enumerate(VECTOR)]
    terms = [(2.0 if i != j else 1.0) * F.get(inverse, F.lit(k)) * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _bin(x: Column) -> Column:
    return F.greatest(F.floor(BINS * F.log2(x + 1e-9)), F.lit(-32 * BINS)).cast("int")


MOMENTS = "grp string, mean array<double>, cov array<double>, inverse array<double>, logdet double"


def inverted(cov: np.ndarray, floors: tuple[float, ...]) -> tuple[np.ndarray, float]:
    """The inverse of a covariance, and the logarithm of its determinant, once no direction varies by less than its floor."""
    unit = np.outer(floors, floors)
    values, vectors = np.linalg.eigh(cov / unit)
    values = np.maximum(values, 1.0)
    return (vectors / values) @ vectors.T / unit, float(np.log(values).sum())


def _square(upper: list[float]) -> np.ndarray:
    out = np.zeros((len(VECTOR), len(VECTOR)))
    for value, (i, j) in zip(upper, PAIRS, strict=True):
        out[i, j] = out[j, i] = value
    return out


def _upper(square: np.ndarray) -> list[float]:
    return [float(square[i, j]) for i, j in PAIRS]


def _moments(rows: DataFrame, floors: tuple[float, ...], scale: float, central: bool = True) -> DataFrame:
    """MOMENTS of each group's rows, the covariance times scale; about zero unless central."""
    # sums need no salt: each task hands on one row for a group
    sums = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)), *(F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                mean = np.array([row[f"s{i}"] for i in range(len(VECTOR))]) / row["n"] * central
                cov = scale * (_square([row[f"p{k}"] / row["n"] for k in range(len(PAIRS))]) - np.outer(mean, mean))
                inverse, logdet = inverted(cov, floors)
                for column, value in zip(out, (mean.tolist(), _upper(cov), _upper(inverse), logdet), strict=True):
                    column.append(value)
            lists = [pa.array(x, pa.list_(pa.float64())) for x in out[:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(out[3], pa.float64())], ["grp", "mean", "cov", "inverse", "logdet"])

    return sums.mapInArrow(invert, MOMENTS)


class Groups:
    """Which groups and salts rows (grp, salt, VECTOR) have, and how a row of each group goes back to its rows."""

    def __init__(self, rows: DataFrame, most: int):
        self.sizes = written(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *salt_marks()))
        self.few = self.sizes.count() <= most

    def joined(self, rows: DataFrame, of_group: DataFrame) -> DataFrame:
        """rows with the columns of their group's row: broadcast where there are at most `most` groups, else by salts."""
        if self.few:
            return rows.join(F.broadcast(of_group), "grp")
        spread = of_group.join(self.sizes.select("grp", F.explode(salts_in()).alias("salt")), "grp")
        return rows.join(spread.hint("merge"), ["grp", "salt"])


def _nearest(rows: DataFrame, groups: Groups, share: float) -> DataFrame:
    """rows has grp, salt and dist; keeps at least that share of each group, the nearest by bins of dist."""
    bins = rows.select("grp", _bin(F.col("dist")).alias("b")).groupBy("grp", "b").agg(F.count(F.lit(1)).alias("n"))
    lists = bins.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("bins"), F.sum("n").alias("total"))
    # a group has a few thousand bins at most
    walk = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("b")), lambda a, x: F.when(a["b"].isNotNull(), a).otherwise(F.struct((a["sum"] + x["n"]).alias("sum"), F.when(a["sum"] + x["n"] >= F.ceil(F.col("total") * share), x["b"]).alias("b"))))
    cuts = lists.select("grp", walk["b"].alias("cut"))
    return groups.joined(rows, cuts).where(_bin(F.col("dist")) <= F.col("cut")).drop("cut")


def _medians(rows: DataFrame, name: str) -> DataFrame:
    """Per group the medians of the vector, to the width of a bin of 1/64, from counts."""
    long = rows.select("grp", F.posexplode(F.array(*(F.round(F.col(v) * 64).cast("int") for v in VECTOR))).alias("k", "b"))
    bins = long.groupBy("grp", "k", "b").agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy("grp", "k").agg(F.percentile("b", F.lit(0.5), F.col("n")).alias("m")).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"] / 64).alias(name))


def _starts(rows: DataFrame, groups: Groups, floors: tuple[float, ...]) -> list[DataFrame]:
    """Two first estimates (grp, mean, inverse): medians with their deviations, and with the shape of spatial signs."""
    centre = written(_medians(rows, "mean"))
    off = [F.col(v) - F.get("mean", F.lit(i)) for i, v in enumerate(VECTOR)]
    away = groups.joined(rows, centre).select("grp", "salt", *(x.alias(v) for x, v in zip(off, VECTOR, strict=True)))
    width = [F.greatest(1.4826 * F.get("mad", F.lit(i)), F.lit(floors[i])) for i in range(len(VECTOR))]
    spread = _medians(away.select("grp", *(F.abs(v).alias(v) for v in VECTOR)), "mad").select("grp", F.array(*width).alias("width"))
    known = written(centre.join(spread, "grp"))
    over = lambda i, j: F.get("width", F.lit(i)) * F.get("width", F.lit(j))
    plain = known.select("grp", "mean", F.array(*(F.lit(0.0) if i != j else 1 / over(i, i) for i, j in PAIRS)).alias("inverse"))
    scaled = groups.joined(away, known.select("grp", "width")).select("grp", *((F.col(v) / F.get("width", F.lit(i))).alias(v) for i, v in enumerate(VECTOR)))
    length = F.sqrt(sum((F.col(v) * F.col(v) for v in VECTOR), F.lit(0.0)))
    signs = scaled.select("grp", *(F.when(length > 0, F.col(v) / length).otherwise(0.0).alias(v) for v in VECTOR))
    shape = _moments(signs, (0.05,) * len(VECTOR), 1.0, central=False).select("grp", F.col("inverse").alias("shape"))
    turned = known.join(shape, "grp").select("grp", "mean", F.array(*(F.get("shape", F.lit(k)) / over(i, j) for k, (i, j) in enumerate(PAIRS))).alias("inverse"))
    return [plain, turned]


def estimates(rows: DataFrame, groups: Groups, share: float = 0.75, steps: int = 4, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Per grp the reweighted minimum-covariance-determinant mean and covariance of its rows' vectors."""
    away = lambda now: groups.joined(rows, now.select("grp", "mean", "inverse")).select("grp", "salt", *VECTOR, _distance().alias("dist"))
    ends = []
    for now in _starts(rows, groups, floors):
        for _ in range(steps):
            now = written(_moments(_nearest(away(now), groups, share), floors, 1.0))
        ends.append(now)
    least = written(ends[0].unionByName(ends[1]).groupBy("grp").agg(F.min_by(F.struct("mean", "inverse"), "logdet").alias("e")).select("grp", "e.*"))
    # consistent at the normal distribution: the median distance of all rows is that of a chi-square
    half = away(least)
    middle = _nearest(half, groups, 0.5).groupBy("grp").agg(F.max("dist").alias("m"))
    scaled = groups.joined(half, middle).where(F.col("dist") <= CHI_975 * F.greatest(F.col("m") / CHI_MEDIAN, F.lit(1e-9)))
    return written(_moments(scaled, floors, REWEIGHTED).select("grp", "mean", "cov"))


def _mixed(of: DataFrame, floors: tuple[float, ...], prior: float) -> DataFrame:
    """Rows with n, mean and cov of a group (0), its language (1) and all (2) to grp, mean and inverse of their averages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, inverses = [], []
            for row in batch.to_pylist():
                mean, cov = np.array(row["mean2"]), _square(row["cov2"])
                for k in (1, 0):
                    share, own = row[f"n{k}"] / (row[f"n{k}"] + prior), np.array(row[f"mean{k}"])
                    cov = share * _square(row[f"cov{k}"]) + (1 - share) * cov
                    mean = share * own + (1 - share) * mean
                means.append(mean.tolist())
                inverses.append(_upper(inverted(cov, floors)[0]))
            lists = [pa.array(x, pa.list_(pa.float64())) for x in (means, inverses)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["grp", "mean", "inverse"])

    return of.select("grp", *(f"{c}{k}" for k in range(3) for c in ("n", "mean", "cov") if c != "n" or k < 2)).mapInArrow(run, "grp string, mean array<double>, inverse array<double>")


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cut: float = CHI_9999,
    prior: float = 20.0,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    floors: tuple[float, ...] = FLOORS,
    most_broadcast: int = 10_000,
) -> DataFrame:
    """Every row's counts, base_failed, its squared distance (null for rows that fail the base rules) and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    name = lambda *c: F.to_json(F.array(*(F.col(x) for x in c)))
    levels = [F.concat(F.lit("0"), name("lang", "source")), F.concat(F.lit("1"), name("lang")), F.lit("2")]
    counts = counted(docs, id_col, text_col, lang_col, source_col).withColumns({"base_failed": failed, "salt": row_salt("id")})
    rows = written(with_vector(counts).withColumn("grps", F.array(*levels)))
    good = rows.where(~F.col("base_failed"))
    every = good.select(F.explode("grps").alias("grp"), "salt", *VECTOR)
    groups = Groups(every, most_broadcast)
    found = written(groups.sizes.join(estimates(every, groups, floors=floors), "grp").select("grp", "n", "mean", "cov"))
    of = lambda k: found.where(F.col("grp").startswith(str(k))).select(F.col("grp").alias(f"grp{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("n", "mean", "cov")))
    named = good.select("grps").distinct().select(*(F.col("grps")[k].alias(f"grp{k}") for k in range(3)))
    mixed = written(_mixed(named.join(of(0), "grp0").join(of(1), "grp1").join(of(2), "grp2").withColumnRenamed("grp0", "grp"), floors, prior))
    distance = groups.joined(good.withColumn("grp", F.col("grps")[0]), mixed).select(*rows.columns, _distance().alias("distance"))
    out = distance.unionByName(rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"), "distance")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
