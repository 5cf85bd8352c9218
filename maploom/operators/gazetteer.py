"""Names in texts: tokens, longest matches against a gazetteer, and tidy names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-']*[\p{L}\p{N}_])?"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def fold(name: str) -> str:
    """A name for comparison: compatibility forms and accents dissolved (NFKD), marks dropped, case folded, trimmed."""
    if name.isascii():
        return name.lower().strip()
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).casefold().strip()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_each(lists: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    one = lambda w: known[w] if w in known else known.setdefault(w, fold(w))
    return lists.map(lambda ws: None if ws is None else [one(w) for w in ws])


def folded_words(words: Column) -> Column:
    """Each of an array's words folded. Arrays of ASCII words stay in the JVM; only the others go through Python."""
    joined = F.array_join(words, "")
    plain = F.octet_length(joined) == F.char_length(joined)
    return F.coalesce(_fold_each(F.when(~plain, words)), F.transform(words, lambda w: F.trim(F.lower(w))))


def longest_matches(docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 4, most_broadcast: int = 100_000) -> DataFrame:
    """Names found from left to right, the longest at each place first; matched words are not used again.

    Returns id, place (of the first word, from 0), words, name. gazetteer has a column name, already folded.
    A place is looked at only if its word begins some name; spans of one to max_words words then meet the gazetteer.
    Both are broadcast up to most_broadcast names, and joined by shuffling beyond. The fold per text runs over its matches alone.
    """
    names = gazetteer.select("name").distinct()
    sized = (lambda df: F.broadcast(df)) if names.count() <= most_broadcast else (lambda df: df)
    firsts = names.select(F.substring_index("name", " ", 1).alias("w")).distinct()
    w = docs.select(id_col, folded_words(tokens(F.col(text_col))).alias("ws"))
    each = w.select(id_col, F.inline(F.transform("ws", lambda x, i: F.struct(i.alias("place"), x.alias("w"), F.slice("ws", i + 1, max_words).alias("next")))))
    begun = each.join(sized(firsts), "w", "left_semi")
    spans = F.transform(F.sequence(F.lit(1), F.size("next")), lambda n: F.struct(n.alias("words"), F.array_join(F.slice("next", 1, n), " ").alias("name")))
    hits = begun.select(id_col, "place", F.inline(spans)).join(sized(names), "name", "left_semi")
    listed = hits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", (-F.col("words")).alias("r"), "name"))).alias("hits"))
    start = F.struct(F.lit(0).alias("free"), F.slice("hits", 1, 0).alias("taken"))
    step = lambda acc, h: F.when(h["place"] >= acc["free"], F.struct((h["place"] - h["r"]).alias("free"), F.array_append(acc["taken"], h).alias("taken"))).otherwise(acc)
    chosen = listed.select(id_col, F.explode(F.aggregate("hits", start, step, lambda acc: acc["taken"])).alias("h"))
    return chosen.select(id_col, "h.place", (-F.col("h.r")).alias("words"), "h.name")


def _grams(text: Column, n: Column) -> Column:
    """The distinct substrings of n characters of a text that has at least so many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda k: F.substring(text, k, n)))


def containing(names: DataFrame, gazetteer: DataFrame, most: int = 10) -> DataFrame:
    """For names without an equal in the gazetteer (columns name, population): up to `most` of its names that contain
    name, anywhere in them, the most populous first.

    Names meet the gazetteer over three characters, or as many as they have: over those of a name's that fewest gazetteer
    names share, so that frequent ones are no keys. An empty name has no candidates.
    """
    c = F.col
    missing = names.join(gazetteer, "name", "left_anti").where(F.char_length("name") > 0)
    width = F.least(F.lit(3), F.char_length("name"))
    widths = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: n <= F.char_length("name"))
    parts = gazetteer.where(F.char_length("name") > 0).select("population", c("name").alias("candidate"), F.explode(F.flatten(F.transform(widths, lambda n: _grams(c("name"), n)))).alias("gram"))
    counts = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = missing.select("name", F.explode(_grams(c("name"), width)).alias("gram")).join(counts, "gram", "left")
    rarest = asked.groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("name", c("g.gram").alias("gram"))
    found = rarest.join(parts, "gram").where(F.contains("candidate", "name")).drop("gram")
    order = Window.partitionBy("name").orderBy(F.desc("population"), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(c("rank") <= most)


def best_candidates(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Each name with its most populous candidate, the first listed of equals; found is false where there is none."""
    best = gazetteer.groupBy("name").agg(F.max_by(F.struct("population", "lat", "lon", "place_id"), F.struct(F.coalesce("population", F.lit(0)), -F.col("place_id"))).alias("c"))
    found = names.join(best, "name", "left")
    return found.select("name", F.col("c").isNotNull().alias("found"), F.coalesce("c.population", F.lit(0)).alias("population"), F.coalesce("c.lat", F.lit(0.0)).alias("lat"), F.coalesce("c.lon", F.lit(0.0)).alias("lon"))


def safe_name(name: Column) -> Column:
    """Trimmed, slashes and NUL as hyphens, at most 64 characters, never empty."""
    return F.coalesce(F.nullif(F.substring(F.translate(F.trim(name), "/\\\x00", "---"), 1, 64), F.lit("")), F.lit("unnamed"))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows whose name gets _2, _3 and so on from its second occurrence."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn(name, F.when(n > 1, F.concat_ws("_", F.col(name), n.cast("string"))).otherwise(F.col(name)))
