"""Exact deduplication by skew-safe combining.

Rows of equal text meet in three steps. Each task first combines the copies it has itself (the partial half
of the salted aggregate). Then groups of (digest, salt) merge: the salt comes from the row's id, so that a
text with millions of copies is dealt over 64 tasks. Last, the at most 64 winners of a text combine into the
global one. Every step groups by the text itself beside its digest, so texts whose digests collide stay apart.

The global winners go back to the rows over (digest, salt), again 64 keys for a hot text. Only digests that
really stand for several texts, if any, are joined by text.

Defined results: a null text counts as empty; a null id is smaller than any other; rows that repeat the id of
the row that stays, with the same text, are that row and are all marked kept, and drop_exact_duplicates leaves
one of them; an empty table gives an empty result. Only the two named columns are read, so other columns may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maploom.llm.shared import ascii_lower, row_salt, salt_marks, salts_in, written


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _with_group(rows: DataFrame) -> DataFrame:
    """rows has id, norm, digest, salt and what the caller keeps; adds keep_id and group_size, drops norm."""
    keys = rows.select("id", "norm", "digest", "salt")
    salted = keys.groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = (
        salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), *salt_marks())
    )
    narrow = whole.select("digest", "keep_id", "group_size", "salts", "top")
    texts = narrow.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.bit_or("salts").alias("salts"), F.max("top").alias("top")
    )
    winners = written(texts)
    single = winners.where("texts = 1").select("digest", F.explode(salts_in()).alias("salt"), "keep_id", "group_size")
    found = rows.drop("norm").join(single, ["digest", "salt"])
    several = winners.where("texts > 1").select("digest")
    if several.isEmpty():
        return found
    by_text = whole.join(several, "digest", "left_semi").select("digest", "norm", F.explode(salts_in()).alias("salt"), "keep_id", "group_size")
    apart = rows.join(several, "digest", "left_semi").join(by_text, ["digest", "salt", "norm"]).drop("norm")
    return found.unionByName(apart)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """For each row its id, keep_id, group_size, kept and the digest of its normalised text.

    digest maps the normalised text to a key; any function of the text gives the same groups.
    """
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), row_salt(id_col).alias("salt")).withColumn("digest", digest(F.col("norm")))
    return _with_group(rows).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_digest")
    )


def _one_of_each(found: DataFrame) -> DataFrame:
    """Of rows that bear the id that stays, one for each text; rows has digest, salt, keep_id and text_hash.

    Rows of one id have one salt, so that they lie in one partition already. Rows without an id do not: where
    they alone bear a text, the at most 2 * SALTS that are left of them meet by digest.
    """
    first = lambda rows, *keys: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("salt"))).where("_n = 1").drop("_n")
    local = first(found, "digest", "salt", "text_hash")
    named, nameless = local.where("keep_id IS NOT NULL"), local.where("keep_id IS NULL")
    return named.unionByName(first(nameless, "digest", "text_hash"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row of each text, with all its columns: of those that bear keep_id, any one."""
    rows = docs.select(
        F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"), row_salt(id_col).alias("salt"), F.struct("*").alias("row")
    ).withColumn("digest", digest(F.col("norm")))
    found = _with_group(rows).where(F.col("id").eqNullSafe(F.col("keep_id")))
    return _one_of_each(found.withColumn("text_hash", F.xxhash64(ascii_lower(F.col("row").getField(text_col))))).select("row.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("text_digest", "text_sha256")


OP1_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
