"""What several operators need: intermediate tables, and group results handed back to rows without skew."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group's rows are dealt over so many salts; one bit of a long names each.
SALTS = 64
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent and Spark runs in one process (local tests) a temporary folder of this machine
    becomes its value. On a cluster there is no such folder that all could see, so its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="maploom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/maploom/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and lost executors cost nothing."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")  # its shuffle files go when it is written, not when the driver collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def salt_of(*cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def row_salt(id_col: str | Column) -> Column:
    """A salt for rows by their id. Rows without an id get one of SALTS further salts by where they stand, so that many
    of them are no hot key; what joins them must offer all of these (salts_in does), for a second reading may differ."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.when(id_col.isNotNull(), salt_of(id_col)).otherwise(SALTS + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))


def salt_marks(salt: str = "salt") -> list[Column]:
    """Aggregates that salts_in reads: the bits of the salts below SALTS, and the largest salt."""
    salt = F.col(salt)
    return [F.bit_or(F.when(salt < SALTS, F.call_function("shiftleft", F.lit(1).cast("long"), salt)).otherwise(F.lit(0).cast("long"))).alias("salts"), F.max(salt).alias("top")]


def salts_in(salts: str | Column = "salts", top: str | Column = "top") -> Column:
    """The salts that the marks name; all those of rows without an id if there is one such row."""
    salts, top = (F.col(c) if isinstance(c, str) else c for c in (salts, top))
    named = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("shiftrightunsigned", salts, s).bitwiseAND(F.lit(1)) == 1)
    return F.when(top < SALTS, named).otherwise(F.concat(named, F.sequence(F.lit(SALTS), F.lit(2 * SALTS - 1))))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and no other letter; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def salted_group(rows: DataFrame, keys: list[str], merge: list[Column]) -> DataFrame:
    """Aggregates rows by keys and returns the result once for each (keys, salt) that rows have.

    rows needs a column salt. A task hands on one partial result for each key that it has, so that a hot key is no
    more rows than there are tasks. Rows join the result on keys and salt: a hot key is many keys in the join.
    """
    whole = rows.groupBy(*keys).agg(*merge, *salt_marks())
    return whole.withColumn("salt", F.explode(salts_in())).drop("salts", "top")
