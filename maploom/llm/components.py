"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import salt_of, salted_group, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds m, the least of u and its neighbours; a hub's neighbours are dealt over salts."""
    rows = edges.withColumn("salt", salt_of("v"))
    least = salted_group(rows, ["u"], [F.least(F.min("v"), F.first("u")).alias("m")])
    # merged: a broadcast would gather the edges on the driver
    return rows.join(least.hint("merge"), ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    return met.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number, and sums and differences of two 64-bit hashes."""
    one, two = F.xxhash64("u", "v"), F.xxhash64("v", F.lit("mark"), "u")
    halves = [F.sum(part) for h in (one, two) for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1)))]
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(one), F.bit_xor(two), *halves).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs, without nulls or loops; returns (vertex, root), root the least of its component.

    Vertices that are their own root are not listed. The number of rounds grows with the logarithm of the
    largest component. Each round is a written table; only a count and checksums reach the driver.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(now)
    while True:
        now = written(_small_star(_large_star(now)))
        if (mark_now := _mark(now)) == seen:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        seen = mark_now
