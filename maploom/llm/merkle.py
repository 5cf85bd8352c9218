"""Merkle manifest of a dataset by slot pivots.

Rows are leaves, in order of their id within their source. A level of a tree is a table of nodes (group, pos, n, h).
Grouping by pos div fanout and one conditional aggregate for each slot spreads the children of a parent into
columns: all columns joined make the parent's hash, all but the own one are the siblings of a child. Levels go up
until a group has one node; the nodes that are left, in order of their source, are the leaves of the last tree. On the
way down a parent's row, which has its own path to the root by then, becomes one row for each slot, so that the
paths of siblings travel as one.

A source may hold most rows: positions come from a sort by ranges of (source, id), numbered in each partition and
moved by how many rows of the source stand in earlier partitions. No task has more than its range, and no group is
larger than the fanout. The driver learns one number, the size of the largest source.

Defined results: null values hash as "-"; a null source is a source, before all others; null ids come first in
their source and are never tampered with; rows of one id are in the order of their hashes, so that repeated rows are
leaves of their own and which is which does not matter; a lone leaf is its subroot, and with one source its subroot is
the root; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maploom.llm.shared import written

FANOUT = 3


def field(value: Column) -> Column:
    """A value as it is hashed: its bytes counted, so that no two rows of fields are alike."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows, written in this order over all partitions; part and at say where: at counts the rows of the partition."""
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    return written(placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}))


def with_places(leaves: DataFrame) -> DataFrame:
    """Leaves (source, id, h, tie and others) with group, the number of their source in order, pos in it, and n, its size.

    Runs, the rows of one source in one partition, are at most as many as there are partitions and sources. Spark
    broadcasts them where their table is below its threshold; else rows and runs meet by (source, part), and one
    such key is never more than a partition.
    """
    rows = in_order(leaves, "source", "id", "h", "tie")
    runs = written(rows.groupBy("source", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size")))
    sources = in_order(runs.groupBy("source").agg(F.sum("size").alias("n")), "source")
    # one row for each partition of the sorted sources
    parts = sources.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    numbered = sources.join(F.broadcast(before), "part").select(F.col("source").alias("of"), "n", (F.col("before") + F.col("at")).alias("group"))
    earlier = F.sum("size").over(Window.partitionBy("source").orderBy("part")) - F.col("size")
    runs = runs.withColumn("moved", earlier - F.col("first")).join(numbered, F.col("source").eqNullSafe(F.col("of")))
    runs = written(runs.select(F.col("source").alias("of"), F.col("part").alias("run"), "moved", "n", "group"))
    met = rows.join(runs, (F.col("part") == F.col("run")) & F.col("source").eqNullSafe(F.col("of")))
    return met.withColumn("pos", F.col("at") + F.col("moved")).drop("of", "run", "moved", "part", "at", "tie", "source")


def _slot(k: int) -> str:
    return f"s{k}"


def pivot(nodes: DataFrame, kept: Sequence[str], fanout: int) -> DataFrame:
    """Parents (group, pos, n, h): their children in slot columns, structs of what is kept of a child, h among it."""
    slots = [F.max(F.when(F.pmod("pos", F.lit(fanout)) == k, F.struct(*kept))).alias(_slot(k)) for k in range(fanout)]
    parents = nodes.groupBy("group", F.expr(f"pos div {fanout}").alias("parent")).agg(*slots, F.expr(f"(first(n) + {fanout - 1}) div {fanout}").alias("n"))
    return parents.withColumnRenamed("parent", "pos").withColumn("h", digest(*_hashes(fanout)))


def _hashes(fanout: int) -> list[Column]:
    return [F.coalesce(F.col(_slot(k)).getField("h"), F.lit("")) for k in range(fanout)]


def children(parents: DataFrame, kept: Sequence[str], carried: Sequence[str], fanout: int) -> DataFrame:
    """Parents with their path to one row for each slot taken: its place, its own path, what is kept of it and carried down.

    A path has a struct for each level, lowest first: the siblings before the node and those behind it, each joined.
    """
    h = _hashes(fanout)
    rows = [
        F.struct(
            F.col(_slot(k)).isNotNull().alias("taken"),
            (F.col("pos") * fanout + k).alias("pos"),
            F.struct(F.concat(F.lit(""), *h[:k]).alias("before"), F.concat(F.lit(""), *h[k + 1 :]).alias("behind")).alias("step"),
            *[F.col(_slot(k)).getField(c).alias(c) for c in kept],
        )
        for k in range(fanout)
    ]
    rows = parents.select("group", F.col("path").alias("above"), *carried, F.inline(F.array(*rows))).where("taken")
    return rows.select("group", "pos", F.concat(F.array("step"), "above").alias("path"), *carried, *kept)


Level = tuple[DataFrame, list[str]]


def climb(nodes: DataFrame, kept: list[str], most: int, fanout: int) -> tuple[list[Level], DataFrame]:
    """nodes (group, pos, n, kept), most the largest n, to the parents of each level with what their slots hold, and to
    the last node of each group: (group, h, level), level the one it stands on, 0 for nodes."""
    one = lambda level, rows: rows.where("n = 1").select("group", "h", F.lit(level).alias("level"))
    levels: list[Level] = []
    now, last = nodes, one(0, nodes)
    while most > 1:
        now = written(pivot(now.where("n > 1"), kept, fanout))
        levels.append((now, kept))
        last = last.unionByName(one(len(levels), now))
        most, kept = -(-most // fanout), ["h"]
    return levels, last


def descend(levels: list[Level], nodes: DataFrame, kept: list[str], above: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """above (group, level, path, carried) has a row for each group: where its last node stands and the path from there.
    Returns nodes with their paths."""
    start = lambda level: above.where(F.col("level") == level).select("group", F.lit(0).cast("long").alias("pos"), "path", *carried)
    found = nodes.where("n = 1").join(start(0), ["group", "pos"]).select("group", "pos", "path", *carried, *kept)
    here = None
    for level in range(len(levels), 0, -1):
        parents, own = levels[level - 1]
        here = start(level) if here is None else here.select("group", "pos", "path", *carried).unionByName(start(level))
        here = children(parents.drop("n", "h").join(here, ["group", "pos"]), own, carried, fanout)
    return found if here is None else found.unionByName(here)


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """leaves: source, id, h (the leaf's hash) and further columns. Returns id, h and these, subroot, root and path.

    path is an array with a struct for each level, leaf first, up to the root: the siblings before the node and behind
    it. Columns named group, pos, n, part, at, tie, path, subroot or root are not allowed among the further ones.
    """
    if fanout < 2:
        raise ValueError("fanout is at least 2")
    kept = ["h", "id", *[c for c in leaves.columns if c not in ("source", "id", "h")]]
    nodes = written(with_places(leaves.withColumn("tie", F.monotonically_increasing_id())))
    levels, last = climb(nodes, kept, nodes.agg(F.max("n")).first()[0] or 0, fanout)
    last = written(last)
    count = last.count()
    # the tree over the sources: a source is a leaf, its number the place
    tops = last.select(F.lit(0).cast("long").alias("group"), F.col("group").alias("pos"), F.lit(count).cast("long").alias("n"), "h", "level")
    upper, top = climb(tops, ["h", "level"], count, fanout)
    top = top.first()
    root, height = (top["h"], top["level"]) if top else (None, 0)
    none = F.array().cast("array<struct<before:string,behind:string>>")
    start = leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("group"), F.lit(height).alias("level"), none.alias("path"))
    above = descend(upper, tops, ["h", "level"], start, [], fanout)
    above = written(above.select(F.col("pos").alias("group"), "level", "path", F.col("h").alias("subroot")))
    found = descend(levels, nodes, kept, above, ["subroot"], fanout)
    return found.select(*kept, "subroot", F.lit(root).cast("string").alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with these siblings."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["before"], h, step["behind"]))


def proof(path: Column) -> Column:
    """The siblings of all levels, leaf first, joined."""
    return F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["behind"])))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaf(**changed: Column) -> Column:
    """The hash of a document's row, or of one with a field changed."""
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Each document's leaf, subroot and root, the digest of its proof, and whether the row, tampered with where the
    checksum of its id is even, still folds to the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.lit(False))
    leaf = document_leaf()
    tampered = F.when(even & F.col("text").contains("\n"), document_leaf(text=F.regexp_replace("text", "\n", "")))
    found = manifest(docs.select("source", F.col("doc_id").alias("id"), leaf.alias("h"), tampered.alias("tampered")))
    found = found.select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "h"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 by bits: each byte enters, then eight shifts.
OP11_SQL = """
WITH RECURSIVE
docs AS (
  SELECT doc_id, source, text,
         concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                     lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS tampered
  FROM docs),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
up AS (
  SELECT grp, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY grp, level, pos // 3, n),
subroots AS (SELECT grp, level, h, count(*) OVER () AS groups FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, grp AS pos, groups AS n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (
  SELECT grp, level, pos, n, h FROM up UNION ALL SELECT -1, level, pos, n, h FROM top),
slots AS (
  SELECT grp, level, pos // 3 AS parent, n, max(h) FILTER (pos % 3 = 0) AS s0, coalesce(max(h) FILTER (pos % 3 = 1), '') AS s1, coalesce(max(h) FILTER (pos % 3 = 2), '') AS s2
  FROM nodes WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT grp AS own, doc_id, pos AS leaf_pos, grp, 0 AS level, pos, n, tampered AS acc, '' AS proof FROM placed
  UNION ALL
  SELECT own, doc_id, leaf_pos, CASE WHEN w.n > 1 THEN w.grp ELSE -1 END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN w.n > 1 THEN w.pos // 3 ELSE w.grp END, CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE (SELECT max(groups) FROM subroots) END,
         CASE WHEN w.n = 1 THEN acc WHEN w.pos % 3 = 0 THEN sha256(acc || s1 || s2) WHEN w.pos % 3 = 1 THEN sha256(s0 || acc || s2) ELSE sha256(s0 || s1 || acc) END,
         CASE WHEN w.n = 1 THEN proof WHEN w.pos % 3 = 0 THEN proof || s1 || s2 WHEN w.pos % 3 = 1 THEN proof || s0 || s2 ELSE proof || s0 || s1 END
  FROM walk w LEFT JOIN slots s ON w.n > 1 AND s.grp = w.grp AND s.level = w.level AND s.parent = w.pos // 3
  WHERE w.n > 1 OR w.grp >= 0)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = r.h AS verified
FROM placed p JOIN subroots s USING (grp) JOIN (SELECT h FROM top WHERE n = 1) r ON true
JOIN walk w ON w.own = p.grp AND w.leaf_pos = p.pos AND w.grp = -1 AND w.n = 1
"""
