"""One document for each key, by Spark's own writers, so that a failed attempt leaves nothing and any file system will do.

A document is the file in folder `<name of key column>=<key>` of the path. Rows of a key are its lines, in order: they
stream through one task's writer and are never gathered in memory. Writing again replaces the documents of the keys
that are written, and no others. A key is not null; its characters that a file name can't have are escaped by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _written(lines: DataFrame, path: str, key: str, order: list[str]) -> None:
    """lines (key, order, value): each key's values in order, as the lines of its document."""
    rows = lines.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    rows.select(key, "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def read(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key and text of the documents under path, without the line end that Spark puts behind each."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col(key).cast("string").alias(key), F.regexp_replace("value", r"\n\z", "").alias("text"))


def write_texts(texts: DataFrame, path: str, key: str, text: str = "text") -> None:
    """A text document for each row; key is unique, a null text is an empty document."""
    _written(texts.select(key, F.lit(0).alias("_n"), F.coalesce(text, F.lit("")).alias("value")), path, key, ["_n"])


def extraction_report(source: Column, lines: Column, at: Column) -> Column:
    """The text document of what was read from a picture: its name, when, and the blocks found (an array of strings)."""
    # fixed values: the two headings
    return F.concat(F.lit("=== OCR EXTRACTION  ===\n"), F.lit("Source File: "), source, F.lit("\nDate extraction: "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n=== TEXTE EXTRAIT ===\n\n"), F.array_join(lines, "\n"))


def report_name(source: Column, at: Column) -> Column:
    """The document's name: when, and the source's name without its last extension."""
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.regexp_replace(source, r"(?<=.)\.[^.]*$", ""))


def _listed(rows: DataFrame, path: str, key: str, order: str, item: Column, head: str, tail: str, keys: DataFrame | None) -> None:
    """JSON documents: a head, an item a row with commas between, a tail. Keys of `keys` without rows get empty lists."""
    own = rows.where(F.col(key).isNotNull()).select(key, F.lit(1).alias("_part"), F.col(order).alias("_order"), item.alias("_item"))
    every = own.select(key).distinct() if keys is None else own.select(key).unionByName(keys.select(key)).distinct()
    none = F.lit(None).cast(own.schema["_order"].dataType)
    ends = every.select(key, F.explode(F.array(F.struct(F.lit(0).alias("_part"), F.lit(head).alias("_item")), F.struct(F.lit(2).alias("_part"), F.lit(tail).alias("_item")))).alias("e")).select(key, "e._part", none.alias("_order"), "e._item")
    # the first item stands alone, each further one behind a comma: a key's least is found without gathering it
    first = own.groupBy(key).agg(F.min(F.struct("_order", "_item")).alias("_first"))
    marked = own.join(first, key).withColumn("value", F.when(F.col("_order").eqNullSafe(F.col("_first._order")), F.col("_item")).otherwise(F.concat(F.lit(","), "_item")))
    _written(marked.select(key, "_part", "_order", "value").unionByName(ends.select(key, "_part", "_order", F.col("_item").alias("value"))), path, key, ["_part", "_order"])


def write_collections(features: DataFrame, path: str, key: str, order: str, feature: str = "feature", keys: DataFrame | None = None) -> None:
    """A FeatureCollection for each key: its features, a column of structs or JSON texts, by order (unique within a key).

    Keys of the table `keys` that have no feature get an empty collection; without it there is none for them.
    """
    kind = features.schema[feature].dataType.typeName()
    item = F.col(feature) if kind == "string" else F.to_json(F.col(feature))
    _listed(features.where(F.col(feature).isNotNull()), path, key, order, item, '{"type":"FeatureCollection","features":[', "]}", keys)


def write_shapes_metadata(shapes: DataFrame, path: str, key: str, order: str, image_area: float, keys: DataFrame | None = None) -> None:
    """A JSON list for each key of its described shapes (operators.shapes), numbered by order from 1: morphology, box, centre
    and outline. order is unique within a key."""
    from pyspark.sql import Window

    c = F.col
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    size = F.when(F.lit(image_area) > 0, c("area") / image_area).otherwise(0.0)
    points = F.transform("points", lambda p: F.array(p["x"], p["y"])) if "points" in shapes.columns else F.transform("measures.outline", lambda p: F.array(p["x"], p["y"]))
    says = F.struct(
        number.alias("shape_id"),
        F.struct(c("area"), size.alias("relative_size"), c("aspect_ratio"), c("solidity"), c("extent"), c("num_vertices"), c("perimeter")).alias("morphology"), "bounding_box", "center",
        F.struct(F.lit("Polygon").alias("type"), F.struct(points.alias("contour_points"), c("bounding_box"), c("center")).alias("pixel_coords")).alias("geometry"),
    )
    rows = shapes.select(key, order, F.to_json(says).alias("_says"))
    _listed(rows, path, key, order, c("_says"), "[", "]", keys)


#: Types of pictures that are taken, and the most bytes of one.
IMAGE_TYPES, MOST_BYTES = ("image/jpeg", "image/jpg", "image/png"), 10 * 1024 * 1024


def with_thumbnails(projects: DataFrame, uploads: DataFrame, types: tuple[str, ...] = IMAGE_TYPES, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """projects (project_id, user_id, image and others) with the last accepted picture of uploads, and what became of each upload.

    uploads: (project_id, user_id, content_type, content, at). One is refused, in this order, for its type, for a project
    that is not there or not the user's, for no content, for too much; else it is "ok", and the latest of a project stays.
    """
    c = F.col
    owned = projects.select(c("project_id").alias("_p"), c("user_id").alias("_u"))
    met = uploads.join(owned, (c("project_id") == c("_p")) & (c("user_id") == c("_u")), "left")
    refusal = (
        F.when(~F.coalesce(c("content_type").isin(*types), F.lit(False)), "unsupported type").when(c("_p").isNull(), "project not found")
        .when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty image").when(F.octet_length("content") > most, "image too large").otherwise("ok")
    )
    results = met.withColumn("status", refusal).drop("_p", "_u")
    latest = results.where("status = 'ok'").groupBy("project_id").agg(F.max_by("content", "at").alias("_image"))
    saved = projects.join(latest, "project_id", "left").withColumn("image", F.coalesce("_image", "image")).drop("_image")
    return saved.select(projects.columns), results
