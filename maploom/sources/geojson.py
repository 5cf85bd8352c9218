"""GeoJSON files as tables, and tables as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "array<double>"
LINE = f"array<{POSITION}>"
POLYGON = f"array<{LINE}>"
#: Arrays around a position in each geometry's coordinates.
DEPTHS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
FEATURE = "struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"


def read(spark: SparkSession, path: str, types: tuple[str, ...] = tuple(DEPTHS)) -> DataFrame:
    """feature_id, kind, rings and properties of the features below path whose geometry is of one of types.

    rings has the depth of a MultiPolygon, array<array<array<array<double>>>>, whatever the kind. Features
    without geometry, or whose coordinates cannot be read, are left out. Files are read whole, in parallel.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    found = F.from_json("value", f"type string, features array<{FEATURE}>, id string, geometry struct<type: string, coordinates: string>, properties map<string, string>")
    parsed = files.select(found.alias("j"))
    lone = F.struct(F.col("j.id").alias("id"), F.col("j.geometry").alias("geometry"), F.col("j.properties").alias("properties"))
    each = parsed.select(F.explode(F.when(F.col("j.type") == "Feature", F.array(lone)).otherwise(F.col("j.features"))).alias("f")).where(F.col("f.geometry.type").isin(*types))
    rings = F.lit(None).cast(f"array<{POLYGON}>")
    for kind, depth in DEPTHS.items():
        inner = POSITION
        for _ in range(depth):
            inner = f"array<{inner}>"
        value = F.from_json("f.geometry.coordinates", inner)
        for _ in range(3 - depth):
            value = F.array(value)
        rings = F.when(F.col("f.geometry.type") == kind, F.when(F.from_json("f.geometry.coordinates", inner).isNotNull(), value)).otherwise(rings)
    return each.select(F.col("f.id").alias("feature_id"), F.col("f.geometry.type").alias("kind"), rings.alias("rings"), F.col("f.properties").alias("properties")).where("rings IS NOT NULL")


def segments(features: DataFrame) -> DataFrame:
    """sid, x1, y1, x2, y2 of the line work of read()."""
    lines = features.where(F.col("kind").isin("LineString", "MultiLineString", "Polygon", "MultiPolygon")).select(F.explode(F.flatten("rings")).alias("line"))
    pairs = F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))
    each = lines.where(F.size("line") > 1).select(F.explode(pairs).alias("p"))
    ends = [F.col(f"p.{e}")[k].alias(f"{c}{n}") for n, e in ((1, "a"), (2, "b")) for k, c in enumerate("xy")]
    rows = each.select(*ends)
    return rows.withColumn("sid", F.xxhash64("x1", "y1", "x2", "y2"))


def write(features: DataFrame, path: str) -> None:
    """One GeoJSON feature a line, out of columns geometry and properties."""
    features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "geometry", "properties")).alias("value")).write.text(path)
