"""Image files: which are taken, their size from the header, and their pixels."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("jpg", "jpeg", "png")
MOST_BYTES = 10 << 20
#: The JPEG markers that begin a frame header.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
SIZE = "struct<width: int, height: int>"


def accepted(path: Column, length: Column) -> Column:
    """Null for files that are taken, else why not."""
    known = F.lower(F.substring_index(path, ".", -1)).isin(*EXTENSIONS) & F.contains(path, F.lit("."))
    return F.when(~known, "extension").when(length == 0, "empty").when(length > MOST_BYTES, "too large")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, content, width and height of the image files below path that are taken."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.where(accepted(F.col("path"), F.col("length")).isNull()).select("path", "content", size(F.col("content")).alias("size"))
    return rows.select("path", "content", "size.width", "size.height")


def png_size(content: Column) -> Column:
    """struct(width, height) from a PNG header, null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    fits = (F.octet_length(content) >= 24) & (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (number(17) > 0) & (number(21) > 0)
    return F.when(fits, F.struct(number(17).cast("int").alias("width"), number(21).cast("int").alias("height")))


def jpeg_dimensions(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the first frame header of a JPEG file."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xFF:  # padding
            at += 1
        elif marker in (0x01, *range(0xD0, 0xD9)):  # markers that stand alone
            at += 2
        else:
            length = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if length < 2:
                return None
            if marker in FRAMES:
                if at + 9 > len(data):
                    return None
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return (width, height) if width and height else None
            at += 2 + length
    return None


def jpeg_size(content: Column) -> Column:
    @F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jpeg_dimensions(f) or (None, None) for f in files], columns=["width", "height"]).astype("Int32")

    return run(content)


def size(content: Column) -> Column:
    """struct(width, height) of PNG and JPEG files; its fields are null for others."""
    jpeg = jpeg_size(content)
    png = png_size(content)
    return F.struct(F.coalesce(png["width"], jpeg["width"]).alias("width"), F.coalesce(png["height"], jpeg["height"]).alias("height"))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """image_id, y, x, b, g, r and whether the pixel is opaque, of the images below path, in Spark's image format."""
    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    index = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda k: F.hex(F.substring(F.col("data"), k * F.col("nChannels") + 1, F.col("nChannels")))))
    rows = images.select(F.col("origin").alias("image_id"), "width", "nChannels", index.alias("k", "v"))
    byte = lambda n: F.conv(F.substring("v", 2 * n - 1, 2), 16, 10).cast("int")
    grey = F.col("nChannels") == 1
    channel = lambda n: F.when(grey, byte(1)).otherwise(byte(n))
    opaque = (F.col("nChannels") < 4) | (byte(4) > 0)
    return rows.select("image_id", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).cast("int").alias("x"), channel(1).alias("b"), channel(2).alias("g"), channel(3).alias("r"), opaque.alias("opaque"))
