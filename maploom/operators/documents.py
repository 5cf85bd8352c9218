"""GeoJSON documents: normal form, nested keys, merges and signatures."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT = ("id", "map_id", "created_at", "updated_at")


def collection(feature: Column) -> Column:
    """A FeatureCollection of one feature."""
    return F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))


def feature(x: Column, y: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_last")).select("_last.*")


def data_uri(image: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("image/png")), F.lit(";base64,"), F.base64(image))


def as_array(value: Column) -> Column:
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def signature(rows: DataFrame, group: str, key: str, *content: str) -> DataFrame:
    """A digest of each group's rows, whatever their order: their number and the sums of two parts of each row's MD5."""
    own = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *content))))
    part = lambda at: F.sum(F.conv(F.substring(own, at, 8), 16, 10).cast("long"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), part(1).alias("low"), part(9).alias("high"))


def _rename(value, change):
    if isinstance(value, dict):
        return {change(k): _rename(v, change) for k, v in value.items()}
    return [_rename(v, change) for v in value] if isinstance(value, list) else value


def _renamed(change) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(_rename(json.loads(t), change), ensure_ascii=False, separators=(",", ":")))

    return run


def camel_keys(text: Column) -> Column:
    """JSON text with all keys in camel case: an underscore and a small letter become the capital."""
    return _renamed(lambda k: re.sub(r"_([a-z])", lambda m: m[1].upper(), k))(text)


def snake_keys(text: Column) -> Column:
    """JSON text with all keys in snake case: each capital becomes an underscore and the small letter."""
    return _renamed(lambda k: re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), k))(text)
