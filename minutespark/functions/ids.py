"""Stable document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122, in hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"


def uuid5_url(url: Column) -> Column:
    """UUID version 5 of a (normalised) URL, as lower-case text."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(url, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike(UUID), F.lit(False))


def split_collisions(rows: DataFrame) -> DataFrame:
    """Marks ``failed`` all rows but that of the smallest url under one doc_id (groups of a few rows)."""
    return rows.withColumn("failed", F.col("url") != F.min("url").over(Window.partitionBy("doc_id")))
