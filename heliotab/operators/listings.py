"""Sorted listings, latest entries, unions and upload rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.functions import names


def listing(df: DataFrame) -> DataFrame:
    """Newest first; equal times by name."""
    return df.orderBy(F.col("mtime").desc(), "name")


def latest(df: DataFrame, key: str | None = None) -> DataFrame:
    """Newest entry (of each key), without sorting; no row where there is no entry."""
    newest = F.max_by("name", F.struct("mtime", "name")).alias("name")
    stamp = F.max("mtime").alias("mtime")
    if key:
        return df.groupBy(key).agg(newest, stamp)
    return df.agg(newest, stamp).filter("name IS NOT NULL")


def order_by_name(df: DataFrame, name: str = "name") -> DataFrame:
    return df.orderBy(name)


def build_features(points: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Image points and anomaly polygons in one table; the sort key puts an image's point before its polygons."""
    first = points.withColumns({"kind_rank": F.lit(0), "det_idx": F.lit(-1)})
    return first.unionByName(anomalies.withColumn("kind_rank", F.lit(1)), allowMissingColumns=True)


def scored_or_reason(scored: DataFrame, failed: DataFrame) -> DataFrame:
    """Scored rows and failure rows in one table; failures have empty lists."""
    empty = {
        "boxes": F.array().cast("array<array<double>>"),
        "scores": F.array().cast("array<double>"),
        "classes": F.array().cast("array<int>"),
    }
    return scored.unionByName(failed.withColumns(empty), allowMissingColumns=True)


def upload_plan(files: DataFrame, key: str = "upload") -> DataFrame:
    """Which files of an upload count: its archives if there are any, else its images.

    ``role`` is ``archive`` or ``image``.
    """
    is_zip = F.lower("name").endswith(".zip")
    with_zip = files.groupBy(key).agg(F.bool_or(is_zip).alias("has_zip"))
    joined = files.join(with_zip, key)
    role = F.when(is_zip, "archive").when(~F.col("has_zip") & names.is_image(F.col("name"), "dataset"), "image")
    return joined.withColumn("role", role).filter("role IS NOT NULL").drop("has_zip")
