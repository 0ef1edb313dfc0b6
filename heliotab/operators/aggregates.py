"""Counts, listings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotab.functions import names, planes
from heliotab.functions.bind import let
from heliotab.operators.skew import collect_chunks, ranked

TIFF_PATTERN = r"(?i)\.tiff?$"
ASSET_KINDS = ("images", "overlays", "thumbs")
FEATURES_PER_COLLECTION = 10_000
COLLECTION_NAME = "anomalies"


def dataset_listing(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Image count per dataset folder (name, mtime), empty ones included, newest first."""
    counts = (
        files.filter(names.is_image(F.col("name"), "dataset"))
        .groupBy(F.col("dataset").alias("name"))
        .agg(F.count("*").alias("count"))
    )
    joined = folders.join(counts, "name", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    return joined.select("name", "count", "mtime").orderBy(F.col("mtime").desc(), "name")


def decode_stats(results: DataFrame, key: str = "split") -> DataFrame:
    """Outcome of decoding per split: ok, fail, total and the first error in file order."""
    failed = ~F.col("ok")
    return results.groupBy(key).agg(
        F.count_if("ok").alias("ok"),
        F.count_if(failed).alias("fail"),
        F.count("*").alias("total"),
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("name"))).alias("first_error"),
    )


def count_thermal(files: DataFrame) -> DataFrame:
    """Thermal TIFF files per dataset, at any depth below its ``thermal`` folder."""
    place = r"^(?:.*/)?([^/]+)/thermal/"
    tiffs = files.filter(F.col("path").rlike(place) & F.col("path").rlike(TIFF_PATTERN))
    return tiffs.groupBy(F.regexp_extract("path", place, 1).alias("dataset")).agg(F.count("*").alias("tif_count"))


def thermal_usage(df: DataFrame, path: str = "thermal_path", px: str = "px") -> DataFrame:
    """One row of totals: planes from TIFF files, from other files, and missing ones."""
    kind = planes.thermal_kind(F.col(path), F.col(px))
    kinds = df.select(kind.alias("kind"))
    return kinds.agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("tif", "other", "missing")], F.count("*").alias("total")
    )


def manifest_counts(preds: DataFrame) -> DataFrame:
    """Boxes per image (the whole list, also where scores or classes are shorter)."""
    return preds.withColumn("n", F.greatest(F.size("boxes"), F.lit(0)).cast("bigint"))


def total_predictions(manifest: DataFrame, key: str = "session") -> DataFrame:
    return manifest.groupBy(key).agg(F.sum("n").alias("total_preds"))


def num_classes(categories: DataFrame, key: str = "split") -> DataFrame:
    return categories.groupBy(key).agg(F.count("id").alias("num_classes"))


def class_names(categories: DataFrame, key: str = "split") -> DataFrame:
    """Class names in the order of their ids; the lists are as long as the label set."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "name")))
    return categories.groupBy(key).agg(F.transform(ordered, lambda c: c["name"]).alias("class_names"))


def channel_histogram(df: DataFrame, channels: str = "channels") -> DataFrame:
    """Images per channel count (3, 4, 5, other) and whether all have four."""
    n = F.col(channels)
    return df.agg(
        F.count_if(n == 3).alias("c3"),
        F.count_if(n == 4).alias("c4"),
        F.count_if(n == 5).alias("c5"),
        F.count_if(~n.isin(3, 4, 5)).alias("other"),
        F.coalesce(F.bool_and(n == 4), F.lit(True)).alias("all_four"),
    )


def asset_urls(files: DataFrame) -> DataFrame:
    """URL of each session file (session, kind, name); image TIFFs come a second time as kind ``tifs``."""
    known = files.filter(F.col("kind").isin(*ASSET_KINDS))
    urls = known.withColumn("url", names.media_url(F.col("session"), F.col("kind"), F.col("name")))
    tifs = (F.col("kind") == "images") & F.lower("url").rlike(TIFF_PATTERN)
    kinds = F.when(tifs, F.array("kind", F.lit("tifs"))).otherwise(F.array("kind"))
    return urls.withColumn("kind", F.explode(kinds)).select("session", "kind", "name", "url")


def session_assets(files: DataFrame, chunk_size: int = 10_000) -> DataFrame:
    """Sorted URL lists per session and kind, in chunks of bounded length."""
    return collect_chunks(asset_urls(files), ["session", "kind"], ["name"], F.col("url"), chunk_size, "urls")


def layer_bounds(features: DataFrame, key: str = "session") -> DataFrame:
    """Extent of the features that have a position."""
    return features.groupBy(key).agg(
        F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east")
    )


def percentile_of(values: Column, q: float) -> Column:
    """Linear-interpolated percentile of an ascending array."""
    place = F.lit(q) * (F.size(values) - 1).cast("double")
    low = F.floor(place).cast("int")
    first = F.get(values, low).cast("double")
    second = F.get(values, F.least(low + 1, F.size(values) - 1)).cast("double")
    return first + (second - first) * (place - low)


def tile_percentiles(px: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """``struct<low,high>`` over the finite pixels of one tile, sorted inside its row: no explode, no shuffle."""
    # sort_array compares in place, where array_sort would call a comparator per pair.
    finite = F.sort_array(F.filter(px, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return let(
        finite, lambda v: F.struct(percentile_of(v, low).alias("low"), percentile_of(v, high).alias("high"))
    )


def feature_collections(features: DataFrame, size: int = FEATURES_PER_COLLECTION, key: str = "session") -> DataFrame:
    """GeoJSON collections (session, chunk, n, geojson) of at most ``size`` features each, in feature order.

    ``features`` has name, kind_rank, det_idx and the text of each feature in ``feature``. A session of any size
    becomes as many collections as it needs; with one chunk the text is the whole layer.
    """
    order = [c for c in ("name", "doc", "kind_rank", "det_idx") if c in features.columns]
    lists = collect_chunks(features, [key], order, F.col("feature"), size, "__features")
    head = F.lit('{"type":"FeatureCollection","features":[')
    tail = F.lit(f'],"name":"{COLLECTION_NAME}"}}')
    return lists.select(
        key,
        "chunk",
        F.size("__features").cast("bigint").alias("n"),
        F.concat(head, F.array_join("__features", ","), tail).alias("geojson"),
    )


def numbered_features(features: DataFrame, key: str = "session") -> DataFrame:
    """Features with their position in the session's layer (for writers that stream them out)."""
    order = [c for c in ("name", "doc", "kind_rank", "det_idx") if c in features.columns]
    return ranked(features, [key], order, "seq")


def session_summary(sessions: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per session: URL of its map layer if present, and how many assets and manifest rows it has.

    The lists themselves come from :func:`session_assets` and the manifest table.
    """
    layer = files.filter((F.col("kind") == "") & (F.col("name") == "anomalies.geojson"))
    present = layer.groupBy("session").agg(F.count("*").alias("__layers"))
    kinds = ("images", "tifs", "overlays", "thumbs")
    assets = asset_urls(files).groupBy("session").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    rows = manifest.groupBy("session").agg(F.count("*").alias("n_manifest"), F.sum("n").alias("total_preds"))
    joined = sessions.join(present, "session", "left").join(assets, "session", "left").join(rows, "session", "left")
    url = F.concat(F.lit("/media/"), F.col("session"), F.lit("/anomalies.geojson"))
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in (*[f"n_{k}" for k in kinds], "n_manifest", "total_preds")]
    return joined.select("session", F.when(F.col("__layers") > 0, url).alias("geojson_url"), *counts)


def image_points(georeferenced: DataFrame) -> DataFrame:
    """Position and URL of each georeferenced image that has a prediction."""
    return georeferenced.select("session", "name", "lat", "lon", "url")
