"""Writers. Rows go out as Spark partitions them; nothing is gathered to write a file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.functions import names
from heliotab.operators.aggregates import COLLECTION_NAME, numbered_features
from heliotab.operators.skew import collect_chunks


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON row per image below its session's folder, packed, with the reason where scoring failed."""
    rows = df.select("session", "file", "boxes", "scores", "classes", "reason")
    rows.write.mode(mode).partitionBy("session").option("compression", "lz4").json(path)


def geojson_lines(features: DataFrame, key: str = "session") -> DataFrame:
    """Lines (session, seq, value) that make up one GeoJSON collection per session, head and tail included."""
    numbered = numbered_features(features, key)
    body = numbered.select(
        key, "seq", F.concat(F.when(F.col("seq") > 1, ",").otherwise(""), F.col("feature")).alias("value")
    )
    frame = numbered.groupBy(key).agg(F.max("seq").alias("last"))
    head = frame.select(key, F.lit(0).cast("bigint").alias("seq"), F.lit('{"type":"FeatureCollection","features":[').alias("value"))
    tail = frame.select(key, (F.col("last") + 1).alias("seq"), F.lit(f'],"name":"{COLLECTION_NAME}"}}').alias("value"))
    return body.unionByName(head).unionByName(tail)


def write_geojson(features: DataFrame, path: str, key: str = "session", mode: str = "overwrite") -> None:
    """GeoJSON per session, as part files that give one collection when read in name order.

    Lines are range-partitioned by session and position, so a session of any size is written by many tasks.
    """
    lines = geojson_lines(features, key)
    ordered = lines.repartitionByRange(key, "seq").sortWithinPartitions(key, "seq")
    ordered.select(key, "value").write.mode(mode).partitionBy(key).text(path)


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("session", "file", "overlay", "thumb", "n").write.mode(mode).partitionBy("session").json(path)


def pairs_documents(pairs: DataFrame, key: str = "split", chunk_size: int = 100_000) -> DataFrame:
    """JSON objects (split, chunk, n, text) from colour to thermal path, each of at most ``chunk_size`` pairs."""
    entry = F.struct(F.col("rgb_path").alias("key"), F.col("thermal_path").alias("value"))
    lists = collect_chunks(pairs.select(key, "rgb_path", "thermal_path"), [key], ["rgb_path"], entry, chunk_size, "entries")
    return lists.select(
        key,
        "chunk",
        F.size("entries").cast("bigint").alias("n"),
        F.to_json(F.map_from_entries("entries")).alias("text"),
    )


def write_pairs(pairs: DataFrame, path: str, key: str = "split", mode: str = "overwrite") -> None:
    pairs_documents(pairs, key).select(key, F.col("text").alias("value")).write.mode(mode).partitionBy(key).text(path)


def model_meta_record(df: DataFrame) -> DataFrame:
    """Registry rows of trained models, with the mode they were really trained in."""
    return df.select(
        "name",
        F.when(F.col("use_thermal"), "rgbtherm").otherwise("rgb").alias("input_mode"),
        F.col("num_classes").cast("int").alias("num_classes"),
        F.coalesce("score_thresh_test", F.lit(0.6)).alias("score_thresh_test"),
        "class_names",
    )


def append_model_meta(df: DataFrame, path: str) -> None:
    model_meta_record(df).write.mode("append").json(path)


def plane_records(df: DataFrame) -> DataFrame:
    """Thermal planes under the name ``<stem>_thermal``, as 32-bit floats."""
    return df.select(
        F.concat(names.stem(F.col("name")), F.lit("_thermal")).alias("image_id"),
        "h",
        "w",
        F.col("px").cast("array<float>").alias("px"),
    )


def write_planes(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    plane_records(df).write.mode(mode).parquet(path)


def absent(src: DataFrame, dst: DataFrame, key: str = "name") -> DataFrame:
    """Rows of ``src`` whose key ``dst`` does not have yet."""
    return src.join(dst.select(key), key, "left_anti")


def copy_if_absent(src: DataFrame, dst_path: str, key: str = "name") -> None:
    """Append to a table the rows it does not have yet; rows that are there stay as they are.

    A table that does not exist is empty. Of rows that share a key the least one is copied.
    """
    spark = src.sparkSession
    once = src.groupBy(key).agg(F.min(F.struct(*src.columns)).alias("r")).select("r.*")
    try:
        dst = spark.read.schema(src.schema).option("ignoreMissingFiles", "true").parquet(dst_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        dst = src.limit(0)
    absent(once, dst, key).write.mode("append").parquet(dst_path)
