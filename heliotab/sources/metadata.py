"""Small JSON documents: model metadata, manifests, thermal pairs and user GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab import schemas
from heliotab.functions import names
from heliotab.sources.files import read_texts

DEFAULT_MODE = "rgb"


def parse_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Colour to thermal paths; malformed documents give no rows.

    A text may hold several objects, one after another on lines of their own, as ``write_pairs`` makes them.
    """
    kept = [c for c in docs.columns if c != text]
    # A line break between } and { can't stand within an object.
    single = docs.select(*kept, F.explode(F.split(F.col(text), r"(?<=\})\s*\n\s*(?=\{)")).alias("__object"))
    pairs = F.from_json(F.col("__object"), "map<string,string>")
    return single.select(*kept, F.explode(pairs).alias("rgb_path", "thermal_path"))


def read_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_pairs(read_texts(spark, path)).select("rgb_path", "thermal_path")


def parse_model_meta(docs: DataFrame, text: str = "text") -> DataFrame:
    """Metadata with defaults; a missing or malformed document is as good as an empty one."""
    kept = [c for c in docs.columns if c != text]
    meta = F.from_json(F.col(text), schemas.MODEL_META)
    rows = docs.select(*kept, meta.alias("m")).select(*kept, "m.*")
    return rows.withColumns(
        {
            "input_mode": F.coalesce("input_mode", F.lit(DEFAULT_MODE)),
            "num_classes": F.coalesce("num_classes", F.lit(0)),
            "class_names": F.coalesce("class_names", F.array().cast("array<string>")),
        }
    )


def read_model_meta(spark: SparkSession, runs_root: str | list[str]) -> DataFrame:
    """One row per ``model_meta.json`` below the runs folder, named after its run."""
    texts = read_texts(spark, runs_root, "model_meta.json")
    return parse_model_meta(texts.select(names.basename(names.folder(F.col("path"))).alias("name"), "text"))


def parse_manifest(docs: DataFrame, text: str = "text") -> DataFrame:
    kept = [c for c in docs.columns if c != text]
    items = F.from_json(F.col(text), schemas.MANIFEST)
    return docs.select(*kept, F.explode(items).alias("i")).filter("i IS NOT NULL").select(*kept, "i.*")


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Manifest rows (session, file, overlay, thumb, n) below a path, in both forms that exist.

    A ``manifest.json`` is one list, named after its folder; ``write_manifest`` stores a row a line below a folder per
    session, in as many files as there are tasks. What isn't JSON gives no rows.
    """
    texts = read_texts(spark, path, "manifest.json")
    single = parse_manifest(texts.select(names.basename(names.folder(F.col("path"))).alias("session"), "text"))
    reader = spark.read.schema("file string, overlay string, thumb string, n int").option("recursiveFileLookup", "true")
    lines = reader.option("pathGlobFilter", "part-*").json(path)
    # The session is in the path: escaped as the name of a folder, and that as part of a URI.
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    session = plain(plain(F.regexp_extract("_metadata.file_path", r"/session=([^/]*)/[^/]*$", 1)))
    session = F.nullif(F.nullif(session, F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(""))
    named = lines.select(session.alias("session"), "file", "overlay", "thumb", "n")
    return single.unionByName(named.filter("coalesce(file, overlay, thumb, cast(n AS string)) IS NOT NULL"))


def parse_geojson(docs: DataFrame, text: str = "text") -> DataFrame:
    """Features of GeoJSON documents (collections or single features) with their raw geometry.

    Points also get lat and lon; documents that are not JSON give no rows.
    """
    kept = [c for c in docs.columns if c != text]
    parsed = docs.select(*kept, F.try_parse_json(F.col(text)).alias("g"))
    listed = F.coalesce(
        F.try_variant_get("g", "$.features", "array<variant>"),
        F.when(F.try_variant_get("g", "$.type", "string") == "Feature", F.array("g")),
    )
    rows = parsed.select(*kept, F.posexplode(listed).alias("idx", "f"))
    point = F.try_variant_get("f", "$.geometry.coordinates", "array<double>")
    return rows.select(
        *kept,
        "idx",
        F.try_variant_get("f", "$.geometry.type", "string").alias("geometry_type"),
        F.get(point, F.lit(1)).alias("lat"),
        F.get(point, F.lit(0)).alias("lon"),
        F.to_json(F.try_variant_get("f", "$.geometry", "variant")).alias("geometry"),
        F.to_json(F.try_variant_get("f", "$.properties", "variant")).alias("properties"),
    )


def read_geojson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_geojson(read_texts(spark, path))
