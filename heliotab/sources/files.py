"""File listings, raw bytes and whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab.functions import names


def _binary(spark: SparkSession, root: str | list[str], recursive: bool, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def list_files(
    spark: SparkSession, root: str | list[str], recursive: bool = False, glob: str | None = None, content: bool = False
) -> DataFrame:
    """The ``files`` table: path parts, size and time; bytes are read only when asked for."""
    raw = _binary(spark, root, recursive, glob)
    listed = raw.select(
        "path",
        names.basename(names.folder(F.col("path"))).alias("dataset"),
        names.basename(F.col("path")).alias("name"),
        names.stem(F.col("path")).alias("stem"),
        names.suffix(F.col("path")).alias("ext"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        *(["content"] if content else []),
    )
    return listed


def filter_images(files: DataFrame, policy: str = "dataset", path: str = "path") -> DataFrame:
    return files.filter(names.is_image(F.col(path), policy))


def list_images(spark: SparkSession, root: str | list[str], policy: str = "dataset", recursive: bool = False) -> DataFrame:
    """Image files of a folder under one of the listing policies ``dataset``, ``scan`` and ``predict``."""
    return filter_images(list_files(spark, root, recursive), policy)


def read_texts(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """One row (path, text) per file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def path_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Table of given paths, for names that Spark's readers hide (those that start with ``_`` or ``.``)."""
    return spark.createDataFrame([(p,) for p in paths], "path string")


def existing(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path exists as a file, tested on the executors through the file system of the path."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            keep = []
            for value in batch[path]:
                system, inner = fs.FileSystem.from_uri(value)
                keep.append(system.get_file_info(inner).type == fs.FileType.File)
            yield batch[keep]

    return paths.mapInPandas(probe, paths.schema)
