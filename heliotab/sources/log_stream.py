"""Log lines as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log_stream(spark: SparkSession, folder: str, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Tail of the text files of a folder: (line, file)."""
    reader = spark.readStream
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def read_table_stream(spark: SparkSession, folder: str, schema, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream, for logs that were collected into tables. The table is one file or a
    folder of part files."""
    # A pattern that matches the name alone: the source takes a single file by pattern only.
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")
