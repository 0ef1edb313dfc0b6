"""Zip archives of images."""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab.functions import names

_BATCH_BYTES = 32 << 20
_BATCH_ROWS = 10_000
# What reading a damaged, encrypted or unusually packed member raises.
_DAMAGE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError, ValueError)


def expand_archive_bytes(files: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Members (archive, member, content) of archives given as (archive, content); a broken archive gives no rows.

    A member that can't be read has null content; only members with one of the ``extensions`` (in lower case) are
    decompressed, if these are given. Members leave in batches of bounded size and number, whatever archives they are
    of: an archive never has to fit twice into memory, and many small ones leave together.
    """
    return files.select("archive", "content").mapInArrow(
        lambda batches: _expand(batches, extensions), "archive string, member string, content binary"
    )


def _expand(batches: Iterator[pa.RecordBatch], extensions: tuple[str, ...] | None) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for archive, raw in zip(batch.column("archive").to_pylist(), batch.column("content")):
            try:
                opened = zipfile.ZipFile(io.BytesIO(raw.as_py()))
            except zipfile.BadZipFile:
                continue
            with opened:
                for info in opened.infolist():
                    if info.is_dir() or extensions and not info.filename.lower().endswith(extensions):
                        continue
                    if rows and (held + info.file_size > _BATCH_BYTES or len(rows) >= _BATCH_ROWS):
                        yield _members(rows)
                        rows, held = [], 0
                    try:
                        content = opened.read(info)
                    except _DAMAGE:
                        content = None
                    rows.append((archive, info.filename, content))
                    held += info.file_size
    if rows:
        yield _members(rows)


def _members(rows: list[tuple]) -> pa.RecordBatch:
    names_, kinds = ["archive", "member", "content"], [pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names_)


def expand_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Image members of the archives in a folder: (archive, member, name, content)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)
    members = expand_archive_bytes(raw.select(F.col("path").alias("archive"), "content"), names.DATASET_EXTENSIONS)
    return image_members(members)


def image_members(members: DataFrame) -> DataFrame:
    kept = members.filter(names.is_image(F.col("member"), "dataset"))
    return kept.select("archive", "member", names.basename(F.col("member")).alias("name"), "content")
