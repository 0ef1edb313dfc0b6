"""COCO and YOLO labels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from heliotab import schemas
from heliotab.functions import names
from heliotab.sources.files import existing, path_table

# Annotation file names in order of preference.
COCO_NAMES = (
    "_annotations.coco.json",
    "_annotations.coco",
    "annotations.json",
    "train.json",
    "valid.json",
    "test.json",
)
_SECTIONS = ("images", "annotations", "categories")
_SCHEMAS = dict(zip(_SECTIONS, (schemas.IMAGES, schemas.ANNOTATIONS, schemas.CATEGORIES)))
_READ_SIZE = 1 << 20
_BATCH = 4096


def coco_candidates(split_dirs: DataFrame, file_names: tuple[str, ...] = COCO_NAMES) -> DataFrame:
    """Candidate annotation files (split, rank, path) of each split folder."""
    listed = F.array(*[F.lit(n) for n in file_names])
    return split_dirs.select("split", F.posexplode(listed).alias("rank", "name")).select(
        "split", "rank", F.concat_ws("/", F.regexp_replace("split", "/+$", ""), "name").alias("path")
    )


def first_candidate(candidates: DataFrame) -> DataFrame:
    """The existing candidate of the lowest rank per split."""
    return candidates.groupBy("split").agg(F.min_by("path", "rank").alias("path"))


def _elements(stream, wanted: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """Elements of the wanted top-level arrays of a JSON object, one at a time.

    The text is read in blocks, so the memory needed is that of one element, not of the file.
    """
    decoder = json.JSONDecoder()
    blank = re.compile(r"[\s,:]*")
    buffer, pos, done = "", 0, False

    def fill() -> bool:
        nonlocal buffer, pos, done
        block = "" if done else stream.read(_READ_SIZE)
        done = done or not block
        buffer, pos = buffer[pos:] + block, 0
        return bool(block)

    def skip() -> str:
        nonlocal pos
        while True:
            pos = blank.match(buffer, pos).end()
            if pos < len(buffer) or not fill():
                return buffer[pos : pos + 1]

    def value():
        nonlocal pos
        while True:
            try:
                found, end = decoder.raw_decode(buffer, pos)
            except json.JSONDecodeError:
                if not fill():
                    raise
                continue
            # A number that ends at the edge of the block may go on in the next one.
            if end == len(buffer) and fill():
                continue
            pos = end
            return found

    if skip() != "{":
        return
    pos += 1
    while skip() not in ("}", ""):
        key = value()
        if key in wanted and skip() == "[":
            pos += 1
            while skip() not in ("]", ""):
                yield key, json.dumps(value())
            pos += 1
        else:
            skip()
            value()


def _element_frames(pairs: Iterator[tuple[str, str, str]]) -> Iterator[pd.DataFrame]:
    rows = []
    for row in pairs:
        rows.append(row)
        if len(rows) == _BATCH:
            yield pd.DataFrame(rows, columns=["split", "section", "element"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["split", "section", "element"])


def coco_elements(files: DataFrame) -> DataFrame:
    """Rows (split, section, element) of annotation files given as (split, path)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pyarrow import fs

        def rows():
            for batch in batches:
                for split, path in zip(batch["split"], batch["path"]):
                    system, inner = fs.FileSystem.from_uri(path)
                    with io.TextIOWrapper(system.open_input_stream(inner), encoding="utf-8") as text:
                        for section, element in _elements(text, _SECTIONS):
                            yield split, section, element

        yield from _element_frames(rows())

    return files.select("split", "path").mapInPandas(read, "split string, section string, element string")


def coco_text_elements(docs: DataFrame) -> DataFrame:
    """As :func:`coco_elements` for documents that are rows already, given as (split, text).

    A document is parsed once, in whole: an element is a struct with a field per section, of which that of its own
    section is set. Only a section that holds something else than objects is read as texts, parsed one by one.
    """
    kinds = {s: f"struct<{schema}>" for s, schema in _SCHEMAS.items()}
    typed = F.from_json("text", ", ".join(f"{s} array<{kind}>" for s, kind in kinds.items()))
    texts = F.from_json("text", ", ".join(f"{s} array<string>" for s in _SECTIONS))

    def elements(section: str) -> Column:
        one_by_one = F.transform(texts[section], lambda text: F.from_json(text, _SCHEMAS[section]))
        wrapped = lambda e: F.struct(*[(e if s == section else F.lit(None).cast(k)).alias(s) for s, k in kinds.items()])
        return F.transform(F.coalesce(F.col(f"doc.{section}"), one_by_one), wrapped)

    sections = F.array(*[F.struct(F.lit(s).alias("section"), elements(s).alias("elements")) for s in _SECTIONS])
    rows = docs.select("split", "text", typed.alias("doc")).select("split", F.explode(sections).alias("s"))
    return rows.select("split", "s.section", F.explode("s.elements").alias("element"))


class CocoTables(tuple):
    """Images, annotations and categories, each with its split; made of rows with a struct for each section."""

    def __new__(cls, records: DataFrame) -> CocoTables:
        table = lambda s: records.filter(F.col("section") == s).select("split", f"{s}.*")
        images, annotations, categories = map(table, _SECTIONS)
        made = super().__new__(
            cls, (images.withColumnRenamed("id", "image_id"), annotations.withColumnRenamed("id", "ann_id"), categories)
        )
        made.records = records
        return made

    def union(self, **shapes: Callable[[Column], dict[str, Column]]) -> DataFrame:
        """Rows of all three tables in one pass, each with the split and the columns that its shape makes of its element."""
        shaped = [
            F.when(F.col("section") == s, F.struct(*[c.alias(name) for name, c in shapes[s](F.col(s)).items()])) for s in _SECTIONS
        ]
        rows = self.records.filter(F.col("section").isin(*_SECTIONS))
        return rows.select("split", F.coalesce(*shaped).alias("r")).select("split", "r.*")


def coco_tables(elements: DataFrame) -> CocoTables:
    """Images, annotations and categories, each with its split, of elements as texts or parsed."""
    texts = elements.schema["element"].dataType == StringType()
    parsed = {s: F.from_json("element", _SCHEMAS[s]) if texts else F.col(f"element.{s}") for s in _SECTIONS}
    return CocoTables(
        elements.select("split", "section", *[F.when(F.col("section") == s, c).alias(s) for s, c in parsed.items()])
    )


def read_coco(
    spark: SparkSession, split_dirs: list[str], file_names: tuple[str, ...] = COCO_NAMES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of the first annotation file found in each split folder."""
    splits = path_table(spark, split_dirs).withColumnRenamed("path", "split")
    files = first_candidate(existing(coco_candidates(splits, file_names)))
    return coco_tables(coco_elements(files))


def parse_yolo(lines: DataFrame, stem: str = "file_stem", line: str = "line") -> DataFrame:
    """Label lines ``class cx cy w h`` to rows; other lines are left out."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    rows = lines.select(
        F.col(stem).alias("file_stem"),
        F.get(parts, F.lit(0)).try_cast("int").alias("cls"),
        number(1).alias("cx"),
        number(2).alias("cy"),
        number(3).alias("w"),
        number(4).alias("h"),
    )
    return rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("cls", "cx", "cy", "w", "h")))


def read_yolo(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path)
    return parse_yolo(lines.select(names.stem(F.col("_metadata.file_name")).alias("file_stem"), F.col("value").alias("line")))
