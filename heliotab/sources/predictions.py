"""Tolerant reader of prediction JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab import schemas
from heliotab.functions import names
from heliotab.functions.bind import let
from heliotab.sources.files import read_texts

_BOXES = "array<array<double>>"


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _first_filled(*lists: Column) -> Column:
    """First list that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(item) > 0, item) for item in lists])


def _integer(value: Column, path: str) -> Column:
    return F.coalesce(_get(value, path, "int"), _get(value, path, "double").cast("int"))


def _labels(doc: Column, path: str) -> Column:
    """Texts of a list of classes, with a point where the document has one: a name is looked up by plain digits only."""

    def text(item: Column) -> Column:
        plain, kind = _get(item, "$", "string"), F.schema_of_variant(item)
        # 1.0 is a decimal without decimals; whole numbers of up to 18 digits are none.
        pointed = kind.rlike(r"^DECIMAL\(([1-9]|1[0-8]),0\)$")
        return F.when(pointed, F.concat(plain, F.lit(".0"))).otherwise(plain)

    return F.transform(_get(doc, path, "array<variant>"), text)


def _document(
    file: Column, boxes: Column, scores: Column, classes: Column, labels: Column, reason: Column, corrupt: Column
) -> Column:
    filled = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return F.struct(
        file.alias("file"),
        filled(boxes, _BOXES).alias("boxes"),
        filled(scores, "array<double>").alias("scores"),
        filled(classes, "array<int>").alias("classes"),
        filled(labels, "array<string>").alias("labels"),
        reason.alias("reason"),
        corrupt.alias("_corrupt"),
    )


def _from_object(doc: Column, stem: Column) -> Column:
    return _document(
        F.coalesce(F.nullif(_get(doc, "$.file", "string"), F.lit("")), stem),
        _first_filled(_get(doc, "$.boxes", _BOXES), _get(doc, "$.bboxes", _BOXES)),
        _get(doc, "$.scores", "array<double>"),
        _get(doc, "$.classes", "array<int>"),
        _labels(doc, "$.classes"),
        _get(doc, "$.reason", "string"),
        F.lit(False),
    )


def _item(item: Column) -> Column:
    """Box of a list item (four numbers or more count) and what an object says about it."""

    def read(parts: Column) -> Column:
        plain = F.slice(parts, 1, 4)
        named = _first_filled(*[_get(item, f"$.{key}", "array<double>") for key in ("bbox", "box", "b")])
        numbers = F.transform(plain, lambda p: _get(p, "$", "double"))
        null = lambda key: F.coalesce(F.is_variant_null(_get(item, key, "variant")), F.lit(False))
        return F.struct(
            F.when(parts.isNull(), named).when(F.size(parts) >= 4, numbers).alias("box"),
            parts.isNull().alias("is_object"),
            F.coalesce(_get(item, "$.score", "double"), F.lit(0.0)).alias("score"),
            F.coalesce(_integer(item, "$.class"), _integer(item, "$.cls"), F.lit(0)).alias("class"),
            (null("$.score") | null("$.class")).alias("null"),
        )

    return let(_get(item, "$", "array<variant>"), read)


def _from_list(doc: Column, stem: Column) -> Column:
    def lists(usable: Column) -> Column:
        return let(F.filter(usable, lambda i: i["is_object"]), lambda objects: collect(usable, objects))

    def collect(usable: Column, objects: Column) -> Column:
        missing = F.size(usable) - F.size(objects)
        padded = lambda field, zero: F.concat(
            F.transform(objects, lambda i: i[field]), F.array_repeat(zero, missing)
        )
        return _document(
            stem,
            F.transform(usable, lambda i: F.slice(i["box"], 1, 4)),
            padded("score", F.lit(0.0)),
            padded("class", F.lit(0)),
            F.transform(padded("class", F.lit(0)), lambda c: c.cast("string")),
            F.lit(None).cast("string"),
            F.exists(objects, lambda i: i["null"]),
        )

    items = F.transform(_get(doc, "$", "array<variant>"), _item)
    return let(F.filter(items, lambda i: F.size(i["box"]) >= 4), lists)


def coerce_predictions(df: DataFrame, value: str = "value", stem: str = "stem") -> DataFrame:
    """Canonical (file, boxes, scores, classes, labels, reason) of prediction documents of several shapes.

    * an object with ``boxes`` or ``bboxes``, ``scores`` and ``classes``, taken as they are;
    * a list of objects (``bbox``/``box``/``b``, ``score``, ``class``/``cls``) or of lists of four numbers. Scores and
      classes come from the objects only and are padded with zeros at the end;
    * anything else is empty.

    ``labels`` are the classes as they are written, for looking up their names. ``_corrupt`` marks documents that are not JSON, or list items that carry a null score or class.
    """
    nothing = F.lit(None)
    first = F.left(F.ltrim(F.col(value), F.lit(" \t\r\n")), F.lit(1))
    name = F.col(stem)

    def canonical(doc: Column) -> Column:
        other = _document(name, nothing, nothing, nothing, nothing, nothing.cast("string"), doc.isNull())
        return (
            F.when(doc.isNotNull() & (first == "{"), _from_object(doc, name))
            .when(doc.isNotNull() & (first == "["), _from_list(doc, name))
            .otherwise(other)
        )

    # Generated columns are computed once; filters and join conditions on them do not parse the text again.
    return df.select("*", F.inline(F.array(let(F.try_parse_json(F.col(value)), canonical))))


def recognised(preds: DataFrame) -> DataFrame:
    """Documents in which boxes, scores or classes hold anything."""
    return preds.filter((F.size("boxes") > 0) | (F.size("scores") > 0) | (F.size("classes") > 0))


def detection_list(threshold: float | None = None, labels: bool = False) -> Column:
    """Detections of a document as ``array<struct<det_idx,box,score,class>>``, with ``label`` if there are labels;
    unequal lists end at the shortest.

    The threshold is applied inside the array, so that dropped detections never become rows.
    """
    shortest = F.least(F.size("boxes"), F.size("scores"), F.size("classes"))
    cut = lambda c: F.slice(c, F.lit(1), shortest)
    lists = {"boxes": "box", "scores": "score", "classes": "class"} | ({"labels": "label"} if labels else {})
    zipped = F.transform(
        F.arrays_zip(*[cut(c).alias(name) for c, name in lists.items()]),
        lambda d, i: F.struct(i.alias("det_idx"), *[d[name].alias(name) for name in lists.values()]),
    )
    if threshold is not None:
        zipped = F.filter(zipped, lambda d: d["score"].isNull() | (d["score"] >= F.lit(float(threshold))))
    return zipped


def explode_detections(preds: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row per detection of each document."""
    kept = [c for c in preds.columns if c not in ("boxes", "scores", "classes", "labels", "_corrupt", "reason")]
    dets = preds.select(*kept, F.explode(detection_list(threshold)).alias("d")).select(*kept, "d.*")
    corner = {n: F.get("box", F.lit(i)) for i, n in enumerate(("x1", "y1", "x2", "y2"))}
    return dets.withColumns(corner)


def read_predictions(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    texts = read_texts(spark, path, glob)
    return coerce_predictions(texts.withColumn("stem", names.stem(F.col("path"))), "text", "stem").drop("text")


def read_prediction_table(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as the prediction writer stores them, one JSON row per image below its session's folder."""
    return spark.read.schema(f"{schemas.PREDICTIONS}, session string").json(path)
