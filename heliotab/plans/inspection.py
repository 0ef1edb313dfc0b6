"""Inspection report: predictions to map features, counts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.functions import geo, names
from heliotab.operators.detections import SCORE_THRESHOLD
from heliotab.operators.joins import georeference, shared_keys, with_class_names
from heliotab.sources.predictions import detection_list, recognised


def located_features(located: DataFrame, classes: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """One point per document with any prediction, and a square polygon per detection that reaches the threshold.

    Both come out of one pass over the documents: the point is the first entry of the list that is exploded.
    """
    written = "labels" in located.columns
    fields = {"box": "array<double>", "score": "double", "class": "int"} | ({"label": "string"} if written else {})
    point = F.struct(F.lit(-1).alias("det_idx"), *[F.lit(None).cast(kind).alias(name) for name, kind in fields.items()])
    entries = F.concat(F.array(point), detection_list(threshold, written))
    kept = ["session", "doc", "name", "lat", "lon", "url"]
    rows = located.select(*kept, F.explode(entries).alias("d")).select(*kept, "d.*")
    # Like a score, a class that is null counts as 0.
    rows = rows.withColumn("class", F.when(F.col("det_idx") >= 0, F.coalesce("class", F.lit(0))))
    named = with_class_names(rows, classes, label="label" if written else None)
    is_point = F.col("det_idx") < 0
    score = F.coalesce("score", F.lit(0.0))
    image = F.struct(F.lit("image").alias("type"), F.col("name"), F.col("url"))
    anomaly = F.struct(
        F.lit("anomaly").alias("type"),
        F.col("name").alias("image"),
        score.alias("score"),
        F.col("class"),
        F.col("classname"),
        F.col("box").alias("bbox_pixel"),
        F.lit("approx_square").alias("polygon_note"),
    )
    lat, lon = F.col("lat"), F.col("lon")
    text = F.when(is_point, geo.point_feature(lat, lon, image)).otherwise(geo.polygon_feature(lat, lon, anomaly))
    return named.select(
        *kept,
        F.when(is_point, 0).otherwise(1).alias("kind_rank"),
        "det_idx",
        F.when(~is_point, score).alias("score"),
        "class",
        F.when(~is_point, F.col("classname")).alias("classname"),
        text.alias("feature"),
    )


def locate(preds: DataFrame, images: DataFrame, geo_points: DataFrame) -> DataFrame:
    """Recognised predictions of existing images with a position, and the image's URL.

    ``preds`` has doc, file and the lists; ``images`` has session and name; ``geo_points`` has name, lat and lon. Where
    ``preds`` and ``geo_points`` have a session, images are matched within it.
    """
    known = recognised(preds).withColumnRenamed("file", "name")
    located = georeference(known, images.select("session", "name"), geo_points)
    return located.withColumn("url", names.media_url(F.col("session"), "images", F.col("name")))


def inspection_features(
    preds: DataFrame, images: DataFrame, geo_points: DataFrame, classes: DataFrame, threshold: float = SCORE_THRESHOLD
) -> DataFrame:
    """All map features, points before the polygons of the same document."""
    return located_features(locate(preds, images, geo_points), classes, threshold)


def inspection_report(
    preds: DataFrame, images: DataFrame, geo_points: DataFrame, classes: DataFrame, threshold: float = SCORE_THRESHOLD
) -> DataFrame:
    """Per session: images on the map, anomalies on the map, their mean position and the detections in all.

    One pass over the located predictions: the lists are counted where they are, so no detection becomes a row.
    """
    named = preds.withColumnRenamed("file", "name")
    drawn = images.select("session", "name").join(named, shared_keys(images, named))
    points = geo_points.select(*shared_keys(drawn, geo_points), "lat", "lon")
    located = drawn.join(points, shared_keys(drawn, points), "left")
    usable = (F.size("boxes") > 0) | (F.size("scores") > 0) | (F.size("classes") > 0)
    mapped = usable & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    shortest = F.least(F.size("boxes"), F.size("scores"), F.size("classes"))
    over = F.size(
        F.filter(
            F.slice("scores", F.lit(1), shortest), lambda s: s.isNull() | (s >= F.lit(float(threshold)))
        )
    )
    return located.groupBy("session").agg(
        F.count_if(mapped).alias("image_points"),
        F.sum(F.when(mapped, over).otherwise(0)).alias("anomalies"),
        F.sum(F.size("boxes")).alias("total_preds"),
        F.min(F.when(mapped, F.col("lat"))).alias("south"),
        F.min(F.when(mapped, F.col("lon"))).alias("west"),
        F.max(F.when(mapped, F.col("lat"))).alias("north"),
        F.max(F.when(mapped, F.col("lon"))).alias("east"),
    )
