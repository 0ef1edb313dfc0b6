"""Quality report after training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.operators.evaluate import coco_eval
from heliotab.operators.joins import with_class_names


def quality_report(dets: DataFrame, gts: DataFrame, classes: DataFrame) -> DataFrame:
    """Average precision overall and per class, with class names."""
    scores = coco_eval(dets, gts).withColumn("class_id_text", F.col("class"))
    overall = scores.filter("class IS NULL").select("metric", F.lit("(all)").alias("classname"), "value")
    per_class = scores.filter("class IS NOT NULL").withColumn("class", F.col("class").cast("int"))
    named = with_class_names(per_class, classes).select("metric", "classname", "value")
    return overall.unionByName(named)
