"""Scoring sessions: choose the model and the mode, score, and keep records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.functions import names
from heliotab.operators.joins import resolve_weights, trained_runs
from heliotab.operators.listings import latest, scored_or_reason
from heliotab.operators.scoring import Predictor, inputs_for, predict, scoring_mode


def choose_model(runs: DataFrame, files: DataFrame, meta: DataFrame, requests: DataFrame) -> DataFrame:
    """Model, mode and weights of each request (session, model or null, use_thermal).

    A request without a model takes the newest trained run.
    """
    newest = latest(trained_runs(runs, files)).select("name").scalar()
    named = requests.withColumn("model", F.coalesce("model", newest))
    weights = resolve_weights(runs, files).select(F.col("run").alias("model"), "weights")
    modes = meta.select(F.col("name").alias("model"), "input_mode", "score_thresh_test", "class_names")
    joined = named.join(weights, "model", "left").join(modes, "model", "left")
    return joined.withColumn("mode", scoring_mode(F.col("use_thermal"), F.col("input_mode")))


def scoring_session(
    rasters: DataFrame,
    planes: DataFrame,
    predictor: Callable[[], Predictor],
    mode: str,
    session: str,
) -> tuple[DataFrame, DataFrame]:
    """Predictions of a session and its manifest (every readable image, also with no detection)."""
    ready, failed = inputs_for(rasters, planes if mode == "rgbtherm" else None, mode)
    preds = scored_or_reason(predict(ready, predictor), failed).withColumn("session", F.lit(session))
    return preds, manifest(preds)


def manifest(preds: DataFrame) -> DataFrame:
    """Manifest rows (session, file, overlay, thumb, n) of the images that could be read."""
    picture = F.concat(names.stem(F.col("file")), F.lit(".jpg"))
    readable = preds.filter(F.coalesce(F.col("reason"), F.lit("")) != "read_failed")
    return readable.select(
        "session",
        "file",
        names.media_url(F.col("session"), "overlays", picture).alias("overlay"),
        names.media_url(F.col("session"), "thumbs", picture).alias("thumb"),
        F.size("boxes").cast("bigint").alias("n"),
    )
