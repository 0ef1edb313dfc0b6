"""Batch scoring with a user's own model, and the audit of a scoring run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotab.functions.planes import fitted, scaled_for_scoring
from heliotab.operators.listings import scored_or_reason

# A predictor takes an image (channels, height, width) of float32 and returns boxes, scores and classes. One marked with
# :func:`batched` takes images of one size (number, channels, height, width) and returns these three for each.
Predictor = Callable[[np.ndarray], tuple[list, list, list] | list[tuple[list, list, list]]]
BATCH_IMAGES = 16
BATCH_BYTES = 64_000_000
_COLOURS = ("blue", "green", "red")
_PREDICTED = "file string, boxes array<array<double>>, scores array<double>, classes array<int>"


def batched(predictor: Callable[[np.ndarray], list[tuple[list, list, list]]]) -> Predictor:
    """Mark a predictor that takes images by the batch."""
    predictor.takes_batches = True
    return predictor


def inputs_for(rasters: DataFrame, planes: DataFrame | None, mode: str) -> tuple[DataFrame, DataFrame]:
    """Rows to score (file, h, w, colours and, for thermal scoring, the plane th, tw, tpx) and failure rows (file, reason).

    ``rasters`` has file, height, width, blue, green, red and reason; ``planes`` has file, h, w, px, where null pixels
    stand for a plane that could not be read. Thermal scoring needs a readable plane per image.
    """
    plane: list[str] = []
    if mode == "rgb":
        reason = F.col("reason")
        joined = rasters
    elif mode == "rgbtherm":
        if planes is None:
            raise ValueError("thermal scoring needs planes")
        plane = ["th", "tw", "tpx"]
        side = planes.select("file", F.col("h").alias("th"), F.col("w").alias("tw"), F.col("px").alias("tpx"), F.lit(True).alias("found"))
        joined = rasters.join(side, "file", "left")
        reason = (
            F.when(F.col("reason").isNotNull(), F.col("reason"))
            .when(F.col("found").isNull(), "no_thermal_sidecar")
            .when(F.col("tpx").isNull(), "thermal_read_failed")
        )
    else:
        raise ValueError(f"unknown scoring mode {mode!r}")
    judged = joined.withColumn("why", reason)
    size = [F.col("height").cast("int").alias("h"), F.col("width").cast("int").alias("w")]
    ready = judged.filter("why IS NULL").select("file", *size, *_COLOURS, *plane)
    failed = judged.filter("why IS NOT NULL").select("file", F.col("why").alias("reason"))
    return ready, failed


def _image(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """Channels of one image as float32: blue, green, red and, where there is one, 255 times the scaled plane."""
    h, w = batch.column("h")[row].as_py(), batch.column("w")[row].as_py()
    pixels = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
    image = np.empty((4 if "tpx" in batch.schema.names else 3, h * w), dtype=np.float32)
    for channel, name in enumerate(_COLOURS):
        image[channel] = pixels(name)
    if len(image) == 4:
        scaled = scaled_for_scoring(pixels("tpx").astype(np.float64))
        image[3] = fitted(scaled, batch.column("th")[row].as_py(), batch.column("tw")[row].as_py(), h, w, "linear") * 255.0
    return image.reshape(-1, h, w)


def predict(inputs: DataFrame, predictor_factory: Callable[[], Predictor], batch_images: int = BATCH_IMAGES) -> DataFrame:
    """Predictions (file, boxes, scores, classes) of prepared inputs; the model is built once per task.

    Pixels go from Arrow to float32 buffers of the model's layout in the task and are no column of any table. Images of
    one size that follow each other are given to the model together, at most ``batch_images`` and BATCH_BYTES.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = predictor_factory()
        together = getattr(predictor, "takes_batches", False)
        schema = pa.schema(
            [("file", pa.string()), ("boxes", pa.list_(pa.list_(pa.float64()))), ("scores", pa.list_(pa.float64())), ("classes", pa.list_(pa.int32()))]
        )
        for batch in batches:
            found: list[tuple] = []
            files, waiting = batch.column("file").to_pylist(), []

            def ask() -> None:
                if waiting:
                    images = np.stack(waiting)
                    found.extend(predictor(images) if together else [predictor(image) for image in images])  # noqa: B023
                    waiting.clear()  # noqa: B023

            for row in range(batch.num_rows):
                image = _image(batch, row)
                most = min(batch_images, max(1, BATCH_BYTES // max(1, image.nbytes)))
                if waiting and (waiting[0].shape != image.shape or len(waiting) >= most):
                    ask()
                waiting.append(image)
            ask()
            boxes, scores, classes = zip(*found) if found else ((), (), ())
            columns = [files, [[list(map(float, b)) for b in row] for row in boxes], [list(map(float, s)) for s in scores]]
            columns.append([list(map(int, c)) for c in classes])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return inputs.mapInArrow(score, _PREDICTED)


def batch_score(
    rasters: DataFrame,
    planes: DataFrame | None = None,
    predictor: Callable[[], Predictor] | None = None,
    mode: str = "rgb",
) -> DataFrame:
    """Predictions of every image: boxes, scores and classes, or the reason why there are none."""
    if predictor is None:
        raise ValueError("a predictor factory is needed")
    ready, failed = inputs_for(rasters, planes, mode)
    return scored_or_reason(predict(ready, predictor), failed)


def scoring_mode(use_thermal: Column, input_mode: Column) -> Column:
    """Thermal scoring only if asked for and the model was trained with it."""
    thermal = use_thermal & (F.lower(F.coalesce(input_mode, F.lit("rgb"))) == "rgbtherm")
    return F.when(thermal, "rgbtherm").otherwise("rgb")


def scoring_audit(files: DataFrame, runs: DataFrame, params: dict[str, object]) -> DataFrame:
    """Audit record per run: size and short checksum of its weights (-1 and ``missing`` without a file), and settings.

    ``runs`` has run and weights, ``files`` has run, name and content.
    """
    sums = files.select(
        "run",
        F.col("name").alias("weights"),
        F.length("content").cast("bigint").alias("size"),
        F.substring(F.md5("content"), 1, 8).alias("sum"),
    )
    joined = runs.join(sums, ["run", "weights"], "left")
    return joined.select(
        "run",
        "weights",
        F.coalesce("size", F.lit(-1).cast("bigint")).alias("weights_bytes"),
        F.coalesce("sum", F.lit("missing")).alias("weights_md5"),
        *[F.lit(v).alias(k) for k, v in params.items()],
    )


def num_classes(categories: DataFrame, fn: Callable[[pd.DataFrame], int] | None = None, key: str = "split") -> DataFrame:
    """Class count per split from the user's own function, or the built-in count where it fails or is not given."""
    from heliotab.operators.aggregates import num_classes as built_in

    counted = built_in(categories, key)
    if fn is None:
        return counted

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        try:
            answer = int(fn(group))
        except Exception:  # whatever goes wrong in user code, the built-in count stands
            answer = None
        return pd.DataFrame({key: [group[key].iloc[0]], "own": pd.array([answer], dtype="Int64")})

    kind = categories.schema[key].dataType.simpleString()
    own = categories.groupBy(key).applyInPandas(ask, f"{key} {kind}, own bigint")
    return counted.join(own, key, "left").select(key, F.coalesce("own", "num_classes").alias("num_classes"))


def build_examples(df: DataFrame, mapper: Callable[[DataFrame], DataFrame] | list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Training examples through a user's mapper, or a chain of them: functions from DataFrame to DataFrame."""
    for step in mapper if isinstance(mapper, list) else [mapper]:
        df = df.transform(step)
    return df
