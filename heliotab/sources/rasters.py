"""Colour rasters through Spark's image source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHANNELS = "blue array<int>, green array<int>, red array<int>"


def _split_channels(data: pd.Series, height: pd.Series, width: pd.Series, bands: pd.Series) -> pd.DataFrame:
    rows = []
    for raw, h, w, n in zip(data, height, width, bands):
        if h is None or h < 0 or not n:
            rows.append((None, None, None))
            continue
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(int(h) * int(w), int(n)).astype(np.int32)
        rows.append(tuple(pixels[:, c if n >= 3 else 0] for c in range(3)))
    return pd.DataFrame(rows, columns=["blue", "green", "red"])


def normalise_image_struct(images: DataFrame, image: str = "image") -> DataFrame:
    """Rows (path, height, width, blue, green, red, reason) from the image struct.

    Alpha is dropped and grey is expanded. A file that does not decode has height -1 and gets ``read_failed``.
    """
    field = lambda name: F.col(f"{image}.{name}")
    failed = field("height") < 0
    channels = F.pandas_udf(_split_channels, _CHANNELS)
    split = channels(field("data"), field("height"), field("width"), field("nChannels"))
    return images.withColumn("__channels", split).select(
        field("origin").alias("path"),
        F.when(~failed, field("height")).alias("height"),
        F.when(~failed, field("width")).alias("width"),
        "__channels.blue",
        "__channels.green",
        "__channels.red",
        F.when(failed, "read_failed").alias("reason"),
    )


def read_rasters(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    raw = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    return normalise_image_struct(raw)
