"""Thermal planes from .npy, .npz and uncompressed TIFF bytes."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab.functions import names

# Fixed values of the TIFF format: tags, field sizes and sample types.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _STRIP_BYTES, _FORMAT = 256, 257, 258, 259, 273, 277, 279, 339
_FIELD_CODES = {1: "B", 3: "H", 4: "I"}
_SAMPLE_TYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def _tiff_tags(raw: bytes) -> tuple[str, dict[int, list[int]]]:
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    (first,) = struct.unpack_from(order + "I", raw, 4)
    (count,) = struct.unpack_from(order + "H", raw, first)
    tags = {}
    for entry in range(first + 2, first + 2 + 12 * count, 12):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, entry)
        code = _FIELD_CODES.get(kind)
        if code:
            size = struct.calcsize(order + str(n) + code)
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", raw, entry + 8)[0]
            tags[tag] = list(struct.unpack_from(order + str(n) + code, raw, place))
    return order, tags


def _read_tiff(raw: bytes) -> np.ndarray:
    order, tags = _tiff_tags(raw)
    if tags.get(_COMPRESSION, [1])[0] != 1:
        raise ValueError("compressed TIFF")
    kind = _SAMPLE_TYPES[tags.get(_FORMAT, [1])[0], tags.get(_BITS, [1])[0]]
    h, w, samples = tags[_HEIGHT][0], tags[_WIDTH][0], tags.get(_SAMPLES, [1])[0]
    body = b"".join(raw[start : start + size] for start, size in zip(tags[_STRIPS], tags[_STRIP_BYTES]))
    values = np.frombuffer(body, dtype=order + kind, count=h * w * samples)
    return values.reshape((h, w) if samples == 1 else (h, w, samples))


def _read_array(path: str, raw: bytes) -> np.ndarray:
    low = path.lower()
    if low.endswith(".npy"):
        return np.load(io.BytesIO(raw), allow_pickle=False)
    if low.endswith(".npz"):
        with np.load(io.BytesIO(raw), allow_pickle=False) as archive:
            return archive[archive.files[0]]
    return _read_tiff(raw)


def _to_plane(array: np.ndarray) -> np.ndarray | None:
    """Two dimensions as float32; further ones are averaged over the last axis."""
    if array.ndim > 2:
        array = array.astype("float32").mean(axis=-1) if array.shape[-1] > 1 else array[..., 0]
    return array.astype("float32") if array.ndim == 2 else None


def decode_planes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows (image_id, path, h, w, px) from file bytes; what cannot be read keeps its row with null pixels."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"]):
                try:
                    plane = _to_plane(_read_array(name, raw))
                except Exception:  # any malformed file counts as unreadable
                    plane = None
                if plane is None:
                    rows.append((name, None, None, None))
                else:
                    rows.append((name, *plane.shape, plane.ravel()))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "px"])

    decoded = files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(
        decode, "path string, h int, w int, px array<float>"
    )
    return decoded.select(names.stem(F.col("path")).alias("image_id"), "path", "h", "w", "px")


def read_thermal_planes(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    )
    return decode_planes(raw)
