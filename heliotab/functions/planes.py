"""Raster planes kept as one row-major array per image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotab.functions.bind import let

_HELD_PIXELS = 1 << 20


def thermal_kind(path: Column, px: Column) -> Column:
    return (
        F.when(px.isNull(), "missing").when(F.lower(path).rlike(r"\.tiff?$"), "tif").otherwise("other")
    )


def normalize_thermal_infer(px: Column) -> Column:
    """Scoring-time scaling: above 1.5 the values are degrees out of 100, else stretched between min and max.

    NaN is ignored for the limits and stays in place.
    """
    known = F.filter(px, lambda v: ~F.isnan(v))
    zero = F.lit(0.0)
    keep_nan = lambda v, scaled: F.when(F.isnan(v), v.cast("double")).otherwise(scaled)

    def scale(limits: Column) -> Column:
        low, high = limits["low"].cast("double"), limits["high"].cast("double")
        span = high - low
        percent = F.transform(
            px, lambda v: keep_nan(v, F.least(F.greatest(v.cast("double"), zero), F.lit(100.0)) / F.lit(100.0))
        )
        stretched = F.transform(px, lambda v: keep_nan(v, (v.cast("double") - low) / span))
        flat = F.transform(px, lambda v: keep_nan(v, zero))
        return F.when(high > 1.5, percent).when(span > 0, stretched).otherwise(flat)

    return let(F.struct(F.array_min(known).alias("low"), F.array_max(known).alias("high")), scale)


def normalize_thermal_train(px: Column) -> Column:
    """Training-time scaling: divide by a maximum above 1, then clip to [0, 1]; a NaN maximum divides nothing."""
    high = F.array_max(px).cast("double")
    divisor = lambda m: F.when((m > 1) & ~F.isnan(m), m).otherwise(F.lit(1.0))
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    def scale(d: Column) -> Column:
        return F.transform(
            px, lambda v: F.when(F.isnan(v), v.cast("double")).otherwise(clip(v.cast("double") / d))
        )

    return let(divisor(high), scale)


def mean_of_planes(planes: Column) -> Column:
    """Average of equally long planes held in one array of arrays."""
    zeros = F.transform(planes[0], lambda v: F.lit(0.0))
    count = F.size(planes).cast("double")
    total = F.aggregate(planes, zeros, lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda v: v / count)


PARTIAL_BYTES = 64_000_000  # of sums that a task holds before it hands them on


def _hashable(row: tuple) -> tuple:
    return tuple(tuple(v) if isinstance(v, list) else v for v in row)


def _listed(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as one list column."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _sums_of(px: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Values of a plane, 0 where they are null, and 1 where they aren't."""
    values = px.values.cast(pa.float64())
    return values.fill_null(0.0).to_numpy(zero_copy_only=False), np.asarray(values.is_valid()).astype(np.int64)


def _padded_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
    out = longer.copy()
    out[: len(shorter)] += shorter
    return out


def mean_planes(df: DataFrame, key: str = "image_id", px: str = "px") -> DataFrame:
    """Planes of an image in separate rows to one plane: the mean of the values at each position.

    Null pixels don't count; a plane that is shorter than others has no say beyond its end, and null or empty planes
    have none. Planes are added up in each task as arrays, up to PARTIAL_BYTES of sums at a time, and only these sums
    are shuffled: no pixel is a row, and an image with very many planes is as many rows as tasks hold it.
    """
    keys = [c for c in df.columns if c not in (px, "band")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([row[0][i] for row in held.values()], t) for i, t in enumerate(types)]
            sums, counts = [_listed([row[n] for row in held.values()], t) for n, t in ((1, pa.float64()), (2, pa.int64()))]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, sums, counts], [*keys, "__sum", "__n"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            rows = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            for i, row in enumerate(rows):
                total, n = _sums_of(batch.column(px)[i])
                of = _hashable(row)
                if of in held:
                    held[of][1:] = [_padded_sum(held[of][1], total), _padded_sum(held[of][2], n)]
                    continue
                held[of] = [row, total, n]
                size += total.nbytes * 2
                if size > PARTIAL_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total, n = None, None, None
        for batch in batches:
            out: list[tuple] = []
            types = [batch.schema.field(k).type for k in keys]
            rows = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            for i, row in enumerate(rows):
                more, count = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("__sum", "__n"))
                if here is not None and _hashable(row) == _hashable(here):
                    total, n = _padded_sum(total, more), _padded_sum(n, count)
                    continue
                if here is not None:
                    out.append((here, total, n))
                here, total, n = row, more, count
            if out:
                yield means(out, types)
        if here is not None:
            yield means([(here, total, n)], types)

    def means(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([r[0][i] for r in rows], t) for i, t in enumerate(types)]
        values = [np.divide(t, n, out=np.full(len(t), np.nan), where=n > 0) for _, t, n in rows]
        nulls = np.concatenate([n == 0 for _, _, n in rows])
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        flat = pa.array(np.concatenate(values), mask=nulls)
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*keys, px])

    filled = df.select(*keys, F.col(px)).filter(F.size(px) > 0)
    partial = filled.mapInArrow(add, f"{kinds}, __sum array<double>, __n array<bigint>")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = partial.repartition(parts, *keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(merge, f"{kinds}, `{px}` array<double>")


def _grid(n: int, new_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper source index and the share of the upper one, per target index."""
    place = np.clip((np.arange(new_n) + 0.5) * n / new_n - 0.5, 0, n - 1)
    low = np.floor(place).astype(int)
    return low, np.minimum(low + 1, n - 1), place - low


def _nearest(plane: np.ndarray, new_h: int, new_w: int) -> np.ndarray:
    h, w = plane.shape
    rows, cols = np.arange(new_h) * h // new_h, np.arange(new_w) * w // new_w
    return plane[np.ix_(np.minimum(rows, h - 1), np.minimum(cols, w - 1))]


def _linear(plane: np.ndarray, new_h: int, new_w: int) -> np.ndarray:
    r0, r1, fy = _grid(plane.shape[0], new_h)
    c0, c1, fx = _grid(plane.shape[1], new_w)
    top = plane[np.ix_(r0, c0)] * (1 - fx) + plane[np.ix_(r0, c1)] * fx
    bottom = plane[np.ix_(r1, c0)] * (1 - fx) + plane[np.ix_(r1, c1)] * fx
    return top * (1 - fy)[:, None] + bottom * fy[:, None]


def _resizer(method):
    def resize(px: pd.Series, h: pd.Series, w: pd.Series, new_h: pd.Series, new_w: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if p is None else method(np.asarray(p, dtype=float).reshape(int(a), int(b)), int(c), int(d)).ravel()
                for p, a, b, c, d in zip(px, h, w, new_h, new_w)
            ]
        )

    return F.pandas_udf(resize, "array<double>")


def resize_nearest(px: Column, h: Column, w: Column, new_h: Column, new_w: Column) -> Column:
    return _resizer(_nearest)(px, h, w, new_h, new_w)


def resize_linear(px: Column, h: Column, w: Column, new_h: Column, new_w: Column) -> Column:
    return _resizer(_linear)(px, h, w, new_h, new_w)


def fit_plane(px: Column, h: Column, w: Column, new_h: Column, new_w: Column, mode: str) -> Column:
    """Plane in the wanted size; only planes of another size go through Python."""
    fits = (h == new_h) & (w == new_w)
    resize = {"nearest": resize_nearest, "linear": resize_linear}[mode]
    return F.coalesce(F.when(fits, px), resize(F.when(~fits, px), h, w, new_h, new_w))


def resize_plane(df: DataFrame, new_h: Column, new_w: Column, mode: str = "nearest", px: str = "px") -> DataFrame:
    """Resize the plane of each row to (new_h, new_w), over Arrow batches."""
    resize = {"nearest": resize_nearest, "linear": resize_linear}[mode]
    resized = df.withColumn(px, resize(F.col(px), F.col("h"), F.col("w"), new_h, new_w))
    return resized.withColumns({"h": new_h.cast("int"), "w": new_w.cast("int")})


def scaled_for_scoring(plane: np.ndarray) -> np.ndarray:
    """:func:`normalize_thermal_infer` of one plane."""
    known = plane[~np.isnan(plane)]
    if not len(known):
        return plane
    low, high = known.min(), known.max()
    if high > 1.5:
        return np.clip(plane, 0.0, 100.0) / 100.0
    return (plane - low) / (high - low) if high > low else np.where(np.isnan(plane), plane, 0.0)


def scaled_for_training(plane: np.ndarray) -> np.ndarray:
    """:func:`normalize_thermal_train` of one plane."""
    high = plane.max() if len(plane) else 0.0
    return np.clip(plane / high if high > 1 else plane, 0.0, 1.0)


def fitted(plane: np.ndarray, h: int, w: int, new_h: int, new_w: int, mode: str) -> np.ndarray:
    """:func:`fit_plane` of one plane."""
    if (h, w) == (new_h, new_w):
        return plane
    return (_nearest if mode == "nearest" else _linear)(plane.reshape(h, w), new_h, new_w).ravel()


def stacked(colours: list[np.ndarray], thermal: np.ndarray | None, layout: str) -> np.ndarray | None:
    """:func:`stack_channels` of one image: its channels one after another."""
    if layout == "train":
        band = np.zeros(len(colours[0])) if thermal is None else np.clip(thermal, 0.0, 1.0)
        return np.concatenate([np.asarray(c, dtype=float) / 255.0 for c in colours] + [band])
    return None if thermal is None else np.concatenate([*[np.asarray(c, dtype=float) for c in colours], thermal * 255.0])


def _checked(layout: str, pixel: str) -> None:
    if layout not in ("train", "score"):
        raise ValueError(f"unknown layout {layout!r}")
    if pixel not in ("float", "double"):
        raise ValueError(f"unknown pixel type {pixel!r}")


def stack_channels(channels: list[Column], thermal: Column, layout: str, pixel: str = "double") -> Column:
    """Four channels in CHW order, as one array of ``pixel`` (float or double), stacked over Arrow batches.

    ``train``: colours / 255 and a thermal plane in [0, 1], zeros where thermal is missing.
    ``score``: blue, green, red as they are and 255 * thermal; null where thermal is missing.
    """
    _checked(layout, pixel)

    def stack(a: pd.Series, b: pd.Series, c: pd.Series, band: pd.Series) -> pd.Series:
        plane = lambda t: None if t is None else np.asarray(t, dtype=float)
        return pd.Series([None if x is None else stacked([x, y, z], plane(t), layout) for x, y, z, t in zip(a, b, c, band)])

    return F.pandas_udf(stack, f"array<{pixel}>")(*channels, thermal)


def training_tensor(
    channels: list[Column], thermal: Column, th: Column, tw: Column, height: Column, width: Column, pixel: str = "float"
) -> Column:
    """Training tensor of an image in one pass over Arrow batches: the thermal plane scaled, fitted to the image by the
    nearest pixel, and stacked behind the colours; zeros where it is missing."""
    _checked("train", pixel)

    kind = pa.float32() if pixel == "float" else pa.float64()

    def build(
        a: pa.Array, b: pa.Array, c: pa.Array, t: pa.Array, th: pa.Array, tw: pa.Array, h: pa.Array, w: pa.Array
    ) -> pa.Array:
        pixels = lambda column, row: column[row].values.to_numpy(zero_copy_only=False)
        parts, known, together = [], a.is_valid().to_numpy(zero_copy_only=False), 0
        out, held = [], []

        def put() -> None:
            if held:
                out.append(pa.array(np.concatenate(held), kind, from_pandas=True))
                held.clear()

        # Tensors are in Arrow as soon as some are done; a whole batch is never a list of arrays.
        for row in range(len(a)):
            size = 0
            if known[row]:
                plane = None
                if t[row].is_valid:
                    sizes = [int(x[row].as_py()) for x in (th, tw, h, w)]
                    plane = fitted(scaled_for_training(pixels(t, row).astype(float)), *sizes, "nearest")
                held.append(stacked([pixels(x, row) for x in (a, b, c)], plane, "train").astype(kind.to_pandas_dtype()))
                size = len(held[-1])
            parts.append(size)
            together += size
            if together >= _HELD_PIXELS:
                put()
                together = 0
        put()
        starts = pa.array(np.concatenate([[0], np.cumsum(parts)]), pa.int32(), mask=np.append(~known, False))
        return pa.ListArray.from_arrays(starts, pa.concat_arrays(out) if out else pa.array([], kind))

    return F.arrow_udf(build, f"array<{pixel}>")(*channels, thermal, th, tw, height, width)


def stretch_u8(value: Column, low: Column, high: Column) -> Column:
    """Stretch between two percentiles to 0..255, truncated; NaN and layers without a finite pixel become 0."""
    top = F.when(high <= low, low + F.lit(1.0)).otherwise(high)
    part = F.least(F.greatest((value - low) / (top - low), F.lit(0.0)), F.lit(1.0))
    known = value.isNotNull() & ~F.isnan(value) & low.isNotNull()
    return F.when(known, (part * F.lit(255.0)).cast("int")).otherwise(F.lit(0))


def stretch_plane(px: Column, limits: Column) -> Column:
    """:func:`stretch_u8` of a whole plane between the limits ``struct<low,high>``."""
    return let(limits, lambda p: F.transform(px, lambda v: stretch_u8(v, p["low"], p["high"])))
