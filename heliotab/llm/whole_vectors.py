"""Vectors of whole numbers, as operators 11 to 13 take them: floors of scaled components, added up exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Floors up to here keep squared distances and inner products of up to 256 components within 62 bits.
LIMIT = 1 << 26


def finite(vector: str) -> Column:
    """Whether a vector takes part: not null, no component null or not finite. The empty vector does."""
    ok = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False))


def floors(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, a row a vector. All vectors have ``width`` components.

    A floor beyond LIMIT is an error: sums of its products might not fit a long, and a wrong sum is worse.
    """
    if not len(column) or not width:
        return np.zeros((len(column), width), np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    x = np.floor(x * scale)
    if np.abs(x).max() > LIMIT or width > 256:
        raise ValueError(f"components times {scale} must lie within {LIMIT}, and vectors have 256 components at most")
    return x.astype(np.int64)


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a bigint column, 0 where it is null, and where it isn't."""
    known = np.asarray(column.is_valid())
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known


def exact_sums(parts: DataFrame, *keys: str) -> list:
    """Per key the sums of the columns ``total`` and ``n``. Python integers: no table is too long for them.

    Only for keys of a fixed number, as (cluster, dimension): the sums come to the driver.
    """
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    return [(*[r[k] for k in keys], int(r["total"]), int(r["n"])) for r in parts.groupBy(*keys).agg(whole("total"), whole("n")).collect()]
