"""Running totals, ranks and bounded lists over groups that may hold a large share of all rows.

A plain window sorts one group in one task. Here rows are range-partitioned by (group, order), so that a hot group
spreads over many slices; each slice is summed on its own, as it is sorted, and shifted by the totals of the slices
before it. That is one shuffle of the rows and one copy in shared storage, which Spark deletes once nothing refers to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotab.session import pin

SLICE = "slice_id"


def _ordered(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def slices(
    df: DataFrame, part: Sequence[str], order: Sequence[str | Column], tiebreak: bool = True, sort: Sequence[Column] = ()
) -> DataFrame:
    """Rows range-partitioned by group and order, with their partition in the column ``SLICE``, in fixed storage.

    With ``sort`` the rows of a partition are sorted by it.
    """
    order = _ordered(order)
    tie = [F.xxhash64(*df.columns)] if tiebreak else []
    ranged = df.repartitionByRange(*[F.col(p).asc() for p in part], *order, *tie)
    sorted_ = ranged.sortWithinPartitions(*sort) if sort else ranged
    return pin(sorted_.withColumn(SLICE, F.spark_partition_id()))


def _segmented(values: np.ndarray, group: np.ndarray, starts: np.ndarray, largest: bool) -> np.ndarray:
    """Running sums, or maxima, that begin anew where a group starts."""
    if not largest:
        sums = np.cumsum(values)
        return sums - (sums[starts] - values[starts])[group]
    # Places in ascending order as whole numbers, so that each group lies above the one before it.
    ascending, place = np.unique(values, return_inverse=True)
    return ascending[np.maximum.accumulate(place + group * len(ascending)) % len(ascending)]


def _scan(keys: list[str], sums: list[str], maxima: list[str]):
    """Function that adds running values to sorted batches, and the number of the slice."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[str, object] = {}
        last: tuple | None = None
        number = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for key in keys:
                column = batch.column(key)
                before, after = column.slice(0, n - 1), column.slice(1)
                differ = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
                new[1:] |= differ | (np.asarray(before.is_null()) != np.asarray(after.is_null()))
            first = tuple(batch.column(key)[0].as_py() for key in keys)
            goes_on = last == first
            new[0] = True
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            head = slice(0, int(starts[1]) if len(starts) > 1 else n)
            added = []
            for name in (*sums, *maxima):
                column, largest = batch.column(name), name in maxima
                floats = pa.types.is_floating(column.type)
                least = (-np.inf if floats else np.iinfo(np.int64).min) if largest else 0
                values = pc.fill_null(column, pa.scalar(least, column.type)).to_numpy(zero_copy_only=False)
                local = _segmented(values, group, starts, largest)
                if goes_on:
                    local[head] = np.maximum(local[head], carried[name]) if largest else local[head] + carried[name]
                carried[name] = local[-1]
                added.append(pa.array(local, column.type))
            last = tuple(batch.column(key)[n - 1].as_py() for key in keys)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added, pa.array(np.full(n, number, dtype=np.int32))],
                [*batch.schema.names, *[f"__run_{name}" for name in (*sums, *maxima)], SLICE],
            )

    return scan


def running(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str | Column],
    totals: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    tiebreak: bool = True,
) -> DataFrame:
    """Add inclusive running sums and maxima per ``part`` in ``order``, as bigint or double.

    The order should be total; rows that agree in it are ordered by a hash of the row when ``tiebreak`` is set. A null
    to be summed counts as 0 and a null is never the maximum; groups are columns of plain values, null being one.
    """
    totals, maxima = totals or {}, maxima or {}
    inputs = {name: f"__in_{name}" for name in (*totals, *maxima)}
    added = df.withColumns({inputs[name]: value for name, value in {**totals, **maxima}.items()})
    whole = ("tinyint", "smallint", "int", "bigint")
    kinds = {n: "bigint" if added.schema[c].dataType.simpleString() in whole else "double" for n, c in inputs.items()}
    added = added.withColumns({c: F.col(c).cast(kinds[n]) for n, c in inputs.items()})
    keys = list(part)
    tie = [F.xxhash64(*df.columns)] if tiebreak else []
    sorting = [*[F.col(p).asc() for p in keys], *_ordered(order), *tie]
    ranged = added.repartitionByRange(*sorting).sortWithinPartitions(*sorting)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema]
    fields += [f"`__run_{n}` {kind}" for n, kind in kinds.items()] + [f"{SLICE} int"]
    scan = _scan(keys, [inputs[n] for n in totals], [inputs[n] for n in maxima])
    local = pin(ranged.mapInArrow(scan, ", ".join(fields)))

    combine = {**{name: F.sum for name in totals}, **{name: F.max for name in maxima}}
    # One row per (slice, group). Rows with a predecessor are at most one per slice, because a group only continues
    # from the slice before; that bounds the broadcast by the number of partitions.
    per_slice = local.groupBy(SLICE, *keys).agg(*[fn(f"__in_{n}").alias(f"__off_{n}") for n, fn in combine.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_slice.withColumns(
        {
            "__earlier": F.count(F.lit(1)).over(before),
            **{f"__off_{n}": fn(f"__off_{n}").over(before) for n, fn in combine.items()},
        }
    ).filter("__earlier > 0")
    offsets = F.broadcast(shifted.drop("__earlier").alias("o"))

    match = F.col(f"l.{SLICE}") == F.col(f"o.{SLICE}")
    for key in keys:
        match = match & F.col(f"l.{key}").eqNullSafe(F.col(f"o.{key}"))
    joined = local.alias("l").join(offsets, match, "left")
    merged = []
    for name in totals:
        merged.append((F.col(f"l.__run_{name}") + F.coalesce(F.col(f"o.__off_{name}"), F.lit(0))).alias(name))
    for name in maxima:
        merged.append(F.greatest(F.col(f"l.__run_{name}"), F.col(f"o.__off_{name}")).alias(name))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *merged)


def ranked(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Row numbers from 1 per group, for groups of any size."""
    return running(df, part, order, {name: F.lit(1).cast("bigint")})


def collect_chunks(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    size: int,
    out: str = "items",
) -> DataFrame:
    """Ordered lists of at most ``size`` values: rows (part…, chunk, items), chunks numbered from 0 per group."""
    numbered = ranked(df, part, order, "__rank").withColumn("__value", value)
    chunk = F.floor((F.col("__rank") - 1) / F.lit(size)).cast("bigint").alias("chunk")
    listed = F.array_sort(F.collect_list(F.struct("__rank", "__value")))
    return (
        numbered.groupBy(*part, chunk)
        .agg(listed.alias("__list"))
        .select(*part, "chunk", F.transform("__list", lambda s: s["__value"]).alias(out))
    )
