"""Unique names against saving one by one."""

import random

import pytest
from pyspark.sql import functions as F

from heliotab.operators.windows import dedupe_names
from heliotab.session import pin


def saved(rows, taken=(), extension=True):
    used, out = set(taken), {}
    for dataset, member, name in rows:
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if extension and stem and ext else (name, "")
        got, k = name, 1
        while (dataset, got) in used:
            got, k = f"{stem}-{k}{ext}", k + 1
        used.add((dataset, got))
        out[dataset, member] = got
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "dataset string, member string, name string")
    return {(r.dataset, r.member): r.unique_name for r in dedupe_names(df, **more).collect()}


def name(rng, extension):
    root = rng.choice(["a", "a", "b", "x-0", "-1", ""])
    tail = "".join(f"-{rng.choice([1, 1, 2, 3, 5, 12])}" for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])))
    return root + tail + rng.choice([".jpg", ".jpg", ".tif", "", ".-1"] if extension else ["", "", ".v1"])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("extension", [True, False])
def test_names_as_if_saved_one_by_one(spark, seed, extension):
    rng = random.Random(seed)
    size = rng.choice([5, 40, 300])
    rows = [(f"d{rng.randint(0, 1)}", f"{i:04d}", name(rng, extension)) for i in range(size)]
    rows = [r for r in rows if r[2]]
    taken = sorted({(f"d{rng.randint(0, 1)}", name(rng, extension)) for _ in range(rng.choice([0, 3, 30]))})
    df = spark.createDataFrame([t for t in taken if t[1]] * 2, "dataset string, name string")
    got = found(spark, rows, taken=df, extension=extension)
    assert got == saved(rows, taken, extension)
    assert len({(d, n) for (d, _), n in got.items()} | {t for t in taken if t[1]}) == len(rows) + len({t for t in taken if t[1]})


def test_many_numbered_names_take_a_fixed_number_of_passes(spark, monkeypatch):
    """Copies of a name against names that hold every second of its numbers, and the other way round."""
    pinned = []
    monkeypatch.setattr("heliotab.operators.windows.pin", lambda df: pinned.append(1) or pin(df))
    monkeypatch.setattr("heliotab.operators.skew.pin", lambda df: pinned.append(1) or pin(df))
    holds = [f"a-{k}.jpg" for k in range(2, 1200, 2)]
    for names in (holds + ["a.jpg"] * 900, ["a.jpg"] * 900 + holds, ["a-1.jpg", "a.jpg"] * 400 + holds):
        rows = [("d", f"{i:05d}", n) for i, n in enumerate(names)]
        pinned.clear()
        assert found(spark, rows) == saved(rows)
        assert len(pinned) <= 3


def test_folders_and_odd_names(spark):
    rows = [("t", "1", "scan.v1"), ("t", "2", "scan.v1"), ("t", "3", "scan.v1-1"), (None, "4", "x"), (None, "5", "x"), (None, "6", "x-1")]
    taken = spark.createDataFrame([("t", "scan.v1"), ("t", "scan.v1-2")], "dataset string, name string")
    got = found(spark, rows, taken=taken, extension=False)
    assert got == {
        ("t", "1"): "scan.v1-1", ("t", "2"): "scan.v1-3", ("t", "3"): "scan.v1-1-1",
        (None, "4"): "x", (None, "5"): "x-1", (None, "6"): "x-1-1",
    }
    nulls = spark.createDataFrame([("t", "1", None), ("t", "2", None)], "dataset string, member string, name string")
    assert [r.unique_name for r in dedupe_names(nulls.withColumn("extra", F.lit(1))).collect()] == [None, None]
    assert dedupe_names(nulls.limit(0)).count() == 0
