"""Planes and tensors over Arrow buffers against plain loops and the column forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliotab.functions import planes
from heliotab.operators import scoring
from heliotab.plans import training

C = F.col


def plain_means(rows):
    by = {}
    for key, px in rows:
        if px:
            by.setdefault(key, []).append(px)
    out = {}
    for key, listed in by.items():
        n = max(map(len, listed))
        at = [[p[i] for p in listed if i < len(p) and p[i] is not None] for i in range(n)]
        out[key] = [sum(v) / len(v) if v else None for v in at]
    return out


@pytest.mark.parametrize("bytes_, parts", [(64_000_000, 4), (300, 4), (1, 13)])
def test_means_equal_plain_loops(spark, monkeypatch, bytes_, parts):
    monkeypatch.setattr(planes, "PARTIAL_BYTES", bytes_)
    rng = random.Random(3)
    rows = []
    for k in range(240):
        # One image holds a third of the planes; some planes are short, some pixels null, some planes missing.
        key = ("hot" if k % 3 == 0 else rng.choice(["a", "b", "c", None]), rng.randint(0, 1))
        px = [rng.choice([None, 0.0, 1.5, -2.25, 7.0]) for _ in range(rng.choice([6, 6, 6, 4]))]
        rows.append((*key, k, rng.choice([px, px, px, px, None, []])))
    df = spark.createDataFrame(rows, "image_id string, half int, band int, px array<double>").repartition(parts)
    got = {(r.image_id, r.half): r.px for r in planes.mean_planes(df).collect()}
    want = plain_means([((i, h), px) for i, h, _, px in rows])
    assert got.keys() == want.keys()
    for key, px in want.items():
        assert all((a is None and b is None) or abs(a - b) < 1e-12 for a, b in zip(got[key], px)) and len(got[key]) == len(px)
    assert planes.mean_planes(df.limit(0)).count() == 0


def test_means_of_full_planes_shuffle_sums_only(spark):
    n, h, w = 6, 512, 640
    make = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: ((i * 7 + C("id") * 13) % 101).cast("float"))
    df = spark.range(n).select((C("id") % 2).alias("image_id"), C("id").alias("band"), make.alias("px"))
    means = planes.mean_planes(df)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    for r in means.collect():
        want = np.mean([(np.arange(h * w) * 7 + k * 13) % 101 for k in range(n) if k % 2 == r.image_id], axis=0)
        assert np.allclose(r.px, want, atol=1e-9)


def test_planes_equal_the_columns(spark):
    nan = math.nan
    cases = [[1.0, 2.0, 90.0, 3.0], [0.5, 0.25, 0.0, 1.0], [nan, 0.5, 0.1, 1.2], [nan, 50.0, 120.0, -1.0], [0.7] * 4, [nan] * 4, [-3.0, -1.0, 0.5, 1.5]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, px array<double>")
    rows = df.select("i", planes.normalize_thermal_infer(C("px")).alias("s"), planes.normalize_thermal_train(C("px")).alias("t")).collect()
    for r in rows:
        px = np.array(cases[r.i])
        assert np.array_equal(planes.scaled_for_scoring(px), np.array(r.s), equal_nan=True)
        assert np.array_equal(planes.scaled_for_training(px), np.array(r.t), equal_nan=True)


def test_training_tensors_equal_the_columns(spark):
    rng = np.random.default_rng(4)
    rasters, thermal = [], []
    for i in range(9):
        h, w = int(rng.integers(1, 5)), int(rng.integers(1, 5))
        colours = [rng.integers(0, 256, h * w).tolist() for _ in range(3)]
        rasters.append((i, h, w, *colours))
        th, tw = (h, w) if i % 2 else (3, 2)
        thermal.append((i, "a.tif", th, tw, None if i == 4 else rng.normal(1, 2, th * tw).tolist()))
    rasters = spark.createDataFrame(rasters, "image_id int, height int, width int, red array<int>, green array<int>, blue array<int>")
    thermal = spark.createDataFrame(thermal[:8], "image_id int, path string, h int, w int, px array<double>")
    got = training.training_tensors(rasters, thermal, "double")
    side = thermal.select("image_id", C("h").alias("th"), C("w").alias("tw"), planes.normalize_thermal_train(C("px")).alias("t"))
    joined = rasters.join(side, "image_id", "left").withColumn(
        "t", planes.fit_plane(C("t"), C("th"), C("tw"), C("height"), C("width"), "nearest")
    )
    want = joined.select("image_id", planes.stack_channels([C("red"), C("green"), C("blue")], C("t"), "train").alias("px"))
    assert {r.image_id: r.px for r in got.collect()} == {r.image_id: r.px for r in want.collect()}
    assert {r.kind for r in got.collect()} == {"tif", "missing"} and {r.channels for r in got.collect()} == {4}
    floats = training.training_tensors(rasters, thermal)
    assert floats.schema["px"].dataType.simpleString() == "array<float>"


def test_training_tensors_leave_in_parts(spark, monkeypatch):
    rows = [(i, 1, 2, *([None] * 3 if i == 3 else [[51 * i, 0]] * 3)) for i in range(6)]
    rasters = spark.createDataFrame(rows, "image_id int, height int, width int, red array<int>, green array<int>, blue array<int>").coalesce(1)
    planes_ = [(i, "a.tif", 1, 2, None if i == 4 else [0.5, None if i == 5 else 0.25]) for i in range(6)]
    thermal = spark.createDataFrame(planes_, "image_id int, path string, h int, w int, px array<double>")
    monkeypatch.setattr(planes, "_HELD_PIXELS", 9)
    got = {r.image_id: r.px for r in training.training_tensors(rasters, thermal, "double").collect()}
    last = {4: [0.0, 0.0], 5: [0.5, None]}
    for i in range(6):
        want = None if i == 3 else [v for _ in range(3) for v in (51 * i / 255, 0.0)] + last.get(i, [0.5, 0.25])
        assert got[i] == want


def test_predictors_see_batches_of_one_size(spark):
    sizes = [(2, 3)] * 9 + [(1, 1)] * 2 + [(2, 3)] * 3
    rows = [(f"{i:02d}", h, w, *[[i] * (h * w)] * 3, None) for i, (h, w) in enumerate(sizes)]
    rasters = spark.createDataFrame(rows, "file string, height int, width int, blue array<int>, green array<int>, red array<int>, reason string").coalesce(1)

    def factory():
        def predict(images):
            assert images.dtype == np.float32 and images.ndim == 4 and images.shape[1] == 3
            return [([[0.0, 0.0, 1.0, 1.0]], [float(image[0, 0, 0])], [len(images)]) for image in images]

        return scoring.batched(predict)

    ready, _ = scoring.inputs_for(rasters, None, "rgb")
    got = {r.file: r for r in scoring.predict(ready.orderBy("file"), factory, batch_images=4).collect()}
    assert [got[f"{i:02d}"].scores[0] for i in range(14)] == list(range(14))
    assert [got[f"{i:02d}"].classes[0] for i in range(14)] == [4] * 8 + [1] + [2] * 2 + [3] * 3


def test_full_images_are_scored_from_buffers(spark):
    h, w, n = 512, 640, 5
    ramp = lambda k: F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: ((i + C("id") * k) % 256).cast("int"))
    rasters = spark.range(n).select(C("id").cast("string").alias("file"), F.lit(h).alias("height"), F.lit(w).alias("width"),
                                    ramp(1).alias("blue"), ramp(2).alias("green"), ramp(3).alias("red"), F.lit(None).cast("string").alias("reason"))
    thermal = spark.range(n).select(C("id").cast("string").alias("file"), F.lit(256).alias("h"), F.lit(320).alias("w"),
                                    F.transform(F.sequence(F.lit(0), F.lit(256 * 320 - 1)), lambda i: (i % 90).cast("float")).alias("px"))
    factory = lambda: scoring.batched(lambda images: [([[0.0, 0.0, float(i.shape[1]), float(i.shape[2])]], [float(i[3].max())], [len(i)]) for i in images])
    preds = scoring.batch_score(rasters, thermal, factory, "rgbtherm")
    assert "array<double>" not in str([f.dataType.simpleString() for f in scoring.inputs_for(rasters, thermal, "rgbtherm")[0].schema])
    for r in preds.collect():
        # A quarter of the way from the peak, where the border row has no other above it.
        assert r.reason is None and r.boxes == [[0, 0, h, w]] and r.classes == [4] and abs(r.scores[0] - 255 * (0.75 * 89 + 0.25 * 88) / 100) < 1e-3
