import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliotab.functions import boxes, geo, logs, names, planes
from heliotab.operators.joins import resolve_class

C = F.col


def values(spark, rows, expression, column="c", kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_safe_name(spark):
    long = "x" * 130
    assert values(spark, ["\ta b\t", "   ", None, long, "a/b:c", " é "], names.safe_name(C("c"))) == [
        "a_b", "", "", "x" * 128, "a_b_c", "_"
    ]


def test_slugify(spark):
    assert values(spark, ["..a b..zip", "###.zip", "a.b.c", "dir/My Set.zip", "-._"], names.slugify(C("c"))) == [
        "a-b", "dataset", "a.b", "My-Set", "dataset"
    ]


def test_stem_and_suffix(spark):
    paths = ["/a/b.tar.gz", ".bashrc", "/a/x", "a.", "/d/..zip"]
    assert values(spark, paths, names.stem(C("c"))) == ["b.tar", ".bashrc", "x", "a.", "."]
    assert values(spark, paths, names.suffix(C("c"))) == [".gz", "", "", "", ".zip"]


def test_strip_rf_suffix(spark):
    assert values(spark, ["a.rf.b.rf.c", "a", ".rf.x"], names.strip_rf_suffix(C("c"))) == ["a", "a", ""]


def test_two_decimals_as_python(spark):
    rng = np.random.default_rng(1)
    numbers = [0.125, 2.675, 0.005, 0.015, 0.995, 1.0, 0.0, 1e6 + 0.005, -0.125, *rng.random(500), *(rng.integers(0, 1000, 500) / 1000 + 0.005)]
    numbers = [float(n) for n in numbers]
    assert values(spark, numbers, names.two_decimals(C("c")), kind="double") == [f"{n:.2f}" for n in numbers]


def test_name_or_stamp(spark):
    ts = F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5))
    assert values(spark, ["", "a b"], names.name_or_stamp(C("c"), ts, "data_")) == ["data_20240102_030405", "a_b"]


def test_dms(spark):
    df = spark.createDataFrame(
        [((1, 1), (30, 1), (36, 1), "S"), ((1, 1), (30, 1), (36, 1), "s"), ((1, 1), (30, 1), (36, 0), "N"), ((1, 1), (30, 1), (36, 1), None)],
        "d struct<num:bigint,den:bigint>, m struct<num:bigint,den:bigint>, s struct<num:bigint,den:bigint>, r string",
    )
    got = [r[0] for r in df.select(geo.dms_to_deg(C("d"), C("m"), C("s"), C("r"))).collect()]
    assert got[0] == pytest.approx(-1.51) and got[1] == pytest.approx(1.51) and got[2] is None and got[3] == pytest.approx(1.51)


def test_tile_bounds(spark):
    row = spark.range(1).select(geo.tile_bounds(F.lit(1), F.lit(0), F.lit(0)).alias("b")).select("b.*").first()
    assert row.left == pytest.approx(-math.pi * 6378137) and row.right == pytest.approx(0) and row.bottom == pytest.approx(0)


def test_bounds_fall_back(spark):
    b = geo.bounds_wgs84(F.lit(2056), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))
    assert tuple(spark.range(1).select(b.alias("b")).select("b.*").first()) == (-180.0, -85.0, 180.0, 85.0)


def test_resolve_class(spark):
    got = values(spark, ["1", "1.0", "-1", "7"], resolve_class(C("c"), F.array(F.lit("a"), F.lit("b"))))
    assert [tuple(r) for r in got] == [(1, "b"), (1, "a"), (-1, "a"), (7, "7")]


def test_box_lengths(spark):
    got = values(spark, [[1.0, 2.0, 3.0, 4.0], [10.0, 10.0, 4.0, 2.0, 90.0], [1.0]], boxes.box_to_xyxy(C("c")), kind="array<double>")
    assert got[0] == [1, 2, 4, 6] and got[1] == pytest.approx([9, 8, 11, 12]) and got[2] is None


def test_flip_twice_is_identity_and_clip_is_idempotent(spark):
    df = spark.createDataFrame([(1, -3.0, 4.0, 700.0, 80.0, 640, 512)], "image_id int, x1 double, y1 double, x2 double, y2 double, width int, height int")
    once = boxes.flip_boxes(df, F.lit(True))
    assert boxes.flip_boxes(once, F.lit(True)).collect() == df.collect()
    clipped = boxes.clip_boxes(df)
    assert boxes.clip_boxes(clipped).collect() == clipped.collect()


def test_random_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(200).select(C("id").alias("image_id"), F.lit(640).alias("width"), F.lit(512).alias("height"))
    for style in ("choice", "range"):
        a = boxes.resize_shortest_edge(df, style=style).orderBy("image_id").collect()
        assert boxes.resize_shortest_edge(df.repartition(7), style=style).orderBy("image_id").collect() == a
        assert len({r.new_h for r in a}) > 3 and all(640 <= r.new_h <= 800 for r in a)


def test_thermal_scaling_as_numpy(spark):
    nan = float("nan")
    rows = [[2.0, 2.0, 2.0], [1.0, nan, 0.5], [1.5, 0.0, 0.75], [1.51, 0.0, -3.0], [120.0, 50.0, -1.0], [40.0, 20.0, -5.0], [1.0, -0.5, 0.2]]
    infer = values(spark, rows, planes.normalize_thermal_infer(C("c")), kind="array<double>")
    train = values(spark, rows, planes.normalize_thermal_train(C("c")), kind="array<double>")
    for row, a, b in zip(rows, infer, train):
        x = np.array(row)
        low, high = np.nanmin(x), np.nanmax(x)
        want = np.clip(x, 0, 100) / 100 if high > 1.5 else (x - low) / (high - low) if high > low else x * 0
        np.testing.assert_allclose(a, want)
        top = x.max()
        np.testing.assert_allclose(b, np.clip(x / top if top > 1 else x, 0, 1))


def test_equal_values_scale_to_zero(spark):
    assert values(spark, [[0.5, 0.5]], planes.normalize_thermal_infer(C("c")), kind="array<double>") == [[0.0, 0.0]]


def test_mean_of_planes(spark):
    got = values(spark, [[[1.0, 2.0], [3.0, 6.0]]], planes.mean_of_planes(C("c")), kind="array<array<double>>")
    assert got == [[2.0, 4.0]]


def test_stretch(spark):
    got = values(spark, [[0.0, 5.0, 10.0, float("nan"), float("inf")]], planes.stretch_plane(C("c"), F.struct(F.lit(0.0).alias("low"), F.lit(10.0).alias("high"))), kind="array<double>")
    assert got == [[0, 127, 255, 0, 255]]


def test_log_lines(spark):
    lines = ["[01:02:03] INFO: UI:OK:train: Training started", "plain", "[01:02:03] ERROR: UI:ERR:test: a: b", "[01:02:03] WARNING: UI:WARN:train: w", "x total_loss: 1", "x loss: 1"]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    rows = logs.parse_log(df).orderBy("i").collect()
    assert (rows[0].ts, rows[0].level, rows[0].ui_level, rows[0].job, rows[0].text) == ("01:02:03", "INFO", "OK", "train", "Training started")
    assert rows[1].ts is None and rows[2].text == "a: b"
    assert values(spark, lines, logs.is_train_line(C("c"))) == [True, False, False, False, False, True]
    status = values(spark, lines, logs.status_of(C("c")))
    assert tuple(status[0]) == ("train", "started", None) and tuple(status[2]) == ("test", "failed", "a: b") and status[1] is None
