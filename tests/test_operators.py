import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from heliotab.operators import aggregates, detections, evaluate, joins, listings, scoring, skew, tiles, windows
from heliotab.plans import inspection, maps, sessions, training

C = F.col


# ------------------------------------------------------------------------------------------------------- skew


def hot_groups(spark, n=3000):
    """One group holds more than a third of all rows; values repeat."""
    return spark.range(n).select(
        F.when(C("id") % 5 < 2, "hot").otherwise(F.concat(F.lit("g"), (C("id") % 40).cast("string"))).alias("g"),
        (C("id") * 7919 % 101).alias("o"),
        C("id").alias("id"),
        (C("id") % 13).alias("v"),
    )


def test_running_equals_window(spark):
    df = hot_groups(spark)
    got = skew.running(df, ["g"], ["o", "id"], {"rank": F.lit(1), "total": C("v")}, {"top": C("v")})
    w = Window.partitionBy("g").orderBy("o", "id")
    want = df.withColumns({"rank": F.row_number().over(w), "total": F.sum("v").over(w), "top": F.max("v").over(w)})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_over_the_whole_table_and_null_groups(spark):
    df = hot_groups(spark).withColumn("g", F.when(C("g") != "g7", C("g")))
    whole = skew.ranked(df, [], ["id"]).orderBy("id").collect()
    assert [r["rank"] for r in whole] == list(range(1, 3001))
    nulls = skew.ranked(df, ["g"], ["id"]).filter("g IS NULL").orderBy("id").collect()
    assert [r["rank"] for r in nulls] == list(range(1, len(nulls) + 1)) and len(nulls) > 0


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_running_over_small_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    df = hot_groups(spark, 400).withColumns(
        {
            "g": F.when(C("g") != "g7", C("g")),
            "x": F.when(C("id") % 11 > 0, (C("id") * 31 % 17 - 9) / 4),
            "list": F.array("id", "v"),
            "h": F.when(C("id") % 3 > 0, C("id") % 2),
        }
    )
    got = skew.running(df, ["g", "h"], [C("o").desc(), "id"], {"total": F.coalesce("x", F.lit(0.0)), "n": F.lit(1)}, {"top": C("x")})
    w = Window.partitionBy("g", "h").orderBy(C("o").desc(), "id")
    top = F.coalesce(F.max("x").over(w), F.lit(float("-inf")))
    want = df.withColumns({"total": F.sum(F.coalesce("x", F.lit(0.0))).over(w), "n": F.row_number().over(w), "top": top})
    found, expected = sorted(map(repr, got.collect())), sorted(map(repr, want.collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == expected
    assert skew.running(df.limit(0), ["g"], ["id"], {"n": F.lit(1)}).count() == 0


def test_hot_group_is_spread_over_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sliced = skew.slices(hot_groups(spark, 20000), ["g"], ["o", "id"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sliced.filter("g = 'hot'").select(skew.SLICE).distinct().count() > 1


def test_chunks(spark):
    chunks = skew.collect_chunks(hot_groups(spark), ["g"], ["o", "id"], C("id"), 100)
    assert chunks.filter(F.size("items") > 100).count() == 0
    hot = [i for r in chunks.filter("g = 'hot'").orderBy("chunk").collect() for i in r["items"]]
    assert hot == [r.id for r in hot_groups(spark).filter("g = 'hot'").orderBy("o", "id").collect()]


# ------------------------------------------------------------------------------------------------------ joins


# Colour image, thermal files of its split, and the expected file and stage.
THERMAL_CASES = [
    ("X.jpg", ["thermal/X.tif", "thermal/X.tiff"], "thermal/X.tif", "stem"),
    ("X.rf.h1.jpg", ["thermal/X.png", "thermal/X.TIFF"], "thermal/X.TIFF", "stem"),
    ("X_T_JPG.rf.h.jpg", ["thermal/X_T_JPG.tif", "thermal/X_T.tif"], "thermal/X_T_JPG.tif", "stem"),
    ("X_T_JPG.rf.h.jpg", ["thermal/X_T.tif", "thermal/X.tif"], "thermal/X_T.tif", "stem"),
    ("X_T_JPG.rf.h.jpg", ["thermal/X.tif", "thermal/YX_T_JPG.tif"], "thermal/X.tif", "stem"),
    ("X_JPG.jpg", ["thermal/X.tif"], "thermal/X.tif", "stem"),
    ("X_T.jpg", ["thermal/X.tif"], "thermal/X.tif", "stem"),
    ("X.jpg", ["thermal/x.tif", "thermal/xx.tif"], "thermal/x.tif", "case"),
    ("X_T_JPG.jpg", ["thermal/x_t_jpg.tiff"], "thermal/x_t_jpg.tiff", "case"),
    ("AbC.jpg", ["thermal/zabcz.tif", "thermal/abc1.tif"], "thermal/zabcz.tif", "substring"),
    ("long_name_1.jpg", ["thermal/NAME.tif", "thermal/name_1.tiff"], "thermal/name_1.tiff", "substring"),
    ("X.jpg", ["thermal/q.tif", "ir/X.tif"], None, None),
    ("X.jpg", ["ir/X.tif", "IR/X.tif"], "ir/X.tif", "stem"),
    ("X.jpg", ["other/X.tif"], None, None),
    ("X.jpg", ["thermal/q.TIF"], None, None),
    ("X.jpg", [], None, None),
]


def test_match_thermal_on_cases(spark):
    rgb = [(f"/d{k}/{name}",) for k, (name, *_) in enumerate(THERMAL_CASES)]
    files = [(f"/d{k}/{f}",) for k, (_, fs, *_) in enumerate(THERMAL_CASES) for f in fs]
    got = joins.match_thermal(spark.createDataFrame(rgb, "path string"), spark.createDataFrame(files, "path string"))
    found = {r.path: (r.thermal_path, r.stage) for r in got.collect()}
    for k, (name, _, want, stage) in enumerate(THERMAL_CASES):
        assert found[f"/d{k}/{name}"] == (want and f"/d{k}/{want}", stage), name


def test_explicit_thermal_file_comes_first(spark):
    rgb = spark.createDataFrame([("/d/a.jpg", None, "/x/t.tif"), ("/d/b.jpg", "/gone.tif", None)], "path string, thermal string, ir_path string")
    files = spark.createDataFrame([("/x/t.tif",), ("/d/thermal/a.tif",), ("/d/thermal/b.tif",)], "path string")
    got = {r.path: (r.thermal_path, r.stage) for r in joins.match_thermal(rgb, files).collect()}
    assert got == {"/d/a.jpg": ("/x/t.tif", "explicit"), "/d/b.jpg": ("/d/thermal/b.tif", "stem")}


def test_sidecar_folders(spark):
    rgb = spark.createDataFrame([("/d/a.jpg",), ("/d/b.jpg",)], "path string")
    files = spark.createDataFrame([("/d/a_thermal.tiff",), ("/d/a_thermal.tif",), ("/d/thermal/b_thermal.tif",)], "path string")
    beside = {r.path: r.thermal_path for r in joins.sidecar_join(rgb, files).collect()}
    below = {r.path: r.thermal_path for r in joins.sidecar_join(rgb, files, "thermal").collect()}
    assert beside == {"/d/a.jpg": "/d/a_thermal.tif", "/d/b.jpg": None}
    assert below == {"/d/a.jpg": None, "/d/b.jpg": "/d/thermal/b_thermal.tif"}


# ------------------------------------------------------------------------------------------------- detections


def crowded(spark, n=600, seed=3, copies=True):
    """Boxes of few sizes around few places, with exact copies and some empty boxes."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = rng.choice([50.0, 60.0, 300.0]) + rng.normal(0, 6), rng.choice([40.0, 200.0]) + rng.normal(0, 6)
        w, h = rng.choice([8.0, 20.0, 45.0]) * rng.uniform(0.8, 1.3), rng.choice([8.0, 20.0]) * rng.uniform(0.8, 1.3)
        if i % 50 == 0:
            w = 0.0
        sides = [float(v) for v in (x, y, x + w, y + h)]
        rows.append((1 if i % 3 else 2, int(rng.integers(0, 2)), *sides, float(rng.integers(0, 200)) / 200, i))
        if copies and i % 10 == 0:
            rows.append((*rows[-1][:6], rows[-1][6] / 2, 10000 + i))
    return spark.createDataFrame(rows, "image_id int, class int, x1 double, y1 double, x2 double, y2 double, score double, det_idx int")


@pytest.mark.parametrize("min_iou", [0.5])
def test_nms_rounds_equal_greedy(spark, min_iou):
    dets = crowded(spark, 120)
    usual = detections.nms(dets, min_iou)
    spread = detections.nms(dets, min_iou, group_limit=15)
    assert sorted(map(tuple, usual.collect())) == sorted(map(tuple, spread.collect()))
    kept = usual.alias("a").join(usual.select(*[C(c).alias(f"g_{c}") for c in usual.columns]), (C("image_id") == C("g_image_id")) & (C("class") == C("g_class")) & (C("det_idx") < C("g_det_idx")))
    assert kept.filter(detections.iou() > min_iou + 1e-9).count() == 0
    assert 0 < usual.count() < dets.count()


@pytest.mark.parametrize("min_iou", [0.2, 0.5, 0.7])
def test_kept_boxes_are_found_by_their_cells(monkeypatch, min_iou):
    monkeypatch.setattr(detections, "LATE_BOXES", 20)
    monkeypatch.setattr(detections, "BOX_PAIRS", 50)
    rng = np.random.default_rng(2)
    corner, size = rng.uniform(-200, 200, (1500, 2)), np.exp2(rng.uniform(0, 5, (1500, 2)))
    boxes = np.concatenate([corner, corner + size], axis=1)
    group = np.repeat([0.0, np.nan, 1.0], [900, 100, 500])
    columns = {c: boxes[:, i] for i, c in enumerate(("x1", "y1", "x2", "y2"))}
    keys = pa.StructArray.from_arrays([pa.array(group)], ["g"])
    rows = pa.RecordBatch.from_pydict({"k": keys, "i": np.arange(1500), **columns})
    kept = pa.Table.from_batches(detections._suppress(iter([rows.slice(i, 333) for i in range(0, 1500, 333)]), "k", min_iou))
    starts = ((0, 900), (900, 1000), (1000, 1500))
    assert kept.column("i").to_pylist() == [int(i) + a for a, b in starts for i in detections._greedy(boxes[a:b], min_iou)]


def test_large_groups_take_no_rounds(spark, monkeypatch):
    def rounds(*_):
        raise AssertionError("a group that one task can go through went in rounds")

    monkeypatch.setattr(detections, "_nms_rounds", rounds)
    dets = spark.range(20000).select(
        F.lit(1).alias("image_id"), F.lit(0).alias("class"), (C("id") % 90).cast("double").alias("x1"), (C("id") % 41).cast("double").alias("y1"),
        (C("id") % 90 + 9).cast("double").alias("x2"), (C("id") % 41 + 7).cast("double").alias("y2"),
        (C("id") * 7919 % 1009).cast("double").alias("score"), C("id").alias("det_idx"),
    )
    kept = detections.nms(dets).toPandas()
    rows = dets.toPandas().sort_values(["score", "det_idx"], ascending=[False, True])
    best = rows.iloc[detections._greedy(rows[["x1", "y1", "x2", "y2"]].to_numpy(), 0.5)]
    assert sorted(kept["det_idx"]) == sorted(best["det_idx"])


def test_nms_of_odd_boxes_and_null_keys(spark):
    rows = [(None, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (None, 0, 1.0, 0.0, 10.0, 10.0, 0.8, 1), (None, 0, 90.0, 0.0, 50.0, 9.0, 0.7, 2),
            (None, 0, 300.0, 0.0, 200.0, 9.0, 0.6, 3), (None, 0, None, 0.0, 5.0, 5.0, 0.5, 4), (None, 0, 0.0, 0.0, 10.0, 10.0, 0.4, 5)]
    dets = spark.createDataFrame(rows, "image_id int, class int, x1 double, y1 double, x2 double, y2 double, score double, det_idx int")
    for limit in (100, 1):
        kept = detections.nms(dets, 0.5, group_limit=limit)
        assert sorted(r.det_idx for r in kept.collect()) == [0, 2, 3, 4] and kept.columns == dets.columns


@pytest.mark.parametrize("min_iou", [0.3, 0.6])
def test_iou_join_grid_equals_direct(spark, min_iou):
    dets, gts = crowded(spark, 400), crowded(spark, 400, 4).withColumnRenamed("det_idx", "gt_key").drop("score")
    direct = detections.iou_join(dets, gts, min_iou)
    grid = detections.iou_join(dets, gts, min_iou, pair_limit=100)
    key = ("image_id", "class", "det_idx", "g_gt_key")
    a = sorted(tuple(r) for r in direct.select(*key).collect())
    assert a == sorted(tuple(r) for r in grid.select(*key).collect()) and a


def test_topk(spark):
    top = detections.topk_per_image(crowded(spark), 5)
    assert {r["count"] for r in top.groupBy("image_id").count().collect()} == {5}


def test_score_filter_keeps_what_is_no_number(spark):
    df = spark.createDataFrame([("0.6",), ("0.59",), ("x",), (None,)], "score string")
    assert sorted(str(r.score) for r in detections.score_filter(df).collect()) == ["0.6", "None", "x"]


# ------------------------------------------------------------------------------------------------- evaluation


def brute_force_ap(dets, gts):
    """The public protocol, one image and class at a time."""
    out = {}
    classes = sorted({g["class"] for g in gts})
    images = sorted({r["image_id"] for r in dets + gts})
    for cls in classes:
        for t in evaluate.THRESHOLDS:
            for area, (low, high) in evaluate.AREAS.items():
                entries, npig = [], 0
                for image in images:
                    ds = sorted((d for d in dets if d["image_id"] == image and d["class"] == cls), key=lambda d: (-d["score"], d["det_key"]))[:100]
                    gs = sorted((g for g in gts if g["image_id"] == image and g["class"] == cls), key=lambda g: g["gt_key"])
                    ignored = lambda g: g["iscrowd"] == 1 or not low <= g["area"] <= high
                    gs = [g for g in gs if not ignored(g)] + [g for g in gs if ignored(g)]
                    npig += sum(not ignored(g) for g in gs)
                    taken = set()
                    for d in ds:
                        best, m = min(t, 1 - 1e-10) - 1e-10, None
                        for g in gs:
                            if g["gt_key"] in taken and not g["iscrowd"]:
                                continue
                            if m is not None and not ignored(m) and ignored(g):
                                break
                            w = min(d["x2"], g["x2"]) - max(d["x1"], g["x1"])
                            h = min(d["y2"], g["y2"]) - max(d["y1"], g["y1"])
                            inter = max(0.0, w) * max(0.0, h)
                            da, ga = (d["x2"] - d["x1"]) * (d["y2"] - d["y1"]), (g["x2"] - g["x1"]) * (g["y2"] - g["y1"])
                            share = inter / da if g["iscrowd"] else inter / (da + ga - inter)
                            if share < best:
                                continue
                            best, m = share, g
                        if m is not None:
                            taken.add(m["gt_key"])
                            skip = ignored(m)
                        else:
                            skip = not low <= (d["x2"] - d["x1"]) * (d["y2"] - d["y1"]) <= high
                        if not skip:
                            entries.append((-d["score"], image, d["det_key"], m is not None))
                if not npig:
                    continue
                hits = np.array([e[3] for e in sorted(entries)], dtype=float)
                tp, fp = np.cumsum(hits), np.cumsum(1 - hits)
                recall, precision = tp / npig, tp / (tp + fp + np.spacing(1))
                for i in range(len(precision) - 1, 0, -1):
                    precision[i - 1] = max(precision[i - 1], precision[i])
                at = np.searchsorted(recall, np.linspace(0, 1, 101), side="left")
                out[cls, t, area] = float(np.mean([precision[i] if i < len(precision) else 0.0 for i in at]))
    return out


def labelled(seed, n_images=12):
    rng = np.random.default_rng(seed)
    dets, gts = [], []
    for image in range(n_images):
        for k in range(int(rng.integers(0, 9))):
            x, y, size = (float(v) for v in (rng.uniform(0, 120), rng.uniform(0, 120), rng.choice([12.0, 32.0, 50.0, 96.0, 130.0])))
            gts.append(dict(image_id=image, x1=x, y1=y, x2=x + size, y2=y + size, area=size * size, iscrowd=int(rng.random() < 0.15), gt_key=k, **{"class": int(rng.integers(0, 3))}))
            for j in range(int(rng.integers(0, 4))):
                s = size * float(rng.uniform(0.75, 1.2))
                dx, dy = (float(v) for v in rng.normal(0, size * 0.08, 2))
                dets.append(dict(image_id=image, x1=x + dx, y1=y + dy, x2=x + dx + s, y2=y + dy + s, score=float(rng.integers(1, 40)) / 40, det_key=k * 10 + j, **{"class": gts[-1]["class"]}))
    return dets, gts


DETS = "image_id int, class int, x1 double, y1 double, x2 double, y2 double, score double, det_key int"
GTS = "image_id int, class int, x1 double, y1 double, x2 double, y2 double, area double, iscrowd int, gt_key int"


@pytest.mark.parametrize("seed", [1, 2])
def test_average_precision_against_the_protocol(spark, seed):
    dets, gts = labelled(seed)
    d, g = spark.createDataFrame(dets, DETS), spark.createDataFrame(gts, GTS)
    got = {(r["class"], r.iou, r.area): r.ap for r in evaluate.average_precision(evaluate.match_detections(d, g), g).collect()}
    want = brute_force_ap(dets, gts)
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9), key


@pytest.mark.parametrize("block", [1, 3])
def test_boxes_in_blocks_match_as_whole(spark, monkeypatch, block):
    dets, gts = labelled(3, 8)
    dets.append({**dets[0]})
    for rows in (dets, gts):
        rows.append({**rows[0], "image_id": None})
    d, g = spark.createDataFrame(dets, DETS), spark.createDataFrame(gts, GTS)
    whole = sorted(map(repr, evaluate.match_detections(d, g).collect()))
    monkeypatch.setattr(evaluate, "GT_BLOCK", block)
    assert sorted(map(repr, evaluate.match_detections(d, g).collect())) == whole
    assert len(whole) == len(dets) and evaluate.match_detections(d.limit(0), g).count() == 0
    assert {r.hits for r in evaluate.match_detections(d, g.limit(0)).collect()} == {0}


def test_detections_and_boxes_are_shuffled_once(spark):
    dets, gts = labelled(5)
    dets += [{**dets[0], "image_id": None, "det_key": 10_000 + i, "score": i / 7} for i in range(7)]
    d, g = spark.createDataFrame(dets, DETS), spark.createDataFrame(gts, GTS)
    matches = evaluate.match_detections(d, g, max_dets=5)
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    per_image = {}
    for r in dets:
        per_image.setdefault((r["image_id"], r["class"]), []).append((-r["score"], r["det_key"]))
    want = {(*k, key) for k, rows in per_image.items() for _, key in sorted(rows)[:5]}
    assert {(r.image_id, r["class"], r.det_key) for r in matches.collect()} == want


def test_curves_do_not_depend_on_the_slices(spark, monkeypatch):
    dets, gts = labelled(6, 8)
    for i, r in enumerate(dets):
        r["score"] = (0.5, 0.5, 0.75, float("nan"), float("inf"), float("-inf"), None)[i % 7]
    dets += [{**dets[0], "image_id": None}, {**dets[1], "class": None}]
    d, g = spark.createDataFrame(dets, DETS), spark.createDataFrame(gts, GTS)
    matches, found = evaluate.match_detections(d, g), []
    for most in (1, 2, 64):
        monkeypatch.setattr(evaluate, "SLICES_A_PARTITION", most)
        found.append(sorted(map(repr, evaluate.average_precision(matches, g, alike=d if most == 2 else None).collect())))
    monkeypatch.setattr(evaluate, "_cuts", lambda *_: {})
    found.append(sorted(map(repr, evaluate.average_precision(matches, g).collect())))
    assert found[0] == found[1] == found[2] == found[3] and any("ap=0.0)" not in r for r in found[0])


def test_pairs_come_in_parts(monkeypatch):
    monkeypatch.setattr(evaluate, "MOST_PAIRS", 5)
    group, start, end = np.array([0, 0, 1, 2, 2]), np.array([0, 3, 3]), np.array([3, 3, 10])
    parts = [list(zip(d.tolist(), g.tolist())) for d, g in evaluate._pairs(np.arange(5), np.arange(10), group, start, end)]
    assert sum(parts, []) == [(d, g) for d in range(5) for g in range(start[group[d]], end[group[d]])] and len(parts) > 2


def test_a_slice_is_summed_batch_by_batch():
    rng = np.random.default_rng(4)
    hits = rng.integers(0, 1 << 40, 400)
    rows = pa.RecordBatch.from_pydict(
        {"class": ["a"] * 150 + ["b"] * 250, skew.SLICE: pa.array([3] * 400, pa.int32()), "hits": hits, "ignored": rng.integers(0, 1 << 40, 400) & ~hits}
    )
    before = {(c, 3): ([k] * 40, [2] * 40, [500, 300, 100, None]) for k, c in enumerate("ab")}
    found = lambda batches: [r for b in evaluate._slice_points(iter(batches), "class", before) for r in b.to_pylist()]
    whole = found([rows])
    assert {r["class"] for r in whole} == {"a", "b"} and "large" not in {r["area"] for r in whole}
    assert found([rows.slice(i, 7) for i in range(0, 400, 7)]) == whole


def test_perfect_detections_score_one(spark):
    _, gts = labelled(7)
    g = spark.createDataFrame([x for x in gts if not x["iscrowd"]], GTS)
    d = g.select("image_id", "class", "x1", "y1", "x2", "y2", F.lit(0.9).alias("score"), C("gt_key").alias("det_key"))
    values = {r.metric: r.value for r in evaluate.coco_eval(d, g).filter("class IS NULL").collect()}
    assert values["AP"] == pytest.approx(1) and values["AP50"] == pytest.approx(1)


# ---------------------------------------------------------------------------------------------------- windows


def test_names_as_if_saved_one_by_one(spark):
    rng = random.Random(2)
    rows = [(f"d{rng.randint(0, 1)}", f"{i:04d}", rng.choice(["a.jpg", "a-1.jpg", "a-1-1.jpg", "a-2.jpg", "b", "b-1"])) for i in range(120)]
    got = {(r.dataset, r.member): r.unique_name for r in windows.dedupe_names(spark.createDataFrame(rows, "dataset string, member string, name string")).collect()}
    used, want = set(), {}
    for dataset, member, name in rows:
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if dot else (name, "")
        out, k = name, 1
        while (dataset, out) in used:
            out, k = f"{stem}-{k}{ext}", k + 1
        used.add((dataset, out))
        want[dataset, member] = out
    assert got == want


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "image_id")
    a = windows.preflight_sample(df).collect()
    assert len(a) == 120 and windows.preflight_sample(df.repartition(5)).collect() == a


def test_decode_stats_of_nothing_and_errors(spark):
    rows = [("s", "b", False, "E2"), ("s", "a", False, "E1"), ("s", "c", True, None), ("t", "a", True, None)]
    got = {r.split: tuple(r)[1:] for r in aggregates.decode_stats(spark.createDataFrame(rows, "split string, name string, ok boolean, error string")).collect()}
    assert got == {"s": (1, 2, 3, "E1"), "t": (1, 0, 1, None)}
    modes = training.training_mode(spark.createDataFrame([("a", 0, "E"), ("b", 1, None)], "split string, ok int, first_error string"))
    assert [(r.mode, r.fallback_reason) for r in modes.orderBy("split").collect()] == [("rgb", "E"), ("rgbtherm", None)]


def test_latest_of_nothing(spark):
    assert listings.latest(spark.createDataFrame([], "name string, mtime bigint")).count() == 0


# ------------------------------------------------------------------------------------------- scoring and plans


def test_batch_score_reasons(spark):
    px = [float(v) for v in range(4)]
    rasters = spark.createDataFrame(
        [("ok", 2, 2, [1] * 4, [2] * 4, [3] * 4, None), ("bad", None, None, None, None, None, "read_failed"), ("lone", 2, 2, [1] * 4, [2] * 4, [3] * 4, None), ("cut", 2, 2, [1] * 4, [2] * 4, [3] * 4, None)],
        "file string, height int, width int, blue array<int>, green array<int>, red array<int>, reason string",
    )
    thermal = spark.createDataFrame([("ok", 1, 4, px), ("cut", None, None, None)], "file string, h int, w int, px array<double>")
    shapes = lambda: lambda image: ([[0.0, 0.0, float(image.shape[0]), 1.0]], [float(image[3].max())], [1])
    rows = {r.file: r for r in scoring.batch_score(rasters, thermal, shapes, "rgbtherm").collect()}
    assert rows["ok"].boxes == [[0, 0, 4, 1]] and 0 < rows["ok"].scores[0] <= 255
    assert {k: r.reason for k, r in rows.items()} == {"ok": None, "bad": "read_failed", "lone": "no_thermal_sidecar", "cut": "thermal_read_failed"}
    colour = lambda: lambda image: ([[0.0, 0.0, float(image.shape[0]), 1.0]], [float(image[0, 0, 0])], [1])
    plain = {r.file: r for r in scoring.batch_score(rasters, None, colour).collect()}
    assert plain["lone"].boxes == [[0, 0, 3, 1]] and plain["lone"].scores == [1.0] and plain["bad"].reason == "read_failed"
    manifest = sessions.manifest(scoring.batch_score(rasters, None, colour).withColumn("session", F.lit("s")))
    assert manifest.count() == 3


def test_features_of_a_session(spark):
    preds = spark.createDataFrame([("d1", "a.jpg", [[1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 2.0, 2.0]], [0.6, 0.59], [1, 9]), ("d2", "b.jpg", [], [], []), ("d3", "c.jpg", [[0.0, 0.0, 1.0, 1.0]], [0.9], [9])], "doc string, file string, boxes array<array<double>>, scores array<double>, classes array<int>")
    images = spark.createDataFrame([("s", n) for n in ("a.jpg", "b.jpg", "c.jpg")], "session string, name string")
    geo = spark.createDataFrame([("a.jpg", 1.0, 2.0), ("b.jpg", 1.0, 2.0), ("c.jpg", None, None)], "name string, lat double, lon double")
    classes = spark.createDataFrame([(0, "x"), (1, "y")], "class_id int, class_name string")
    features = inspection.inspection_features(preds, images, geo, classes)
    text = aggregates.feature_collections(features).first().geojson
    layer = json.loads(text)
    assert [f["geometry"]["type"] for f in layer["features"]] == ["Point", "Polygon"]
    assert layer["features"][0]["geometry"]["coordinates"] == [2.0, 1.0]
    assert layer["features"][1]["properties"]["classname"] == "y" and layer["features"][1]["properties"]["bbox_pixel"] == [1, 2, 3, 4]
    assert len(layer["features"][1]["geometry"]["coordinates"][0]) == 5


def test_tile_of_a_constant_plane_and_bands(spark):
    plane = spark.createDataFrame([("s", b, 2, 2, 3857, -2e7, 2e7, 2e7, 2e7, [5.0] * 4) for b in (0, 1)], "source string, band int, h int, w int, epsg int, x0 double, y0 double, dx double, dy double, px array<double>")
    rows = maps.map_tiles(plane, 0, 8)
    assert rows.count() == 2 and all(len(r.px) == 64 for r in rows.collect())
    rgb = tiles.rgb_tiles(rows).first()
    assert rgb.red == rgb.green and rgb.blue == [0] * 64
    grey = tiles.rgb_tiles(rows.filter("band = 0")).first()
    assert grey.red == grey.green == grey.blue
