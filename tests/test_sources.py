import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliotab.catalog.encode import jpeg_with_gps, npy_bytes, npz_bytes, tiff_bytes, zip_bytes
from heliotab.functions import boxes
from heliotab.operators.windows import dedupe_names
from heliotab.plans.inspection import located_features
from heliotab.sinks import writers
from heliotab.sources import archives, coco, exif, files, metadata, planes, predictions, rasters

C = F.col


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    body = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def test_listing_policies(spark, tmp_path):
    for name in ("a.JPG", "b.webp", "c_thermal.tif", "c_thermal.tiff", "d.txt", "e.Png"):
        (tmp_path / name).write_bytes(b"x")
    listed = {p: sorted(r["name"] for r in files.list_images(spark, str(tmp_path), p).collect()) for p in ("dataset", "scan", "predict")}
    assert listed["dataset"] == ["a.JPG", "b.webp", "c_thermal.tif", "c_thermal.tiff", "e.Png"]
    assert listed["scan"] == ["a.JPG", "c_thermal.tiff"]
    assert listed["predict"] == ["a.JPG", "c_thermal.tif", "c_thermal.tiff", "e.Png"]


def test_rasters(spark, tmp_path):
    rgb = np.arange(24).reshape(2, 4, 3)
    (tmp_path / "rgb.png").write_bytes(png(rgb))
    (tmp_path / "rgba.png").write_bytes(png(np.dstack([rgb, np.full((2, 4), 255)])))
    (tmp_path / "grey.png").write_bytes(png(np.arange(8).reshape(2, 4)))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in rasters.read_rasters(spark, str(tmp_path)).collect()}
    for name in ("rgb.png", "rgba.png"):
        assert (rows[name].height, rows[name].width) == (2, 4)
        assert rows[name].red == rgb[..., 0].ravel().tolist() and rows[name].blue == rgb[..., 2].ravel().tolist()
    assert rows["grey.png"].red == rows["grey.png"].green == list(range(8))
    assert rows["bad.png"].reason == "read_failed" and rows["bad.png"].red is None


def test_planes(spark, tmp_path):
    plane = np.arange(6, dtype=np.float32).reshape(2, 3) - 1.5
    (tmp_path / "a.tif").write_bytes(tiff_bytes(plane))
    (tmp_path / "b.npy").write_bytes(npy_bytes(np.dstack([plane, plane + 2])))
    (tmp_path / "c.npz").write_bytes(npz_bytes(plane))
    (tmp_path / "d.tif").write_bytes(b"II*\0zz")
    (tmp_path / "e.npy").write_bytes(npy_bytes(np.arange(3.0)))
    rows = {r.image_id: r for r in planes.read_thermal_planes(spark, str(tmp_path)).collect()}
    assert (rows["a"].h, rows["a"].w, rows["a"].px) == (2, 3, plane.ravel().tolist())
    assert rows["b"].px == (plane + 1).ravel().tolist() and rows["c"].px == plane.ravel().tolist()
    assert rows["d"].px is None and rows["e"].px is None


@pytest.fixture
def split(tmp_path):
    images = [{"id": i, "license": 1, "file_name": f"f{i}.jpg", "height": 512, "width": 640, "extra": {"name": "n"}} for i in range(3)]
    annotations = [
        {"id": 0, "image_id": 0, "category_id": 1, "bbox": [10, 20.5, 30, 40], "area": 1200, "segmentation": [[1, 2, 3.5, 4]], "iscrowd": 0},
        {"id": 1, "image_id": 0, "category_id": 1, "bbox": [0, 0, 64, 51.2], "area": 1, "segmentation": [], "iscrowd": 0},
        {"id": 2, "image_id": 2, "category_id": 1, "bbox": [100, 100, 5, 5], "area": 25, "segmentation": [], "iscrowd": 1},
    ]
    categories = [{"id": 0, "name": "hotspots", "supercategory": "none"}, {"id": 1, "name": "hotspots", "supercategory": "hotspots"}]
    doc = {"info": {"year": "2024", "images": [1]}, "images": images, "annotations": annotations, "categories": categories}
    (tmp_path / "_annotations.coco.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "train.json").write_text("{}")
    for name, lines in {"f0": annotations[:2], "f2": annotations[2:]}.items():
        text = "\n".join("0 " + " ".join(str(v) for v in ((b[0] + b[2] / 2) / 640, (b[1] + b[3] / 2) / 512, b[2] / 640, b[3] / 512)) for b in (a["bbox"] for a in lines))
        (tmp_path / f"{name}.txt").write_text(text)
    return tmp_path


def test_coco_and_yolo_agree(spark, split):
    images, annotations, categories = coco.read_coco(spark, [str(split)])
    assert (images.count(), annotations.count(), categories.count()) == (3, 3, 2)
    first = annotations.filter("ann_id = 0").first()
    assert first.bbox == [10, 20.5, 30, 40] and first.segmentation == [[1, 2, 3.5, 4]]
    pixel = boxes.corners(annotations.withColumn("b", boxes.box_to_xyxy(C("bbox"))), "b")
    yolo = coco.read_yolo(spark, str(split))
    other = boxes.yolo_to_xyxy(*[C(c) for c in ("cx", "cy", "w", "h")], F.lit(640), F.lit(512))
    yolo = boxes.corners(yolo.withColumn("b", other), "b")
    sides = ("x1", "y1", "x2", "y2")
    a = sorted(tuple(r) for r in pixel.select(*sides).collect())
    b = sorted(tuple(r) for r in yolo.select(*sides).collect())
    np.testing.assert_allclose(a, b, atol=0.001)


ODD_DOCS = [
    '{"images":[{"id":1,"file_name":"a","extra":{"name":"n"}},null,{"id":"x","width":2}],"annotations":[],"categories":[{"id":0}]}',
    '{"images":[{"id":1},5,"{\\"id\\":7}"],"annotations":[{"id":1,"bbox":[1,2.5],"segmentation":{"counts":[1]},"iscrowd":1}],"categories":null}',
    '{"annotations":[{"id":2,"bbox":[1,"a",3],"category_id":1.5,"image_id":3},{"id":99999999999999999999,"area":"7"}]}',
    '{"images":{"id":1},"annotations":[[{"id":4}]],"categories":[{"id":1,"name":12}]}',
    '{"images":[{"id":1}],"annotations":[{"id":1',
    "[]",
    "",
    None,
]


def test_documents_in_one_pass_are_their_elements_one_by_one(spark):
    docs = spark.createDataFrame([(f"d{i}", text) for i, text in enumerate(ODD_DOCS)], "split string, text string")
    parsed = F.from_json("text", "images array<string>, annotations array<string>, categories array<string>")
    listed = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"d.{s}").alias("e")) for s in ("images", "annotations", "categories")])
    texts = docs.select("split", parsed.alias("d")).select("split", F.explode(listed).alias("s"))
    texts = texts.select("split", "s.section", F.explode("s.e").alias("element"))
    got, want = coco.coco_tables(coco.coco_text_elements(docs)), coco.coco_tables(texts)
    rows = lambda table: sorted(map(repr, table.collect()))
    for a, b in zip(got, want, strict=True):
        assert a.schema.simpleString() == b.schema.simpleString() and rows(a) == rows(b)
    assert [t.count() for t in want] == [6, 4, 2]
    shape = {s: lambda r, s=s: {"kind": F.lit(s), "id": r["id"].cast("bigint")} for s in ("images", "annotations", "categories")}
    keys = {"images": "image_id", "annotations": "ann_id", "categories": "id"}
    each = [t.select("split", F.lit(s).alias("kind"), F.col(k).cast("bigint").alias("id")) for t, (s, k) in zip(want, keys.items())]
    assert rows(got.union(**shape)) == rows(want.union(**shape)) == rows(each[0].union(each[1]).union(each[2]))


def test_s4_reads_its_documents_once(spark, tmp_path):
    from heliotab.catalog import all_queries

    items = [(1, 2, 3, 1, 50.0, 9.5), (1, 4, 5, 2, 7.0, 8.5), (None, 4, 5, None, 7.0, 8.5)]
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame(items, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = all_queries()[0]["S4"](spark, str(tmp_path))
    assert {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()} == {"image": 3, "annotation": 3, "category": 6}
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_coco_elements_across_small_blocks(monkeypatch):
    import io

    doc = {"x": {"images": [1, 2]}, "images": [{"id": 12345, "s": 'a"]}'}, {"id": 2}], "n": 1234, "annotations": [], "categories": [1234, 56]}
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(coco, "_READ_SIZE", size)
        got = list(coco._elements(io.StringIO(json.dumps(doc)), ("images", "annotations", "categories")))
        assert [(k, json.loads(v)) for k, v in got] == [("images", doc["images"][0]), ("images", doc["images"][1]), ("categories", 1234), ("categories", 56)]


def test_prediction_shapes(spark):
    docs = {
        "mixed": '[[1,2,3,4],{"bbox":[5,6,7,8],"score":0.9,"class":1}]',
        "fallback": '{"boxes":[],"bboxes":[[1,2,3,4]]}',
        "text": '"text"',
        "number": "3",
        "empty": "{}",
        "broken": "{",
        "named": ' {"file":"n.jpg","boxes":[[1,2,3,4]],"scores":[0.5],"classes":[2],"reason":"r"}',
        "short": '[[1,2,3],{"b":[1,2,3]},{"bbox":[],"box":[1,2,3,4,5],"cls":"3"}]',
        "nulls": '[{"bbox":[1,2,3,4],"score":null}]',
    }
    df = spark.createDataFrame(list(docs.items()), "stem string, value string")
    rows = {r.stem: r for r in predictions.coerce_predictions(df).collect()}
    assert rows["mixed"].boxes == [[1, 2, 3, 4], [5, 6, 7, 8]] and rows["mixed"].scores == [0.9, 0.0] and rows["mixed"].classes == [1, 0]
    assert rows["fallback"].boxes == [[1, 2, 3, 4]] and rows["fallback"].file == "fallback"
    for name in ("text", "number", "empty", "broken"):
        assert rows[name].boxes == [] and rows[name].scores == []
    assert rows["broken"]._corrupt and not rows["text"]._corrupt
    assert (rows["named"].file, rows["named"].reason) == ("n.jpg", "r")
    assert rows["short"].boxes == [[1, 2, 3, 4]] and rows["short"].classes == [3]
    assert rows["nulls"]._corrupt
    assert predictions.recognised(predictions.coerce_predictions(df)).count() == 5
    dets = predictions.explode_detections(predictions.coerce_predictions(df.filter("stem = 'fallback'")))
    assert dets.count() == 0


def test_predictions_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"file":"a.jpg","boxes":[[1,2,3,4]],"scores":[0.5],"classes":[2]}')
    (tmp_path / "in" / "b.json").write_text('{"file":"b.jpg","boxes":[],"scores":[],"classes":[],"reason":"read_failed"}')
    preds = predictions.read_predictions(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    writers.write_predictions(preds.withColumn("session", F.lit("s1")), out)
    back = {r.file: r for r in predictions.read_prediction_table(spark, out).collect()}
    assert back["a.jpg"].boxes == [[1, 2, 3, 4]] and back["a.jpg"].session == "s1" and back["b.jpg"].reason == "read_failed"


def test_small_documents(spark, tmp_path):
    for run, text in {"r1": '{"input_mode":"rgbtherm","num_classes":2,"class_names":["a"]}', "r2": "{x", "r3": "{}"}.items():
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "model_meta.json").write_text(text)
    meta = {r["name"]: r for r in metadata.read_model_meta(spark, str(tmp_path / "runs")).collect()}
    assert meta["r1"].input_mode == "rgbtherm" and meta["r1"].class_names == ["a"]
    assert meta["r2"].input_mode == "rgb" and meta["r3"].num_classes == 0 and meta["r2"].class_names == []

    (tmp_path / "pairs").mkdir()
    (tmp_path / "pairs" / "pairs.json").write_text('{"/a.jpg": "/t/a.tif",\n "/b.jpg": "/t/b.tif"}')
    (tmp_path / "pairs" / "bad.json").write_text("[")
    assert sorted(map(tuple, metadata.read_pairs(spark, str(tmp_path / "pairs")).collect())) == [("/a.jpg", "/t/a.tif"), ("/b.jpg", "/t/b.tif")]

    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "manifest.json").write_text('[{"file":"a","overlay":"o","thumb":"t","n":3}]')
    assert tuple(metadata.read_manifest(spark, str(tmp_path / "s1")).first()) == ("s1", "a", "o", "t", 3)

    (tmp_path / "gj").mkdir()
    (tmp_path / "gj" / "a.json").write_text('{"type":"Feature","properties":{"k":1},"geometry":{"type":"Point","coordinates":[7,8]}}')
    (tmp_path / "gj" / "b.json").write_text("no json")
    row = metadata.read_geojson(spark, str(tmp_path / "gj")).collect()
    assert len(row) == 1 and (row[0].lat, row[0].lon, row[0].properties) == (8, 7, '{"k":1}')


def test_archives_to_unique_names(spark, tmp_path):
    members = [("x/a.jpg", b"1"), ("y/a.jpg", b"22"), ("y/a-1.jpg", b"333"), ("notes.txt", b"-")]
    (tmp_path / "set.ZIP").write_bytes(zip_bytes(members))
    (tmp_path / "bad.zip").write_bytes(b"PK?")
    rows = archives.expand_archives(spark, str(tmp_path))
    named = dedupe_names(rows, "archive", ["member"])
    assert {r.member: r.unique_name for r in named.collect()} == {"x/a.jpg": "a.jpg", "y/a-1.jpg": "a-1.jpg", "y/a.jpg": "a-2.jpg"}


def test_exif(spark, tmp_path):
    good = jpeg_with_gps([(10, 1), (30, 1), (3600, 100)], "S", [(20, 1), (0, 1), (0, 1)], "E")
    (tmp_path / "a.jpg").write_bytes(good + b"tail")
    (tmp_path / "b.jpg").write_bytes(jpeg_with_gps([(10, 1), (30, 1), (1, 0)], "N", [(20, 1), (0, 1), (0, 1)], "E"))
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xd9")
    (tmp_path / "d.jpg").write_bytes(good[:60])
    rows = {r["name"]: (r.lat, r.lon) for r in exif.read_exif_gps(spark, str(tmp_path)).collect()}
    assert rows["a.jpg"] == (pytest.approx(-10.51), pytest.approx(20))
    assert rows["b.jpg"] == rows["c.jpg"] == rows["d.jpg"] == (None, None)


def test_geojson_parts_make_one_document(spark, tmp_path):
    features = spark.range(500).select(
        F.when(C("id") % 5 == 0, "s1").otherwise("s2").alias("session"),
        F.format_string("n%04d", "id").alias("name"),
        F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("id").alias("properties"))).alias("feature"),
    )
    writers.write_geojson(features, str(tmp_path / "g"))
    for session, n in (("s1", 100), ("s2", 400)):
        parts = sorted((tmp_path / "g" / f"session={session}").glob("part-*"))
        layer = json.loads("".join(p.read_text() for p in parts))
        ids = [f["properties"]["id"] for f in layer["features"]]
        assert layer["type"] == "FeatureCollection" and len(ids) == n and ids == sorted(ids)


def test_copy_if_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1)], "name string, v int").write.parquet(path)
    writers.copy_if_absent(spark.createDataFrame([("a", 9), ("b", 2)], "name string, v int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2)]


def test_manifest_in_both_forms(spark, tmp_path):
    odd = ["sessions/a b", "50%+1", "ü=x", "plain"]
    rows = spark.createDataFrame([(s, f"{k}.jpg", "o", None, k) for k, s in enumerate(odd)], "session string, file string, overlay string, thumb string, n int")
    writers.write_manifest(rows.repartition(3), str(tmp_path / "out"))
    (tmp_path / "out" / "old").mkdir()
    (tmp_path / "out" / "old" / "manifest.json").write_text('[{"file":"z","overlay":"o","thumb":"t","n":3}]')
    (tmp_path / "out" / "bad").mkdir()
    (tmp_path / "out" / "bad" / "manifest.json").write_text("[{")
    got = metadata.read_manifest(spark, str(tmp_path / "out")).collect()
    assert {(r.session, r.file, r.overlay, r.thumb, r.n) for r in got} == {(s, f"{k}.jpg", "o", None, k) for k, s in enumerate(odd)} | {("old", "z", "o", "t", 3)}
    one = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("session=sessions"))
    assert [r.session for r in metadata.read_manifest(spark, str(one)).collect()] == ["sessions/a b"]
    assert metadata.read_manifest(spark, str(tmp_path / "out" / "old")).count() == 1


def test_classes_are_named_by_their_text(spark):
    classes = ["1", '"1"', "1.0", "-1", "7", "null", "1e0", '"01"', "12345678901"]
    text = '{"file":"a.jpg","boxes":[%s],"scores":[%s],"classes":[%s]}' % (",".join(["[0,0,1,1]"] * 9), ",".join(["0.9"] * 9), ",".join(classes))
    preds = predictions.coerce_predictions(spark.createDataFrame([("d", "a", text)], "doc string, stem string, value string"))
    assert preds.first().labels == ["1", "1", "1.0", "-1", "7", None, "1.0", "01", "12345678901"]
    named = spark.createDataFrame([(0, "a"), (1, "b")], "class_id int, class_name string")
    located = preds.selectExpr("'s' AS session", "doc", "file AS name", "1D AS lat", "2D AS lon", "'u' AS url", "boxes", "scores", "classes", "labels")
    rows = located_features(located, named).filter("kind_rank = 1").orderBy("det_idx").collect()
    assert [r.classname for r in rows] == ["b", "b", "a", "a", "7", "a", "a", "b", "12345678901"]
    assert [r["class"] for r in rows] == [1, 1, 1, -1, 7, 0, 1, 1, 0]
    plain = located_features(located.drop("labels"), named).filter("kind_rank = 1").orderBy("det_idx").collect()
    assert [r.classname for r in plain] == ["b", "b", "b", "a", "7", "a", "b", "b", "a"]
