"""Readers and writers through real files, and sessions that share file names."""

import io
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliotab.plans.inspection import inspection_features, inspection_report
from heliotab.session import shared_dir
from heliotab.sinks import writers
from heliotab.sources.archives import _expand, expand_archives
from heliotab.sources.exif import decode_exif_gps, positions
from heliotab.sources.metadata import read_pairs
from heliotab.sources.predictions import read_prediction_table


def test_sessions_with_equal_names_stay_apart(spark):
    box = [1.0, 2.0, 3.0, 4.0]
    preds = spark.createDataFrame(
        [("A", "d1", "DJI_1.jpg", [box], [0.9], [0]), ("B", "d2", "DJI_1.jpg", [box] * 3, [0.9] * 3, [0] * 3)],
        "session string, doc string, file string, boxes array<array<double>>, scores array<double>, classes array<int>",
    )
    images = spark.createDataFrame([("A", "DJI_1.jpg"), ("B", "DJI_1.jpg")], "session string, name string")
    geo = spark.createDataFrame([("A", "DJI_1.jpg", 1.0, 2.0), ("B", "DJI_1.jpg", 5.0, 6.0)], "session string, name string, lat double, lon double")
    classes = spark.createDataFrame([(0, "x")], "class_id int, class_name string")
    report = {r.session: r for r in inspection_report(preds, images, geo, classes).collect()}
    assert (report["A"].image_points, report["A"].anomalies, report["A"].total_preds, report["A"].north) == (1, 1, 1, 1.0)
    assert (report["B"].image_points, report["B"].anomalies, report["B"].total_preds, report["B"].north) == (1, 3, 3, 5.0)
    features = inspection_features(preds, images, geo, classes).groupBy("session").count().collect()
    assert {r.session: r["count"] for r in features} == {"A": 2, "B": 4}


def tiff_with_position():
    """Little-endian TIFF with a GPS directory: 10 20 30 N, 40 50 60 E."""
    out = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8825, 4, 1, 26) + struct.pack("<I", 0)
    out += struct.pack("<H", 4)
    values = 26 + 2 + 48 + 4
    out += struct.pack("<HHI4s", 1, 2, 2, b"N\0\0\0") + struct.pack("<HHII", 2, 5, 3, values)
    out += struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack("<HHII", 4, 5, 3, values + 24) + struct.pack("<I", 0)
    return out + struct.pack("<12I", 10, 1, 20, 1, 30, 1, 40, 1, 50, 1, 60, 1)


def test_positions_behind_long_segments_and_in_other_formats(spark):
    block = tiff_with_position()
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    late = b"\xff\xd8" + segment(0xE2, bytes(60_000)) * 3 + segment(0xE1, b"Exif\0\0" + block) + b"\xff\xda"
    chunk = b"VP8 " + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(block)) + block
    webp = b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk
    rows = [("late.jpg", late), ("a.tif", block), ("a.webp", webp), ("none.jpg", b"\xff\xd8\xff\xda"), ("null", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.lat, r.lon) for r in positions(decode_exif_gps(files)).collect()}
    assert got["late.jpg"] == got["a.tif"] == got["a.webp"] and abs(got["a.tif"][0] - (10 + 20 / 60 + 30 / 3600)) < 1e-9
    assert got["none.jpg"] == got["null"] == (None, None)


def test_pairs_of_several_chunks_come_back(spark, tmp_path):
    pairs = spark.range(7).select(F.lit("s").alias("split"), F.concat(F.lit("/r/"), "id").alias("rgb_path"), F.lit("/t{}").alias("thermal_path"))
    lines = writers.pairs_documents(pairs, chunk_size=2).select(F.col("text").alias("value"))
    lines.coalesce(1).write.text(str(tmp_path / "p"))
    assert read_pairs(spark, str(tmp_path / "p")).count() == 7


def test_copy_to_a_new_table_and_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, v int")
    path = str(tmp_path / "table")
    for _ in range(2):
        writers.copy_if_absent(rows, path)
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3)]


def test_damaged_members_do_not_end_the_job(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as archive:
        for name in ("a.jpg", "b.jpg", "notes.txt"):
            archive.writestr(name, name.encode() * 50)
    damaged = raw.getvalue().replace(b"a.jpg" * 50, b"x.jpg" * 50)
    (tmp_path / "one.zip").write_bytes(damaged)
    got = {r.name: r.content for r in expand_archives(spark, str(tmp_path)).collect()}
    assert got["a.jpg"] is None and bytes(got["b.jpg"]) == b"b.jpg" * 50 and set(got) == {"a.jpg", "b.jpg"}


def test_predictions_are_written_packed(spark, tmp_path):
    rows = [(f"s{i % 3}", f"{i}.jpg", [[1.0, 2.0, 3.0, 4.0]], [0.5], [i], None) for i in range(9)]
    schema = "session string, file string, boxes array<array<double>>, scores array<double>, classes array<int>, reason string"
    preds = spark.createDataFrame(rows, schema)
    writers.write_predictions(preds, str(tmp_path / "preds"))
    files = [f.name for f in (tmp_path / "preds").glob("session=*/part-*")]
    assert files and all(name.endswith(".json.lz4") for name in files)
    back = read_prediction_table(spark, str(tmp_path / "preds")).select(*preds.columns)
    assert sorted(map(tuple, back.drop("boxes").collect())) == sorted(map(tuple, preds.drop("boxes").collect()))


def test_small_archives_leave_together():
    raw = []
    for i in range(300):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("a.jpg", str(i))
        raw.append(out.getvalue())
    files = pa.RecordBatch.from_pydict({"archive": [str(i) for i in range(300)], "content": [*raw[:-1], b"PK?"]})
    members = list(_expand(iter([files.slice(0, 100), files.slice(100)]), None))
    assert len(members) == 1
    assert members[0].column("content").to_pylist() == [str(i).encode() for i in range(299)]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
