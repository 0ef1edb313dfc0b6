"""Queries over the sources and sinks. File contents are derived from the tables, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliotab.catalog.encode import encode_archives, encode_jpegs, encode_planes
from heliotab.catalog.registry import query
from heliotab.functions import names
from heliotab.operators.scoring import scoring_audit
from heliotab.session import scratch_path
from heliotab.sinks import writers
from heliotab.sources import archives, coco, exif, log_stream, metadata, predictions, rasters
from heliotab.sources import planes as plane_source
from heliotab.sources.files import filter_images
from heliotab.streaming import log_streams

C = F.col


@query(
    "S1",
    """
    SELECT 'dataset' AS policy, path FROM v_files WHERE regexp_matches(lower(name), '\\.(jpg|jpeg|png|tif|tiff|bmp|webp)$')
    UNION ALL
    SELECT 'scan' AS policy, path FROM v_files WHERE regexp_matches(name, '\\.(jpg|jpeg|JPG|JPEG|png|PNG|tif|tiff|TIF|TIFF)$')
      AND name NOT LIKE '%_thermal.tif'
    UNION ALL
    SELECT 'predict' AS policy, path FROM v_files WHERE regexp_matches(lower(name), '\\.(jpg|jpeg|png|tif|tiff|bmp)$')""",
)
def s1(t):
    files = t("v_files")
    listed = [filter_images(files, p).select(F.lit(p).alias("policy"), "path") for p in ("dataset", "scan", "predict")]
    return listed[0].unionByName(listed[1]).unionByName(listed[2])


@query(
    "S2",
    """
    WITH b AS (SELECT vec_id, label, list_transform(px, lambda v: cast(floor(abs(v) * 7) AS int) % 256) AS d,
                      CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS n,
                      CASE vec_id % 3 WHEN 0 THEN 64 WHEN 1 THEN 21 ELSE 16 END AS size FROM v_planes),
         p AS (SELECT *, unnest(range(0, size)) AS pos FROM b WHERE label <> 9)
    SELECT cast(vec_id AS VARCHAR) AS path, cast(pos AS int) AS pos, d[pos * n + 1] AS blue,
           d[pos * n + 1 + CASE WHEN n = 1 THEN 0 ELSE 1 END] AS green, d[pos * n + 1 + CASE WHEN n = 1 THEN 0 ELSE 2 END] AS red,
           cast(NULL AS VARCHAR) AS reason FROM p
    UNION ALL
    SELECT cast(vec_id AS VARCHAR), -1, -1, -1, -1, 'read_failed' FROM b WHERE label = 9""",
)
def s2(t):
    """Images with one, three or four channels; label 9 stands for a file that does not decode."""
    kind = C("vec_id") % 3
    pick = lambda a, b, c: F.when(kind == 0, a).when(kind == 1, b).otherwise(c)
    failed = C("label") == 9
    digits = F.transform("px", lambda v: F.lpad(F.hex(F.floor(F.abs(v) * 7).cast("int") % 256), 2, "0"))
    n, w = pick(F.lit(1), F.lit(3), F.lit(4)), pick(F.lit(8), F.lit(7), F.lit(4))
    h = pick(F.lit(8), F.lit(3), F.lit(4))
    data = F.unhex(F.array_join(F.slice(digits, F.lit(1), h * w * n), ""))
    image = F.struct(
        C("vec_id").cast("string").alias("origin"),
        F.when(failed, -1).otherwise(h).alias("height"),
        F.when(failed, -1).otherwise(w).alias("width"),
        F.when(failed, -1).otherwise(n).alias("nChannels"),
        F.when(failed, F.unhex(F.lit(""))).otherwise(data).alias("data"),
    )
    rows = rasters.normalise_image_struct(t("v_planes").select(image.alias("image")))
    zipped = F.arrays_zip("blue", "green", "red")
    out = rows.select("path", "reason", F.posexplode_outer(zipped).alias("pos", "p"))
    known = lambda c, name: F.coalesce(F.col(c), F.lit(-1)).alias(name)
    return out.select(
        "path", known("pos", "pos"), known("p.blue", "blue"), known("p.green", "green"), known("p.red", "red"), "reason"
    )


@query(
    "S3",
    """
    SELECT cast(vec_id AS VARCHAR) AS image_id, CASE WHEN label <> 9 THEN 8 ELSE -1 END AS h,
           CASE WHEN label <> 9 THEN 8 ELSE -1 END AS w,
           CASE WHEN label <> 9 THEN round(f[1], 4) + 0 END AS first, CASE WHEN label <> 9 THEN round(f[64], 4) + 0 END AS last,
           CASE WHEN label <> 9 THEN round(list_sum(f), 3) + 0 END AS total
    FROM (SELECT *, list_transform(px, lambda v: cast(cast(v AS FLOAT) AS DOUBLE)) AS f FROM v_planes) p""",
)
def s3(t):
    rows = plane_source.decode_planes(encode_planes(t.spread(t("v_planes"))))
    px = F.transform("px", lambda v: v.cast("double"))
    total = F.aggregate(px, F.lit(0.0), lambda a, v: a + v)
    value = lambda c, d: F.round(c, d) + F.lit(0.0)
    return rows.select(
        "image_id",
        F.coalesce("h", F.lit(-1)).alias("h"),
        F.coalesce("w", F.lit(-1)).alias("w"),
        value(F.get(px, F.lit(0)), 4).alias("first"),
        value(F.get(px, F.lit(63)), 4).alias("last"),
        value(total, 3).alias("total"),
    )


def _coco_docs(t):
    """A COCO document per line item: one image and as many annotations as the line number says."""
    i = F.sequence(F.lit(1), C("l_linenumber"))
    box = lambda k: F.array(
        (C("l_partkey") + k * 13) % 600, (C("l_suppkey") * 7 + k * 29) % 480, C("l_quantity").cast("bigint"), C("l_linenumber") * 5
    )
    annotations = F.transform(
        i,
        lambda k: F.struct(
            k.alias("id"),
            C("l_orderkey").alias("image_id"),
            (k % 2).alias("category_id"),
            box(k).alias("bbox"),
            F.array().cast("array<array<double>>").alias("segmentation"),
            F.when(C("l_quantity") == 50, 1).otherwise(0).alias("iscrowd"),
        ),
    )
    image = F.struct(
        C("l_orderkey").alias("id"), C("file").alias("file_name"), F.lit(512).alias("height"), F.lit(640).alias("width")
    )
    categories = F.array(
        *[F.struct(F.lit(k).alias("id"), F.lit("hotspots").alias("name")) for k in (0, 1)]
    )
    doc = F.to_json(
        F.struct(F.array(image).alias("images"), annotations.alias("annotations"), categories.alias("categories"))
    )
    return t.sql("SELECT * FROM v_docs", spread=True).select(C("doc").alias("split"), doc.alias("text"))


@query(
    "S4",
    """
    SELECT doc AS split, 'image' AS kind, image_id AS id, file AS name, cast(NULL AS double) AS x, cast(NULL AS double) AS y,
           -1 AS category_id FROM v_boxes WHERE i = 1
    UNION ALL
    SELECT doc, 'annotation', i, NULL, x1, y1, i % 2 FROM v_boxes
    UNION ALL
    SELECT doc, 'category', k, 'hotspots', NULL, NULL, -1 FROM v_docs, (VALUES (0), (1)) AS c(k)""",
)
def s4(t):
    tables = coco.coco_tables(coco.coco_text_elements(_coco_docs(t)))
    number, text, no_class = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(-1)

    def row(kind, key, name=text, x=number, y=number, category=no_class):
        return {"kind": F.lit(kind), "id": key.cast("bigint"), "name": name, "x": x, "y": y, "category_id": category}

    return tables.union(
        images=lambda r: row("image", r["id"], r["file_name"]),
        annotations=lambda r: row("annotation", r["id"], x=r["bbox"][0], y=r["bbox"][1], category=r["category_id"]),
        categories=lambda r: row("category", r["id"], r["name"]),
    )


@query(
    "S5",
    """
    SELECT image_id, '/rgb/' || name AS rgb_path, '/th/' || name || '.tif' AS thermal_path FROM v_images WHERE image_id % 7 <> 0
    UNION ALL
    SELECT image_id, '/rgb2/' || name, '/th2/' || name || '.tif' FROM v_images WHERE image_id % 7 <> 0""",
)
def s5(t):
    """Pair files of two pairs each; each seventh is cut off and counts as empty."""
    path = lambda d, e: F.concat(F.lit(d), "name", F.lit(e))
    text = F.to_json(F.create_map(path("/rgb/", ""), path("/th/", ".tif"), path("/rgb2/", ""), path("/th2/", ".tif")))
    cut = F.when(C("image_id") % 7 == 0, F.lit('{"a": ')).otherwise(text)
    return metadata.parse_pairs(t("v_images").select("image_id", cut.alias("text")))


def prediction_docs(t):
    """Prediction JSON in four shapes: object, object with ``bboxes``, list of objects, list of lists."""
    i = F.sequence(F.lit(1), C("l_linenumber"))
    x1, y1 = (lambda k: (C("l_partkey") + k * 13) % 600), (lambda k: (C("l_suppkey") * 7 + k * 29) % 480)
    box = lambda k: F.array(
        x1(k).cast("double"), y1(k).cast("double"), x1(k) + C("l_quantity"), y1(k) + (C("l_linenumber") * 5).cast("double")
    )
    score = lambda k: ((C("l_partkey") * 37 + C("l_suppkey") * 11 + k * 101) % 1000).cast("double") / F.lit(1000.0)
    label = lambda k: ((C("l_partkey") + k) % 7).cast("int")
    boxes, scores, labels = F.transform(i, box), F.transform(i, score), F.transform(i, label)
    common = [scores.alias("scores"), labels.alias("classes")]
    items = F.transform(i, lambda k: F.struct(box(k).alias("bbox"), score(k).alias("score"), label(k).alias("class")))
    text = (
        F.when(C("shape") == 0, F.to_json(F.struct("file", boxes.alias("boxes"), *common)))
        .when(C("shape") == 1, F.to_json(F.struct("file", boxes.alias("bboxes"), *common)))
        .when(C("shape") == 2, F.to_json(items))
        .otherwise(F.to_json(boxes))
    )
    return t.sql("SELECT * FROM v_docs", spread=True).select("doc", C("file").alias("stem"), text.alias("value"))


def coerced(t):
    """Predictions (doc, file, boxes, scores, classes) of all documents."""
    return predictions.coerce_predictions(prediction_docs(t)).drop("value", "stem", "_corrupt")


_DETS_OF_DOCS = """
    SELECT doc, file, cast(i - 1 AS int) AS det_idx, x1, y1, x2, y2, score, class FROM v_boxes"""


@query("S6", _DETS_OF_DOCS)
def s6(t):
    dets = predictions.explode_detections(coerced(t))
    return dets.select("doc", "file", "det_idx", "x1", "y1", "x2", "y2", "score", "class")


def model_docs(t):
    meta = F.to_json(
        F.struct(
            F.when(C("s_suppkey") % 5 > 0, F.when(C("s_suppkey") % 2 == 0, "rgbtherm").otherwise("rgb")).alias("input_mode"),
            F.when(C("s_suppkey") % 4 > 0, C("s_nationkey")).alias("num_classes"),
            (C("s_suppkey") % 10 / 10).alias("score_thresh_test"),
            F.array(F.lit("hot"), C("name")).alias("class_names"),
        )
    )
    text = F.when(C("s_suppkey") % 7 == 0, F.lit("{broken")).otherwise(meta)
    return t("v_runs").select("name", text.alias("text"))


_META = """
    SELECT name, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 THEN 'rgb' WHEN s_suppkey % 2 = 0 THEN 'rgbtherm' ELSE 'rgb' END
           AS input_mode, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 4 = 0 THEN 0 ELSE s_nationkey END AS num_classes,
           CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE cast(s_suppkey % 10 AS double) / 10 END AS score_thresh_test,
           CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'hot,' || name END AS class_names FROM v_runs"""


@query("S7", _META)
def s7(t):
    meta = metadata.parse_model_meta(model_docs(t))
    return meta.select("name", "input_mode", "num_classes", "score_thresh_test", F.array_join("class_names", ",").alias("class_names"))


@query(
    "S8",
    """
    SELECT l_orderkey || '-' || l_linenumber AS file_stem, cast(l_linenumber % 2 AS int) AS cls,
           cast(l_partkey % 1000 AS double) / 1000 AS cx, cast(l_suppkey % 1000 AS double) / 1000 AS cy,
           l_quantity / 100 AS w, cast(l_linenumber AS double) / 10 AS h FROM lineitem WHERE l_linenumber <> 7""",
)
def s8(t):
    """A label line per line item; where the line number is 7 a word stands for the height."""
    parts = [
        (C("l_linenumber") % 2).cast("string"),
        (C("l_partkey") % 1000 / 1000).cast("string"),
        (C("l_suppkey") % 1000 / 1000).cast("string"),
        (C("l_quantity") / 100).cast("string"),
        F.when(C("l_linenumber") == 7, "tall").otherwise((C("l_linenumber") / 10).cast("string")),
    ]
    lines = t.table("lineitem").select(
        F.concat_ws("-", C("l_orderkey").cast("string"), C("l_linenumber").cast("string")).alias("file_stem"),
        F.concat_ws(" ", *parts).alias("line"),
    )
    return coco.parse_yolo(lines)


@query(
    "S9",
    """
    SELECT 'a_' || o_orderkey || '.zip' AS archive, 'f' || i || '/im_' || o_orderkey || '_' || i || '.jpg' AS member,
           'im_' || o_orderkey || '_' || i || '.jpg' AS name, cast(length(cast(o_orderkey AS VARCHAR)) * (i + 1) AS int) AS size
    FROM orders, (VALUES (0), (2)) AS n(i) WHERE i <= o_orderkey % 4""",
)
def s9(t):
    members = archives.image_members(archives.expand_archive_bytes(encode_archives(t.spread(t.table("orders").select("o_orderkey")))))
    return members.select("archive", "member", "name", F.length("content").alias("size"))


@query("S10", "SELECT name, round(lat, 9) AS lat, round(lon, 9) AS lon FROM v_geo")
def s10(t):
    located = exif.positions(exif.decode_exif_gps(encode_jpegs(t("v_gps"))))
    return located.select(C("path").alias("name"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(
    "S11",
    """
    SELECT o_orderkey, 0 AS idx, 'Point' AS geometry_type, cast(o_custkey % 90 AS double) AS lat, o_totalprice AS lon,
           '{"n":' || o_custkey || '}' AS properties FROM orders WHERE o_orderkey % 6 <> 0
    UNION ALL
    SELECT o_orderkey, 1, 'Polygon', NULL, NULL, '{"n":1}' FROM orders WHERE o_orderkey % 6 <> 0""",
)
def s11(t):
    """A collection of a point and a polygon per order; each sixth text is not JSON."""
    number = lambda c: c.cast("string")
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":'),
        number(C("o_custkey")),
        F.lit('},"geometry":{"type":"Point","coordinates":['),
        number(C("o_totalprice")),
        F.lit(","),
        number((C("o_custkey") % 90).cast("double")),
        F.lit(']}},{"type":"Feature","properties":{"n":1},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}'),
    )
    docs = t.table("orders").select("o_orderkey", F.when(C("o_orderkey") % 6 == 0, "nope").otherwise(text).alias("text"))
    return metadata.parse_geojson(docs).drop("geometry")


_MANIFEST = """
    SELECT doc AS session, file || cast(i AS VARCHAR) AS file, '/media/o/' || i AS overlay, '/media/t/' || i AS thumb,
           cast(i * 3 AS int) AS n FROM v_boxes WHERE shape <> 3"""


@query("S12", _MANIFEST)
def s12(t):
    i = F.sequence(F.lit(1), C("l_linenumber"))
    item = lambda k: F.struct(
        F.concat("file", k.cast("string")).alias("file"),
        F.concat(F.lit("/media/o/"), k.cast("string")).alias("overlay"),
        F.concat(F.lit("/media/t/"), k.cast("string")).alias("thumb"),
        (k * 3).alias("n"),
    )
    text = F.when(C("shape") == 3, F.lit("[{]")).otherwise(F.to_json(F.transform(i, item)))
    return metadata.parse_manifest(t.sql("SELECT * FROM v_docs", spread=True).select(C("doc").alias("session"), text.alias("text")))


@query("S13", "SELECT event_id, event_type, user_id FROM events")
def s13(t):
    """The events table read as a stream, appended to a table exactly once."""
    schema = t.table("events").schema
    stream = log_stream.read_table_stream(t.spark, t.sf_dir, schema, "events.parquet")
    out = scratch_path(t.spark, "s13")
    log_streams.append_to_table(stream.select("event_id", "event_type", "user_id"), out, f"{out}-state").awaitTermination()
    return t.spark.read.parquet(out)


# ------------------------------------------------------------------------------------------------------- sinks


@query("K1", _DETS_OF_DOCS)
def k1(t):
    """Predictions written per session and read back."""
    out = scratch_path(t.spark, "k1")
    rows = coerced(t).withColumn("session", F.concat(F.lit("s"), F.split("doc", "-")[1]))
    keyed = rows.withColumn("file", F.concat_ws("|", "doc", "file"))
    writers.write_predictions(keyed, out)
    back = predictions.explode_detections(predictions.read_prediction_table(t.spark, out))
    part = F.split("file", r"\|")
    return back.select(
        part[0].alias("doc"), part[1].alias("file"), "det_idx", "x1", "y1", "x2", "y2", "score", "class"
    )


_POINTS = "SELECT i.session, g.name, g.lat, g.lon FROM v_images i JOIN v_geo g ON i.name = g.name WHERE g.lat IS NOT NULL"


@query(
    "K2",
    f"""
    WITH p AS (SELECT session, name, row_number() OVER (PARTITION BY session ORDER BY name) AS seq FROM ({_POINTS}) q)
    SELECT session, seq, name, 'feature' AS kind FROM p
    UNION ALL SELECT DISTINCT session, 0, NULL, 'head' FROM p
    UNION ALL SELECT session, max(seq) + 1, NULL, 'tail' FROM p GROUP BY session""",
)
def k2(t):
    from heliotab.functions import geo

    text = geo.point_feature(C("lat"), C("lon"), F.struct("name"))
    features = t.sql(_POINTS).select("session", "name", text.alias("feature"))
    lines = writers.geojson_lines(features)
    name = F.get_json_object(F.regexp_replace("value", "^,", ""), "$.properties.name")
    kind = F.when(C("value").startswith('{"type":"FeatureCollection"'), "head").when(name.isNull(), "tail").otherwise("feature")
    return lines.select("session", "seq", F.when(kind == "feature", name).alias("name"), kind.alias("kind"))


@query("K3", "SELECT session, name AS file, '/media/' || session || '/overlays/' || name AS overlay, image_id % 9 AS n FROM v_images")
def k3(t):
    out = scratch_path(t.spark, "k3")
    rows = t("v_images").select(
        C("session").alias("session"),
        C("name").alias("file"),
        names.media_url(C("session"), "overlays", C("name")).alias("overlay"),
        names.media_url(C("session"), "thumbs", C("name")).alias("thumb"),
        (C("image_id") % 9).alias("n"),
    )
    writers.write_manifest(rows, out)
    return metadata.read_manifest(t.spark, out).select("session", "file", "overlay", C("n").cast("bigint").alias("n"))


@query(
    "K4",
    """
    SELECT dataset AS split, (row_number() OVER (PARTITION BY dataset ORDER BY '/rgb/' || name) - 1) // 500 AS chunk,
           '/rgb/' || name AS rgb_path, '/th/' || image_id || '.tif' AS thermal_path FROM v_images""",
)
def k4(t):
    pairs = t("v_images").select(
        C("dataset").alias("split"),
        F.concat(F.lit("/rgb/"), "name").alias("rgb_path"),
        F.concat(F.lit("/th/"), C("image_id").cast("string"), F.lit(".tif")).alias("thermal_path"),
    )
    return metadata.parse_pairs(writers.pairs_documents(pairs, chunk_size=500).drop("n"))


@query(
    "K5",
    """
    SELECT name, CASE WHEN s_nationkey < 12 THEN 'rgbtherm' ELSE 'rgb' END AS input_mode, s_nationkey AS num_classes,
           CASE WHEN s_suppkey % 3 = 0 THEN 0.6 ELSE cast(0.5 AS double) END AS score_thresh_test, 'a,' || name AS class_names
    FROM v_runs""",
)
def k5(t):
    out = scratch_path(t.spark, "k5")
    rows = t("v_runs").select(
        "name",
        (C("s_nationkey") < 12).alias("use_thermal"),
        C("s_nationkey").alias("num_classes"),
        F.when(C("s_suppkey") % 3 > 0, F.lit(0.5)).alias("score_thresh_test"),
        F.array(F.lit("a"), C("name")).alias("class_names"),
    )
    writers.append_model_meta(rows, out)
    schema = "name string, input_mode string, num_classes int, score_thresh_test double, class_names array<string>"
    return t.spark.read.schema(schema).json(out).withColumn("class_names", F.array_join("class_names", ","))


@query(
    "K6",
    """
    SELECT doc_id AS run, 'w.pth' AS weights, CASE WHEN lang = 'en' THEN -1 ELSE octet_length(encode(text)) END AS weights_bytes,
           CASE WHEN lang = 'en' THEN 'missing' ELSE substr(md5(text), 1, 8) END AS weights_md5, 0.6::DOUBLE AS score_thresh,
           'rgb' AS mode FROM documents""",
)
def k6(t):
    """Each document stands for a weights file; those in English are missing."""
    docs = t.table("documents").withColumn("weights", F.lit("w.pth"))
    files = docs.filter("lang <> 'en'").select(
        C("doc_id").alias("run"), C("weights").alias("name"), F.encode("text", "UTF-8").alias("content")
    )
    runs = docs.select(C("doc_id").alias("run"), "weights")
    return scoring_audit(files, runs, {"score_thresh": 0.6, "mode": "rgb"})


@query(
    "K7",
    """
    SELECT 'v' || vec_id || '_thermal' AS image_id, h, w, round(f[1], 4) + 0 AS first, round(list_sum(f), 3) + 0 AS total
    FROM (SELECT *, list_transform(px, lambda v: cast(cast(v AS FLOAT) AS DOUBLE)) AS f FROM v_planes) p""",
)
def k7(t):
    out = scratch_path(t.spark, "k7")
    rows = t("v_planes").withColumn("name", F.concat(F.lit("v"), C("vec_id").cast("string"), F.lit(".jpg")))
    writers.write_planes(rows, out)
    total = F.aggregate("px", F.lit(0.0), lambda a, v: a + v.cast("double"))
    value = lambda c, d: F.round(c.cast("double"), d) + F.lit(0.0)
    return t.spark.read.parquet(out).select(
        "image_id", "h", "w", value(C("px")[0], 4).alias("first"), value(total, 3).alias("total")
    )


@query("K9", "SELECT name FROM v_images i WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = i.image_id)")
def k9(t):
    images = t("v_images").select("name")
    present = t("v_docs").select(C("file").alias("name"))
    return writers.absent(images, present)
