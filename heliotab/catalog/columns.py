"""Queries over the column functions: names, logs, positions, boxes and planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliotab.catalog.registry import pixels, query
from heliotab.functions import boxes, geo, logs, names, planes
from heliotab.operators.detections import score_filter
from heliotab.operators.joins import resolve_class

C = F.col

# ------------------------------------------------------------------------------------------------------ names


@query("P1", "SELECT image_id, split_part(name, '.rf.', 1) AS stem FROM v_images")
def p1(t):
    return t("v_images").select("image_id", names.strip_rf_suffix(C("name")).alias("stem"))


_PATHS = """
    SELECT path FROM v_files UNION ALL SELECT url AS path FROM pages UNION ALL
    SELECT '/x/..' || p_name || '..zip' AS path FROM part UNION ALL SELECT '.' || p_type AS path FROM part"""


@query(
    "P2",
    f"""
    WITH paths AS ({_PATHS}), b AS (SELECT path, regexp_extract(path, '([^/]*)/*$', 1) AS base FROM paths)
    SELECT path, base, regexp_replace(base, '^(.+)\\.[^.]+$', '\\1') AS stem,
           lower(regexp_extract(base, '^.+(\\.[^.]+)$', 1)) AS suffix FROM b""",
)
def p2(t):
    path = C("path")
    return t.sql(_PATHS).select(
        "path",
        names.basename(path).alias("base"),
        names.stem(path).alias("stem"),
        names.suffix_lower(path).alias("suffix"),
    )


@query(
    "P3",
    """
    SELECT doc_id, regexp_replace(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 128), '[^A-Za-z0-9._-]+', '_', 'g')
           AS safe FROM documents""",
)
def p3(t):
    return t.table("documents").select("doc_id", names.safe_name(C("text")).alias("safe"))


_SLUG_INPUT = """
    SELECT url AS name FROM pages UNION ALL SELECT p_name || '.' || p_type || '.zip' AS name FROM part UNION ALL
    SELECT '###' || repeat('.', p_size) || '.zip' AS name FROM part"""


@query(
    "P4",
    f"""
    WITH n AS ({_SLUG_INPUT}),
         s AS (SELECT name, regexp_replace(regexp_extract(name, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1') AS stem FROM n)
    SELECT name, coalesce(nullif(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'),
           ''), 'dataset') AS slug FROM s""",
)
def p4(t):
    return t.sql(_SLUG_INPUT).select("name", names.slugify(C("name")).alias("slug"))


@query(
    "P12",
    """
    SELECT image_id, '/media/' || session || '/images/' || name AS image_url,
           '/media/' || session || '/overlays/' || name AS overlay_url, '/media/' || session || '/thumbs/' || name AS thumb_url
    FROM v_images""",
)
def p12(t):
    url = lambda kind: names.media_url(C("session"), kind, C("name"))
    return t("v_images").select(
        "image_id",
        url("images").alias("image_url"),
        url("overlays").alias("overlay_url"),
        url("thumbs").alias("thumb_url"),
    )


@query(
    "P8",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           l_returnflag || ':' || printf('%.2f', l_extendedprice / l_quantity / 1000) AS label,
           l_returnflag || ':' || printf('%.2f', (l_partkey % 1000) / 1000 + 0.005) AS tie_label FROM lineitem""",
)
def p8(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    tie = (C("l_partkey") % 1000) / 1000 + F.lit(0.005)
    return t.table("lineitem").select(
        *keys,
        names.box_label(C("l_returnflag"), C("l_extendedprice") / C("l_quantity") / 1000).alias("label"),
        names.box_label(C("l_returnflag"), tie).alias("tie_label"),
    )


@query(
    "P29",
    """
    SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp,
           CASE WHEN event_type = 'view' THEN 'data_' || strftime(ts, '%Y%m%d_%H%M%S')
                ELSE regexp_replace(event_type || ' ' || props, '[^A-Za-z0-9._-]+', '_', 'g') END AS name FROM events""",
)
def p29(t):
    given = F.when(C("event_type") == "view", F.lit("  ")).otherwise(F.concat_ws(" ", "event_type", "props"))
    return t.table("events").select(
        "event_id", names.run_stamp(C("ts")).alias("stamp"), names.name_or_stamp(given, C("ts"), "data_").alias("name")
    )


# ------------------------------------------------------------------------------------------------------- logs

_PARSED = """
    SELECT seq, clock AS ts, CASE WHEN line LIKE '%] ERROR: %' THEN 'ERROR' ELSE 'INFO' END AS level,
           substr(line, CASE WHEN line LIKE '%] ERROR: %' THEN 19 ELSE 18 END) AS message, line FROM v_logs"""
_TAGGED = rf"""
    SELECT seq, ts, level, message, line,
           nullif(regexp_extract(message, '^UI:(OK|INFO|WARN|ERR):(train|test): ?', 1), '') AS ui_level,
           nullif(regexp_extract(message, '^UI:(OK|INFO|WARN|ERR):(train|test): ?', 2), '') AS job,
           CASE WHEN message LIKE 'UI:%' THEN regexp_replace(message, '^UI:[A-Z]+:[a-z]+: ?', '') END AS text
    FROM ({_PARSED}) p"""


@query("P30", f"SELECT seq, ts, level, message, ui_level, job, text FROM ({_TAGGED}) x")
def p30(t):
    parsed = logs.parse_log(t("v_logs"))
    return parsed.select("seq", "ts", "level", "message", "ui_level", "job", "text")


_TRAIN = """(line LIKE '%[train]%' OR line LIKE '%UI:INFO:train%' OR line LIKE '%UI:OK:train%' OR line LIKE '%UI:ERR:train%'
             OR regexp_matches(line, '(?i)\\biter[: ]|\\bloss[: ]|\\beta[: ]'))"""
_TEST = """(line LIKE '%[test]%' OR line LIKE '%UI:INFO:test%' OR line LIKE '%UI:OK:test%' OR line LIKE '%UI:ERR:test%')"""


@query("P31", f"SELECT seq, {_TRAIN} AS train, {_TEST} AS test FROM v_logs")
def p31(t):
    return t("v_logs").select("seq", logs.is_train_line(C("line")).alias("train"), logs.is_test_line(C("line")).alias("test"))


@query(
    "P32",
    """
    SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l
    WHERE regexp_matches(line, '[^\\s]')""",
)
def p32(t):
    return logs.explode_lines(t.table("documents"), "text").select("doc_id", "line")


# ---------------------------------------------------------------------------------------------------- geometry


def _rational(num, den=None):
    return F.struct(C(num).alias("num"), (C(den) if den else F.lit(1).cast("bigint")).alias("den"))


@query("P5", "SELECT name, round(lat, 9) AS lat, round(lon, 9) AS lon FROM v_geo")
def p5(t):
    side = lambda d, ref: geo.dms_to_deg(_rational(d), _rational("m"), _rational("s_num", "s_den"), C(ref))
    gps = t("v_gps")
    return gps.select(
        "name", F.round(side("lat_d", "lat_ref"), 9).alias("lat"), F.round(side("lon_d", "lon_ref"), 9).alias("lon")
    )


@query(
    "P10",
    "SELECT name, 'Feature' AS ftype, 'Point' AS gtype, name AS prop, round(lon, 9) AS lon, round(lat, 9) AS lat FROM v_geo "
    "WHERE lat IS NOT NULL",
)
def p10(t):
    text = geo.point_feature(C("lat"), C("lon"), F.struct("name"))
    part = lambda p: F.get_json_object("f", p)
    return (
        t("v_geo")
        .filter("lat IS NOT NULL")
        .withColumn("f", text)
        .select(
            "name",
            part("$.type").alias("ftype"),
            part("$.geometry.type").alias("gtype"),
            part("$.properties.name").alias("prop"),
            F.round(part("$.geometry.coordinates[0]").cast("double"), 9).alias("lon"),
            F.round(part("$.geometry.coordinates[1]").cast("double"), 9).alias("lat"),
        )
    )


@query(
    "P11",
    """
    SELECT name, pos, round(lon + dx * cast(0.00001 AS double), 9) AS lon, round(lat + dy * cast(0.00001 AS double), 9) AS lat
    FROM v_geo, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) AS c(pos, dx, dy)
    WHERE lat IS NOT NULL""",
)
def p11(t):
    ring = geo.square_ring(C("lat"), C("lon"))
    rows = t("v_geo").filter("lat IS NOT NULL").select("name", F.posexplode(ring).alias("pos", "corner"))
    return rows.select(
        "name", "pos", F.round(C("corner")[0], 9).alias("lon"), F.round(C("corner")[1], 9).alias("lat")
    )


@query(
    "P37",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, z, x, y,
           round(x * side - h, 6) AS l, round(h - y * side - side, 6) AS b, round(x * side - h + side, 6) AS r,
           round(h - y * side, 6) AS t
    FROM (SELECT *, 2 * h / pow(2, z) AS side FROM
           (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber * 3 AS z, l_partkey % (1 << l_linenumber) AS x,
                   l_suppkey % (1 << l_linenumber) AS y, pi() * cast(6378137 AS double) AS h FROM lineitem) a) s""",
)
def p37(t):
    rows = t.sql(
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber * 3 AS z, l_partkey % shiftleft(1, l_linenumber) AS x, "
        "l_suppkey % shiftleft(1, l_linenumber) AS y FROM lineitem"
    ).withColumn("q", geo.tile_bounds(C("z"), C("x"), C("y")))
    sides = {"l": "left", "b": "bottom", "r": "right", "t": "top"}
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "z", "x", "y", *[F.round(f"q.{f}", 6).alias(a) for a, f in sides.items()]
    )


_LAYER = """
    SELECT source, CASE WHEN vec % 7 = 0 THEN 2056 ELSE epsg END AS epsg, x0 AS l, y0 - h * dy AS b, x0 + w * dx AS r, y0 AS t
    FROM (SELECT *, cast(source AS bigint) AS vec FROM v_rasters) s"""


@query(
    "P38",
    f"""
    SELECT source, round(CASE epsg WHEN 4326 THEN l WHEN 3857 THEN degrees(l / 6378137) ELSE -180 END, 6) AS west,
           round(CASE epsg WHEN 4326 THEN b WHEN 3857 THEN degrees(2 * atan(exp(b / 6378137)) - pi() / 2) ELSE -85 END, 6) AS south,
           round(CASE epsg WHEN 4326 THEN r WHEN 3857 THEN degrees(r / 6378137) ELSE 180 END, 6) AS east,
           round(CASE epsg WHEN 4326 THEN t WHEN 3857 THEN degrees(2 * atan(exp(t / 6378137)) - pi() / 2) ELSE 85 END, 6) AS north
    FROM ({_LAYER}) q""",
)
def p38(t):
    rows = t.sql(_LAYER).withColumn("q", geo.bounds_wgs84(C("epsg"), C("l"), C("b"), C("r"), C("t")))
    sides = {"west": "left", "south": "bottom", "east": "right", "north": "top"}
    return rows.select("source", *[(F.round(f"q.{f}", 6) + F.lit(0.0)).alias(a) for a, f in sides.items()])


# ------------------------------------------------------------------------------------------------------- boxes

_SCORES = """
    SELECT image_id, det_key, CASE WHEN class = 3 THEN 'n/a' WHEN class = 2 THEN NULL ELSE cast(score AS string) END AS score
    FROM v_dets"""


@query(
    "P6",
    f"SELECT image_id, det_key FROM ({_SCORES}) s WHERE try_cast(score AS double) >= 0.6 OR try_cast(score AS double) IS NULL",
)
def p6(t):
    return score_filter(t.sql(_SCORES)).select("image_id", "det_key")


_CLASS_TEXT = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN '1.0' WHEN 3 THEN '-1'
           WHEN 4 THEN '7' WHEN 5 THEN '0' WHEN 6 THEN '2' ELSE '2.9' END AS c FROM lineitem"""


@query(
    "P7",
    f"""
    WITH c AS ({_CLASS_TEXT}), k AS (SELECT *, CASE WHEN regexp_matches(c, '^[0-9]+$') THEN cast(c AS int) ELSE 0 END AS id FROM c)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(trunc(cast(c AS double)) AS int) AS class,
           CASE id WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE cast(id AS string) END AS classname FROM k""",
)
def p7(t):
    names_ab = F.array(F.lit("a"), F.lit("b"))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return t.sql(_CLASS_TEXT).select(*keys, resolve_class(C("c"), names_ab).alias("r")).select(*keys, "r.*")


_MOVED = "SELECT image_id, det_key, x1 - 20.7 AS x1, y1 - 10.3 AS y1, x2 + 0.9 AS x2, y2 + 0.4 AS y2 FROM v_dets"
_MOVED = _MOVED.replace("20.7", "cast(20.7 AS double)").replace("10.3", "cast(10.3 AS double)")
_MOVED = _MOVED.replace("0.9", "cast(0.9 AS double)").replace("0.4", "cast(0.4 AS double)")


@query(
    "P9",
    f"""
    SELECT image_id, det_key, cast(trunc(x1) AS int) AS x1i, cast(trunc(y1) AS int) AS y1i, cast(trunc(x2) AS int) AS x2i,
           cast(trunc(y2) AS int) AS y2i, cast(trunc(x1) AS int) AS label_x, greatest(0, cast(trunc(y1) AS int) - 6) AS label_y
    FROM ({_MOVED}) m""",
)
def p9(t):
    return boxes.draw_list(t.sql(_MOVED)).select(
        "image_id", "det_key", "x1i", "y1i", "x2i", "y2i", "label_x", "label_y"
    )


@query("P13", "SELECT image_id, ann_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM v_anns")
def p13(t):
    boxed = t("v_anns").withColumn("b", boxes.xywh_to_xyxy(F.array("x", "y", "w", "h")))
    return boxes.corners(boxed, "b").select("image_id", "ann_id", "x1", "y1", "x2", "y2")


@query(
    "P14",
    """
    SELECT image_id, ann_id, round(x - hw, 6) AS x1, round(y - hh, 6) AS y1, round(x + hw, 6) AS x2, round(y + hh, 6) AS y2
    FROM (SELECT *, (abs(cos(radians(ann_id % 180))) * w + abs(sin(radians(ann_id % 180))) * h) / 2 AS hw,
                 (abs(cos(radians(ann_id % 180))) * h + abs(sin(radians(ann_id % 180))) * w) / 2 AS hh FROM v_anns) a""",
)
def p14(t):
    hull = boxes.rotated_to_xyxy(C("x"), C("y"), C("w"), C("h"), C("ann_id") % 180)
    rows = boxes.corners(t("v_anns").withColumn("b", hull), "b")
    return rows.select("image_id", "ann_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("x1", "y1", "x2", "y2")])


_SIZED = _MOVED.replace("SELECT image_id", "SELECT 600 AS width, 480 AS height, image_id")
_CLIPPED = f"""
    SELECT image_id, det_key, greatest(0, least(x1, 600)) AS x1, greatest(0, least(y1, 480)) AS y1,
           greatest(0, least(x2, 600)) AS x2, greatest(0, least(y2, 480)) AS y2 FROM ({_SIZED}) s"""


@query("P15", f"SELECT image_id, det_key, round(x1, 9) AS x1, round(y1, 9) AS y1, round(x2, 9) AS x2, round(y2, 9) AS y2 FROM ({_CLIPPED}) c")
def p15(t):
    clipped = boxes.clip_boxes(t.sql(_SIZED))
    return clipped.select("image_id", "det_key", *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("P16", f"SELECT image_id, det_key FROM ({_CLIPPED}) c WHERE x2 > x1 AND y2 > y1")
def p16(t):
    return boxes.drop_empty(boxes.clip_boxes(t.sql(_SIZED))).select("image_id", "det_key")


_CROWDS = "SELECT image_id, ann_id, CASE WHEN category_id = 3 THEN NULL ELSE iscrowd END AS iscrowd FROM v_anns"


@query("P17", f"SELECT image_id, ann_id FROM ({_CROWDS}) c WHERE iscrowd IS NULL OR iscrowd = 0")
def p17(t):
    return boxes.drop_crowd(t.sql(_CROWDS)).select("image_id", "ann_id")


_YOLO = """
    SELECT image_id, ann_id, (x + w / 2) / 640 AS cx, (y + h / 2) / 512 AS cy, w / 640 AS w, h / 512 AS h, 640 AS width,
           512 AS height FROM v_anns"""


@query(
    "P18",
    "SELECT image_id, ann_id, round(x, 6) AS x1, round(y, 6) AS y1, round(x + w, 6) AS x2, round(y + h, 6) AS y2 FROM v_anns",
)
def p18(t):
    box = boxes.yolo_to_xyxy(*[C(c) for c in ("cx", "cy", "w", "h", "width", "height")])
    rows = boxes.corners(t.sql(_YOLO).withColumn("b", box), "b")
    return rows.select("image_id", "ann_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("x1", "y1", "x2", "y2")])


_RESIZE_IN = """
    SELECT image_id, det_key, 200 + cast(det_key % 900 AS int) AS width, 300 + cast(image_id % 500 AS int) AS height,
           640 + 32 * cast(image_id % 6 AS int) AS target, x1, y1, x2, y2 FROM v_dets"""


@query(
    "P25",
    f"""
    WITH s AS ({_RESIZE_IN}),
         a AS (SELECT *, CASE WHEN height < width THEN cast(target AS double) ELSE cast(target AS double) / width * height END AS rh,
                      CASE WHEN height < width THEN cast(target AS double) / height * width ELSE cast(target AS double) END AS rw FROM s),
         b AS (SELECT *, CASE WHEN greatest(rh, rw) > 1333 THEN 1333 / greatest(rh, rw) ELSE 1 END AS k FROM a),
         c AS (SELECT *, cast(floor(rh * k + 0.5) AS int) AS new_h, cast(floor(rw * k + 0.5) AS int) AS new_w FROM b)
    SELECT image_id, det_key, new_h, new_w, round(x1 * (new_w / width), 6) AS x1, round(y1 * (new_h / height), 6) AS y1,
           round(x2 * (new_w / width), 6) AS x2, round(y2 * (new_h / height), 6) AS y2 FROM c""",
)
def p25(t):
    resized = boxes.resize_shortest_edge(t.sql(_RESIZE_IN), size=C("target"))
    return resized.select(
        "image_id", "det_key", "new_h", "new_w", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")]
    )


@query(
    "P26",
    """
    SELECT image_id, det_key, CASE WHEN image_id % 2 = 0 THEN 640 - x2 ELSE x1 END AS x1,
           CASE WHEN image_id % 2 = 0 THEN 640 - x1 ELSE x2 END AS x2, CASE WHEN image_id % 3 = 0 THEN 512 - y2 ELSE y1 END AS y1,
           CASE WHEN image_id % 3 = 0 THEN 512 - y1 ELSE y2 END AS y2 FROM v_dets""",
)
def p26(t):
    sized = t("v_dets").withColumns({"width": F.lit(640), "height": F.lit(512)})
    flipped = boxes.flip_boxes(sized, C("image_id") % 2 == 0, "horizontal")
    flipped = boxes.flip_boxes(flipped, C("image_id") % 3 == 0, "vertical")
    return flipped.select("image_id", "det_key", "x1", "x2", "y1", "y2")


def _turned(x, y, axis):
    dx, dy = f"({x} - 320)", f"({y} - 256)"
    return f"(ca * {dx} + sa * {dy} + 320)" if axis == "x" else f"(ca * {dy} - sa * {dx} + 256)"


_CORNERS = (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))
_TX = ", ".join(_turned(x, y, "x") for x, y in _CORNERS)
_TY = ", ".join(_turned(x, y, "y") for x, y in _CORNERS)


@query(
    "P27",
    f"""
    SELECT image_id, det_key, round(greatest(0, least(640, least({_TX}))), 6) AS x1, round(greatest(0, least(512, least({_TY}))), 6) AS y1,
           round(greatest(0, least(640, greatest({_TX}))), 6) AS x2, round(greatest(0, least(512, greatest({_TY}))), 6) AS y2
    FROM (SELECT *, cos(radians(image_id % 11 - 5)) AS ca, sin(radians(image_id % 11 - 5)) AS sa FROM v_dets) d""",
)
def p27(t):
    sized = t("v_dets").withColumns({"width": F.lit(640), "height": F.lit(512)})
    turned = boxes.rotate_boxes(sized, C("image_id") % 11 - 5)
    return turned.select("image_id", "det_key", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "P28",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, 420 AS w,
           greatest(1, cast(floor(l_linenumber * 37 * (cast(420 AS double) / greatest(1, l_partkey % 1900))) AS int)) AS h FROM lineitem""",
)
def p28(t):
    size = boxes.thumb_size(C("l_partkey") % 1900, C("l_linenumber") * 37)
    return t.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", size.alias("s")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "s.w", "s.h"
    )


# ------------------------------------------------------------------------------------------------------- planes

_KINDS = """
    SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'a.TIF' WHEN 1 THEN 'a.tiff' WHEN 2 THEN 'a.png' ELSE 'tif' END AS path,
           CASE WHEN label = 3 THEN NULL ELSE px END AS px FROM v_planes"""


@query(
    "P19",
    f"""SELECT vec_id, CASE WHEN px IS NULL THEN 'missing' WHEN regexp_matches(lower(path), '\\.tiff?$') THEN 'tif' ELSE 'other' END
        AS kind FROM ({_KINDS}) k""",
)
def p19(t):
    return t.sql(_KINDS).select("vec_id", planes.thermal_kind(C("path"), C("px")).alias("kind"))


_UNNEST = "SELECT vec_id, cast(generate_subscripts({c}, 1) - 1 AS int) AS pos, round(unnest({c}), 6) + 0 AS v FROM ({q}) p"


def _by_pixel(q: str, c: str = "px") -> str:
    return _UNNEST.format(q=q, c=c)


@query(
    "P20",
    _by_pixel(
        """
        SELECT vec_id, CASE WHEN list_max(px) > 1.5 THEN list_transform(px, lambda v: least(greatest(v, 0), 100) / 100)
                            WHEN list_max(px) > list_min(px)
                            THEN list_transform(px, lambda v: (v - list_min(px)) / (list_max(px) - list_min(px)))
                            ELSE list_transform(px, lambda v: cast(0 AS double)) END AS px FROM v_planes"""
    ),
)
def p20(t):
    return pixels(t("v_planes"), ["vec_id"], planes.normalize_thermal_infer(C("px")))


@query(
    "P21",
    _by_pixel(
        """
        SELECT vec_id, list_transform(px, lambda v: least(greatest(v / CASE WHEN list_max(px) > 1 THEN list_max(px) ELSE 1 END, 0), 1))
               AS px FROM v_planes"""
    ),
)
def p21(t):
    return pixels(t("v_planes"), ["vec_id"], planes.normalize_thermal_train(C("px")))


@query(
    "P22",
    """
    SELECT image_id, pos, round(avg(v), 6) + 0 AS v FROM
      (SELECT vec_id // 3 AS image_id, cast(generate_subscripts(px, 1) - 1 AS int) AS pos, unnest(px) AS v FROM v_planes) p
    GROUP BY image_id, pos""",
)
def p22(t):
    bands = t("v_planes").select(
        F.floor(C("vec_id") / 3).alias("image_id"), (C("vec_id") % 3).alias("band"), "px"
    )
    return pixels(planes.mean_planes(bands), ["image_id"])


def _source(i: str, n: int, new_n: int) -> str:
    return f"greatest(0, least({n - 1}, ({i} + 0.5) * cast({n} AS double) / {new_n} - 0.5))"


_Y, _X = _source("(i // 10)", 8, 12), _source("(i % 10)", 8, 10)
_AT = "px[cast({r} * 8 + {c} + 1 AS int)]"
_R0, _C0 = f"floor({_Y})", f"floor({_X})"
_R1, _C1 = f"least(7, floor({_Y}) + 1)", f"least(7, floor({_X}) + 1)"
_FY, _FX = f"({_Y} - {_R0})", f"({_X} - {_C0})"
_LINEAR = (
    f"({_AT.format(r=_R0, c=_C0)} * (1 - {_FX}) + {_AT.format(r=_R0, c=_C1)} * {_FX}) * (1 - {_FY}) + "
    f"({_AT.format(r=_R1, c=_C0)} * (1 - {_FX}) + {_AT.format(r=_R1, c=_C1)} * {_FX}) * {_FY}"
)
_NEAREST = "px[least(7, (i // 10) * 8 // 12) * 8 + least(7, (i % 10) * 8 // 10) + 1]"


@query(
    "P23",
    f"""
    SELECT 'nearest' AS mode, n.* FROM ({_by_pixel(f"SELECT vec_id, list_transform(range(0, 120), lambda i: {_NEAREST}) AS px FROM v_planes")}) n
    UNION ALL
    SELECT 'linear' AS mode, n.* FROM ({_by_pixel(f"SELECT vec_id, list_transform(range(0, 120), lambda i: {_LINEAR}) AS px FROM v_planes")}) n""",
)
def p23(t):
    both = []
    for mode in ("nearest", "linear"):
        resized = planes.resize_plane(t.spread(t("v_planes")), F.lit(12), F.lit(10), mode)
        both.append(pixels(resized, ["vec_id"]).select(F.lit(mode).alias("mode"), "vec_id", "pos", "v"))
    return both[0].unionByName(both[1])


_COLOURED = (
    """
    SELECT vec_id, transform(px, v -> cast(floor(abs(v) * 7) AS int) % 256) AS c1,
           transform(px, v -> cast(floor(abs(v) * 11) AS int) % 256) AS c2,
           transform(px, v -> cast(floor(abs(v) * 13) AS int) % 256) AS c3,
           CASE WHEN label = 3 THEN NULL ELSE transform(px, v -> v / 10) END AS th FROM v_planes""",
    """
    SELECT vec_id, list_transform(px, lambda v: cast(floor(abs(v) * 7) AS int) % 256) AS c1,
           list_transform(px, lambda v: cast(floor(abs(v) * 11) AS int) % 256) AS c2,
           list_transform(px, lambda v: cast(floor(abs(v) * 13) AS int) % 256) AS c3,
           CASE WHEN label = 3 THEN NULL ELSE list_transform(px, lambda v: v / 10) END AS th FROM v_planes""",
)


def _stacked(layout: str) -> str:
    if layout == "train":
        colour = lambda c: f"list_transform({c}, lambda v: v / cast(255 AS double))"
        band = "coalesce(list_transform(th, lambda v: least(greatest(v, 0), 1)), list_transform(c1, lambda v: cast(0 AS double)))"
    else:
        colour = lambda c: f"list_transform({c}, lambda v: cast(v AS double))"
        band = "list_transform(th, lambda v: v * 255)"
    where = "" if layout == "train" else " WHERE th IS NOT NULL"
    joined = f"list_concat(list_concat({colour('c1')}, {colour('c2')}), list_concat({colour('c3')}, {band}))"
    return f"SELECT vec_id, {joined} AS px FROM ({_COLOURED[1]}) c{where}"


@query(
    "P24",
    f"""
    SELECT 'train' AS layout, n.* FROM ({_by_pixel(_stacked("train"))}) n
    UNION ALL
    SELECT 'score' AS layout, n.* FROM ({_by_pixel(_stacked("score"))}) n""",
)
def p24(t):
    both = []
    for layout in ("train", "score"):
        rows = t.sql(_COLOURED[0])
        px = planes.stack_channels([C("c1"), C("c2"), C("c3")], C("th"), layout)
        both.append(pixels(rows, ["vec_id"], px).select(F.lit(layout).alias("layout"), "vec_id", "pos", "v"))
    return both[0].unionByName(both[1])


@query(
    "P40",
    """
    SELECT vec_id, pos, cast(floor(greatest(0, least(1, (v - lo) / CASE WHEN hi <= lo THEN 1 ELSE hi - lo END)) * 255) AS int) AS u8
    FROM (SELECT vec_id, cast(generate_subscripts(px, 1) - 1 AS int) AS pos, unnest(px) AS v, px[10] AS lo, px[20] AS hi FROM v_planes) p""",
)
def p40(t):
    low, high = F.get("px", F.lit(9)), F.get("px", F.lit(19))
    rows = t("v_planes").withColumn("u", F.transform("px", lambda v: planes.stretch_u8(v, low, high)))
    return rows.select("vec_id", F.posexplode("u").alias("pos", "u8"))
