"""Queries over scoring, evaluation and the end-to-end plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from heliotab.catalog.columns import _COLOURED
from heliotab.catalog.joined import TILE, ZOOM, _tile_grid
from heliotab.catalog.readers import coerced, model_docs
from heliotab.catalog.registry import query
from heliotab.functions import boxes
from heliotab.operators.evaluate import coco_eval
from heliotab.operators.scoring import batch_score, batched, build_examples
from heliotab.plans import inspection, maps, quality, sessions, training
from heliotab.sources.metadata import parse_model_meta
from heliotab.sources.predictions import coerce_predictions

C = F.col

# ---------------------------------------------------------------------------------------------------- quality

_SINGLE = "SELECT doc, class, x1, y1, x2, y2, score, det_key FROM v_single"
_SINGLE_GT = "SELECT doc, class, g_x1 AS x1, y1, g_x2 AS x2, y2, area, iscrowd, det_key AS gt_key FROM v_single"

# The curves and their averages, from detections that are counted (class, thr, range, met, score, doc, det_key) and the
# numbers of boxes n (class, range, n).
_CURVE = """k AS (SELECT class, thr, range, count(*) FILTER (met) OVER w AS tp, count(*) FILTER (NOT met) OVER w AS fp FROM c WHERE counted
          WINDOW w AS (PARTITION BY class, thr, range ORDER BY score DESC, doc, det_key ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT k.class, thr, k.range, tp / n AS recall, tp / (tp + fp + 2.220446049250313e-16) AS precision FROM k
          JOIN n ON n.class = k.class AND n.range = k.range AND n > 0),
    g AS (SELECT class, thr, range, i * 0.01::DOUBLE AS point FROM n, thr x(thr), range(0, 101) q(i) WHERE n > 0),
    s AS (SELECT class, thr, range, floor(recall * 100 + 1e-9) AS step, max(precision) AS precision FROM r GROUP BY ALL),
    ap AS (SELECT g.class, g.thr, g.range, g.point, coalesce(max(s.precision), 0) AS precision FROM g
           LEFT JOIN s ON s.class = g.class AND s.thr = g.thr AND s.range = g.range AND s.step >= round(g.point * 100) GROUP BY ALL),
    curve AS (SELECT class, thr, range, avg(precision) AS ap FROM ap GROUP BY class, thr, range)"""

_AP = f"""
    areas(area, lo, hi) AS (VALUES ('all', 0::DOUBLE, 1e10), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10)),
    thr AS (SELECT round(0.5 + 0.05 * k, 2)::DOUBLE AS iou FROM range(0, 10) r(k)),
    p AS (SELECT d.doc, d.class, d.score, d.det_key, g.iscrowd, g.area AS ga, (d.x2 - d.x1) * (d.y2 - d.y1) AS da,
                 greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1)) AS inter
          FROM ({_SINGLE}) d JOIN ({_SINGLE_GT}) g ON d.doc = g.doc),
    f AS (SELECT p.*, t.iou AS thr, a.area AS range, (iscrowd = 0 AND inter / (da + ga - inter) >= thr - 1e-10) AS met,
                 (iscrowd = 1 AND inter / da >= thr - 1e-10) AS crowded, ga BETWEEN lo AND hi AS g_in, da BETWEEN lo AND hi AS d_in
          FROM p, thr t, areas a),
    c AS (SELECT *, CASE WHEN met THEN g_in WHEN crowded THEN false ELSE d_in END AS counted FROM f),
    n AS (SELECT class, range, count(*) FILTER (iscrowd = 0 AND g_in) AS n FROM c WHERE thr = 0.5 GROUP BY class, range),
    {_CURVE}"""
_OVERALL = """
    SELECT 'AP' AS metric, avg(ap) AS value FROM curve WHERE range = 'all'
    UNION ALL SELECT 'AP50', avg(ap) FROM curve WHERE range = 'all' AND thr = 0.5
    UNION ALL SELECT 'AP75', avg(ap) FROM curve WHERE range = 'all' AND thr = 0.75
    UNION ALL SELECT 'APs', avg(ap) FROM curve WHERE range = 'small'
    UNION ALL SELECT 'APm', avg(ap) FROM curve WHERE range = 'medium'
    UNION ALL SELECT 'APl', avg(ap) FROM curve WHERE range = 'large'"""


def _single(t):
    dets = t.sql(_SINGLE).withColumnRenamed("doc", "image_id")
    return dets, t.sql(_SINGLE_GT).withColumnRenamed("doc", "image_id")


@query(
    "A12",
    f"""
    WITH {_AP} SELECT metric, cast(NULL AS VARCHAR) AS class, round(value, 6) AS value FROM ({_OVERALL}) o
    UNION ALL SELECT 'AP', cast(class AS VARCHAR), round(avg(ap), 6) FROM curve WHERE range = 'all' GROUP BY class""",
)
def a12(t):
    dets, gts = _single(t)
    return coco_eval(dets, gts).withColumn("value", F.round("value", 6))


def _competing(dets: str, gts: str) -> str:
    """The protocol with detections that compete for boxes: along the ranks of an image and class, the boxes taken so
    far are a list per curve."""
    side = lambda a, b: f"greatest(0, least(d.{b}, g.{b}) - greatest(d.{a}, g.{a}))"
    return f"""
    WITH RECURSIVE areas(area, lo, hi) AS (VALUES ('all', 0::DOUBLE, 1e10), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10)),
    thr AS (SELECT round(0.5 + 0.05 * k, 2)::DOUBLE AS iou FROM range(0, 10) r(k)),
    d AS MATERIALIZED (SELECT *, (x2 - x1) * (y2 - y1) AS da FROM
      (SELECT *, row_number() OVER (PARTITION BY image_id, class ORDER BY score DESC, det_key) AS r FROM ({dets}) x) y WHERE r <= 100),
    gt AS MATERIALIZED ({gts}),
    p AS (SELECT image_id, class, r, iscrowd, gt_key, area, CASE iscrowd WHEN 1 THEN inter / da ELSE inter / (da + ga - inter) END AS share
          FROM (SELECT d.image_id, d.class, d.r, g.iscrowd, g.gt_key, g.area, d.da, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga,
                       {side("x1", "x2")} * {side("y1", "y2")} AS inter
                FROM d JOIN gt g ON d.image_id = g.image_id AND d.class = g.class) i WHERE inter > 0),
    crowd AS (SELECT image_id, class, r, max(share) AS share FROM p WHERE iscrowd = 1 GROUP BY image_id, class, r),
    near AS (SELECT image_id, class, r, thr.iou AS thr, areas.area AS range,
                    list({{'share': share, 'gt': gt_key, 'inside': p.area BETWEEN lo AND hi}} ORDER BY share DESC, gt_key DESC) AS boxes
             FROM p JOIN thr ON share >= 0.5 AND share >= thr.iou - 1e-10, areas WHERE iscrowd = 0 GROUP BY ALL),
    step AS MATERIALIZED (
      SELECT d.image_id, d.class, d.r, d.score, d.det_key, thr.iou AS thr, areas.area AS range, coalesce(boxes, []) AS boxes,
             coalesce(crowd.share, 0) AS crowd, coalesce(crowd.share, 0) >= thr.iou - 1e-10 OR NOT da BETWEEN lo AND hi AS spare
      FROM d CROSS JOIN thr CROSS JOIN areas
      LEFT JOIN near n ON n.image_id = d.image_id AND n.class = d.class AND n.r = d.r AND n.thr = thr.iou AND n.range = areas.area
      LEFT JOIN crowd ON crowd.image_id = d.image_id AND crowd.class = d.class AND crowd.r = d.r),
    walk AS (
      SELECT image_id, class, thr, range, cast(0 AS BIGINT) AS r, cast([] AS BIGINT[]) AS taken, false AS met, false AS skipped
      FROM step WHERE r = 1
      UNION ALL
      SELECT image_id, class, thr, range, r,
             CASE WHEN own IS NOT NULL THEN list_append(taken, own.gt) WHEN crowd < other.share THEN list_append(taken, other.gt) ELSE taken END,
             own IS NOT NULL, own IS NULL AND coalesce(crowd < other.share, false)
      FROM (SELECT s.*, w.taken, list_filter(s.boxes, lambda b: b.inside AND NOT list_contains(w.taken, b.gt))[1] AS own,
                   list_filter(s.boxes, lambda b: NOT b.inside AND NOT list_contains(w.taken, b.gt))[1] AS other
            FROM walk w JOIN step s ON s.image_id = w.image_id AND s.class = w.class AND s.thr = w.thr AND s.range = w.range AND s.r = w.r + 1) x),
    c AS (SELECT s.image_id AS doc, s.class, s.thr, s.range, s.score, s.det_key, w.met, NOT w.skipped AND (w.met OR NOT s.spare) AS counted
          FROM walk w JOIN step s ON s.image_id = w.image_id AND s.class = w.class AND s.thr = w.thr AND s.range = w.range AND s.r = w.r),
    n AS (SELECT class, areas.area AS range, count(*) FILTER (gt.area BETWEEN lo AND hi) AS n FROM gt, areas WHERE iscrowd = 0 GROUP BY class, areas.area),
    {_CURVE}
    SELECT metric, cast(NULL AS VARCHAR) AS class, round(value, 6) AS value FROM ({_OVERALL}) o
    UNION ALL SELECT 'AP', cast(class AS VARCHAR), round(avg(ap), 6) FROM curve WHERE range = 'all' GROUP BY class"""


# A few line items agree in all that makes a key; they differ in the width only, and the widest counts.
_KEYED = "SELECT image_id, class, det_key, score, x1, y1, max(x2) AS x2, y2 FROM v_dets GROUP BY image_id, class, det_key, score, x1, y1, y2"
_KEYED_GT = """
    SELECT image_id, class, gt_key, x1, y1, max(x2) AS x2, y2, max(area) AS area, max(iscrowd) AS iscrowd FROM v_gts
    GROUP BY image_id, class, gt_key, x1, y1, y2"""


@query("A12_shared_images", _competing(_KEYED, _KEYED_GT))
def a12_shared(t):
    """As A12 with the boxes of an order on one image, where detections compete for boxes."""
    return coco_eval(t.sql(_KEYED), t.sql(_KEYED_GT)).withColumn("value", F.round("value", 6))


# Some three boxes of a class on an image (at sf0.01), near each other.
_NEAR = f"""
    SELECT image_id % 4999 AS image_id, class, x1 % 40 AS x1, y1 % 30 AS y1, x1 % 40 + x2 - x1 AS x2, y1 % 30 + y2 - y1 AS y2, score,
           det_key * 7 + image_id % 7 AS det_key FROM ({_KEYED}) k"""
_NEAR_GT = f"""
    SELECT image_id % 4999 AS image_id, class, x1 % 40 + 1 AS x1, y1 % 30 AS y1, x1 % 40 + x2 - x1 AS x2, y1 % 30 + y2 - y1 + 2 AS y2,
           (x2 - x1 - 1) * (y2 - y1 + 2) AS area, iscrowd, gt_key * 7 + image_id % 7 AS gt_key FROM ({_KEYED_GT}) k WHERE x2 - x1 > 1"""


@query("A12_competing", _competing(_NEAR, _NEAR_GT))
def a12_competing(t):
    """As A12 with several boxes in one place."""
    return coco_eval(t.sql(_NEAR), t.sql(_NEAR_GT)).withColumn("value", F.round("value", 6))


@query(
    "Q5",
    f"""
    WITH {_AP} SELECT metric, '(all)' AS classname, round(value, 6) AS value FROM ({_OVERALL}) o
    UNION ALL SELECT 'AP', class_name, round(avg(ap), 6) FROM curve JOIN v_classes ON class = class_id WHERE range = 'all'
              GROUP BY class_name""",
)
def q5(t):
    dets, gts = _single(t)
    return quality.quality_report(dets, gts, t("v_classes")).withColumn("value", F.round("value", 6))


# ---------------------------------------------------------------------------------------------------- scoring


def peak_predictor():
    """Stand-in for a user's model: one unit box at the highest value of the last channel."""

    def predict(images: np.ndarray):
        last = images[:, -1].reshape(len(images), -1)
        found = []
        for at, value in zip(last.argmax(axis=1), last.max(axis=1)):
            y, x = divmod(int(at), images.shape[3])
            found.append(([[float(x), float(y), x + 1.0, y + 1.0]], [float(value) / 255.0], [0]))
        return found

    return batched(predict)


def _scoring_inputs(t):
    """Images of 8 x 8 pixels; label 9 does not decode, 3 has no thermal plane, 4 an unreadable one."""
    label = C("label")
    colour = lambda k: F.transform("px", lambda v: F.floor(F.abs(v) * k).cast("int") % 256)
    planes = t.spread(t("v_planes")).withColumn("file", F.concat(C("vec_id").cast("string"), F.lit(".jpg")))
    rasters = planes.select(
        "file",
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        colour(7).alias("blue"),
        colour(11).alias("green"),
        colour(13).alias("red"),
        F.when(label == 9, "read_failed").alias("reason"),
    )
    thermal = planes.filter("label <> 3").select("file", "h", "w", F.when(label != 4, C("px")).alias("px"))
    return rasters, thermal


_SCORED = """
    SELECT vec_id || '.jpg' AS file, CASE label WHEN 9 THEN 'read_failed' WHEN 3 THEN 'no_thermal_sidecar' WHEN 4 THEN 'thermal_read_failed' END
           AS reason, list_position(px, list_max(px)) - 1 AS i,
           CASE WHEN list_max(px) > 1.5 THEN list_max(px) / 100 WHEN list_max(px) > list_min(px) THEN 1 ELSE 0 END AS top FROM v_planes"""


@query(
    "F1",
    f"""
    SELECT file, reason, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS n, CASE WHEN reason IS NULL THEN cast(i % 8 AS DOUBLE) ELSE -1 END AS x1,
           CASE WHEN reason IS NULL THEN cast(i // 8 AS DOUBLE) ELSE -1 END AS y1,
           CASE WHEN reason IS NULL THEN round(top, 5) ELSE -1 END AS score FROM ({_SCORED}) s""",
)
def f1(t):
    rasters, thermal = _scoring_inputs(t)
    preds = batch_score(rasters, thermal, peak_predictor, "rgbtherm")
    box = F.get("boxes", F.lit(0))
    or_none = lambda c: F.coalesce(c, F.lit(-1.0))
    return preds.select(
        "file",
        "reason",
        F.size("boxes").alias("n"),
        or_none(F.get(box, F.lit(0))).alias("x1"),
        or_none(F.get(box, F.lit(1))).alias("y1"),
        F.round(or_none(F.get("scores", F.lit(0))), 5).alias("score"),
    )


@query(
    "F3",
    """
    SELECT image_id, ann_id, greatest(0, least(x, 300)) AS x1, greatest(0, least(x + w, 300)) AS x2 FROM v_anns
    WHERE iscrowd = 0 AND greatest(0, least(x + w, 300)) > greatest(0, least(x, 300)) AND greatest(0, least(y + h, 200)) > greatest(0, least(y, 200))""",
)
def f3(t):
    """A chain of mappers: drop crowds, convert, clip to a small canvas, drop what is empty."""
    boxed = lambda df: boxes.corners(df.withColumn("b", boxes.xywh_to_xyxy(F.array("x", "y", "w", "h"))), "b")
    canvas = lambda df: df.withColumns({"width": F.lit(300), "height": F.lit(200)})
    rows = build_examples(t("v_anns"), [boxes.drop_crowd, boxed, canvas, boxes.clip_boxes, boxes.drop_empty])
    return rows.select("image_id", "ann_id", "x1", "x2")


# ------------------------------------------------------------------------------------------------------ plans


def flagship(t):
    """The inspection report: predictions, threshold, positions and counts per session."""
    images = t("v_images").select("session", "name")
    return inspection.inspection_report(coerced(t), images, t("v_geo"), t("v_classes"))


@query(
    "Q1",
    """
    WITH d AS (SELECT doc, file, count(*) AS n, count(*) FILTER (score >= 0.6) AS over FROM v_boxes GROUP BY doc, file)
    SELECT i.session, count(*) FILTER (g.lat IS NOT NULL) AS image_points,
           cast(coalesce(sum(over) FILTER (g.lat IS NOT NULL), 0) AS BIGINT) AS anomalies, cast(sum(n) AS BIGINT) AS total_preds,
           round(min(g.lat), 9) AS south, round(min(g.lon) FILTER (g.lat IS NOT NULL), 9) AS west, round(max(g.lat), 9) AS north,
           round(max(g.lon) FILTER (g.lat IS NOT NULL), 9) AS east
    FROM d JOIN v_images i ON d.file = i.name LEFT JOIN v_geo g ON g.name = i.name GROUP BY i.session""",
)
def q1(t):
    sides = [F.round(c, 9).alias(c) for c in ("south", "west", "north", "east")]
    return flagship(t).select("session", "image_points", "anomalies", "total_preds", *sides)


@query(
    "Q1_features",
    """
    SELECT i.session, d.doc, 0 AS kind_rank, -1 AS det_idx, '' AS classname, cast(0 AS double) AS score FROM v_docs d
    JOIN v_images i ON d.file = i.name JOIN v_geo g ON g.name = i.name WHERE g.lat IS NOT NULL
    UNION ALL
    SELECT i.session, b.doc, 1, cast(b.i - 1 AS int), coalesce(c.class_name, cast(b.class AS VARCHAR)), b.score FROM v_boxes b
    JOIN v_images i ON b.file = i.name JOIN v_geo g ON g.name = i.name LEFT JOIN v_classes c ON c.class_id = b.class
    WHERE g.lat IS NOT NULL AND b.score >= 0.6""",
)
def q1_features(t):
    """The map features of the report, read back from their GeoJSON text."""
    images = t("v_images").select("session", "name")
    rows = inspection.inspection_features(coerced(t), images, t("v_geo"), t("v_classes"))
    part = lambda p, kind: F.try_variant_get("v", f"$.properties.{p}", kind)
    return rows.withColumn("v", F.try_parse_json("feature")).select(
        "session",
        "doc",
        "kind_rank",
        "det_idx",
        F.coalesce(part("classname", "string"), F.lit("")).alias("classname"),
        F.coalesce(part("score", "double"), F.lit(0.0)).alias("score"),
    )


# Documents of sessions that use the same image names, with classes as exporters write them. The SQL states what each means:
# the number, and the id that names it.
_WRITTEN = (("1", 1, 1), ("1.0", 1, 0), ('"2"', 2, 2), ("-1", -1, 0), ("null", 0, 0), ("true", 1, 0), ("9", 9, 9), ("3.5", 3, 0))
_SESSION_DOCS = """
    SELECT doc, 's' || cast(l_linenumber % 3 AS string) AS session, 'im' || cast(l_orderkey % 997 AS string) || '.jpg' AS name,
           cast(l_partkey % 8 AS int) AS k FROM v_docs"""
_SESSION_GEO = """
    SELECT DISTINCT session, name, cast(length(name) AS double) + CASE session WHEN 's0' THEN 10 WHEN 's1' THEN 20 END AS lat,
           cast(7 AS double) AS lon FROM docs"""


@query(
    "Q1_sessions",
    f"""
    WITH docs AS ({_SESSION_DOCS}), geo AS ({_SESSION_GEO}),
         written(k, number, named) AS (VALUES {", ".join(f"({k}, {n}, {i})" for k, (_, n, i) in enumerate(_WRITTEN))})
    SELECT d.session, d.doc, d.name, 0 AS kind_rank, g.lat, -1 AS class, '' AS classname FROM docs d
    JOIN geo g ON g.session = d.session AND g.name = d.name WHERE g.lat IS NOT NULL
    UNION ALL
    SELECT d.session, d.doc, d.name, 1, g.lat, w.number, coalesce(c.class_name, cast(w.named AS VARCHAR)) FROM docs d
    JOIN geo g ON g.session = d.session AND g.name = d.name JOIN written w ON w.k = d.k LEFT JOIN v_classes c ON c.class_id = w.named
    WHERE g.lat IS NOT NULL""",
)
def q1_sessions(t):
    """Features of sessions whose images have the same names; the third session has no positions."""
    docs = t.sql(_SESSION_DOCS)
    docs.createOrReplaceTempView("docs")
    label = F.element_at(F.array(*[F.lit(text) for text, _, _ in _WRITTEN]), C("k") + 1)
    text = F.format_string('{"file":"%s","boxes":[[1,2,3,4]],"scores":[0.75],"classes":[%s]}', "name", label)
    preds = coerce_predictions(docs.select("doc", "session", C("name").alias("stem"), text.alias("value")))
    images = docs.select("session", "name").distinct()
    geo = t.spark.sql(_SESSION_GEO)
    rows = inspection.inspection_features(preds.drop("stem", "value", "_corrupt"), images, geo, t("v_classes"))
    part = lambda p, kind: F.try_variant_get("v", f"$.properties.{p}", kind)
    return rows.withColumn("v", F.try_parse_json("feature")).select(
        "session",
        "doc",
        "name",
        "kind_rank",
        "lat",
        F.coalesce(part("class", "int"), F.lit(-1)).alias("class"),
        F.coalesce(part("classname", "string"), F.lit("")).alias("classname"),
    )


@query(
    "Q2",
    f"""
    WITH c AS ({_COLOURED[1]}),
         b AS (SELECT image_id, count(*) AS n FROM v_anns WHERE iscrowd = 0 AND least(x + w, 640) > least(x, 640) AND least(y + h, 512) > least(y, 512)
               GROUP BY image_id)
    SELECT c.vec_id AS image_id, CASE WHEN th IS NULL THEN 'missing' ELSE 'tif' END AS kind, 4 AS channels, coalesce(b.n, 0) AS n_boxes,
           round((list_sum(c1) + list_sum(c2) + list_sum(c3)) / 255 + coalesce(list_sum(list_transform(th, lambda v: least(greatest(
             v / CASE WHEN list_max(th) > 1 THEN list_max(th) ELSE 1 END, 0), 1))), 0), 4) AS total
    FROM c LEFT JOIN b ON b.image_id = c.vec_id
    WHERE EXISTS (SELECT 1 FROM v_anns a WHERE a.image_id = c.vec_id AND a.iscrowd = 0)""",
)
def q2(t):
    """Tensors and boxes of the images that have annotations, without random augmentation."""
    rows = t.sql(_COLOURED[0])
    rasters = rows.select(
        C("vec_id").alias("image_id"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        C("c1").alias("red"),
        C("c2").alias("green"),
        C("c3").alias("blue"),
    )
    thermal = rows.select(
        C("vec_id").alias("image_id"), F.lit("a.tif").alias("path"), F.lit(8).alias("h"), F.lit(8).alias("w"), C("th").alias("px")
    )
    images = rasters.select("image_id", F.lit(640).alias("width"), F.lit(512).alias("height"))
    anns = t("v_anns").withColumn("bbox", F.array("x", "y", "w", "h"))
    # In doubles, as the SQL computes.
    tensors, _ = training.training_set(images, anns, rasters, thermal, pixel="double")
    counts = training.training_boxes(images, anns).groupBy("image_id").agg(F.count("*").alias("n_boxes"))
    total = F.aggregate("px", F.lit(0.0), lambda s, v: s + v)
    return tensors.join(counts, "image_id", "left").select(
        "image_id",
        "kind",
        "channels",
        F.coalesce("n_boxes", F.lit(0).cast("bigint")).alias("n_boxes"),
        F.round(total, 4).alias("total"),
    )


_REQUESTS = """
    SELECT 's' || cast(s_suppkey AS string) AS session, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS model, s_suppkey % 3 > 0 AS use_thermal
    FROM v_runs_raw"""
_REQUESTS = _REQUESTS.replace("v_runs_raw", "supplier")


@query(
    "Q3",
    f"""
    WITH newest AS (SELECT max_by(r.name, r.mtime * 10000000 + r.s_suppkey) AS name FROM v_runs r
                    WHERE EXISTS (SELECT 1 FROM v_run_files f WHERE f.run = r.name AND f.name = 'model_final.pth')),
         q AS (SELECT session, coalesce(model, (SELECT name FROM newest)) AS model, use_thermal FROM ({_REQUESTS}) x),
         w AS (SELECT run, min_by(name, list_position(['model_final.pth', 'model_best.pth', 'model.pth'], name)) AS best FROM v_run_files
               WHERE name LIKE '%.pth' GROUP BY run),
         m AS (SELECT name, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 THEN 'rgb' WHEN s_suppkey % 2 = 0 THEN 'rgbtherm' ELSE 'rgb' END
                      AS input_mode FROM v_runs),
         p AS (SELECT count(*) FILTER (reason IS NULL) AS thermal, count(*) FILTER (reason IS NULL OR reason <> 'read_failed') AS colour FROM ({_SCORED}) s)
    SELECT q.session, q.model, coalesce(w.best, 'model_final.pth') AS weights,
           CASE WHEN q.use_thermal AND m.input_mode = 'rgbtherm' THEN 'rgbtherm' ELSE 'rgb' END AS mode,
           CASE WHEN q.use_thermal AND m.input_mode = 'rgbtherm' THEN p.thermal ELSE p.colour END AS total_preds
    FROM q LEFT JOIN w ON w.run = q.model LEFT JOIN m ON m.name = q.model, p""",
)
def q3(t):
    """Each request's model, weights and mode, and the boxes that a session in that mode yields."""
    meta = parse_model_meta(model_docs(t))
    chosen = sessions.choose_model(t("v_runs"), t("v_run_files"), meta, t.sql(_REQUESTS))
    rasters, thermal = _scoring_inputs(t)
    totals = []
    for mode in ("rgb", "rgbtherm"):
        _, manifest = sessions.scoring_session(rasters, thermal, peak_predictor, mode, mode)
        totals.append(manifest.groupBy(C("session").alias("mode")).agg(F.sum("n").alias("total_preds")))
    return chosen.join(totals[0].unionByName(totals[1]), "mode").select("session", "model", "weights", "mode", "total_preds")


@query(
    "Q4",
    f"""
    WITH {_tile_grid(ZOOM)}, q2 AS (SELECT source, tx, ty, quantile_cont(val, 0.02) AS lo, quantile_cont(val, 0.98) AS hi FROM z GROUP BY source, tx, ty)
    SELECT z.source, cast(z.tx AS int) AS x, cast(z.ty AS int) AS y, cast(p AS int) AS pos,
           cast(floor(greatest(0, least(1, (val - lo) / CASE WHEN hi <= lo THEN 1 ELSE hi - lo END)) * 255) AS int) AS u8
    FROM z JOIN q2 ON z.source = q2.source AND z.tx = q2.tx AND z.ty = q2.ty""",
)
def q4(t):
    tiles = maps.map_tiles(t.spread(t("v_rasters")), ZOOM, TILE)
    return tiles.select("source", "x", "y", F.posexplode("px").alias("pos", "u8"))


@query(
    "Q4_layers",
    """
    SELECT source, round(CASE epsg WHEN 4326 THEN x0 ELSE degrees(x0 / 6378137) END, 6) AS west,
           round(CASE epsg WHEN 4326 THEN y0 ELSE degrees(2 * atan(exp(y0 / 6378137)) - pi() / 2) END, 6) + 0 AS north, 0 AS minzoom, 22 AS maxzoom
    FROM v_rasters""",
)
def q4_layers(t):
    rows = maps.layers(t("v_rasters"))
    return rows.select(
        "source", F.round("left", 6).alias("west"), (F.round("top", 6) + F.lit(0.0)).alias("north"), "minzoom", "maxzoom"
    )
