"""Queries over windows, rankings and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliotab.catalog.registry import query
from heliotab.operators import detections, windows
from heliotab.operators.skew import ranked

C = F.col

_MEMBERS = """
    SELECT o_orderpriority AS dataset, cast(o_custkey AS string) || '/' || cast(o_orderkey AS string) AS member,
           'im_' || cast(o_custkey % 97 AS string) || '.jpg' AS name FROM orders"""


@query(
    "W2",
    f"""
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY dataset, name ORDER BY member) - 1 AS k FROM ({_MEMBERS}) x)
    SELECT dataset, member, CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '\\.jpg$', '') || '-' || k || '.jpg' END AS unique_name FROM m""",
)
def w2(t):
    return windows.dedupe_names(t.sql(_MEMBERS)).select("dataset", "member", "unique_name")


_UPLOADS = """
    SELECT o_orderpriority AS dataset, 'im_' || cast(o_custkey AS string) || '.jpg' AS name, o_orderkey AS seq, o_totalprice AS size
    FROM orders"""


@query(
    "W3",
    f"""
    SELECT dataset, name, seq, size FROM
      (SELECT *, row_number() OVER (PARTITION BY dataset, name ORDER BY seq DESC) AS r FROM ({_UPLOADS}) u) x WHERE r = 1""",
)
def w3(t):
    return windows.last_wins(t.sql(_UPLOADS), ["dataset", "name"], ["seq"])


_KINDS = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN l_partkey % 5 < 3 THEN 'tif' WHEN l_partkey % 5 = 3 THEN 'other' ELSE 'missing' END AS kind FROM lineitem"""
_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(
    "W5",
    f"""
    SELECT seen, cast(tif AS BIGINT) AS tif, cast(other AS BIGINT) AS other, cast(missing AS BIGINT) AS missing FROM
      (SELECT count(*) OVER w AS seen, count(*) FILTER (kind = 'tif') OVER w AS tif, count(*) FILTER (kind = 'other') OVER w AS other,
              count(*) FILTER (kind = 'missing') OVER w AS missing FROM ({_KINDS}) k
       WINDOW w AS (ORDER BY {_LINE} ROWS UNBOUNDED PRECEDING)) x WHERE seen % 50 = 0""",
)
def w5(t):
    return windows.running_usage(t.sql(_KINDS), _LINE.split(", "))


_RENDERED = "SELECT session, name, image_id % 7 > 0 AS rendered FROM v_images"


@query(
    "W6",
    f"""
    SELECT session, name, row_number() OVER (PARTITION BY session ORDER BY name) AS done, total FROM
      (SELECT *, count(*) OVER (PARTITION BY session) AS total FROM ({_RENDERED}) r) x WHERE rendered""",
)
def w6(t):
    return windows.progress(t.sql(_RENDERED)).select("session", "name", "done", "total")


def _greedy_sql(dets: str) -> str:
    """Suppression box by box, best first: the boxes kept so far are a list that grows along the ranks of a group."""
    side = lambda a, b: f"greatest(0, least(k.{b}, d.{b}) - greatest(k.{a}, d.{a}))"
    area = lambda p: f"({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1)"
    inter = f"({side('x1', 'x2')} * {side('y1', 'y2')})"
    box = "{'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2, 'score': d.score, 'det_key': d.det_key}"
    return f"""
    WITH RECURSIVE b AS ({dets}),
    d AS (SELECT *, row_number() OVER (PARTITION BY image_id, class ORDER BY score DESC, det_key) AS r FROM b),
    walk AS (
      SELECT d.image_id, d.class, d.r, [{box}] AS kept FROM d WHERE r = 1
      UNION ALL
      SELECT d.image_id, d.class, d.r,
             CASE WHEN len(list_filter(w.kept, lambda k: {inter} > cast(0.5 AS DOUBLE) * ({area('k')} + {area('d')} - {inter}))) = 0
                  THEN list_append(w.kept, {box}) ELSE w.kept END
      FROM walk w JOIN d ON d.image_id = w.image_id AND d.class = w.class AND d.r = w.r + 1),
    ends AS (SELECT image_id, class, unnest(max_by(kept, r)) AS k FROM walk GROUP BY image_id, class)
    SELECT image_id, class, k.det_key AS det_key, k.score AS score FROM ends"""


@query("W7", _greedy_sql("SELECT * FROM v_dets"))
def w7(t):
    kept = detections.nms(t("v_dets"), order=("score", "det_key"))
    return kept.select("image_id", "class", "det_key", "score")


# Some thirty boxes of a class on an image (at sf0.01), of which most overlap others.
_CROWDED = """
    SELECT image_id % 499 AS image_id, class, x1 % 90 AS x1, y1 % 40 AS y1, x1 % 90 + x2 - x1 AS x2, y1 % 40 + y2 - y1 AS y2, score,
           image_id * 8 + det_key % 10 AS det_key FROM v_dets"""


@query("W7_crowded", _greedy_sql(f"SELECT DISTINCT ON (image_id, class, det_key) * FROM ({_CROWDED}) c ORDER BY image_id, class, det_key, score, x1, y1, x2, y2"))
def w7_crowded(t):
    """Suppression on images full of boxes; of boxes with the same key the first counts."""
    rows = t.sql(_CROWDED)
    first = F.min(F.struct("score", "x1", "y1", "x2", "y2")).alias("b")
    single = rows.groupBy("image_id", "class", "det_key").agg(first).select("image_id", "class", "det_key", "b.*")
    return detections.nms(single, order=("score", "det_key")).select("image_id", "class", "det_key", "score")


@query(
    "W8",
    """
    SELECT image_id, det_key, score FROM
      (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_key) AS r FROM v_dets) d WHERE r <= 3""",
)
def w8(t):
    return detections.topk_per_image(t("v_dets"), 3, order=("score", "det_key")).select("image_id", "det_key", "score")


_MATCHES = "SELECT class, image_id, det_key, score, (det_key % 10) < 6 AS tp FROM v_dets"


@query(
    "W9",
    f"""
    WITH n AS (SELECT class, count(*) AS n_gt FROM v_gts GROUP BY class),
         m AS (SELECT m.*, n_gt, count(*) FILTER (tp) OVER w AS cum_tp, count(*) FILTER (NOT tp) OVER w AS cum_fp FROM ({_MATCHES}) m JOIN n ON m.class = n.class
               WINDOW w AS (PARTITION BY m.class ORDER BY score DESC, image_id, det_key ROWS UNBOUNDED PRECEDING))
    SELECT class, image_id, det_key, cum_tp, cum_fp, round(cum_tp / n_gt, 9) AS recall, round(cum_tp / (cum_tp + cum_fp), 9) AS precision,
           round(max(cum_tp / (cum_tp + cum_fp)) OVER (PARTITION BY class ORDER BY cum_tp + cum_fp DESC ROWS UNBOUNDED PRECEDING), 9) AS envelope
    FROM m""",
)
def w9(t):
    n_gt = t("v_gts").groupBy("class").agg(F.count("*").alias("n_gt"))
    curve = windows.pr_curve(t.sql(_MATCHES), n_gt, order=("image_id", "det_key"))
    rounded = [F.round(c, 9).alias(c) for c in ("recall", "precision", "envelope")]
    return curve.select("class", "image_id", "det_key", "cum_tp", "cum_fp", *rounded)


@query("W10", "SELECT image_id, name FROM v_images ORDER BY md5('1234:' || cast(image_id AS VARCHAR)), image_id LIMIT 120")
def w10(t):
    return windows.preflight_sample(t("v_images")).select("image_id", "name")
