"""Queries over the joins and detection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliotab.catalog.registry import pixels, query
from heliotab.operators import detections, joins, tiles

C = F.col


@query(
    "J1",
    """
    WITH a AS (SELECT image_id, ann_id, category_id, (row_number() OVER (PARTITION BY image_id ORDER BY ann_id) - 1) // 4 AS chunk
               FROM v_anns),
         g AS (SELECT image_id, chunk, count(*) AS n, min(ann_id) AS first_ann, cast(sum(category_id) AS BIGINT) AS classes
               FROM a GROUP BY image_id, chunk)
    SELECT i.image_id, i.name, coalesce(g.chunk, 0) AS chunk, coalesce(n, 0) AS n, coalesce(first_ann, -1) AS first_ann,
           coalesce(classes, 0) AS classes FROM v_images i LEFT JOIN g ON i.image_id = g.image_id""",
)
def j1(t):
    lists = joins.image_annotations(
        t("v_images").select("image_id", "name"), t("v_anns").select("image_id", "ann_id", "category_id"), chunk_size=4
    )
    classes = F.aggregate("annotations", F.lit(0).cast("bigint"), lambda s, a: s + a["category_id"])
    return lists.select(
        "image_id",
        "name",
        "chunk",
        F.size("annotations").cast("bigint").alias("n"),
        F.coalesce(F.get("annotations", F.lit(0))["ann_id"], F.lit(-1).cast("bigint")).alias("first_ann"),
        classes.alias("classes"),
    )


@query(
    "J2",
    "SELECT image_id FROM v_images i WHERE EXISTS (SELECT 1 FROM v_anns a WHERE a.image_id = i.image_id AND a.iscrowd = 0)",
)
def j2(t):
    return joins.filter_empty(t("v_images"), t("v_anns")).select("image_id")


@query(
    "J3",
    """
    WITH r AS (SELECT path, regexp_extract(path, '^(.*)/[^/]+$', 1) AS split,
                      split_part(regexp_extract(path, '([^/]*)$', 1), '.rf.', 1) AS stem FROM v_rgb),
         t AS (SELECT path AS file, regexp_extract(path, '^(.*)/thermal/[^/]+$', 1) AS split, regexp_extract(path, '([^/]*)$', 1) AS name,
                      regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS root FROM v_thermal),
         v AS (SELECT path, split, stem, stem AS cand, 0 AS rank FROM r
               UNION ALL SELECT path, split, stem, left(stem, length(stem) - 4), 1 FROM r WHERE stem LIKE '%\\_T\\_JPG' ESCAPE '\\'
               UNION ALL SELECT path, split, stem, replace(stem, '_T_JPG', ''), 2 FROM r WHERE stem LIKE '%\\_T\\_JPG' ESCAPE '\\'
               UNION ALL SELECT path, split, stem, left(stem, length(stem) - 4), 3 FROM r WHERE stem LIKE '%\\_JPG' ESCAPE '\\'
               UNION ALL SELECT path, split, stem, left(stem, length(stem) - 2), 4 FROM r WHERE stem LIKE '%\\_T' ESCAPE '\\'),
         hits AS (
           SELECT v.path, t.file, 0 AS stage, v.rank * 4 + list_position(['.tif', '.tiff', '.TIF', '.TIFF'], substr(t.name, length(t.root) + 1))
                  AS rank, t.name FROM v JOIN t ON v.split = t.split AND v.cand = t.root
             WHERE list_contains(['.tif', '.tiff', '.TIF', '.TIFF'], substr(t.name, length(t.root) + 1))
           UNION ALL
           SELECT r.path, t.file, 1, CASE WHEN t.name LIKE '%.tiff' THEN 1 ELSE 0 END, t.name
             FROM r JOIN t ON r.split = t.split AND lower(r.stem) = lower(t.root) WHERE t.name LIKE '%.tif' OR t.name LIKE '%.tiff'
           UNION ALL
           SELECT r.path, t.file, 2, -length(t.name), t.name
             FROM r JOIN t ON r.split = t.split AND (contains(lower(r.stem), lower(t.root)) OR contains(lower(t.root), lower(r.stem)))
             WHERE t.name LIKE '%.tif' OR t.name LIKE '%.tiff'),
         best AS (SELECT path, file, stage FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY stage, rank, name) AS n FROM hits) h
                  WHERE n = 1)
    SELECT r.path, best.file AS thermal_path, CASE stage WHEN 0 THEN 'stem' WHEN 1 THEN 'case' WHEN 2 THEN 'substring' END AS stage
    FROM r LEFT JOIN best ON r.path = best.path""",
)
def j3(t):
    return joins.match_thermal(t.spread(t("v_rgb").select("path")), t.spread(t("v_thermal"))).select("path", "thermal_path", "stage")


_SIDE_FILES = """
    SELECT '/s/' || cast(o_custkey AS string) || '/p' || cast(o_orderkey AS string) ||
           CASE o_orderkey % 4 WHEN 0 THEN '_thermal.tif' WHEN 1 THEN '_thermal.tiff' WHEN 2 THEN '_thermal.png' ELSE '.tif' END AS path
    FROM orders
    UNION ALL
    SELECT '/s/' || cast(o_custkey AS string) || '/p' || cast(o_orderkey AS string) || '_thermal.tiff' AS path FROM orders
    WHERE o_orderkey % 8 = 0"""
_SIDE_RGB = "SELECT '/s/' || cast(o_custkey AS string) || '/p' || cast(o_orderkey AS string) || '.jpg' AS path, o_orderkey FROM orders"


@query(
    "J4",
    f"""
    SELECT o_orderkey, r.path, coalesce(a.path, b.path) AS thermal_path FROM ({_SIDE_RGB}) r
    LEFT JOIN ({_SIDE_FILES}) a ON a.path = regexp_replace(r.path, '\\.jpg$', '_thermal.tif')
    LEFT JOIN ({_SIDE_FILES}) b ON b.path = regexp_replace(r.path, '\\.jpg$', '_thermal.tiff')""",
)
def j4(t):
    return joins.sidecar_join(t.sql(_SIDE_RGB), t.sql(_SIDE_FILES)).select("o_orderkey", "path", "thermal_path")


@query(
    "J5",
    "SELECT image_id, 'no_thermal_sidecar' AS reason FROM v_images i WHERE NOT EXISTS (SELECT 1 FROM v_anns a WHERE a.image_id = i.image_id "
    "AND a.category_id = 1)",
)
def j5(t):
    thermal = t("v_anns").filter("category_id = 1")
    return joins.missing_thermal(t("v_images").select("image_id"), thermal)


@query(
    "J6",
    """
    SELECT d.doc, i.session, i.name, round(g.lat, 9) AS lat, round(g.lon, 9) AS lon
    FROM v_docs d JOIN v_images i ON d.file = i.name JOIN v_geo g ON g.name = i.name WHERE g.lat IS NOT NULL""",
)
def j6(t):
    preds = t("v_docs").select("doc", C("file").alias("name"))
    located = joins.georeference(preds, t("v_images").select("name", "session"), t("v_geo"))
    return located.select("doc", "session", "name", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(
    "J7",
    """
    SELECT d.image_id, d.det_key, coalesce(c.class_name, cast(d.k AS VARCHAR)) AS classname
    FROM (SELECT *, cast(det_key % 9 AS int) AS k FROM v_dets) d LEFT JOIN v_classes c ON d.k = c.class_id""",
)
def j7(t):
    dets = t("v_dets").withColumn("class", (C("det_key") % 9).cast("int"))
    return joins.with_class_names(dets, t("v_classes")).select("image_id", "det_key", "classname")


_OVERLAYS = "SELECT session, '/media/' || session || '/overlays/' || name AS url FROM v_images"
_THUMBS = "SELECT session, '/media/' || session || '/thumbs/' || name AS url FROM v_images WHERE o_custkey % 3 > 0"


@query(
    "J8",
    """
    SELECT session, name AS file, '/media/' || session || '/overlays/' || name AS overlay,
           '/media/' || session || CASE WHEN o_custkey % 3 > 0 THEN '/thumbs/' ELSE '/overlays/' END || name AS thumb FROM v_images""",
)
def j8(t):
    return joins.pair_thumbs(t.sql(_OVERLAYS), t.sql(_THUMBS)).select("session", "file", "overlay", "thumb")


@query(
    "J9",
    """
    SELECT r.name AS run, CASE WHEN f.best IS NULL THEN 'model_final.pth' ELSE f.best END AS weights, f.best IS NOT NULL AS present,
           EXISTS (SELECT 1 FROM v_run_files x WHERE x.run = r.name AND x.name = 'model_final.pth') AS trained
    FROM v_runs r LEFT JOIN (SELECT run, min_by(name, list_position(['model_final.pth', 'model_best.pth', 'model.pth'], name)) AS best
                             FROM v_run_files WHERE name LIKE '%.pth' GROUP BY run) f ON f.run = r.name""",
)
def j9(t):
    runs, files = t("v_runs"), t("v_run_files")
    trained = joins.trained_runs(runs, files).select(C("name").alias("run"), F.lit(True).alias("trained"))
    rows = joins.resolve_weights(runs, files).join(trained, "run", "left")
    return rows.select("run", "weights", C("exists").alias("present"), F.coalesce("trained", F.lit(False)).alias("trained"))


_IOU = """
    SELECT d.image_id, d.class, d.det_key, g.gt_key,
           greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1)) AS inter,
           (d.x2 - d.x1) * (d.y2 - d.y1) AS da, g.area AS ga, d.score
    FROM v_dets d JOIN v_gts g ON d.image_id = g.image_id AND d.class = g.class"""


@query(
    "J10",
    f"SELECT image_id, class, det_key, gt_key, round(inter / (da + ga - inter), 6) AS iou FROM ({_IOU}) p WHERE inter / (da + ga - inter) >= 0.5",
)
def j10(t):
    pairs = detections.iou_join(t("v_dets"), t("v_gts"))
    return pairs.select("image_id", "class", "det_key", C("g_gt_key").alias("gt_key"), F.round("iou", 6).alias("iou"))


TILE = 16


def _tile_grid(zoom: int) -> str:
    n, h = 1 << zoom, "pi() * cast(6378137 AS double)"
    col = f"cast(greatest(0, least({n - 1}, floor(({{v}} + {h}) / (2 * {h} / {n})))) AS int)"
    row = f"cast(greatest(0, least({n - 1}, floor(({h} - {{v}}) / (2 * {h} / {n})))) AS int)"
    return f"""
    b AS (SELECT *, x0 AS l0, y0 AS t0, x0 + w * dx AS r0, y0 - h * dy AS b0 FROM v_rasters),
    m AS (SELECT *, CASE epsg WHEN 4326 THEN radians(l0) * 6378137 ELSE l0 END AS ml, CASE epsg WHEN 4326 THEN radians(r0) * 6378137 ELSE r0 END AS mr,
                 CASE epsg WHEN 4326 THEN ln(tan(pi() / 4 + radians(b0) / 2)) * 6378137 ELSE b0 END AS mb,
                 CASE epsg WHEN 4326 THEN ln(tan(pi() / 4 + radians(t0) / 2)) * 6378137 ELSE t0 END AS mt FROM b),
    tx AS (SELECT *, unnest(range({col.format(v='ml')}, {col.format(v='mr')} + 1)) AS tx FROM m),
    tt AS (SELECT *, unnest(range({row.format(v='mt')}, {row.format(v='mb')} + 1)) AS ty FROM tx),
    g AS (SELECT *, unnest(range(0, {TILE * TILE})) AS p FROM tt),
    c AS (SELECT *, tx * (2 * {h} / {n}) - {h} + (p % {TILE} + 0.5) * (2 * {h} / {n} / {TILE}) AS gx,
                 {h} - ty * (2 * {h} / {n}) - (p // {TILE} + 0.5) * (2 * {h} / {n} / {TILE}) AS gy FROM g),
    q AS (SELECT *, (CASE epsg WHEN 4326 THEN degrees(gx / 6378137) ELSE gx END - x0) / dx AS u,
                 (y0 - CASE epsg WHEN 4326 THEN degrees(2 * atan(exp(gy / 6378137)) - pi() / 2) ELSE gy END) / dy AS v FROM c),
    f AS (SELECT *, greatest(0, least(w - 1, u - 0.5)) AS fu, greatest(0, least(h - 1, v - 0.5)) AS fv FROM q),
    k AS (SELECT *, cast(floor(fu) AS int) AS c0, cast(floor(fv) AS int) AS r0i FROM f),
    z AS (SELECT source, tx, ty, p, CASE WHEN u >= 0 AND u < w AND v >= 0 AND v < h THEN
            (px[r0i * w + c0 + 1] * (1 - (fu - c0)) + px[r0i * w + least(c0 + 1, w - 1) + 1] * (fu - c0)) * (1 - (fv - r0i)) +
            (px[least(r0i + 1, h - 1) * w + c0 + 1] * (1 - (fu - c0)) + px[least(r0i + 1, h - 1) * w + least(c0 + 1, w - 1) + 1] * (fu - c0)) * (fv - r0i)
            ELSE 0 END AS val FROM k)"""


ZOOM = 4


@query(
    "J11",
    f"WITH {_tile_grid(ZOOM)} SELECT source, cast(tx AS int) AS x, cast(ty AS int) AS y, cast(p AS int) AS pos, round(val, 4) + 0 AS v FROM z",
)
def j11(t):
    return pixels(tiles.reproject_tiles(t.spread(t("v_rasters")), ZOOM, TILE), ["source", "x", "y"], digits=4)


# Planes of 640 x 512 pixels, one for a hundred vectors, whose pixels are 15 cm wide.
_LARGE = """
    SELECT cast(part AS string) AS source, 0 AS band, 512 AS h, 640 AS w, 3857 AS epsg, cast(part * 211 + 1000 AS double) AS x0,
           cast(2000 - part * 97 AS double) AS y0, cast(0.15 AS double) AS dx, cast(0.15 AS double) AS dy, min_by(embedding, vec_id) AS v
    FROM (SELECT *, cast(floor(vec_id / 100) AS bigint) AS part FROM embeddings) e GROUP BY part"""
LARGE_ZOOM = 20


def _large_tiles(zoom: int) -> str:
    side = f"(2 * pi() * cast(6378137 AS double) / {1 << zoom})"
    half = "(pi() * cast(6378137 AS double))"
    at = "cast(cast(cast(v[cast({c} AS int) % 64 + 1] AS double) * (cast({r} AS int) % 7 + 1) AS float) AS double)"
    corner = lambda r, c: at.format(r=r, c=c)
    next_r, next_c = "least(r + 1, h - 1)", "least(c + 1, w - 1)"
    return f"""
    WITH l AS ({_LARGE}),
    tx AS (SELECT *, unnest(range(cast(floor((x0 + {half}) / {side}) AS int), cast(floor((x0 + w * dx + {half}) / {side}) AS int) + 1)) AS x FROM l),
    tt AS (SELECT *, unnest(range(cast(floor(({half} - y0) / {side}) AS int), cast(floor(({half} - y0 + h * dy) / {side}) AS int) + 1)) AS y FROM tx),
    g AS (SELECT *, unnest(range(0, 65536)) AS p FROM tt),
    q AS (SELECT *, (x * {side} - {half} + (p % 256 + 0.5) * {side} / 256 - x0) / dx AS pu,
                 (y0 - ({half} - y * {side} - (p // 256 + 0.5) * {side} / 256)) / dy AS pv FROM g),
    f AS (SELECT *, greatest(0, least(w - 1, pu - 0.5)) AS fu, greatest(0, least(h - 1, pv - 0.5)) AS fv FROM q),
    k AS (SELECT *, cast(floor(fu) AS int) AS c, cast(floor(fv) AS int) AS r FROM f)
    SELECT source, cast(x AS int) AS x, cast(y AS int) AS y, count(*) FILTER (WHERE val <> 0) AS n, round(sum(val), 3) + 0 AS total
    FROM (SELECT source, x, y, CASE WHEN pu >= 0 AND pu < w AND pv >= 0 AND pv < h THEN
            ({corner("r", "c")} * (1 - (fu - c)) + {corner("r", next_c)} * (fu - c)) * (1 - (fv - r)) +
            ({corner(next_r, "c")} * (1 - (fu - c)) + {corner(next_r, next_c)} * (fu - c)) * (fv - r) ELSE 0 END AS val FROM k) z
    GROUP BY source, x, y"""


@query("J11_large", _large_tiles(LARGE_ZOOM))
def j11_large(t):
    """Full-size planes at a high zoom: pixels that aren't 0 and their sum, per tile."""
    # Floats, as thermal planes are.
    value = "cast(cast(v[i % 640 % 64] AS double) * (cast(i / 640 AS int) % 7 + 1) AS float)"
    pixel = f"transform(sequence(0, 640 * 512 - 1), i -> {value}) AS px"
    # Spread before the pixels are made.
    large = t.spread(t.sql(_LARGE)).selectExpr("source", "band", "h", "w", "epsg", "x0", "y0", "dx", "dy", pixel)
    found = tiles.reproject_tiles(large, LARGE_ZOOM)
    total = F.aggregate("px", F.lit(0.0), lambda a, v: a + v)
    return found.select(
        "source", "x", "y", F.size(F.filter("px", lambda v: v != 0)).cast("bigint").alias("n"), (F.round(total, 3) + F.lit(0.0)).alias("total")
    )


@query(
    "J12",
    """
    SELECT r.name, CASE WHEN r.s_nationkey % 4 > 0 THEN r.s_nationkey WHEN c.n > 0 THEN c.n ELSE 80 END AS classes
    FROM v_runs r LEFT JOIN (SELECT s_name, cast(s_suppkey % 5 AS int) AS n FROM supplier WHERE s_suppkey % 3 > 0) c ON c.s_name = r.name""",
)
def j12(t):
    models = t("v_runs").select(
        "name", F.when(C("s_nationkey") % 4 > 0, C("s_nationkey")).otherwise(0).alias("num_classes")
    )
    counts = t.table("supplier").filter("s_suppkey % 3 > 0").select(
        C("s_name").alias("name"), (C("s_suppkey") % 5).cast("int").alias("n_categories")
    )
    return joins.resolve_num_classes(models, counts, 80).select("name", "classes")


@query(
    "J13",
    """
    SELECT r.o_orderkey, r.path, p.thermal_path FROM v_rgb r LEFT JOIN
      (SELECT '/d/' || o_custkey || '/F' || o_orderkey || '_T_JPG.rf.' || md5(cast(o_orderkey AS VARCHAR)) || '.jpg' AS rgb_path,
              '/th/' || o_orderkey || '.tif' AS thermal_path FROM orders) p ON r.path = p.rgb_path""",
)
def j13(t):
    pairs = t.sql(
        "SELECT '/d/' || cast(o_custkey AS string) || '/F' || cast(o_orderkey AS string) || '_T_JPG.rf.' || "
        "md5(cast(o_orderkey AS string)) || '.jpg' AS rgb_path, '/th/' || cast(o_orderkey AS string) || '.tif' AS thermal_path FROM orders"
    )
    return joins.attach_pairs(t("v_rgb"), pairs).select("o_orderkey", "path", "thermal_path")
