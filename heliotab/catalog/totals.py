"""Queries over the aggregations, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliotab.catalog.registry import query
from heliotab.functions import geo, names
from heliotab.operators import aggregates, joins, listings
from heliotab.operators.scoring import num_classes as user_num_classes

C = F.col

_FOLDERS = """
    SELECT lower(substr(o_orderpriority, 3, 3)) AS name, cast(max(o_orderkey) * 7 % 1009 AS bigint) AS mtime FROM orders GROUP BY 1
    UNION ALL SELECT lower(n_name) AS name, cast(n_nationkey AS bigint) AS mtime FROM nation"""
_FOLDERS = _FOLDERS.replace("GROUP BY 1", "GROUP BY lower(substr(o_orderpriority, 3, 3))")


@query(
    "A1",
    f"""
    SELECT f.name, coalesce(c.n, 0) AS count, f.mtime FROM ({_FOLDERS}) f LEFT JOIN
      (SELECT dataset, count(*) AS n FROM v_files WHERE regexp_matches(lower(name), '\\.(jpg|jpeg|png|tif|tiff|bmp|webp)$') GROUP BY dataset) c
      ON f.name = c.dataset""",
)
def a1(t):
    return aggregates.dataset_listing(t.sql(_FOLDERS), t("v_files"))


_RESULTS = """
    SELECT dataset AS split, name, image_id % 11 > 2 AS ok, CASE WHEN image_id % 11 > 2 THEN NULL
           ELSE 'ValueError: ' || cast(image_id AS string) END AS error FROM v_images"""


@query(
    "A2",
    f"""
    SELECT split, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail, count(*) AS total,
           min_by(error, name) FILTER (NOT ok) AS first_error FROM ({_RESULTS}) r GROUP BY split""",
)
def a2(t):
    return aggregates.decode_stats(t.sql(_RESULTS))


@query("W4", f"SELECT split, min_by(error, name) FILTER (error IS NOT NULL) AS first_error FROM ({_RESULTS}) r GROUP BY split")
def w4(t):
    from heliotab.operators.windows import first_error

    return first_error(t.sql(_RESULTS))


_NESTED = """
    SELECT '/data/' || dataset || CASE o_orderkey % 3 WHEN 0 THEN '/thermal/' WHEN 1 THEN '/thermal/sub/' ELSE '/' END || name AS path FROM v_files"""


@query(
    "A3",
    f"""
    SELECT split_part(path, '/', 3) AS dataset, count(*) AS tif_count FROM ({_NESTED}) n
    WHERE path LIKE '%/thermal/%' AND regexp_matches(lower(path), '\\.tiff?$') GROUP BY 1""",
)
def a3(t):
    return aggregates.count_thermal(t.sql(_NESTED))


_USAGE = """
    SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'a.TIF' WHEN 1 THEN 'a.tiff' ELSE 'a.png' END AS thermal_path,
           CASE WHEN label = 3 THEN NULL ELSE px END AS px FROM v_planes"""


@query(
    "A4",
    f"""
    SELECT count(*) FILTER (px IS NOT NULL AND lower(thermal_path) LIKE '%.tif%') AS tif,
           count(*) FILTER (px IS NOT NULL AND lower(thermal_path) NOT LIKE '%.tif%') AS other,
           count(*) FILTER (px IS NULL) AS missing, count(*) AS total FROM ({_USAGE}) u""",
)
def a4(t):
    return aggregates.thermal_usage(t.sql(_USAGE))


@query(
    "A5",
    """
    SELECT i.session, cast(sum(n) AS BIGINT) AS total_preds FROM (SELECT doc, file, count(*) AS n FROM v_boxes GROUP BY doc, file) d
    JOIN v_images i ON i.name = d.file GROUP BY i.session""",
)
def a5(t):
    from heliotab.catalog.readers import coerced

    manifest = aggregates.manifest_counts(coerced(t)).select(C("file").alias("name"), "n")
    sessions = t("v_images").select("name", "session")
    return aggregates.total_predictions(manifest.join(sessions, "name"))


_CATEGORIES = "SELECT n_regionkey AS split, 100 - n_nationkey AS id, n_name AS name FROM nation"


@query("A6", f"SELECT split, count(*) AS num_classes FROM ({_CATEGORIES}) c GROUP BY split")
def a6(t):
    return aggregates.num_classes(t.sql(_CATEGORIES))


@query("F2", f"SELECT split, CASE WHEN split % 2 = 0 THEN max(id) ELSE count(*) END AS num_classes FROM ({_CATEGORIES}) c GROUP BY split")
def f2(t):
    """User count: the highest id for even splits; for others the function fails and the built-in count stands."""

    def highest(group):
        if group["split"].iloc[0] % 2:
            raise ValueError("no answer")
        return group["id"].max()

    return user_num_classes(t.sql(_CATEGORIES), highest)


@query("A7", f"SELECT split, string_agg(name, ',' ORDER BY id) AS class_names FROM ({_CATEGORIES}) c GROUP BY split")
def a7(t):
    return aggregates.class_names(t.sql(_CATEGORIES)).select("split", F.array_join("class_names", ",").alias("class_names"))


_CHANNELS = "SELECT l_orderkey AS image_id, cast(2 + l_linenumber % 5 AS int) AS channels FROM lineitem"


@query(
    "A8",
    f"""
    SELECT count(*) FILTER (channels = 3) AS c3, count(*) FILTER (channels = 4) AS c4, count(*) FILTER (channels = 5) AS c5,
           count(*) FILTER (channels NOT IN (3, 4, 5)) AS other, bool_and(channels = 4) AS all_four FROM ({_CHANNELS}) c""",
)
def a8(t):
    return aggregates.channel_histogram(t.sql(_CHANNELS))


_URLS = """
    SELECT session, kind, name, '/media/' || session || '/' || kind || '/' || name AS url FROM v_assets WHERE kind <> 'preds'
    UNION ALL
    SELECT session, 'tifs', name, '/media/' || session || '/' || kind || '/' || name AS url FROM v_assets WHERE kind = 'images' AND name LIKE '%.tif'"""


@query(
    "A9",
    f"""
    WITH u AS (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY name) - 1 AS r FROM ({_URLS}) x)
    SELECT session, kind, r // 50 AS chunk, string_agg(url, ' ' ORDER BY name) AS urls FROM u GROUP BY session, kind, r // 50""",
)
def a9(t):
    return aggregates.session_assets(t("v_assets"), 50).withColumn("urls", F.array_join("urls", " "))


_MAPPED = "SELECT i.session, g.name, g.lat, g.lon FROM v_images i JOIN v_geo g ON i.name = g.name WHERE g.lat IS NOT NULL"


@query(
    "A10",
    f"""
    SELECT session, round(min(lat), 9) AS south, round(min(lon), 9) AS west, round(max(lat), 9) AS north, round(max(lon), 9) AS east
    FROM ({_MAPPED}) m GROUP BY session""",
)
def a10(t):
    bounds = aggregates.layer_bounds(t.sql(_MAPPED))
    return bounds.select("session", *[F.round(c, 9).alias(c) for c in ("south", "west", "north", "east")])


@query(
    "A11",
    """
    SELECT vec_id, round(quantile_cont(v, 0.02), 6) + 0 AS low, round(quantile_cont(v, 0.98), 6) + 0 AS high
    FROM (SELECT vec_id, unnest(px) AS v FROM v_planes) p GROUP BY vec_id""",
)
def a11(t):
    rows = t("v_planes").select("vec_id", aggregates.tile_percentiles(C("px")).alias("p"))
    return rows.select("vec_id", *[(F.round(f"p.{c}", 6) + F.lit(0.0)).alias(c) for c in ("low", "high")])


@query(
    "A13",
    f"""
    SELECT session, r // 200 AS chunk, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM
      (SELECT session, name, row_number() OVER (PARTITION BY session ORDER BY name) - 1 AS r FROM ({_MAPPED}) m) x
    GROUP BY session, r // 200""",
)
def a13(t):
    text = geo.point_feature(C("lat"), C("lon"), F.struct("name"))
    features = t.sql(_MAPPED).select("session", "name", text.alias("feature"))
    chunks = aggregates.feature_collections(features, 200)
    name = lambda i: F.try_variant_get("v", f"$.features[{i}].properties.name", "string")
    count = F.size(F.try_variant_get("v", "$.features", "array<variant>"))
    parsed = chunks.withColumn("v", F.try_parse_json("geojson"))
    listed = F.transform(
        F.try_variant_get("v", "$.features", "array<variant>"),
        lambda f: F.try_variant_get(f, "$.properties.name", "string"),
    )
    return parsed.select(
        "session",
        "chunk",
        count.cast("bigint").alias("n"),
        name(0).alias("first_name"),
        F.element_at(listed, -1).alias("last_name"),
    )


_MANIFEST = "SELECT session, name AS file, image_id % 9 AS n FROM v_images WHERE image_id % 3 > 0"


@query(
    "A14",
    f"""
    WITH s AS (SELECT DISTINCT session FROM v_images), u AS ({_URLS}), m AS ({_MANIFEST})
    SELECT s.session, CASE WHEN s.session < 'sessions/o' THEN '/media/' || s.session || '/anomalies.geojson' END AS geojson_url,
           (SELECT count(*) FROM u WHERE u.session = s.session AND kind = 'images') AS n_images,
           (SELECT count(*) FROM u WHERE u.session = s.session AND kind = 'tifs') AS n_tifs,
           (SELECT count(*) FROM u WHERE u.session = s.session AND kind = 'overlays') AS n_overlays,
           (SELECT count(*) FROM u WHERE u.session = s.session AND kind = 'thumbs') AS n_thumbs,
           (SELECT count(*) FROM m WHERE m.session = s.session) AS n_manifest,
           cast((SELECT sum(n) FROM m WHERE m.session = s.session) AS BIGINT) AS total_preds FROM s""",
)
def a14(t):
    sessions = t("v_images").select("session").distinct()
    layers = sessions.filter("session < 'sessions/o'").select(
        "session", F.lit("").alias("kind"), F.lit("anomalies.geojson").alias("name")
    )
    files = t("v_assets").select("session", "kind", "name").unionByName(layers)
    return aggregates.session_summary(sessions, files, t.sql(_MANIFEST))


@query(
    "A15",
    f"SELECT session, name, round(lat, 9) AS lat, round(lon, 9) AS lon, '/media/' || session || '/images/' || name AS url FROM ({_MAPPED}) m",
)
def a15(t):
    rows = t.sql(_MAPPED).withColumn("url", names.media_url(C("session"), "images", C("name")))
    points = aggregates.image_points(rows)
    return points.select("session", "name", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "url")


# ----------------------------------------------------------------------------------- sorts and set operations


@query("O1", "SELECT name, mtime FROM v_runs")
def o1(t):
    return listings.listing(t("v_runs").select("name", "mtime"))


@query(
    "O2",
    """
    SELECT s_nationkey, max_by(name, mtime * 10000000 + s_suppkey) AS name, max(mtime) AS mtime FROM v_runs GROUP BY s_nationkey
    UNION ALL SELECT -1, max_by(name, mtime * 10000000 + s_suppkey), max(mtime) FROM v_runs""",
)
def o2(t):
    runs = t("v_runs")
    whole = listings.latest(runs).select(F.lit(-1).alias("s_nationkey"), "name", "mtime")
    return listings.latest(runs, "s_nationkey").unionByName(whole)


@query("O3", "SELECT image_id, name FROM v_images")
def o3(t):
    return listings.order_by_name(t("v_images").select("image_id", "name"))


@query(
    "U1",
    f"""
    SELECT session, name, 0 AS kind_rank, -1 AS det_idx, round(lat, 9) AS lat FROM ({_MAPPED}) m
    UNION ALL
    SELECT m.session, m.name, 1, cast(b.i - 1 AS int), round(m.lat, 9) FROM ({_MAPPED}) m JOIN v_boxes b ON b.file = m.name WHERE b.score >= 0.6""",
)
def u1(t):
    mapped = t.sql(_MAPPED)
    anomalies = t.sql(f"""
        SELECT m.session, m.name, cast(b.i - 1 AS int) AS det_idx, m.lat, m.lon FROM ({_MAPPED}) m JOIN v_boxes b ON b.file = m.name
        WHERE b.score >= 0.6""")
    rows = listings.build_features(mapped, anomalies)
    return rows.select("session", "name", "kind_rank", "det_idx", F.round("lat", 9).alias("lat"))


@query(
    "U2",
    """
    SELECT doc, count(*) AS n, cast(NULL AS VARCHAR) AS reason FROM v_boxes WHERE shape <> 3 GROUP BY doc
    UNION ALL SELECT doc, 0, 'read_failed' FROM v_docs WHERE shape = 3""",
)
def u2(t):
    from heliotab.catalog.readers import coerced

    scored = coerced(t).drop("reason").join(t("v_docs").filter("shape <> 3").select("doc"), "doc", "left_semi")
    failed = t("v_docs").filter("shape = 3").select("doc", "file", F.lit("read_failed").alias("reason"))
    rows = listings.scored_or_reason(scored, failed)
    return rows.select("doc", F.size("boxes").cast("bigint").alias("n"), "reason")


_UPLOADS = """
    SELECT o_custkey AS upload, CASE WHEN o_orderkey % 13 = 0 THEN 'u' || cast(o_orderkey AS string) || '.ZIP' ELSE name END AS name FROM v_files"""


@query(
    "U3",
    f"""
    WITH u AS (SELECT *, lower(name) LIKE '%.zip' AS is_zip, bool_or(lower(name) LIKE '%.zip') OVER (PARTITION BY upload) AS has_zip FROM ({_UPLOADS}) x)
    SELECT upload, name, CASE WHEN is_zip THEN 'archive' ELSE 'image' END AS role FROM u
    WHERE is_zip OR (NOT has_zip AND regexp_matches(lower(name), '\\.(jpg|jpeg|png|tif|tiff|bmp|webp)$'))""",
)
def u3(t):
    return listings.upload_plan(t.sql(_UPLOADS)).select("upload", "name", "role")


