"""Domain tables as views over the benchmark tables.

Each view is plain SQL that reads the same in Spark and in DuckDB, over the whole of its table; where the engines spell
something differently, a pair of texts is given.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_IMAGE = (
    "'DJI_' || lpad(cast({k} AS string), 8, '0') || '_T_JPG.rf.' || md5(cast({k} AS string)) || '.jpg'"
)
_DET_KEY = "(l_partkey * 10000000 + l_suppkey) * 10 + l_linenumber"
_DOC = (
    "cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string) || '-' "
    "|| cast(l_suppkey AS string) || '-' || cast(cast(l_quantity AS bigint) AS string) || '-' "
    "|| cast(cast(floor(l_extendedprice) AS bigint) AS string)"
)
_X1, _Y1 = "cast(l_partkey % 600 AS double)", "cast((l_suppkey * 7) % 480 AS double)"
_JOB = "CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'test' END"

VIEWS: dict[str, str | tuple[str, str]] = {
    "v_images": f"""
        SELECT o_orderkey AS image_id, {_IMAGE.format(k="o_orderkey")} AS name, 640 AS width, 512 AS height,
               o_orderpriority AS dataset, 'sessions/' || lower(o_orderstatus) || substr(o_orderpriority, 1, 1) AS session,
               o_custkey
        FROM orders""",
    "v_dets": f"""
        SELECT l_orderkey AS image_id, {_X1} AS x1, {_Y1} AS y1, {_X1} + l_quantity AS x2,
               {_Y1} + cast(l_linenumber * 5 AS double) AS y2, cast(l_linenumber % 4 AS int) AS class,
               cast((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 1000 AS double) / cast(1000 AS double) AS score,
               {_DET_KEY} AS det_key
        FROM lineitem""",
    "v_anns": f"""
        SELECT l_orderkey AS image_id, {_DET_KEY} AS ann_id, cast(l_linenumber % 4 AS int) AS category_id,
               {_X1} + cast(l_linenumber % 3 AS double) AS x, {_Y1} AS y, l_quantity AS w,
               cast(l_linenumber * 5 AS double) AS h, CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END AS iscrowd
        FROM lineitem""",
    "v_gts": """
        SELECT image_id, category_id AS class, x AS x1, y AS y1, x + w AS x2, y + h AS y2, w * h AS area, iscrowd,
               ann_id AS gt_key
        FROM v_anns""",
    # Each line item as an image of its own, with one detection and one ground-truth box.
    "v_single": f"""
        SELECT {_DOC} AS doc, cast(l_linenumber % 4 AS int) AS class, {_X1} AS x1, {_Y1} AS y1, {_X1} + l_quantity AS x2,
               {_Y1} + cast(l_linenumber * 5 AS double) AS y2, {_X1} + cast(l_linenumber % 3 AS double) AS g_x1,
               {_X1} + cast(l_linenumber % 3 AS double) + l_quantity AS g_x2, l_quantity * cast(l_linenumber * 5 AS double) AS area,
               CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END AS iscrowd, {_DET_KEY} AS det_key,
               cast((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 1000 AS double) / cast(1000 AS double) AS score
        FROM lineitem""",
    # One document per line item with as many boxes as its line number says; four JSON shapes.
    "v_docs": f"""
        SELECT {_DOC} AS doc, {_IMAGE.format(k="l_orderkey")} AS file, l_orderkey % 4 AS shape, l_orderkey, l_partkey,
               l_suppkey, l_linenumber, l_quantity
        FROM lineitem""",
    "v_boxes": """
        SELECT d.doc, d.file, d.shape, n.i, d.l_orderkey AS image_id,
               cast((d.l_partkey + n.i * 13) % 600 AS double) AS x1, cast((d.l_suppkey * 7 + n.i * 29) % 480 AS double) AS y1,
               cast((d.l_partkey + n.i * 13) % 600 AS double) + d.l_quantity AS x2,
               cast((d.l_suppkey * 7 + n.i * 29) % 480 AS double) + cast(d.l_linenumber * 5 AS double) AS y2,
               CASE WHEN d.shape = 3 THEN cast(0 AS double)
                    ELSE cast((d.l_partkey * 37 + d.l_suppkey * 11 + n.i * 101) % 1000 AS double) / cast(1000 AS double)
               END AS score,
               CASE WHEN d.shape = 3 THEN 0 ELSE cast((d.l_partkey + n.i) % 7 AS int) END AS class
        FROM v_docs d JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS n(i) ON n.i <= d.l_linenumber""",
    "v_gps": f"""
        SELECT {_IMAGE.format(k="o.o_orderkey")} AS name, c.c_custkey % 80 AS lat_d, c.c_custkey % 180 AS lon_d,
               cast(c.c_nationkey AS bigint) AS m, cast(floor(abs(c.c_acctbal) * 100) AS bigint) % 6000 AS s_num,
               cast(CASE WHEN c.c_custkey % 10 = 0 THEN 0 ELSE 100 END AS bigint) AS s_den,
               CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'S' ELSE 'N' END AS lat_ref,
               CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'W' ELSE 'E' END AS lon_ref
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "v_geo": """
        SELECT name,
               (CASE WHEN lat_ref = 'S' THEN -1 ELSE 1 END) * (cast(lat_d AS double) + cast(m AS double) / cast(60 AS double)
                 + (cast(s_num AS double) / cast(nullif(s_den, 0) AS double)) / cast(3600 AS double)) AS lat,
               (CASE WHEN lon_ref = 'W' THEN -1 ELSE 1 END) * (cast(lon_d AS double) + cast(m AS double) / cast(60 AS double)
                 + (cast(s_num AS double) / cast(nullif(s_den, 0) AS double)) / cast(3600 AS double)) AS lon
        FROM v_gps""",
    "v_classes": "SELECT r_regionkey AS class_id, r_name AS class_name FROM region",
    "v_files": f"""
        SELECT '/data/' || lower(substr(o_orderpriority, 3, 3)) || '/' || name AS path, lower(substr(o_orderpriority, 3, 3)) AS dataset,
               name, o_orderkey, o_custkey, o_orderkey * 37 % 100003 AS mtime
        FROM (SELECT 'IMG_' || cast(o_orderkey AS string) || CASE o_orderkey % 10 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG'
                     WHEN 2 THEN '.jpeg' WHEN 3 THEN '.png' WHEN 4 THEN '.tif' WHEN 5 THEN '.TIFF' WHEN 6 THEN '.webp'
                     WHEN 7 THEN '.txt' WHEN 8 THEN '_thermal.tif' ELSE '.bmp' END AS name,
                     o_orderkey, o_custkey, o_orderpriority
              FROM orders) f""",
    "v_planes": (
        """
        SELECT vec_id, label, 8 AS h, 8 AS w,
               transform(embedding, v -> cast(v AS double) * cast(label * 20 AS double)) AS px FROM embeddings""",
        """
        SELECT vec_id, label, 8 AS h, 8 AS w,
               list_transform(embedding, lambda v: cast(v AS double) * cast(label * 20 AS double)) AS px FROM embeddings""",
    ),
    # Names that follow the variants of the thermal match.
    "v_rgb": """
        SELECT o_orderkey, '/d/' || cast(o_custkey AS string) || '/F' || cast(o_orderkey AS string)
               || CASE o_orderkey % 8 WHEN 2 THEN '_T' ELSE '_T_JPG' END || '.rf.' || md5(cast(o_orderkey AS string)) || '.jpg'
               AS path
        FROM orders""",
    "v_thermal": """
        SELECT '/d/' || cast(o_custkey AS string) || '/thermal/' || CASE o_orderkey % 8
                 WHEN 0 THEN 'F' || cast(o_orderkey AS string) || '_T_JPG.TIF'
                 WHEN 1 THEN 'F' || cast(o_orderkey AS string) || '_T.tif'
                 WHEN 2 THEN 'F' || cast(o_orderkey AS string) || '.tiff'
                 WHEN 3 THEN 'F' || cast(o_orderkey AS string) || '.tif'
                 WHEN 4 THEN 'f' || cast(o_orderkey AS string) || '_t_jpg.tif'
                 WHEN 5 THEN 'xF' || cast(o_orderkey AS string) || '_T_JPG.rf.h_thermal.tif'
                 WHEN 6 THEN '_' || cast(o_orderkey AS string) || '_.tif'
                 ELSE 'n' || cast(o_orderkey AS string) || 'n.tif' END AS path
        FROM orders""",
    "v_logs": f"""
        SELECT event_id AS seq, substr(cast(ts AS string), 12, 8) AS clock, {_JOB} AS job_id,
               '[' || substr(cast(ts AS string), 12, 8) || '] ' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END || ': '
               || CASE event_type
                    WHEN 'error' THEN 'UI:ERR:' || {_JOB} || ': failed at ' || cast(value AS string)
                    WHEN 'purchase' THEN 'UI:OK:' || {_JOB} || ': ' || CASE WHEN user_id % 2 = 1 THEN 'Test complete'
                                         WHEN event_id % 3 = 0 THEN 'Training started' ELSE 'Training completed' END
                    WHEN 'signup' THEN 'UI:WARN:' || {_JOB} || ': ' || props
                    WHEN 'view' THEN CASE WHEN user_id % 3 = 0 THEN 'eta: 1:00 iter: 20 total_loss: 0.5'
                                          WHEN user_id % 3 = 1 THEN '[test] tile' ELSE 'total_loss: 0.5' END
                    ELSE 'UI:INFO:' || {_JOB} || ': ' || props END AS line
        FROM events""",
    # 8 x 8 planes on the map; half in metres, half in degrees.
    "v_rasters": """
        SELECT cast(vec_id AS string) AS source, 0 AS band, h, w, px, CASE WHEN vec_id % 2 = 0 THEN 3857 ELSE 4326 END AS epsg,
               CASE WHEN vec_id % 2 = 0 THEN cast((vec_id % 100) * 50000 AS double) ELSE cast(vec_id % 90 AS double) END AS x0,
               CASE WHEN vec_id % 2 = 0 THEN cast((vec_id % 70) * 60000 AS double) ELSE cast(vec_id % 60 AS double) END AS y0,
               CASE WHEN vec_id % 2 = 0 THEN cast(90000 AS double) ELSE cast(1 AS double) END AS dx,
               CASE WHEN vec_id % 2 = 0 THEN cast(90000 AS double) ELSE cast(1 AS double) END AS dy
        FROM v_planes""",
    "v_runs": "SELECT s_name AS name, s_suppkey * 37 % 1009 AS mtime, s_nationkey, s_suppkey, s_acctbal FROM supplier",
    "v_run_files": """
        SELECT s_name AS run, CASE WHEN s_suppkey % 3 = 0 THEN 'model_final.pth' WHEN s_suppkey % 3 = 1 THEN 'model.pth'
               ELSE 'notes.txt' END AS name FROM supplier
        UNION ALL
        SELECT s_name AS run, 'model_best.pth' AS name FROM supplier WHERE s_nationkey < 12""",
    "v_assets": """
        SELECT session, CASE image_id % 5 WHEN 0 THEN 'images' WHEN 1 THEN 'overlays' WHEN 2 THEN 'thumbs' WHEN 3 THEN 'images'
               ELSE 'preds' END AS kind,
               CASE image_id % 5 WHEN 3 THEN 'p' || cast(image_id AS string) || '.tif'
                 ELSE 'p' || cast(image_id AS string) || '.jpg' END AS name, image_id
        FROM v_images""",
}


def _needed(sql: str) -> list[str]:
    """Views a text refers to, dependencies first."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            for other in [*_needed(_text(name, 0)), name]:
                if other not in found:
                    found.append(other)
    return found


def _text(name: str, dialect: int) -> str:
    text = VIEWS[name]
    return text if isinstance(text, str) else text[dialect]


def expand(sql: str, dialect: int) -> str:
    """Text with the views it needs in front (dialect 0 is Spark, 1 is DuckDB)."""
    ctes = [f"{name} AS ({_text(name, dialect)})" for name in _needed(sql)]
    if not ctes:
        return sql
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body[: len(head)].upper() == head:
            return head + ",\n".join(ctes) + ",\n" + body[len(head) :]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Views and benchmark tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows of a scan over all cores, where one small file would otherwise give one task of heavy row work."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def sql(self, text: str, spread: bool = False) -> DataFrame:
        """Rows of a query; with ``spread`` those of its tables are spread, which is less than what is made of them."""
        full = expand(text, 0)
        for name in TABLES:
            if re.search(rf"\b{name}\b", full):
                rows = self.spread(self.table(name)) if spread else self.table(name)
                rows.createOrReplaceTempView(name)
        return self.spark.sql(full)

    def __call__(self, view: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {view}")
