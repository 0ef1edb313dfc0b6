"""Queries over log streams: the events table read as a stream, to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliotab.catalog.columns import _TAGGED, _TEST, _TRAIN
from heliotab.catalog.registry import query
from heliotab.catalog.views import expand
from heliotab.session import scratch_path
from heliotab.sources.log_stream import read_table_stream
from heliotab.streaming import log_streams

C = F.col


def _stream(t, table: str, sql: str):
    """A query over one table that is read as a stream."""
    source = read_table_stream(t.spark, t.sf_dir, t.table(table).schema, f"{table}.parquet")
    source.createOrReplaceTempView(table)
    return t.spark.sql(expand(sql, 0))


def _stored(t, label: str, stream, write=log_streams.append_to_table):
    out = scratch_path(t.spark, label)
    write(stream, out, f"{out}-state").awaitTermination()
    return t.spark.read.parquet(out)


@query(
    "T1",
    f"""
    SELECT channel, seq, ts, level, ui_level, job, text FROM
      (SELECT 'train' AS channel, * FROM ({_TAGGED}) a WHERE {_TRAIN} UNION ALL SELECT 'test' AS channel, * FROM ({_TAGGED}) b WHERE {_TEST}) x""",
)
def t1(t):
    routed = log_streams.stream_routes(_stream(t, "events", "SELECT seq, line FROM v_logs"))
    return _stored(t, "t1", routed.select("channel", "seq", "ts", "level", "ui_level", "job", "text"))


_STATUS = """
    SELECT seq, job_id AS job, CASE WHEN line LIKE '%UI:ERR:%' THEN 'failed' WHEN line LIKE '%started%' THEN 'started' ELSE 'completed' END AS state,
           CASE WHEN line LIKE '%UI:ERR:%' THEN regexp_extract(line, 'UI:ERR:[a-z]+: (.*)$', 1) END AS text
    FROM v_logs WHERE line LIKE '%UI:ERR:%' OR line LIKE '%UI:OK:%'"""


@query("T2", f"SELECT job, arg_max(state, seq) AS state, arg_max_null(text, seq) AS text FROM ({_STATUS}) s GROUP BY job")
def t2(t):
    status = log_streams.stream_job_status(_stream(t, "events", "SELECT seq, line FROM v_logs"), ("seq",))
    return _stored(t, "t2", status, log_streams.replace_table)


@query(
    "T3",
    """
    SELECT channel, seq, line FROM
      (SELECT job_id AS channel, seq, line, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS r FROM v_logs) x WHERE r <= 1000""",
)
def t3(t):
    lines = _stream(t, "events", "SELECT job_id AS channel, seq, line FROM v_logs")
    buffers = _stored(t, "t3", log_streams.stream_last_n(lines), log_streams.replace_buffers)
    return log_streams.last_n(buffers).select("channel", "seq", "line")


@query(
    "T4",
    """
    SELECT CASE WHEN label = 3 THEN 'missing' WHEN vec_id % 4 < 2 THEN 'tif' ELSE 'other' END AS kind, count(*) AS n
    FROM embeddings GROUP BY 1""",
)
def t4(t):
    planes = _stream(
        t,
        "embeddings",
        "SELECT CASE vec_id % 4 WHEN 0 THEN 'a.TIF' WHEN 1 THEN 'a.tiff' ELSE 'a.png' END AS thermal_path, "
        "CASE WHEN label = 3 THEN NULL ELSE embedding END AS px FROM embeddings",
    )
    return _stored(t, "t4", log_streams.stream_thermal_usage(planes), log_streams.replace_table)


@query("K8", f"SELECT job, line AS value FROM ({_TAGGED}) x WHERE job IS NOT NULL")
def k8(t):
    out = scratch_path(t.spark, "k8")
    stream = _stream(t, "events", "SELECT seq, line FROM v_logs")
    log_streams.write_run_logs(stream, out, f"{out}-state", available_now=True).awaitTermination()
    return t.spark.read.schema("value string, job string").text(out).select("job", "value")
