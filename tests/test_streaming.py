import random

from pyspark.sql import functions as F

from heliotab.sources.log_stream import read_log_stream, read_table_stream
from heliotab.streaming import log_streams

C = F.col


def write_lines(folder, batches):
    folder.mkdir()
    for i, lines in enumerate(batches):
        (folder / f"part{i:03d}.log").write_text("\n".join(lines) + "\n")


def drain(spark, stream, tmp_path, write=log_streams.append_to_table):
    out = str(tmp_path / "out")
    write(stream, out, str(tmp_path / "state")).awaitTermination()
    return spark.read.parquet(out)


def numbered(stream):
    return stream.select(
        F.regexp_extract("line", r"#(\d+)", 1).try_cast("bigint").alias("seq"),
        F.regexp_extract("line", r"^(\w+)", 1).alias("channel"),
        "line",
    )


def test_buffers_stay_bounded_over_many_batches(spark, tmp_path):
    n, shards = 15, 3
    rng = random.Random(5)
    numbers = list(range(700))
    # Out of order by up to some fifty lines, and each batch partly again.
    numbers.sort(key=lambda i: i + rng.randrange(50))
    (tmp_path / "in").mkdir()
    seen = set()
    for b in range(7):
        batch = numbers[b * 100 : (b + 1) * 100]
        lines = [f"{'hot' if i % 4 else 'cold'} #{i}" for i in batch] + ["late #"]
        (tmp_path / "in" / f"part{b:03d}.log").write_text("\n".join(lines) + "\n")
        seen |= set(batch)
        stream = numbered(read_log_stream(spark, str(tmp_path / "in"), files_per_batch=1))
        buffers = drain(spark, log_streams.stream_last_n(stream, n, shards), tmp_path, log_streams.replace_buffers)
        counts = buffers.groupBy("channel", "shard").count().collect()
        assert counts and max(r["count"] for r in counts) <= n and len(counts) <= 2 * shards
        got = {(r.channel, r.seq) for r in log_streams.last_n(buffers, n).collect()}
        want = set()
        for channel in ("hot", "cold"):
            want |= {(channel, i) for i in sorted(i for i in seen if (i % 4 > 0) == (channel == "hot"))[-n:]}
        assert got == want
    assert max(r["count"] for r in counts) == n


def test_buffers_of_null_and_empty_channels(spark, tmp_path):
    write_lines(tmp_path / "in", [["a #1", "b #2"], ["a #3", "c #4", "b #5"]])
    stream = read_log_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    channel = F.when(C("line").startswith("a"), F.lit(None)).when(C("line").startswith("b"), F.lit("")).otherwise(F.lit("7"))
    rows = numbered(stream).withColumn("channel", channel)
    buffers = drain(spark, log_streams.stream_last_n(rows, 1, 1), tmp_path, log_streams.replace_buffers).collect()
    assert sorted((r.channel is None, r.channel or "", r.seq, r.line) for r in buffers) == [
        (False, "", 5, "b #5"), (False, "7", 4, "c #4"), (True, "", 3, "a #3"),
    ]


def test_job_status(spark, tmp_path):
    write_lines(
        tmp_path / "in",
        [
            ["[00:00:01] INFO: UI:OK:train: Training started… #1", "[00:00:02] INFO: other #2"],
            ["[00:00:03] ERROR: UI:ERR:train: Training failed: x #3", "[00:00:04] INFO: UI:OK:test: Test complete. #4"],
        ],
    )
    stream = numbered(read_log_stream(spark, str(tmp_path / "in"), files_per_batch=1))
    rows = drain(spark, log_streams.stream_job_status(stream, ("seq",)), tmp_path, log_streams.replace_table).collect()
    assert {r.job: (r.state, r.text) for r in rows} == {"train": ("failed", "Training failed: x #3"), "test": ("completed", None)}


def test_run_logs(spark, tmp_path):
    write_lines(tmp_path / "in", [["[00:00:01] INFO: UI:INFO:train: a", "[00:00:01] INFO: b"], ["[00:00:01] INFO: UI:WARN:test: c"]])
    stream = read_log_stream(spark, str(tmp_path / "in"))
    log_streams.write_run_logs(stream, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    rows = spark.read.schema("value string, job string").text(str(tmp_path / "out")).collect()
    assert sorted((r.job, r.value[-1]) for r in rows) == [("test", "c"), ("train", "a")]


def test_tables_of_one_file_and_of_many_as_streams(spark, tmp_path):
    rows = spark.range(40).withColumn("line", F.concat(F.lit("l"), "id"))
    rows.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    rows.filter("id < 3").write.parquet(str(tmp_path / "other_events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "single"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "single").glob("*.parquet")).rename(tmp_path / "one" / "events.parquet")
    for folder in (tmp_path, tmp_path / "one"):
        counts = read_table_stream(spark, str(folder), rows.schema, "events.parquet").groupBy().count()
        work = folder / "work"
        work.mkdir()
        assert drain(spark, counts, work, log_streams.replace_table).collect()[0][0] == 40
