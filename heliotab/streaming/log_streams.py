"""Live views of run logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from heliotab.functions import logs, planes

BUFFER_LINES = 1000
SHARDS = 32


def stream_routes(stream: DataFrame, line: str = "line") -> DataFrame:
    """Parsed lines with the panes they belong to, one row per pane; other lines are dropped."""
    panes = F.array_compact(
        F.array(
            F.when(logs.is_train_line(F.col(line)), F.lit("train")),
            F.when(logs.is_test_line(F.col(line)), F.lit("test")),
        )
    )
    return logs.parse_log(stream, line).withColumn("channel", F.explode(panes))


def stream_job_status(stream: DataFrame, order: tuple[str, ...] = ("ts", "seq"), line: str = "line") -> DataFrame:
    """Latest status per job: started, completed or failed, with the text of a failure. The state is one row per job."""
    status = stream.withColumn("status", logs.status_of(F.col(line))).filter("status IS NOT NULL")
    newest = F.struct(*order)
    return status.groupBy(F.col("status.job").alias("job")).agg(
        F.max_by("status.state", newest).alias("state"), F.max_by("status.text", newest).alias("text")
    )


def stream_thermal_usage(stream: DataFrame, path: str = "thermal_path", px: str = "px") -> DataFrame:
    """Running count of planes by provenance."""
    kind = planes.thermal_kind(F.col(path), F.col(px)).alias("kind")
    return stream.select(kind).groupBy("kind").agg(F.count("*").alias("n"))


def last_n(lines: DataFrame, n: int = BUFFER_LINES, channel: str = "channel", seq: str = "seq") -> DataFrame:
    """Batch form of the buffer: the newest n lines per channel, cut per partition before the shuffle."""
    newest = Window.partitionBy(channel).orderBy(F.col(seq).desc())
    return lines.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= n).drop("__r")


BUFFER = "channel string, shard int, seq bigint, line string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Buffer(StatefulProcessor):
    """The newest n lines of one shard of a channel, as list state."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "seq bigint, line string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.lines.get()) if self.lines.exists() else [], columns=["seq", "line"])
        for batch in rows:
            held = pd.concat([held, batch[["seq", "line"]]]).sort_values(["seq", "line"], kind="stable").tail(self.n)
        held["seq"] = held["seq"].astype("int64")
        self.lines.put(list(held.itertuples(index=False, name=None)))
        yield held.assign(channel=key[0], shard=key[1])[["channel", "shard", "seq", "line"]]

    def close(self) -> None:
        pass


def stream_last_n(stream: DataFrame, n: int = BUFFER_LINES, shards: int = SHARDS) -> DataFrame:
    """Bounded buffer per channel over a stream of (channel, seq, line); lines without a number are dropped.

    A channel is split into shards by line number, so a busy channel is not one task. Each shard holds its newest n
    lines as state in the RocksDB store; an older line gives way to a newer one by its number, whatever order they come
    in. In update mode the shards that a batch has touched are emitted whole; :func:`replace_buffers` keeps them as a
    table of at most n rows a channel and shard, and :func:`last_n` over that table gives the buffer.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    shard = F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int").alias("shard")
    lines = stream.select("channel", F.col("seq").cast("bigint").alias("seq"), "line", shard).filter("seq IS NOT NULL")
    return lines.groupBy("channel", "shard").transformWithStateInPandas(_Buffer(n), BUFFER, "Update", "None")


def replace_buffers(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Buffers of :func:`stream_last_n` as a table, everything available so far. A batch replaces the shards that it
    emits and no others, so that the table is as bounded as the state and a batch that is repeated changes nothing."""
    # A null channel and an empty one are told apart.
    part = F.concat_ws("-", F.col("shard").cast("string"), F.coalesce(F.concat(F.lit("c"), "channel"), F.lit("n")))

    def store(batch: DataFrame, _: int) -> None:
        writer = batch.withColumn("part", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part").parquet(path)

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.outputMode("update").trigger(availableNow=True).start()


def write_run_logs(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Lines of each job below its own folder, exactly once."""
    lines = logs.parse_log(stream).filter("job IS NOT NULL").select("job", F.col("line").alias("value"))
    writer = lines.writeStream.format("text").partitionBy("job").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything available so far to Parquet files, exactly once."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(path)


def replace_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A complete aggregate to a table that each batch replaces."""
    store = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.outputMode("complete").trigger(availableNow=True).start()
