"""Parsing and routing of run-log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_PATTERN = r"(?s)^\[(\d{2}:\d{2}:\d{2})\] ([A-Z]+): (.*)$"
TAG_PATTERN = r"(?s)^UI:(OK|INFO|WARN|ERR):(train|test): ?(.*)$"

# Markers that route a line to a pane.
TRAIN_MARKERS = ("[train]", "UI:INFO:train", "UI:OK:train", "UI:ERR:train")
TEST_MARKERS = ("[test]", "UI:INFO:test", "UI:OK:test", "UI:ERR:test")
PROGRESS_PATTERN = r"(?i)\biter[: ]|\bloss[: ]|\beta[: ]"

# Markers that change the status of a job, as (job, state, marker), later rows win within a line.
STATUS_MARKERS = (
    ("train", "started", "UI:OK:train: Training started"),
    ("train", "completed", "UI:OK:train: Training completed"),
    ("train", "failed", "UI:ERR:train:"),
    ("test", "completed", "UI:OK:test: Test complete"),
    ("test", "failed", "UI:ERR:test:"),
)


def parse_log(df: DataFrame, line: str = "line") -> DataFrame:
    """Split lines into clock time, level and message, then the UI tag; what does not match stays null."""
    group = lambda col, pattern, i: F.nullif(F.regexp_extract(col, pattern, i), F.lit(""))
    text = F.col(line)
    parsed = df.withColumns(
        {
            "ts": group(text, LINE_PATTERN, 1),
            "level": group(text, LINE_PATTERN, 2),
            "message": F.when(text.rlike(LINE_PATTERN), F.regexp_extract(text, LINE_PATTERN, 3)),
        }
    )
    message = F.col("message")
    return parsed.withColumns(
        {
            "ui_level": group(message, TAG_PATTERN, 1),
            "job": group(message, TAG_PATTERN, 2),
            "text": F.when(message.rlike(TAG_PATTERN), F.regexp_extract(message, TAG_PATTERN, 3)),
        }
    )


def _contains_any(line: Column, markers: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for marker in markers:
        test = test | line.contains(marker)
    return test


def is_train_line(line: Column) -> Column:
    return _contains_any(line, TRAIN_MARKERS) | line.rlike(PROGRESS_PATTERN)


def is_test_line(line: Column) -> Column:
    return _contains_any(line, TEST_MARKERS)


def status_of(line: Column) -> Column:
    """``struct<job,state,text>`` that a line announces, or null. A failure carries the text behind its last marker."""
    status = F.lit(None).cast("struct<job:string,state:string,text:string>")
    for job, state, marker in STATUS_MARKERS:
        tail = F.trim(F.element_at(F.split(line, marker), -1)) if state == "failed" else F.lit(None).cast("string")
        found = F.struct(F.lit(job).alias("job"), F.lit(state).alias("state"), tail.alias("text"))
        status = F.when(line.contains(marker), found).otherwise(status)
    return status


def explode_lines(df: DataFrame, col: str = "chunk", out: str = "line") -> DataFrame:
    """Chunks of text to their non-blank lines."""
    lines = df.withColumn(out, F.explode(F.split(F.col(col), "\n")))
    return lines.filter(F.col(out).rlike(r"(?U)[^\s\x1c-\x1f]"))
