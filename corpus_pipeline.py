"""Pipeline from documents to training tokens.

Documents that the quality classifier rejects go; lines whose template recurs over documents are dropped but in the
first one; one document of each class of near copies stays; sources are mixed to their target weights; what is left is
encoded, and decoded again as a proof. Each stage takes (spark, docs, sf_dir) and returns the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab.llm.common import table, whole_text
from heliotab.llm.line_templates import drop_recurring_lines
from heliotab.llm.mixing import emit_mix
from heliotab.llm.near_copies import drop_near_copies
from heliotab.llm.piece_codec import round_trip
from heliotab.llm.quality import ACCEPT, score_quality, train
from heliotab.session import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is ACCEPT or more, as the labels of the corpus and these documents teach it."""
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, score="__quality")
    return scored.filter(F.col("__quality") >= ACCEPT).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines. A document that loses all it had goes; ``n_chars`` follows the text."""
    cut = drop_recurring_lines(docs)
    left = cut.filter((F.col("n_dropped") == 0) | (F.trim(whole_text()) != ""))
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", counted)
    return left.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return emit_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document taken, their number, and digests of the ids and of the text that they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return round_trip(docs.select("doc_id", "text"), path).select(
        "doc_id",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near copies", drop_copies),
    ("source mix", mix),
    ("piece encoding", encode),
]

# The classifier and the encoder aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's result is written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
