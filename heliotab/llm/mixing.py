"""Operator 3: mixing sources to target weights.

Tokens are added up per source; the wanted total is dealt out by weight, but a source gets ``cap`` times its own tokens
at most and what is over goes to the others, by weight again. The rate of a source is its target over its tokens. Each
of its documents is taken floor(rate) times, plus once more with the fraction as probability, drawn by a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotab.llm.common import drop_clashing, whole_text
from heliotab.operators.skew import ranked
from heliotab.session import pin

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 20_000  # rates of so many sources at most are broadcast; beyond, a join deals them out


def count_words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def source_targets(
    sizes: DataFrame, source: str, size: str, weights: Sequence[int], share: float, cap: float
) -> DataFrame:
    """Rows (source, source_size, target): ``share`` of all sizes dealt out by weight, at most ``cap`` of the own size.

    Sources in code point order, null last, weigh as ``weights`` says, from the start again when it ends. The level
    that every uncapped target has per weight only rises when a source is capped, so the rounds end; each is a sum
    over the table of sources in Spark.
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("source_size"))
    order = ranked(pin(totals), [], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1).cast("int") % len(weights) + 1)
    weighed = pin(order.withColumn("weight", weight.cast("bigint")).drop("rank"))
    limit = F.col("source_size") * F.lit(float(cap))
    level, known = 0.0, -1
    while True:
        capped = limit < F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.count_if(capped).alias("n"),
            F.sum(F.when(capped, F.col("source_size"))).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] == known or not row["weight"]:
            break
        known = row["n"]
        level = (share * (row["all"] or 0) - cap * (row["full"] or 0)) / row["weight"]
    return weighed.withColumn("target", F.least(limit, F.lit(level) * F.col("weight"))).drop("weight")


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Add ``size`` (words), ``source_size``, ``target`` (both of the source) and ``copies`` to every document.

    Null texts and texts without words have size 0; a source without words has target 0 and none of its documents is
    taken. Null sources are one source. Repeated rows of one id draw alike; a null id draws by its text. Columns that
    have the names of results are replaced. The sums are combined before they are shuffled; documents aren't
    shuffled unless there are more than BROADCAST_SOURCES sources.
    """
    made = ("size", "source_size", "target", "copies")
    sized = drop_clashing(docs.withColumn("__size", count_words(text)), *made)
    targets = source_targets(sized, source, "__size", weights, share, cap).withColumnRenamed("source", "__source")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    by = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(whole_text(text))))
    copies = F.floor(rate) + (draw(seed, by) < rate - F.floor(rate)).cast("bigint")
    return joined.withColumn("copies", copies).withColumnRenamed("__size", "size")


def emit_mix(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", **parameters
) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with the columns of ``docs`` as they are."""
    rows = docs.select(doc_id, text, source, F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    planned = plan_mix(rows, source=source, text=text, doc_id=doc_id, **parameters).filter("copies > 0")
    return planned.select("__row", F.explode(F.sequence(F.lit(1), "copies"))).select("__row.*")
