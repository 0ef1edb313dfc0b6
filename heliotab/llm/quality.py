"""Operator 9: quality classifier on random-indexing word vectors.

Every token (a word in its case, or a run of marks) has a sparse random vector given by its hash. The vector of a word is
the sum of those of its neighbours over the whole corpus. A document is pooled from its tokens' vectors: mean, spread
and likeness of neighbours. A network of two layers in numpy, learned from a bounded sample of labelled rows, gives a
score, whose temperature is fitted on a part of the sample that the network didn't learn from.

Words share a bounded number of rows by their hash, so the table of vectors has a fixed size at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from heliotab.llm.common import (
    WORDS_AND_MARKS,
    Prefix,
    column_parts,
    drop_clashing,
    fold,
    list_array,
    mix64,
    sampled_labels,
    slices_by_bytes,
    text_buffer,
    token_spans,
    whole_text,
)

WORDS = 1 << 14  # rows of the table of word vectors
WIDTH = 48  # dimensions
SIGNS = 4  # entries of a random vector that aren't 0
WINDOW = 2  # neighbours on each side
SAMPLE = 12_000  # labelled rows that are learned from, at most
FOLDS, HELD_OUT = 4, 2
HIDDEN = 32
ROUNDS = 60
ACCEPT = 0.7
CHUNK = 100_000  # tokens whose vectors are held at a time


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of the word table and row of the batch for each token."""
    data, offsets = text_buffer(column)
    start, end, row = token_spans(data, offsets, WORDS_AND_MARKS)
    if not len(start):
        return np.zeros(0, np.int64), row
    return (Prefix(data).parts(start, end) >> np.uint64(11)).astype(np.int64) & (WORDS - 1), row


def _random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each word's random vector."""
    seed = np.arange(WORDS, dtype=np.uint64)[:, None] * np.uint64(SIGNS) + np.arange(SIGNS, dtype=np.uint64)
    drawn = mix64(seed + np.uint64(0x51ED2701))
    return (drawn % np.uint64(WIDTH)).astype(np.int64), np.where(drawn >> np.uint64(63), 1.0, -1.0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours' random vectors over the task's texts, one row a word that occurs."""
    place, sign = _random_vectors()
    total = np.zeros(WORDS * WIDTH)
    count = np.zeros(WORDS, dtype=np.int64)
    for batch in batches:
        for part in slices_by_bytes(batch, most=1_500_000):
            word, row = tokens(part.column(0))
            count += np.bincount(word, minlength=WORDS)
            for step in range(1, WINDOW + 1):
                near = row[step:] == row[:-step]
                a, b = word[:-step][near], word[step:][near]
                for k in range(SIGNS):
                    for own, other in ((a, b), (b, a)):
                        total += np.bincount(own * WIDTH + place[other, k], sign[other, k], minlength=WORDS * WIDTH)
    seen = np.flatnonzero(count)
    sums = total.reshape(WORDS, WIDTH)[seen]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(seen.astype(np.int32)),
            pa.array(count[seen]),
            list_array(sums.ravel(), np.full(len(seen), WIDTH), pa.float64()),
        ],
        ["word", "n", "sums"],
    )


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of each word; whole numbers in doubles, so the order doesn't matter."""
    total, count = {}, {}
    for batch in batches:
        sums = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        for word, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sums):
            count[word] = count.get(word, 0) + n
            total[word] = total[word] + x if word in total else x.copy()
    words = sorted(total)
    flat = np.concatenate([total[w] for w in words]) if words else np.zeros(0)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(words, pa.int32()),
            pa.array([count[w] for w in words], pa.int64()),
            list_array(flat, np.full(len(words), WIDTH), pa.float64()),
        ],
        ["word", "n", "sums"],
    )


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Vectors of all words (WORDS x WIDTH), of length 1, from the neighbourhoods in all of ``docs``.

    Each task adds up its texts before the shuffle; the result has a fixed size (3 MB) and comes to the driver.
    """
    schema = "word int, n bigint, sums array<double>"
    partial = docs.select(whole_text(text).alias("text")).mapInArrow(_contexts, schema)
    rows = partial.repartition("word").mapInArrow(_add_up, schema).toArrow()
    out = np.zeros((WORDS, WIDTH))
    if rows.num_rows:
        out[rows["word"].to_numpy()] = rows["sums"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
        n = np.zeros(WORDS)
        n[rows["word"].to_numpy()] = rows["n"].to_numpy()
        out -= np.outer(n, out.sum(axis=0) / max(1.0, n.sum()))  # what every word has in common tells nothing
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and mean square by dimension, likeness of neighbours, and part of neighbours that are equal."""
    word, row = tokens(column)
    rows = len(column)
    sums = np.zeros((rows, 2 * WIDTH + 2))
    for low in range(0, len(word), CHUNK):
        part, owner = word[low : low + CHUNK], row[low : low + CHUNK]
        x = vectors[part]
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sums[owner[cuts], :WIDTH] += np.add.reduceat(x, cuts, axis=0)
        sums[owner[cuts], WIDTH : 2 * WIDTH] += np.add.reduceat(x * x, cuts, axis=0)
        # Neighbours across the edge of a chunk are taken with the later one.
        back = max(0, low - 1)
        before, after = word[back : low + len(part) - 1], word[back + 1 : low + len(part)]
        same = row[back : low + len(part) - 1] == row[back + 1 : low + len(part)]
        likeness = np.einsum("ij,ij->i", vectors[before], vectors[after]) * same
        owner = row[back + 1 : low + len(part)]
        sums[:, -2] += np.bincount(owner, likeness, minlength=rows)
        sums[:, -1] += np.bincount(owner, (before == after) & same, minlength=rows)
    count = np.bincount(row, minlength=rows)[:, None]
    return sums / np.maximum(count, 1)


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.tanh(((pooled - self.mean) / self.spread) @ a + b) @ c + d)[:, 0]

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(pooled) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _loss(logits: np.ndarray, label: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - label * logits))


def fit(pooled: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> Model:
    """Learn the two layers by Adam on four fifths of the sample, and the temperature on the rest."""
    width = pooled.shape[1] if len(pooled) else 2 * WIDTH + 2
    rng = np.random.default_rng(7)
    layers = [rng.normal(size=(width, HIDDEN)) / np.sqrt(width), np.zeros(HIDDEN)]
    layers += [rng.normal(size=(HIDDEN, 1)) / np.sqrt(HIDDEN), np.zeros(1)]
    model = Model(vectors, np.zeros(width), np.ones(width), layers, 1.0)
    if not len(pooled):
        layers[2][:] = 0
        return model
    model.mean, model.spread = pooled.mean(axis=0), pooled.std(axis=0) + 1e-6
    order = rng.permutation(len(pooled))
    held, learn = order[: len(order) // 5], order[len(order) // 5 :]
    x, y = (pooled - model.mean) / model.spread, label.astype(float)
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(ROUNDS):
        rng.shuffle(learn)
        for low in range(0, len(learn), 128):
            at = learn[low : low + 128]
            a, b, c, d = layers
            hidden = np.tanh(x[at] @ a + b)
            wrong = (_sigmoid((hidden @ c + d)[:, 0]) - y[at])[:, None] / len(at)
            inner = (wrong @ c.T) * (1 - hidden**2)
            slopes = [x[at].T @ inner + 1e-4 * a, inner.sum(axis=0), hidden.T @ wrong + 1e-4 * c, wrong.sum(axis=0)]
            t += 1
            for w, m, v, g in zip(layers, first, second, slopes):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    if len(held):
        logits = model.logits(pooled[held])
        choices = np.exp(np.linspace(np.log(0.5), np.log(8), 57))
        model.temperature = float(min(choices, key=lambda c: _loss(logits / c, y[held])))
    return model


def pooled_vectors(df: DataFrame, vectors: np.ndarray, text: str = "text", out: str = "pooled") -> DataFrame:
    """Add the pooled vector of each text as array<float>; without a token it is all 0."""
    sent = df.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = np.concatenate([pool(p, sent.value) for p in column_parts(column, 1_500_000)] or [np.zeros((0, 1))])
            yield list_array(x.astype(np.float32).ravel(), np.full(len(x), x.shape[1]), pa.float32())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    fn = F.arrow_udf(run, ArrayType(FloatType()))
    made = df.withColumn("__pooled", fn(F.col(text).cast("string")))
    return drop_clashing(made, out).withColumnRenamed("__pooled", out)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors from all documents; the network from at most ``sample`` labelled rows, copies counting once."""
    vectors = word_vectors(docs)
    ids, _ = sampled_labels(labels, "quality", FOLDS, HELD_OUT, sample)
    # The sample is bounded by its parameter, which bounds the broadcast, and the vectors that come to the driver.
    chosen = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(ids), "doc_id")
    pooled = pooled_vectors(chosen, vectors).select("doc_id", F.xxhash64("text").alias("k"), "label", "pooled")
    rows = pooled.dropDuplicates(["k", "label"]).orderBy("k", "doc_id").limit(sample).toArrow()
    x = np.array(rows["pooled"].to_pylist(), dtype=float).reshape(rows.num_rows, 2 * WIDTH + 2)
    return fit(x, rows["label"].to_numpy(), vectors)


def score_quality(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add the probability (0 to 1) that a text is of quality.

    Null and empty texts get the score of a text without tokens. Texts are taken whole, repeated rows stay, and a
    column that has the name of the result is replaced. No shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [sent.value.score(pool(p, sent.value.vectors)) for p in column_parts(column, 1_500_000)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    fn = F.arrow_udf(run, DoubleType())
    made = df.withColumn("__score", fn(F.col(text).cast("string")))
    return drop_clashing(made, score).withColumnRenamed("__score", score)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document by what the labelled rows outside the held-out fold teach."""
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        (fold(FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )
