"""Operator 8: toxic spans by a linear-chain conditional random field.

Two tags, clean and toxic. The evidence of a token is the sum of learned weights of its word, of its beginnings and of
the words beside it; tags beside each other have learned weights too. Forward and backward sums give each token's
marginal probability, which make the offending spans and, aggregated, the score of the document.

Labels are given for documents, so tokens are labelled by them: a token of a toxic document is toxic if its word or one
of its beginnings is found in toxic documents of the sample nearly only. All is learned from a bounded sample of the
labelled rows: SAMPLE rows a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.llm.common import (
    LOWER,
    Prefix,
    column_parts,
    drop_clashing,
    fold,
    sampled_labels,
    text_buffer,
    token_spans,
    whole_text,
)

SAMPLE = 2_000  # labelled rows of each class that are learned from, at most
SAMPLE_BYTES = 30_000  # rows with longer texts aren't among them
FOLDS, HELD_OUT = 5, 0
BITS = 17  # features are hashed to so many bits for each kind
BEGINNINGS = (4, 5, 6)  # bytes
KINDS = 3 + len(BEGINNINGS)  # word, word before, word after, beginnings
LEAST_PLACES, LEAST_SHARE = 15, 0.95  # of a feature that labels tokens
ROUNDS = 12
TOKENS = 100_000  # in a block of the sample, about
STEP = 128  # tokens of the chain that are passed in one go for all parts of it


def features(column: pa.Array):
    """Tokens of a batch of texts: feature numbers (tokens x kinds), row, start and end in the row's bytes."""
    data, offsets = text_buffer(column)
    start, end, row = token_spans(data, offsets)
    out = np.zeros((len(start), KINDS), dtype=np.int32)
    if len(start):
        prefix = Prefix(LOWER[data])
        mask = np.uint64((1 << BITS) - 1)
        word = (prefix.parts(start, end) & mask).astype(np.int32)
        out[:, 0] = word
        beside = row[1:] == row[:-1]
        out[1:, 1] = np.where(beside, word[:-1] + 1, 0)
        out[:-1, 2] = np.where(beside, word[1:] + 1, 0)
        for k, width in enumerate(BEGINNINGS, 3):
            cut = np.minimum(end, start + width)
            out[:, k] = ((prefix.parts(start, cut) >> np.uint64(20)) & mask).astype(np.int32)
        out[:, 1:3] &= (1 << BITS) - 1
        out += np.arange(KINDS, dtype=np.int32) << BITS
    return out, row, start - offsets[row], end - offsets[row]


@dataclass
class Model:
    weight: np.ndarray  # by feature, evidence for toxic
    bias: float
    change: np.ndarray  # 2 x 2, tag before and tag
    begin: np.ndarray  # 2, first tag
    score: np.ndarray  # constant, largest log odds, log of the expected number of toxic tokens


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


class Chain:
    """Forward and backward sums over all tokens at once.

    Texts stand one after another; where a text begins, the tag before doesn't matter, which keeps texts apart. The
    chain is cut into parts of STEP tokens: the matrices of each part are multiplied for all parts together, the parts
    are linked one by one, and the sums within the parts are made for all parts together again.
    """

    def __init__(self, evidence: np.ndarray, first: np.ndarray, change: np.ndarray, begin: np.ndarray):
        n = len(evidence)
        parts = -(-n // STEP)
        odds = np.ones(parts * STEP)
        odds[:n] = np.exp(np.clip(evidence, -30, 30))
        fresh = np.ones(parts * STEP, dtype=bool)
        fresh[:n] = first
        t, b = np.exp(change), np.exp(begin)
        m = np.empty((2, 2, parts * STEP))
        for before in (0, 1):
            m[before, 0] = np.where(fresh, b[0], t[before, 0])
            m[before, 1] = np.where(fresh, b[1], t[before, 1]) * odds
        m = np.ascontiguousarray(m.reshape(2, 2, parts, STEP).transpose(3, 0, 1, 2))  # step, before, tag, part
        whole = np.zeros((2, 2, parts))
        whole[0, 0] = whole[1, 1] = 1
        for k in range(STEP):
            whole = np.einsum("abp,bcp->acp", whole, m[k])
            whole /= whole.sum(axis=(0, 1))
        into = np.empty((2, parts))
        x = (0.5, 0.5)
        w = whole.transpose(2, 0, 1).tolist()
        for p, ((a, bb), (c, d)) in enumerate(w):
            into[0, p], into[1, p] = x
            y, z = x[0] * a + x[1] * c, x[0] * bb + x[1] * d
            x = (y / (y + z), z / (y + z))
        back = np.empty((2, parts))
        x = (0.5, 0.5)
        for p in range(parts - 1, -1, -1):
            back[0, p], back[1, p] = x
            (a, bb), (c, d) = w[p]
            y, z = a * x[0] + bb * x[1], c * x[0] + d * x[1]
            x = (y / (y + z), z / (y + z))
        forward = np.empty((STEP, 2, parts))
        f = into
        for k in range(STEP):
            f = np.einsum("ap,abp->bp", f, m[k])
            f = f / f.sum(axis=0)
            forward[k] = f
        backward = np.empty((STEP, 2, parts))
        g = back
        for k in range(STEP - 1, -1, -1):
            backward[k] = g
            g = np.einsum("abp,bp->ap", m[k], g)
            g = g / g.sum(axis=0)
        both = forward * backward
        flat = lambda x: x.transpose(x.ndim - 1, 0, *range(1, x.ndim - 1)).reshape(parts * STEP, *x.shape[1:-1])[:n]
        self.marginal = flat(both / both.sum(axis=1, keepdims=True))[:, 1]
        self.forward, self.backward, self.m = flat(forward), flat(backward), flat(m)

    def changes(self) -> np.ndarray:
        """Expected number of each pair of neighbouring tags, by token (from the second)."""
        pair = self.forward[:-1, :, None] * self.m[1:] * self.backward[1:, None, :]
        return pair / pair.sum(axis=(1, 2), keepdims=True)


def seeds(feats: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features (words and beginnings) that stand in toxic documents of a sample nearly alone, as a mask.

    What counts are the different words before them, so near copies of one document count about once.
    """
    count = np.zeros((2, KINDS << BITS))
    share = np.maximum(1, np.bincount(toxic, minlength=2))
    for k in (0, *range(3, KINDS)):
        for c in (0, 1):
            mine = toxic[row] == c
            once = np.unique(feats[mine, k].astype(np.int64) << 32 | feats[mine, 1])
            count[c] += np.bincount(once >> 32, minlength=KINDS << BITS)
    toxic_rate, clean_rate = count[1] / share[1], (count[0] + 0.5) / share[0]
    return (count[1] >= LEAST_PLACES) & (toxic_rate >= LEAST_SHARE * (toxic_rate + clean_rate))


def aggregate(marginal: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each document a constant, its largest log odds, and the log of the expected number of toxic tokens."""
    top, total = np.zeros(rows), np.zeros(rows)
    np.maximum.at(top, row, marginal)
    total += np.bincount(row, marginal, minlength=rows)
    return np.stack([np.ones(rows), _log_odds(top) / 10, np.log(total + 1e-6) / 10], axis=1)


def fit(texts: pa.Array, toxic: np.ndarray, prior: float) -> Model:
    """Learn from a sample; ``prior`` is the share of toxic rows among all labelled ones."""
    parts = [features(part) for part in column_parts(texts)]
    feats = np.concatenate([p[0] for p in parts] or [np.zeros((0, KINDS), np.int32)])
    bases = np.cumsum([0, *(len(part) for part in column_parts(texts))])
    row = np.concatenate([p[1] + base for p, base in zip(parts, bases)] or [np.zeros(0, np.int64)])
    del parts
    toxic = np.asarray(toxic, dtype=np.int64)
    none = Model(np.zeros(KINDS << BITS), 0.0, np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    none.score[0] = _log_odds(np.array(prior))
    if not len(feats) or len(np.unique(toxic)) < 2:
        return none
    found = seeds(feats, row, toxic)
    tag = np.zeros(len(row), dtype=np.int64)
    for k in (0, *range(3, KINDS)):
        tag |= found[feats[:, k]]
    tag *= toxic[row]
    blocks = _blocks(row)
    seen_pairs = np.zeros((2, 2))
    for part in blocks:
        inner = row[part][1:] == row[part][:-1]
        pair = 2 * tag[part][:-1][inner] + tag[part][1:][inner]
        seen_pairs += np.bincount(pair, minlength=4).reshape(2, 2)
    weight, bias = np.zeros(KINDS << BITS), -3.0
    change, begin = np.zeros((2, 2)), np.zeros(2)
    squares, b2, c2 = np.full(KINDS << BITS, 1e-2), 1e-2, np.full((2, 2), 1e-2)
    for _ in range(ROUNDS):
        slope, b, c = -0.05 * weight, 0.0, seen_pairs.copy()
        for part in blocks:
            chain = _chain(Model(weight, bias, change, begin, np.zeros(3)), feats[part], row[part])
            wrong = tag[part] - chain.marginal
            for k in range(KINDS):
                low = k << BITS
                slope[low : low + (1 << BITS)] += np.bincount(feats[part, k] - low, wrong, minlength=1 << BITS)
            b += wrong.sum()
            c -= chain.changes()[row[part][1:] == row[part][:-1]].sum(axis=0)
        squares += slope**2
        weight += slope / np.sqrt(squares)
        b2 += b * b
        bias += b / np.sqrt(b2)
        c2 += c * c
        change += 0.5 * c / np.sqrt(c2)
    model = Model(weight, float(bias), change, begin, np.zeros(3))
    # Logistic regression of the document labels on the aggregates, the classes weighted as among all labelled rows.
    x = aggregate(np.concatenate([marginals(model, feats[p], row[p]) for p in blocks]), row, len(toxic))
    share = toxic.mean()
    each = np.where(toxic == 1, prior / share, (1 - prior) / (1 - share))
    score = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ score, -30, 30)))
        slope = x.T @ (each * (toxic - p)) - 1e-3 * score
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        score += np.linalg.solve(curve, slope)
    model.score = score
    return model


def _blocks(row: np.ndarray) -> list[slice]:
    """Parts of a sample's tokens, cut between documents, so that learning needs little memory."""
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    cuts = heads[np.flatnonzero(np.r_[True, np.diff(heads // TOKENS) > 0])]
    return [slice(int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(row)])]


def _chain(model: Model, feats: np.ndarray, row: np.ndarray) -> Chain:
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    evidence = np.full(len(row), model.bias)
    for k in range(KINDS):
        evidence += model.weight[feats[:, k]]
    return Chain(evidence, first, model.change, model.begin)


def marginals(model: Model, feats: np.ndarray, row: np.ndarray) -> np.ndarray:
    return _chain(model, feats, row).marginal if len(feats) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows of each class; copies among them count once."""
    ids, count = sampled_labels(labels, "toxic", FOLDS, HELD_OUT, sample, by_class=True)
    short = docs.select("doc_id", whole_text().alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    # The sample is bounded by its parameter, which bounds the broadcast, and the rows that come to the driver.
    chosen = short.join(F.broadcast(ids), "doc_id").dropDuplicates(["text", "label"])
    rows = chosen.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * sample).toArrow()
    known = max(1, sum(count.values()))
    prior = min(max(count.get(1, 0) / known, 1e-3), 1 - 1e-3)
    texts = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return fit(texts, rows["label"].to_numpy(), prior)


SPAN = "array<struct<start:int,end:int,p:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def tag_toxic(df: DataFrame, model: Model, text: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """Add the document's score (0 to 1) and its toxic spans: byte offsets in the UTF-8 text, and probability.

    Tokens next to each other with a marginal of 0.5 or more are one span. Null and empty texts, and texts without a
    word, have no spans and the score of a document without evidence. Texts are taken whole, repeated rows stay, and
    columns that have the names of results are replaced. No shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    made = pa.struct([("score", pa.float64()), ("spans", _SPAN)])

    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for column in batches:
            parts = [_tag(part, model, made) for part in column_parts(column, 1_500_000)]
            yield pa.concat_arrays(parts) if parts else pa.array([], made)

    tag.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    fn = F.arrow_udf(tag, f"struct<score:double,spans:{SPAN}>")
    tagged = drop_clashing(df.withColumn("__tagged", fn(F.col(text).cast("string"))), score, spans)
    return tagged.withColumns({score: F.col("__tagged.score"), spans: F.col("__tagged.spans")}).drop("__tagged")


def _tag(column: pa.Array, model: Model, made: pa.DataType) -> pa.Array:
    rows = len(column)
    feats, row, start, end = features(column)
    p = marginals(model, feats, row)
    score = 1 / (1 + np.exp(-np.clip(aggregate(p, row, rows) @ model.score, -30, 30)))
    hit = np.flatnonzero(p >= 0.5)
    begins = np.ones(len(hit), dtype=bool)
    begins[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
    head = np.flatnonzero(begins)
    tail = np.append(head[1:], len(hit))[: len(head)] - 1
    top = np.maximum.reduceat(p[hit], head) if len(head) else np.zeros(0)
    offsets = np.zeros(rows + 1, dtype=np.int32)
    np.cumsum(np.bincount(row[hit[head]], minlength=rows), out=offsets[1:])
    span = pa.StructArray.from_arrays(
        [pa.array(start[hit[head]].astype(np.int32)), pa.array(end[hit[tail]].astype(np.int32)), pa.array(top)],
        ["start", "end", "p"],
    )
    spans = pa.ListArray.from_arrays(pa.array(offsets), span).cast(_SPAN)
    return pa.StructArray.from_arrays([pa.array(score), spans], ["score", "spans"]).cast(made)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document by what the labelled rows outside the held-out fold teach."""
    model = train(docs, labels)
    scored = tag_toxic(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (fold(FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        F.transform("spans", lambda s: s["start"]).alias("offsets"),
    )
