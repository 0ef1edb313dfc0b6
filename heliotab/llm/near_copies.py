"""Operator 7: near-duplicate documents by improved consistent weighted sampling.

A document is the multiset of its shingles of five words, weighted by tf-idf. Consistent weighted samples of two
documents agree with a probability equal to their weighted Jaccard similarity, so documents that agree in all samples
of one band are candidates. Candidates are verified by the weighted Jaccard similarity itself.

Document frequencies are counted over all documents in a table of fixed size, by the hash of the shingle. A shingle in
fewer than COMMON of the documents has the full weight 1; beyond, the weight falls with the logarithm of its frequency.
Copies would so depress their own shingles. Therefore documents that share a band of plain min-hashes with many others
count as one document together.

Texts with equal words are one node from the start. In a bucket of a band a pivot is compared with all others; those
that are linked to it need no comparison with each other. That is repeated for the pairs that are still open, and when
few of them are left, all of them are verified: in small buckets as pairs, in others cell by cell, a cell being two
parts of a bucket, so that no pair of a large bucket becomes a row. In a cell texts go that have too little in common
with all of the other part together; what is left is compared in matrices, and links that connect the cell are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.llm.common import (
    LOWER,
    Prefix,
    compact,
    list_array,
    mix64,
    release,
    row_key,
    slices_by_bytes,
    text_buffer,
    token_spans,
    whole_text,
)
from heliotab.llm.components import components
from heliotab.session import pin

SHINGLE = 5  # words
SIMILAR = 0.8
BANDS, ROWS = 16, 4
BUCKETS = 1 << 18  # of the table of document frequencies
COMMON = 0.1  # part of all documents
PLAIN_BANDS, PLAIN_ROWS = 8, 3  # of the plain min-hashes
LARGE = 0.001  # part of all documents from which a group of copies is counted as one; so few groups are broadcast
ROUNDS = 4  # of pivots, at most; what is open then is verified pair by pair
OPEN_PAIRS = 1  # pivots go on while more pairs than this many times the bucket members are open
SMALL_BUCKET = 8  # open members up to which a bucket's pairs are rows
CELL_ROWS, CELL_BYTES = 256, 4_000_000  # of each of the two parts that make a cell of a larger bucket
CELL_COLUMNS = 4096  # shingles that are compared at once in a cell


def shingles(column: pa.Array):
    """Distinct shingles of a batch: hash and count, sorted by row and hash; how many each row has; words' digests.

    Words are lower-cased runs of letters, digits, _ and characters outside ASCII. A text with fewer than five words
    is one shingle; without words it has none.
    """
    data, offsets = text_buffer(column)
    rows = len(column)
    start, end, row = token_spans(data, offsets)
    if not len(start):
        empty = hashlib.md5(b"").digest()
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows, np.int64), [empty] * rows
    word = Prefix(LOWER[data]).parts(start, end)
    words = np.bincount(row, minlength=rows)
    edges = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(words, out=edges[1:])
    digests = [hashlib.md5(word[a:b].tobytes()).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    place = np.arange(len(word)) - edges[row]
    first = (place == 0) | (place <= words[row] - SHINGLE)
    at, owner = np.flatnonzero(first), row[first]
    mixed = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        inside = at + k < edges[owner + 1]
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, word[np.minimum(at + k, len(word) - 1)], 0)
    # 48 bits of the hash and the row in one number, which sorts fast; a batch has fewer than 2**16 rows.
    both = np.sort(owner.astype(np.uint64) << np.uint64(48) | mix64(mixed) >> np.uint64(16))
    new = np.r_[True, both[1:] != both[:-1]]
    hashed, owner = both & np.uint64((1 << 48) - 1), (both >> np.uint64(48)).astype(np.int64)
    heads = np.flatnonzero(new)
    count = np.diff(np.r_[heads, len(hashed)])
    return hashed[heads], count, np.bincount(owner[heads], minlength=rows), digests


def plain_bands(hashed: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands of plain min-hashes (rows x PLAIN_BANDS), and which of them have any shingle.

    Shingles are dealt over the min-hashes by their hash. ``hashed`` ascends within a row, so the first of each is taken.
    """
    many = PLAIN_BANDS * PLAIN_ROWS
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    mixed = mix64(hashed)
    least = np.zeros(len(sizes) * many, dtype=np.uint64)
    place = owner * many + (mixed % np.uint64(many)).astype(np.int64)
    least[place[::-1]] = hashed[::-1] + np.uint64(1)  # the last one written stays
    least = least.reshape(len(sizes), PLAIN_BANDS, PLAIN_ROWS)
    key = np.zeros(least.shape[:2], dtype=np.uint64)
    for k in range(PLAIN_ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
    return key + np.arange(PLAIN_BANDS, dtype=np.uint64), least.any(axis=2)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices_by_bytes(batch):
            hashed, _, sizes, _ = shingles(part.column(0))
            bands, full = plain_bands(hashed, sizes)
            bucket, n = np.unique(bands[full].astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])
            docs = int((sizes > 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs], pa.int64())], ["bucket", "n"])


def _frequencies(groups):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, members = groups.value
        total, docs = np.zeros(BUCKETS), 0.0
        for batch in batches:
            for part in slices_by_bytes(batch):
                hashed, _, sizes, _ = shingles(part.column(0))
                share = np.ones(len(sizes))
                if len(bucket_of):
                    bands, full = plain_bands(hashed, sizes)
                    bands = bands.astype(np.int64)
                    at = np.minimum(np.searchsorted(bucket_of, bands), len(bucket_of) - 1)
                    share = 1 / np.where(full & (bucket_of[at] == bands), members[at], 1).max(axis=1)
                bucket = (hashed & np.uint64(BUCKETS - 1)).astype(np.int64)
                total += np.bincount(bucket, np.repeat(share, sizes), minlength=BUCKETS)
                docs += float(share[sizes > 0].sum())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(total[seen], docs))], ["bucket", "n"]
        )

    return count


def shingle_weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weight (idf) by bucket of a shingle's hash, float32 of the fixed size BUCKETS; counted over all documents.

    A document counts 1/n, n being the members of the largest bucket of plain min-hashes that it stands in, if that is
    a part of at least LARGE of the documents; else 1. At most PLAIN_BANDS / LARGE buckets are that large.
    """
    spark = docs.sparkSession
    lowered = docs.select(F.lower(whole_text(text)).alias("text"))
    plain = pin(lowered.mapInArrow(_plain, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")))
    release(spark)
    many = plain.filter("bucket IS NULL").agg(F.max("n")).first()[0] or 0
    large = plain.filter(F.col("bucket").isNotNull() & (F.col("n") >= max(2.0, LARGE * many)))
    large = large.orderBy("bucket").toArrow()
    groups = spark.sparkContext.broadcast((large["bucket"].to_numpy(), large["n"].to_numpy()))
    rows = lowered.mapInArrow(_frequencies(groups), "bucket int, n double")
    # Sums of fractions depend on their order; rounded ones don't.
    partial = rows.select("bucket", F.round(F.col("n") * (1 << 20)).cast("bigint").alias("n"))
    rows = partial.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy() / (1 << 20)
    docs_seen = max(1.0, n[bucket == -1].sum())
    frequency = np.zeros(BUCKETS)
    frequency[bucket[bucket >= 0]] = n[bucket >= 0]
    share = np.clip(frequency / docs_seen, 1e-12, 1)
    # A shingle that all documents have still weighs a little, so no document is without weight.
    return np.clip(np.log(share) / np.log(COMMON), 0.01, 1).astype(np.float32)


@lru_cache(maxsize=1)
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), and their logarithms, at 2**16 even steps."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * p) + p
    for _ in range(60):  # Newton steps on 1 - (1 + x) exp(-x) = p
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def samples(hashed: np.ndarray, weight: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """Consistent weighted samples (rows x count) of rows with at least one shingle each.

    For shingle s with weight w: r, c ~ Gamma(2, 1) and b ~ U(0, 1) by the hash of s; t = floor(ln w / r + b);
    the sample is the (s, t) with the least c exp(-r (t - b + 1)).
    """
    gamma, log_gamma = _quantiles()
    log_w = np.log(weight).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), count), dtype=np.uint64)
    low16, low24 = np.uint64(0xFFFF), np.uint64(0xFFFFFF)
    for k in range(count):
        x = (hashed ^ np.uint64((k + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        r = gamma[(x >> np.uint64(48)).astype(np.int32)]
        log_c = log_gamma[((x >> np.uint64(32)) & low16).astype(np.int32)]
        b = ((x >> np.uint64(8)) & low24).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + b)
        cost = log_c - r * (t - b + np.float32(1))
        least = np.minimum.reduceat(cost, starts)
        hit = np.flatnonzero(cost == np.repeat(least, sizes))
        hit = hit[np.searchsorted(hit, starts)]  # the first of each row
        out[:, k] = mix64(hashed[hit] + t[hit].astype(np.int64).astype(np.uint64))
    return out


def _signatures(weights):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 300_000):
                hashed, count, sizes, digests = shingles(part.column(2))
                weight = count * weights.value[(hashed & np.uint64(BUCKETS - 1)).astype(np.int64)]
                full = sizes > 0
                bands = np.zeros((part.num_rows, BANDS), dtype=np.uint64)
                total = np.zeros(part.num_rows)
                if full.any():
                    drawn = samples(hashed, weight, sizes[full], BANDS * ROWS).reshape(-1, BANDS, ROWS)
                    key = np.zeros(drawn.shape[:2], dtype=np.uint64)
                    for k in range(ROWS):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + drawn[:, :, k])
                    bands[full] = key + np.arange(BANDS, dtype=np.uint64)
                    total[full] = np.add.reduceat(weight, np.cumsum(sizes[full]) - sizes[full])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(digests, pa.binary()),
                        list_array(bands[full].astype(np.int64).ravel(), np.where(full, BANDS, 0), pa.int64()),
                        pa.array(total),
                    ],
                    ["k_id", "k_text", "node", "bands", "weight"],
                )

    return sign


def _similarities(weights):
    def similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text_a", 1_000_000):
                sides = []
                for name in ("text_a", "text_b"):
                    hashed, count, sizes, _ = shingles(part.column(part.schema.get_field_index(name)))
                    weight = count * weights.value[(hashed & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    sides.append((np.repeat(np.arange(len(sizes)), sizes), hashed, weight.astype(np.float64)))
                (row_a, a, wa), (row_b, b, wb) = sides
                row, both, w = np.r_[row_a, row_b], np.r_[a, b], np.r_[wa, wb]
                order = np.lexsort((both, row))
                row, both, w = row[order], both[order], w[order]
                twin = np.flatnonzero((row[1:] == row[:-1]) & (both[1:] == both[:-1]))
                shared = np.bincount(row[twin], np.minimum(w[twin], w[twin + 1]), minlength=part.num_rows)
                total = np.bincount(row, w, minlength=part.num_rows)
                out = shared / np.maximum(total - shared, 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out)], ["a", "b", "similarity"])

    return similarity


def _shared_weight(rows, columns, weight, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Weight that each text of ``upper`` shares with each of ``lower``; entries (row, column) are sorted by column."""
    out = np.zeros((len(upper), len(lower)))
    for low in range(0, len(weight), CELL_COLUMNS):
        a, b = np.searchsorted(columns, (low, low + CELL_COLUMNS))
        dense = np.zeros((max(upper.max(), lower.max()) + 1, min(CELL_COLUMNS, len(weight) - low)))
        dense[rows[a:b], columns[a:b] - low] = 1
        out += (dense[upper] * weight[low : low + CELL_COLUMNS]) @ dense[lower].T
    return out


def linked_pairs(texts: pa.Array, part: np.ndarray, weights: np.ndarray, similar: float):
    """(x, y, similarity) of all pairs of texts of part 0 and part 1 that are similar; of all pairs, if there is one part.

    A shingle that occurs n times in a text is n shingles, so the weight that two texts share is a sum over those that
    both have. A text whose shingles on the other side weigh less than ``similar`` of its own weight has no link.
    """
    hashed, count, sizes, _ = shingles(texts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, count * weights[(hashed & np.uint64(BUCKETS - 1)).astype(np.int64)], minlength=len(sizes))
    kinds, kind = np.unique(hashed, return_inverse=True)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    rows, entry = np.repeat(owner, count), np.repeat(kind, count) << 32 | nth
    one = not (part.any() and (part == 0).any())
    side = np.zeros(len(part), np.int64) if one else part.astype(np.int64)
    alive = total > 0
    while True:
        keep = alive[rows]
        rows, entry = rows[keep], entry[keep]
        column = np.unique(entry, return_inverse=True)[1]
        seen = np.stack([np.bincount(column[side[rows] == s], minlength=column.max(initial=-1) + 1) for s in (0, 1)])
        shared = seen[0] > 1 if one else (seen > 0).all(axis=0)
        rows, entry = rows[shared[column]], entry[shared[column]]
        weight = weights[(kinds[entry >> 32] & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.float64)
        # Sums in another order may differ in the last digits.
        left = alive & (np.bincount(rows, weight, minlength=len(sizes)) >= (similar - 1e-9) * total)
        if (left == alive).all():
            break
        alive = left
    upper, lower = (np.flatnonzero(alive & (side == s)) for s in ((0, 0) if one else (0, 1)))
    if not len(upper) or not len(lower):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    names, column = np.unique(entry, return_inverse=True)
    order = np.argsort(column, kind="stable")
    weight = weights[(kinds[names >> 32] & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.float64)
    both = _shared_weight(rows[order], column[order], weight, upper, lower)
    out = both / np.maximum(total[upper][:, None] + total[lower][None, :] - both, 1e-12)
    x, y = np.nonzero(out >= similar)
    found = out[x, y]
    x, y = upper[x], lower[y]
    return (x[x < y], y[x < y], found[x < y]) if one else (x, y, found)


def _cell_links(weights, similar: float):
    """Links of a cell between different labels, as many as connect what its links connect."""

    def links(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("node")
        node, label = cell["node"].to_pylist(), cell["label"].to_pylist()
        chunk = cell["chunk"].to_numpy()
        out = []
        if len(set(label)) > 1:
            text = cell["text"].combine_chunks()
            x, y, alike = linked_pairs(text, (chunk != chunk.min()).astype(np.int64), weights.value, similar)
            root = {name: name for name in label}

            def top(name):
                while root[name] != name:
                    root[name] = name = root[root[name]]
                return name

            for i, j, similarity in zip(x.tolist(), y.tolist(), alike.tolist()):
                a, b = top(label[i]), top(label[j])
                if a != b:
                    root[a] = b
                    out.append((min(node[i], node[j]), max(node[i], node[j]), similarity))
        a, b, similarity = zip(*out) if out else ((), (), ())
        return pa.table(
            [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(similarity, pa.float64())],
            ["a", "b", "similarity"],
        )

    return links


def _in_cells(members: DataFrame, texts: DataFrame, weights, similar: float) -> DataFrame:
    """Links (a, b, similarity) between the nodes of each bucket of ``members`` (bucket, node, label).

    A bucket is dealt into parts by the hash of the node. A cell has the texts of two parts, or of one, and each task
    holds one cell at a time.
    """
    sized = members.join(texts.select("node", F.octet_length("text").alias("size")), "node")
    n_parts = F.greatest(F.count("node") / CELL_ROWS, F.sum("size") / CELL_BYTES)
    parts = sized.groupBy("bucket").agg(F.ceil(n_parts).cast("int").alias("parts"))
    dealt = members.join(parts, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = dealt.select("bucket", "node", "label", "chunk", other).select(
        "bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node", "label", "chunk"
    )
    held = cells.join(texts, "node")
    return held.groupBy("bucket", "low", "high").applyInArrow(
        _cell_links(weights, similar), "a binary, b binary, similarity double"
    )


def near_copies(docs: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text"):
    """Nodes of ``docs`` and the links between them.

    Returns (rows, links): ``rows`` has (k_id, k_text, node) for every row of ``docs``, ``node`` the digest of its
    words; ``links`` has (a, b, similarity) between nodes, enough of them to connect all that candidates connect.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(shingle_weights(docs, text))
    lowered = docs.select(*row_key(doc_id, text), F.lower(whole_text(text)).alias("text"))
    schema = "k_id {}, k_text bigint, node binary, bands array<bigint>, weight double"
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = pin(lowered.mapInArrow(_signatures(weights), schema.format(id_type)))

    nodes = rows.groupBy("node").agg(
        F.first("bands").alias("bands"),
        F.first("weight").alias("weight"),
        F.min(F.struct("k_id", "k_text")).alias("where"),
    )
    banded = nodes.select("node", "weight", "where", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("node").alias("n")).filter("n > 1").select("bucket")
    members = pin(banded.join(shared, "bucket"))

    # Texts of the nodes that stand in any bucket, once a node.
    wanted = members.groupBy("node").agg(F.first("where").alias("where"))
    wanted = wanted.select("node", F.col("where.k_id").alias("w_id"), F.col("where.k_text").alias("k_text"))
    same = lowered["k_id"].eqNullSafe(wanted["w_id"]) & (lowered["k_text"] == wanted["k_text"])
    texts = pin(lowered.join(wanted, same).select("node", "text").dropDuplicates(["node"]))
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        side_a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        side_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        joined = pairs.select("a", "b").join(side_a, "a").join(side_b, "b").select("a", "b", "text_a", "text_b")
        return joined.mapInArrow(_similarities(weights), "a binary, b binary, similarity double")

    def pair(x: str, y: str):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    # label: members of a bucket with one label are known to be connected; open: not yet a pivot.
    state = members.select("bucket", "node", "weight", F.col("node").alias("label"), F.lit(True).alias("open"))
    known, tested = None, 0
    for turn in range(ROUNDS + 1):
        # Open pairs are those of open members with different labels.
        alike = state.groupBy("bucket", "label").agg(
            F.count_if("open").cast("double").alias("n"),
            F.count("*").alias("members"),
            F.max_by(F.struct("node", "label", "weight"), F.when(F.col("open"), F.col("node"))).alias("p"),
        )
        summary = alike.groupBy("bucket").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("labels"),
            F.sum("members").alias("members"),
            F.max_by("p", F.when(F.col("n") > 0, F.col("label"))).alias("p"),
        )
        active = pin(summary.filter("n > 0 AND labels > 1"))
        left = active.agg(F.count("n"), F.sum("n"), F.sum(F.expr("(n * n - squares) / 2")), F.sum("members")).first()
        if not left[0]:
            break
        active = compact(active, left[0])
        # Members of the buckets that are still at work; from here on, rounds cost by their number.
        meet = compact(pin(state.join(active.select("bucket", "p", F.col("n").alias("n_open")), "bucket")), left[3])
        if turn == ROUNDS or left[2] <= OPEN_PAIRS * left[1]:
            # A pair is taken in the first bucket that it shares; there it is open too, or else settled.
            now = meet.filter("open")
            # Members of large buckets are dealt out again, as each becomes a row per cell.
            cells = now.filter(F.col("n_open") > SMALL_BUCKET).select("bucket", "node", "label").repartition("node")
            now = now.filter(F.col("n_open") <= SMALL_BUCKET).join(nodes.select("node", "bands"), "node")
            x, y = now.alias("x"), now.alias("y")
            once = (F.col("x.label") != F.col("y.label")) & (F.col("x.node") < F.col("y.node"))
            near = F.least("x.weight", "y.weight") >= similar * F.greatest("x.weight", "y.weight")
            shared = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")
            pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & once & near & shared)
            pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
            pairs = pairs.join(known, ["a", "b"], "left_anti") if known is not None else pairs
            found = compact(pin(verified(pairs).union(_in_cells(cells, texts, weights, similar))), left[2])
            known = found if known is None else known.union(found)
            break
        others = meet.filter("open AND label <> p.label")
        near = F.least("weight", "p.weight") >= similar * F.greatest("weight", "p.weight")
        pairs = others.filter(near).select(*pair("node", "p.node")).distinct()
        pairs = pairs.join(known, ["a", "b"], "left_anti") if known is not None else pairs
        found = compact(pin(verified(pairs)), left[1])
        tested += left[1]
        known = found if known is None else compact(pin(compact(known.union(found), tested).distinct()), tested)
        linked = known.filter(F.col("similarity") >= similar).select("a", "b", F.lit(True).alias("linked"))
        hits = others.withColumns(dict(zip(("a", "b"), (F.least("node", "p.node"), F.greatest("node", "p.node")))))
        hits = hits.join(linked, ["a", "b"]).select("bucket", "label", F.col("p.label").alias("own"))
        least = hits.groupBy("bucket").agg(F.least(F.min("label"), F.min("own")).alias("to"))
        renamed = hits.select("bucket", "label").union(hits.select("bucket", F.col("own").alias("label")))
        renamed = compact(renamed, 2 * left[3]).distinct()
        renamed = renamed.join(least, "bucket")
        state = compact(pin(
            meet.join(renamed, ["bucket", "label"], "left").select(
                "bucket", "node", "weight", F.coalesce("to", "label").alias("label"),
                (F.col("open") & (F.col("node") != F.col("p.node"))).alias("open"),
            )
        ), left[3])
        release(spark)
    if known is None:
        known = spark.createDataFrame([], "a binary, b binary, similarity double")
    return rows.select("k_id", "k_text", "node"), known.filter(F.col("similarity") >= similar)


def near_copy_classes(
    docs: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: (k_id, k_text, class_id, first), a class being all that links connect.

    ``class_id`` is the smallest id of the class, ``first`` whether the row is the document that stays: the smallest
    (id, hash of the text) of its class; null ids come last, and a class of null ids has the class id null. Texts
    with the same words are alike, so texts without any word (null, empty, marks only) are one class. Repeated rows
    have the same class and are all first if one is.
    """
    rows, links = near_copies(docs, similar, doc_id, text)
    found = components(links).withColumnRenamed("component", "class")
    # Nodes without a link are classes of their own.
    placed = rows.join(found, "node", "left").select("k_id", "k_text", F.coalesce("class", "node").alias("class"))
    placed = pin(placed)
    order = F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "k_text")
    heads = placed.groupBy("class").agg(F.min(order).alias("head"))
    named = placed.join(heads, "class")
    first = F.col("k_id").eqNullSafe(F.col("head.k_id")) & (F.col("k_text") == F.col("head.k_text"))
    return named.select("k_id", "k_text", F.col("head.k_id").alias("class_id"), first.alias("first"))


def drop_near_copies(
    docs: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents of which each class of near copies keeps one; repeated rows of it are dropped too."""
    kept = near_copy_classes(docs, similar, doc_id, text).filter("first").select("k_id", "k_text").distinct()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(doc_id, text))
    kept = kept.select(F.col("k_id").alias("o_id"), F.col("k_text").alias("o_text"))
    same = F.col("k_id").eqNullSafe(F.col("o_id")) & (F.col("k_text") == F.col("o_text"))
    stays = keyed.join(kept, same, "left_semi")
    # Rows that agree in id and text but not in other columns: the least of them stays.
    repeated = stays.groupBy("k_id", "k_text").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        stays = stays.groupBy("k_id", "k_text").agg(F.min("row").alias("row"))
    return stays.select("row.*")
