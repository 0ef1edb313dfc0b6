"""Operator 5: approximate nearest neighbours by an adaptive scan of dimensions.

Vectors of length 1 are rotated at random and held in blocks of columns. A query probes the lists of the nearest
centroids. Within a list the distance over the first blocks, scaled up, is tested against the best distances so far: a
random rotation spreads a distance evenly over the dimensions, so a candidate whose partial distance is far too large
is given up before the other blocks are read. What is left is measured exactly on the original vectors.

Centroids and the part of the lists that is probed come from a bounded sample; every row stands in its list. A list of
any size is cut into chunks, and so are the queries that probe it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotab.llm.common import list_array
from heliotab.session import pin

SAMPLE = 20_000  # vectors that centroids and probes are fitted on, at most
MOST_LISTS = 1_024
RECALL = 0.97  # wanted of the probed lists, on the sample
BLOCK = 16  # columns
SLACK = 2.5  # of the test; larger: fewer candidates are given up wrongly
CHUNK, QUERY_CHUNK = 8_192, 256  # rows and queries that meet in one group, at most about


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null, not all zero, all components finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


@dataclass
class Index:
    width: int
    rotation: np.ndarray
    centroids: np.ndarray
    probed: int  # lists a query probes at least

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(unit(x) @ self.centroids.T, axis=1)


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 5) -> Index:
    """Rotation, centroids by spherical k-means, and how many lists reach RECALL on the sample's own neighbours."""
    rng = np.random.default_rng(seed)
    x, width = unit(sample), sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
    lists = int(min(MOST_LISTS, len(x), max(1, np.sqrt(rows) / 4)))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        owner = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-12), centroids)
    owner = np.argmax(x @ centroids.T, axis=1)
    asked = rng.choice(len(x), min(len(x), 256), replace=False)
    alike = x[asked] @ x.T
    alike[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-alike, axis=1)[:, : min(k, len(x) - 1)]
    # Place of each neighbour's list among the query's lists.
    place = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1), axis=1)
    needed = np.take_along_axis(place, owner[near], axis=1).ravel()
    probed = int(np.ceil(np.quantile(needed, RECALL))) + 1 if needed.size else lists
    return Index(width, rotation, centroids, min(lists, probed))


def scan(index: Index, vectors: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int):
    """The k nearest of ``vectors`` for each query by the adaptive scan: (query number, vector number, score)."""
    width = index.width
    x, q = unit(vectors) @ index.rotation, unit(asked) @ index.rotation
    blocks = [slice(a, min(width, a + BLOCK)) for a in range(0, width, BLOCK)]
    columns = [np.ascontiguousarray(x[:, b]) for b in blocks]
    norm_x = np.linalg.norm(vectors / np.abs(vectors).max(axis=1, keepdims=True), axis=1)
    out_q, out_x, out_s = [], [], []
    first = columns[0]
    partial = (first**2).sum(axis=1) + (q[:, blocks[0]] ** 2).sum(axis=1)[:, None] - 2 * q[:, blocks[0]] @ first.T
    scaled_x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    for n in range(len(q)):
        dist = partial[n]
        others = np.flatnonzero(ids != own[n])
        if not len(others):
            continue
        if len(others) > 8 * k:
            # The bound: the k-th best of those that look nearest in the first block.
            look = others[np.argpartition(dist[others], 8 * k - 1)[: 8 * k]]
            bound = np.partition(((x[look] - q[n]) ** 2).sum(axis=1), k - 1)[k - 1]
            alive, d = others, dist[others]
            for b, block in enumerate(blocks):
                if b:
                    d = d + ((columns[b][alive] - q[n, block]) ** 2).sum(axis=1)
                seen = block.stop
                test = bound * (1 + SLACK / np.sqrt(seen)) ** 2 if seen < width else bound * (1 + 1e-9)
                keep = d * (width / seen) <= test + 1e-12
                alive, d = alive[keep], d[keep]
        else:
            alive = others
        ask = asked[n] / np.abs(asked[n]).max()
        # Row by row in one order of summation, so that equal vectors score alike wherever they stand.
        score = (scaled_x[alive] * ask).sum(axis=1) / (norm_x[alive] * np.linalg.norm(ask))
        best = np.lexsort((ids[alive], -score))[:k]
        out_q.append(np.full(len(best), n))
        out_x.append(alive[best])
        out_s.append(score[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that ``queries`` selects its k nearest other rows by cosine.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id or
    with another length than most rows have (the shorter length on a tie), as a cosine needs equal lengths. Rows with the query's id are the query's
    own. A query id that is repeated asks once, with its smallest vector; other repeated rows are candidates each. With
    fewer candidates than k a query gets all of them. Extra columns don't matter.
    """
    schema = ["query_id bigint", "rank int", "vec_id bigint", "score double"]
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("embedding"), queries.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable())
    widths = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
    main = widths.orderBy(F.desc("n"), "width").first()
    if main is None:
        return vectors.sparkSession.createDataFrame([], ", ".join(schema))
    width, count = main["width"], main["n"]
    rows = rows.filter(F.size("embedding") == width).withColumn("embedding", F.col("embedding").cast("array<double>"))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    index = fit(_matrix(drawn["embedding"].combine_chunks(), width), count, k)
    sent = vectors.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = sent.value.nearest(_matrix(batch.column(1), width)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.astype(np.int32)), *batch.columns], ["list", *batch.schema.names]
            )

    listed = pin(rows.mapInArrow(assign, "list int, vec_id bigint, embedding array<double>, asks boolean"))
    # At most MOST_LISTS rows come to the driver.
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for r in listed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(unit(_matrix(batch.column(1), width)) @ index.centroids.T), axis=1)
            # As many lists as were fitted, and more until they hold enough candidates.
            enough = np.argmax(np.cumsum(sizes[order], axis=1) >= min(sizes.sum(), 4 * k + 1), axis=1) + 1
            probed = np.maximum(enough, index.probed)
            flat = np.concatenate([o[:p] for o, p in zip(order, probed)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), list_array(flat.astype(np.int32), probed, pa.int32())],
                ["query_id", "asked", "lists"],
            )

    asked = listed.filter("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    probes = asked.mapInArrow(probe, "query_id bigint, asked array<double>, lists array<int>")
    probes = pin(probes.select("query_id", "asked", F.explode("lists").alias("list")))
    wanted = np.zeros(len(sizes), dtype=np.int64)
    for r in probes.groupBy("list").count().collect():
        wanted[r["list"]] = r["count"]
    parts = np.stack([-(-sizes // CHUNK), -(-wanted // QUERY_CHUNK)], axis=1).clip(1)
    cut = F.array(*[F.struct(F.lit(int(a)).alias("rows"), F.lit(int(b)).alias("queries")) for a, b in parts])
    cuts = F.element_at(cut, F.col("list") + 1)

    def spread(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
        """Each row to one chunk of its own side and to all chunks of the other side."""
        mine = F.pmod(F.xxhash64(key), cuts[own]).cast("int").alias(own)
        return df.select("*", mine, cuts[other].alias("n")).select(
            "*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(other)
        )

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        ids, own = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        x, asks = np.stack(left["embedding"].to_numpy()), np.stack(right["asked"].to_numpy())
        q, v, score = scan(sent.value, x, ids, asks, own, k)
        return pd.DataFrame({"query_id": own[q], "vec_id": ids[v], "score": score})

    by = ["list", "rows", "queries"]
    rows_side = spread(listed.select("list", "vec_id", "embedding"), "rows", "queries", "vec_id")
    asks_side = spread(probes, "queries", "rows", "query_id")
    found = (
        rows_side.select(*by, "vec_id", "embedding").groupBy(*by)
        .cogroup(asks_side.select(*by, "query_id", "asked").groupBy(*by))
        .applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
