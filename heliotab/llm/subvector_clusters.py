"""Operator 13: clustering by centroids over dictionaries of subvectors.

Blocks of dimensions are dictionary-encoded without loss: each chunk of rows keeps the distinct subvectors of a block
once and a code per row. A round measures each distinct subvector's exact squared distance to the centroids once and
adds the partial distances up by code; the new centroids come from the entries, weighed by how many rows of a cluster
hold them. The encoded chunks are written once and read in each round; they carry all that the rounds need.

Chunks are bounded and dealt evenly whatever the rows hold. Only sums per centroid and dimension reach the driver, and
only centroids are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.llm.whole_vectors import exact_sums, finite, floors, numbers
from heliotab.session import pin

CHUNK, LEAST_CHUNK = 65_536, 2_048  # rows that share dictionaries, at most and (for the sake of few cores) at least
BLOCK = 2  # dimensions
_ENCODED = "ids binary, known binary, sizes array<int>, entries binary, codes binary"


class Chunk:
    """Rows as codes: ``entries[b]`` has the distinct subvectors of block b, ``codes[b]`` each row's place there."""

    def __init__(self, ids, known, entries, codes):
        self.ids, self.known, self.entries, self.codes = ids, known, entries, codes

    @classmethod
    def encode(cls, ids: np.ndarray, known: np.ndarray, values: np.ndarray, block: int = BLOCK) -> Chunk:
        entries, codes = [], []
        for start in range(0, values.shape[1], block):
            part = values[:, start : start + block]
            order = np.lexsort(part.T[::-1])
            ordered = part[order]
            new = np.ones(len(part), dtype=bool)
            new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
            code = np.empty(len(part), dtype=np.int32)
            code[order] = np.cumsum(new) - 1
            entries.append(ordered[new])
            codes.append(code)
        return cls(ids, known, entries, codes)

    def values(self) -> np.ndarray:
        """The rows back."""
        return np.concatenate([e[c] for e, c in zip(self.entries, self.codes)], axis=1)

    def dumps(self) -> dict:
        return {
            "ids": self.ids.tobytes(),
            "known": self.known.tobytes(),
            "sizes": [len(e) for e in self.entries],
            "entries": b"".join(e.astype(np.int32).tobytes() for e in self.entries),
            "codes": b"".join(c.astype(np.uint16).tobytes() for c in self.codes),
        }

    @classmethod
    def loads(cls, width: int, block: int, ids: bytes, known: bytes, sizes: list[int], entries: bytes, codes: bytes) -> Chunk:
        ids = np.frombuffer(ids, dtype=np.int64)
        spans = [min(block, width - start) for start in range(0, width, block)]
        flat = np.frombuffer(entries, dtype=np.int32).astype(np.int64)
        cuts = np.cumsum([n * s for n, s in zip(sizes, spans)])[:-1]
        parts = [e.reshape(-1, s) for e, s in zip(np.split(flat, cuts), spans)]
        places = np.frombuffer(codes, dtype=np.uint16).reshape(len(spans), len(ids)).astype(np.int64)
        return cls(ids, np.frombuffer(known, dtype=bool), parts, list(places))

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row (the smaller number of those that tie) and its squared distance."""
        total = np.zeros((len(self.ids), len(centroids)), dtype=np.int64)
        start = 0
        for entry, code in zip(self.entries, self.codes):
            apart = entry[:, None, :] - centroids[None, :, start : start + entry.shape[1]]
            total += (apart * apart).sum(axis=2)[code]
            start += entry.shape[1]
        owner = total.argmin(axis=1)
        return owner, total[np.arange(len(total)), owner]

    def sums(self, owner: np.ndarray, k: int) -> np.ndarray:
        """Sum of the rows of each of k clusters, from how often a cluster holds each entry."""
        out = []
        for entry, code in zip(self.entries, self.codes):
            held = np.bincount(owner * len(entry) + code, minlength=k * len(entry)).reshape(k, len(entry))
            out.append(held @ entry)
        return np.concatenate(out, axis=1)


def _encode(width: int, scale: int, most: int, block: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def chunk() -> pa.RecordBatch:
            fields = Chunk.encode(*(np.concatenate(p) for p in zip(*waiting)), block).dumps()
            waiting.clear()
            kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            columns = [pa.array([value], kind) for value, kind in zip(fields.values(), kinds)]
            return pa.RecordBatch.from_arrays(columns, list(fields))

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                piece = batch.slice(start, most)
                if waiting and sum(len(w[0]) for w in waiting) + piece.num_rows > most:
                    yield chunk()
                waiting.append((*numbers(piece.column(0)), floors(piece.column(1), width, scale)))
        if waiting:
            yield chunk()

    return encode


def _chunks(batches: Iterator[pa.RecordBatch], width: int, block: int) -> Iterator[Chunk]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Chunk.loads(width, block, *(batch.column(i)[row].as_py() for i in range(5)))


def _round(encoded: DataFrame, centroids: np.ndarray, block: int) -> np.ndarray:
    """Centroids after one round: the floor of the mean of each cluster; those of empty clusters stay."""
    sent = encoded.sparkSession.sparkContext.broadcast(centroids)
    k, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for chunk in _chunks(batches, width, block):
            owner, _ = chunk.nearest(sent.value)
            total += chunk.sums(owner, k)
            n += np.bincount(owner, minlength=k)
        c, d = np.nonzero(np.broadcast_to(n[:, None], total.shape))
        columns = [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total[c, d]), pa.array(n[c])]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "total", "n"])

    added = encoded.mapInArrow(add, "cluster int, place int, total bigint, n bigint")
    out = centroids.copy()
    for cluster, place, total, n in exact_sums(added, "cluster", "place"):
        out[cluster, place] = total // n
    sent.unpersist()
    return out


def subvector_clusters(
    vectors: DataFrame,
    clusters: int = 8,
    rounds: int = 10,
    width: int = 64,
    scale: int = 1024,
    block: int = BLOCK,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): the nearest centroid of each
    vector, its squared distance, that distance summed over the cluster and over all, and a digest of the centroid.

    Vectors that are null, have another length than ``width`` or hold null or non-finite components are dropped.
    Centroids start as the vectors with the smallest sha256 of ``3:<vec_id>``; a null id comes last, and rows with
    the same id are taken in the order of their components. With fewer vectors there are fewer centroids. Repeated
    rows count and are returned each. Extra columns don't matter. An empty table gives no rows. Components whose
    floors leave 26 bits are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter((F.size("v") == width) & finite("v"))
    hashed = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    start = rows.orderBy(F.asc_nulls_last(hashed), "v").limit(clusters).select("v").toArrow()
    centroids = floors(start.column(0).combine_chunks(), width, scale)
    count = rows.count()
    parts = max(1, -(-count // CHUNK), min(spark.sparkContext.defaultParallelism, -(-count // LEAST_CHUNK)))
    encoded = pin(rows.repartition(parts).mapInArrow(_encode(width, scale, CHUNK, block), _ENCODED))
    for _ in range(rounds if len(centroids) else 0):
        centroids = _round(encoded, centroids, block)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, width, block):
            owner, squared = chunk.nearest(sent.value)
            columns = [pa.array(chunk.ids, mask=~chunk.known), pa.array(owner, pa.int32()), pa.array(squared)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    assigned = encoded.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint")
    spent = {r["cluster"]: r["spent"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("spent")).collect()}
    if not spent:
        facts = "CAST(NULL AS bigint) cluster_inertia, CAST(NULL AS bigint) inertia, CAST(NULL AS string) centroid_sha256"
        return assigned.selectExpr("*", *[f.strip() for f in facts.split(", ")])
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return assigned.select(
        "*",
        of_cluster([spent.get(c, 0) for c in range(len(centroids))]).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(spent.values())).cast("bigint").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
