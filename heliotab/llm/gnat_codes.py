"""Operator 12: vector codes whose codebook entries are searched by a geometric near-neighbour access tree (GNAT).

Vectors of whole numbers are cut into equal parts; each position has a codebook, fitted by rounds of assignment and
exact means. The nearest entry of a part is found in a tree over the entries: a node has split points, each of which
owns the points nearest to it, and keeps for every pair of split points the range of the distances from the one to
the points of the other. With the distance to a split point and the best one so far, the triangle inequality rules out
whole subtrees. A subtree goes only if all it holds is strictly farther, with distances rounded against that, so that
no entry that ties is lost; nearest and ties are settled on whole-number squared distances.

Tasks add their parts up per entry before the shuffle; only these sums, as many as the codebooks have components, reach
the driver, and only codebooks are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.llm.whole_vectors import exact_sums, finite, floors, numbers
from heliotab.session import pin

DEGREE = 4  # split points of a node; so many points or fewer are a leaf
MARGIN = 2.0**-49  # by which a rounded distance may be off, relative to it; far more than its rounding


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances, in whole numbers."""
    apart = x - point
    return np.einsum("ij,ij->i", apart, apart)


def below(squared: np.ndarray) -> np.ndarray:
    """At most the distance."""
    return np.sqrt(np.asarray(squared, np.float64)) * (1 - MARGIN)


def above(squared: np.ndarray) -> np.ndarray:
    """At least the distance."""
    return np.sqrt(np.asarray(squared, np.float64)) * (1 + MARGIN)


@dataclass
class Node:
    """Split points and, for each, the other points it owns; ``near[i, j]`` and ``far[i, j]`` bound the distances from
    split point i to split point j and the points that it owns."""

    splits: list[int]
    children: list[Node | None]
    near: np.ndarray
    far: np.ndarray


def grow(entries: np.ndarray, points: list[int], degree: int = DEGREE) -> Node | None:
    """Tree over some entries. Split points are taken far from each other, from the lowest number on."""
    if not points:
        return None
    apart = {p: distances(entries[points], entries[p]) for p in points}
    splits = [points[0]]
    while len(splits) < min(degree, len(points)):
        gap = np.min([apart[s] for s in splits], axis=0)
        gap[[points.index(s) for s in splits]] = -1
        splits.append(points[int(np.argmax(gap))])
    owner = np.argmin([apart[s] for s in splits], axis=0)
    owned = [[p for p, o in zip(points, owner) if o == j and p not in splits] for j in range(len(splits))]
    groups = [[points.index(p) for p in [s, *rest]] for s, rest in zip(splits, owned)]
    near = np.array([[below(apart[s][g].min()) for g in groups] for s in splits])
    far = np.array([[above(apart[s][g].max()) for g in groups] for s in splits])
    return Node(splits, [grow(entries, rest, degree) for rest in owned], near, far)


class Codebook:
    """Entries of one position (whole numbers, a row each) and their tree."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries = np.asarray(entries, dtype=np.int64)
        self.tree = grow(self.entries, list(range(len(entries))), degree)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each row (the lowest of those that tie), its squared distance, and distances measured."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        code = np.zeros(len(x), dtype=np.int64)
        measured = self._search(self.tree, x, np.arange(len(x)), best, code)
        return code, best, measured

    def _search(self, node: Node | None, x: np.ndarray, rows: np.ndarray, best: np.ndarray, code: np.ndarray) -> int:
        if node is None or not len(rows):
            return 0
        open_ = np.ones((len(rows), len(node.splits)), dtype=bool)
        measured = 0
        for i, split in enumerate(node.splits):
            asked = np.flatnonzero(open_[:, i])
            at = rows[asked]
            squared = distances(x[at], self.entries[split])
            measured += len(at)
            better = (squared < best[at]) | ((squared == best[at]) & (split < code[at]))
            best[at[better]], code[at[better]] = squared[better], split
            reach = above(best[at])[:, None]
            least = np.maximum(below(squared)[:, None] - node.far[i], node.near[i] - above(squared)[:, None])
            open_[asked] &= ~(least * (1 - MARGIN) > reach)
        for j, child in enumerate(node.children):
            measured += self._search(child, x, rows[open_[:, j]], best, code)
        return measured


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _round(rows: DataFrame, books: list[Codebook], width: int, scale: int) -> list[np.ndarray]:
    """Entries after one round: the floor of the mean of the parts that each is nearest to; unused ones stay."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        each = width // len(books)
        sums = np.zeros((len(books), len(books[0].entries), each), dtype=np.int64)
        n = np.zeros(sums.shape[:2], dtype=np.int64)
        for batch in batches:
            for p, part in enumerate(_parts(floors(batch.column(2), width, scale), len(books))):
                code = books[p].nearest(part)[0]
                np.add.at(sums[p], code, part)
                n[p] += np.bincount(code, minlength=n.shape[1])
        p, e, i = np.nonzero(np.broadcast_to(n[:, :, None], sums.shape))
        columns = [pa.array(c, pa.int32()) for c in (p, e, i)] + [pa.array(sums[p, e, i]), pa.array(n[p, e])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "total", "n"])

    added = rows.mapInArrow(add, "part int, entry int, place int, total bigint, n bigint")
    entries = [book.entries.copy() for book in books]
    for part, entry, place, total, n in exact_sums(added, "part", "entry", "place"):
        entries[part][entry, place] = total // n
    sent.unpersist()
    return entries


def vector_codes(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    degree: int = DEGREE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256): the nearest entry of each part as two hex digits, the
    squared distances to them, their sum over the rows with the same label, and a digest of all final entries.

    Vectors that are null or hold null or non-finite components are dropped. Codebooks are fitted on the vectors of
    the commonest length that ``parts`` divides (the shorter of two); vectors of other lengths stay with null code and
    error. Codebooks start as the parts of the smallest ids (each id once, with its smallest vector, a null id last);
    with fewer of these there are fewer entries. Repeated rows count and are returned each. Rows with a null label are
    summed together. Extra columns don't matter. An empty table gives no rows. Components whose floors leave 26 bits
    are an error, as are more entries than two hex digits name.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
    ).filter(finite("v"))
    lengths = rows.groupBy(F.size("v").alias("width")).count()
    main = lengths.filter((F.col("width") % parts == 0) & (F.col("width") > 0)).orderBy(F.desc("count"), "width").first()
    width = main["width"] if main else 0
    alike = rows.filter(F.size("v") == width) if width else rows.limit(0)
    # At most ``entries`` ids, so that only their vectors are grouped.
    ids = alike.select(F.col("vec_id").alias("id")).distinct().orderBy(F.asc_nulls_last("id")).limit(entries)
    first = alike.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("id")), "left_semi")
    first = first.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id"))
    start = floors(first.select("v").toArrow().column(0).combine_chunks(), width, scale)
    books = [Codebook(part, degree) for part in _parts(start, parts)] if width else []
    for _ in range(rounds if width else 0):
        books = [Codebook(e, degree) for e in _round(alike, books, width, scale)]
    sent = spark.sparkContext.broadcast(books)
    # Labels are grouped by their text and sent through the tasks as such.
    schema = "vec_id bigint, label string, code string, error bigint"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        digits = np.array([f"{e:02x}" for e in range(256)])
        for batch in batches:
            fits = np.flatnonzero((np.asarray(batch.column(2).value_lengths()) == width) & (width > 0))
            code, error = np.full(batch.num_rows, None, dtype=object), np.zeros(batch.num_rows, dtype=np.int64)
            if len(fits):
                text = np.full(len(fits), "", dtype="U" + str(2 * parts))
                for book, part in zip(books, _parts(floors(batch.column(2).take(pa.array(fits)), width, scale), parts)):
                    chosen, squared, _ = book.nearest(part)
                    text = np.char.add(text, digits[chosen])
                    error[fits] += squared
                code[fits] = text
            missing = np.ones(batch.num_rows, dtype=bool)
            missing[fits] = False
            ids, known = numbers(batch.column(0))
            columns = [pa.array(ids, mask=~known), batch.column(1), pa.array(code, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(error, mask=missing)], ["vec_id", "label", "code", "error"])

    coded = pin(rows.withColumn("label", F.col("label").cast("string")).mapInArrow(encode, schema))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    whole = ",".join(str(int(c)) for book in books for c in book.entries.ravel())
    digest = hashlib.sha256(whole.encode()).hexdigest()
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
