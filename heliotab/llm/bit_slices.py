"""Operator 11: exact top-k search over a bit-sliced index.

A block of rows keeps each attribute (component) as bit slices: bitmap b of an attribute holds bit b of its quantised
value for all rows. A query adds the slices up, each as often as its weight says, with bitmap arithmetic: three bitmaps
of one place make one of that place and one of the next, until one is left. Negative weights take the complement of a
slice. The k rows with the largest sums are read off the slices of the sum from the most significant one downward. What
the quantising left out bounds a score from above, so the rows that may still belong to the k best are those whose sum
reaches a bound, again found from the most significant slice downward; these are scored on the whole numbers.

The index is written once, in blocks of bounded size that are dealt evenly whatever the rows hold. Queries are sent to
each part of the index and pass its blocks one after another with their best rows so far, so a part gives at most k
rows a query. Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotab.llm.whole_vectors import finite, floors, numbers
from heliotab.session import pin

BLOCK = 16_384  # rows
PART, LEAST_PART = 131_072, 2_048  # rows of a part of the index, at most and (for the sake of few cores) at least
SLICES = 8  # bits kept of an attribute
_INDEX = "part int, width int, ids binary, known binary, planes binary, rest binary"
_MET = f"{_INDEX}, query_id bigint, weights array<bigint>"


class Block:
    """Rows of the index: ``planes`` has the slices of all attributes and, behind them, their complements."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, values: np.ndarray, slices: int = SLICES):
        self.ids, self.known, self.values = ids, known, values
        n, width = values.shape
        self.low = values.min(axis=0)
        span = int((values - self.low).max()) if width else 0
        self.shift = max(0, span.bit_length() - slices)
        kept = (values - self.low) >> self.shift
        self.bits = int(kept.max()).bit_length() if width else 0
        words = -(-n // 64)
        flags = np.zeros((width, self.bits, words * 64), dtype=np.uint8)
        for b in range(self.bits):
            flags[:, b, :n] = ((kept >> b) & 1).T
        self._hold(np.packbits(flags, axis=-1, bitorder="little").view(np.uint64).reshape(width * self.bits, words))

    def _hold(self, planes: np.ndarray) -> None:
        n = len(self.ids)
        self.planes = np.concatenate([planes, ~planes])
        self.every = np.full(-(-n // 64), np.iinfo(np.uint64).max, dtype=np.uint64)
        if n % 64:
            self.every[-1] = (1 << n % 64) - 1

    def dumps(self) -> dict[str, bytes]:
        return {
            "ids": self.ids.tobytes(),
            "known": self.known.tobytes(),
            "planes": self.planes[: len(self.planes) // 2].tobytes(),
            "rest": self.values.astype(np.int32).tobytes(),
        }

    @classmethod
    def loads(cls, width: int, ids: bytes, known: bytes, planes: bytes, rest: bytes) -> Block:
        self = cls.__new__(cls)
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.known = np.frombuffer(known, dtype=bool)
        self.values = np.frombuffer(rest, dtype=np.int32).astype(np.int64).reshape(len(self.ids), width)
        self.low = self.values.min(axis=0)
        planes = np.frombuffer(planes, dtype=np.uint64).reshape(-1, -(-len(self.ids) // 64))
        self.bits = len(planes) // width if width else 0
        span = int((self.values - self.low).max()) if width else 0
        self.shift = max(0, span.bit_length() - self.bits)
        self._hold(planes)
        return self

    def add(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum, least first: of each attribute times the size of its weight, the complement's if that is
        negative."""
        size = np.abs(weights)
        top = int(size.max()).bit_length() if len(size) else 0
        start = np.arange(len(weights)) * self.bits + np.where(weights < 0, len(self.planes) // 2, 0)
        out, carried, place = [], [], 0
        bit = np.arange(self.bits)
        while place < top + self.bits - 1 or carried:
            behind = place - bit
            hit = ((size[:, None] >> np.clip(behind, 0, 62)) & 1 == 1) & (behind >= 0)
            attribute, b = np.nonzero(hit)
            pile = np.concatenate([self.planes[start[attribute] + b], *carried])
            carried = []
            while len(pile) > 2:
                m = len(pile) // 3
                x, y, z = pile[:m], pile[m : 2 * m], pile[2 * m : 3 * m]
                half = x ^ y
                carried.append((x & y) | (half & z))
                pile = np.concatenate([half ^ z, pile[3 * m :]])
            if len(pile) == 2:
                carried.append(pile[:1] & pile[1:])
                pile = pile[:1] ^ pile[1:]
            out.append(pile[0] if len(pile) else np.zeros_like(self.every))
            place += 1
        return out

    def bounds(self, weights: np.ndarray) -> tuple[int, int, int]:
        """(a, b, c): a row whose slices sum up to s scores (s - a) * 2**shift + b at least, and c more at most."""
        complemented = int(-weights[weights < 0].sum()) * ((1 << self.bits) - 1)
        spare = (1 << self.shift) - 1
        least = int(weights @ self.low) + int(weights[weights < 0].sum()) * spare
        return complemented, least, int(np.abs(weights).sum()) * spare


def largest(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the k rows of ``among`` with the largest sums and of all that tie with the last; all, if fewer."""
    sure, open_ = np.zeros_like(among), among
    for s in reversed(slices):
        tried = sure | (open_ & s)
        n = int(np.bitwise_count(tried).sum())
        if n >= k:
            open_ = open_ & s
        else:
            sure, open_ = tried, open_ & ~s
    return sure | open_


def reaching(slices: list[np.ndarray], among: np.ndarray, bound: int) -> np.ndarray:
    """Bitmap of the rows of ``among`` whose sum is ``bound`` or more."""
    if bound <= 0:
        return among
    if bound >> len(slices):
        return np.zeros_like(among)
    above, equal = np.zeros_like(among), among
    for place in reversed(range(len(slices))):
        s = slices[place]
        if bound >> place & 1:
            equal = equal & s
        else:
            above, equal = above | (equal & s), equal & ~s
    return above | equal


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Best:
    """The k best rows of a query so far: larger score first, then smaller id, an unknown id last."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.ids = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def take(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = (np.concatenate(p) for p in ((self.score, score), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.ids, self.known = score[order], ids[order], known[order]

    def pass_block(self, block: Block, query_id: int, weights: np.ndarray) -> None:
        among = block.every
        own = np.flatnonzero((block.ids == query_id) & block.known)
        if len(own):
            among = among.copy()
            np.bitwise_and.at(among, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        slices = block.add(weights)
        done = np.zeros_like(among)
        if len(self.score) < self.k:
            done = largest(slices, among, self.k)
            self._score(block, weights, done)
        if len(self.score) == self.k:
            a, least, spare = block.bounds(weights)
            bound = -((least + spare - int(self.score[-1])) >> block.shift) + a
            self._score(block, weights, reaching(slices, among, bound) & ~done)

    def _score(self, block: Block, weights: np.ndarray, bitmap: np.ndarray) -> None:
        rows = _rows(bitmap)
        if len(rows):
            self.take(block.values[rows] @ weights, block.ids[rows], block.known[rows])


def _index(scale: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of this task's rows, apart for each length of the vectors; at most four blocks' rows wait."""
        part = TaskContext.get().partitionId()
        waiting: dict[int, list] = {}

        def block(width: int) -> pa.RecordBatch:
            ids, known, values = (np.concatenate(p) for p in zip(*waiting.pop(width)))
            fields = Block(ids, known, values).dumps()
            columns = [pa.array([part], pa.int32()), pa.array([width], pa.int32())]
            columns += [pa.array([fields[n]], pa.binary()) for n in ("ids", "known", "planes", "rest")]
            return pa.RecordBatch.from_arrays(columns, ["part", "width", "ids", "known", "planes", "rest"])

        held = lambda width: sum(len(ids) for ids, _, _ in waiting[width])
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                lengths = np.asarray(piece.column(1).value_lengths())
                for width in np.unique(lengths).tolist():
                    some = piece.take(pa.array(np.flatnonzero(lengths == width)))
                    ids, known = numbers(some.column(0))
                    if width in waiting and held(width) + len(ids) > BLOCK:
                        yield block(width)
                    waiting.setdefault(width, []).append((ids, known, floors(some.column(1), width, scale)))
                while sum(map(held, waiting)) > 4 * BLOCK:
                    yield block(max(waiting, key=held))
        for width in list(waiting):
            yield block(width)

    return build


def _answer(k: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query through the blocks of its part; these stand before the queries."""
        part, blocks = None, []
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                if get("part") != part:
                    part, blocks = get("part"), []
                if get("planes") is not None:
                    width = get("width")
                    blocks.append((width, Block.loads(width, get("ids"), get("known"), get("planes"), get("rest"))))
                    continue
                weights, best = np.array(get("weights"), dtype=np.int64), Best(k)
                for width, block in blocks:
                    if width == len(weights):
                        best.pass_block(block, get("query_id"), weights)
                found.append((np.full(len(best.ids), get("query_id")), best))
            if found:
                known = np.concatenate([b.known for _, b in found])
                columns = [
                    pa.array(np.concatenate([q for q, _ in found]), pa.int64()),
                    pa.array(np.concatenate([b.ids for _, b in found]), pa.int64(), mask=~known),
                    pa.array(np.concatenate([b.score for _, b in found]), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return answer


def top_scores(
    vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that ``queries`` selects the k other rows with the largest
    inner product of the floors of ``scale`` times the components; ties go to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part. A query meets the vectors of its own
    length. Rows with the query's id are its own. A query id that is repeated asks once, with its smallest vector; other
    repeated rows are candidates each, and so is a row with a null id (last among equals, never a query). With fewer
    candidates than k a query gets all of them; an empty table gives no rows. Extra columns don't matter. Components
    whose floors leave 26 bits are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks")
    ).filter(finite("v"))
    count = rows.count()
    parts = max(1, -(-count // PART), min(spark.sparkContext.defaultParallelism, -(-count // LEAST_PART)))
    index = pin(rows.select("vec_id", "v").repartition(parts).mapInArrow(_index(scale), _INDEX))
    asked = rows.filter("asks and vec_id is not null").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    weights = F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("weights")
    sent = asked.select("query_id", weights, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = index.unionByName(sent, allowMissingColumns=True).repartition(parts, "part")
    met = met.sortWithinPartitions("part", F.col("planes").isNull(), "query_id").select(*_columns(_MET))
    found = met.mapInArrow(_answer(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _columns(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]
