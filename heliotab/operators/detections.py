"""Filters, overlap joins, suppression and top-k over detections."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotab.session import pin

SCORE_THRESHOLD = 0.6
NMS_IOU = 0.5
MAX_DETECTIONS = 100
GROUP_LIMIT = 1_000_000  # boxes of a group that one task goes through; it holds those that are kept
LATE_BOXES, BLOCK_BOXES, BOX_PAIRS = 1024, 256, 1_000_000
PAIR_LIMIT = 20_000_000
_BOX = ("x1", "y1", "x2", "y2")


def score_filter(df: DataFrame, threshold: float = SCORE_THRESHOLD, score: str = "score") -> DataFrame:
    """Drop scores below the threshold; what is not a number stays."""
    number = F.col(score).try_cast("double")
    return df.filter((number >= F.lit(float(threshold))) | number.isNull())


def iou(a: str = "", b: str = "g_") -> Column:
    """Intersection over union of two boxes, columns prefixed ``a`` and ``b``; null where both are empty."""
    side = lambda lo, hi: F.greatest(
        F.lit(0.0), F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo))
    )
    inter = side("x1", "x2") * side("y1", "y2")
    area = lambda p: (F.col(p + "x2") - F.col(p + "x1")) * (F.col(p + "y2") - F.col(p + "y1"))
    return F.try_divide(inter, area(a) + area(b) - inter)


# ------------------------------------------------------------------------------------------------- box grid
#
# Boxes whose IoU reaches t differ in their longest side by less than a factor 1/t and in x1 and y1 by at most
# (1-t)/t of the shorter side. A grid per size level, with cells of that width, therefore holds all partners of a box
# in the 3x3 cells around it, on a few levels.


def _level() -> Column:
    return F.floor(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).cast("int")


def _cell(level: Column, min_iou: float) -> Column:
    return F.lit((1 - min_iou) / min_iou) * F.pow(F.lit(2.0), level + 1)


def _home(min_iou: float) -> dict[str, Column]:
    level = _level()
    width = _cell(level, min_iou)
    return {
        "__lv": level,
        "__cx": F.floor(F.col("x1") / width).cast("bigint"),
        "__cy": F.floor(F.col("y1") / width).cast("bigint"),
    }


def _around(df: DataFrame, min_iou: float) -> DataFrame:
    """Each box once per cell around it (columns __lv, __cx, __cy), on all levels a partner can have."""
    reach = math.ceil(math.log2(1 / min_iou))
    offsets = [(dl, dx, dy) for dl in range(-reach, reach + 1) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    steps = F.from_json(F.lit(json.dumps([dict(zip("lxy", o)) for o in offsets])), "array<struct<l:int,x:int,y:int>>")
    spread = df.withColumn("__o", F.explode(steps)).withColumn("__lv", (_level() + F.col("__o.l")).cast("int"))
    width = _cell(F.col("__lv"), min_iou)
    place = lambda side, step: F.floor(F.col(side) / width).cast("bigint") + F.col(f"__o.{step}")
    return spread.withColumns({"__cx": place("x1", "x"), "__cy": place("y1", "y")}).drop("__o")


def iou_join(
    dets: DataFrame,
    gts: DataFrame,
    min_iou: float = 0.5,
    keys: Sequence[str] = ("image_id", "class"),
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Detections with the ground-truth boxes of their image and class that overlap them by at least ``min_iou``.

    Ground-truth columns other than the keys get the prefix ``g_``. Ordinary images are compared directly. Images with
    more than ``pair_limit`` comparisons go through the box grid, which leads to the same pairs.
    """
    if not 0 < min_iou < 1:
        raise ValueError("min_iou must lie between 0 and 1")
    keys = list(keys)
    named = gts.select(*keys, *[F.col(c).alias(f"g_{c}") for c in gts.columns if c not in keys])
    overlap = (
        (F.col("x1") < F.col("g_x2"))
        & (F.col("g_x1") < F.col("x2"))
        & (F.col("y1") < F.col("g_y2"))
        & (F.col("g_y1") < F.col("y2"))
    )

    def compared(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(right, on).filter(overlap).withColumn("iou", iou()).filter(F.col("iou") >= min_iou)

    sizes = (
        dets.groupBy(keys).agg(F.count("*").alias("d")).join(gts.groupBy(keys).agg(F.count("*").alias("g")), keys)
    )
    hot = pin(sizes.filter(F.col("d") * F.col("g") > pair_limit).select(*keys))
    if hot.isEmpty():
        return compared(dets, named, keys)
    usual = compared(dets.join(hot, keys, "left_anti"), named.join(hot, keys, "left_anti"), keys)
    solid = "x2 > x1 AND y2 > y1"
    spread = _around(dets.join(hot, keys, "left_semi").filter(solid), min_iou)
    home = gts.join(hot, keys, "left_semi").filter(solid).withColumns(_home(min_iou))
    home = home.select(*keys, "__lv", "__cx", "__cy", *[F.col(c).alias(f"g_{c}") for c in gts.columns if c not in keys])
    crowded = compared(spread, home, [*keys, "__lv", "__cx", "__cy"]).drop("__lv", "__cx", "__cy")
    return usual.unionByName(crowded)


# ---------------------------------------------------------------------------------------------- suppression


def _greedy(boxes: np.ndarray, min_iou: float) -> np.ndarray:
    """Positions kept when boxes, best first, suppress those that overlap them by more than ``min_iou``."""
    x1, y1, x2, y2 = boxes.T
    area = (x2 - x1) * (y2 - y1)
    alive = np.ones(len(boxes), dtype=bool)
    kept = []
    for i in range(len(boxes)):
        if not alive[i]:
            continue
        kept.append(i)
        w = np.maximum(0.0, np.minimum(x2[i], x2[i + 1 :]) - np.maximum(x1[i], x1[i + 1 :]))
        h = np.maximum(0.0, np.minimum(y2[i], y2[i + 1 :]) - np.maximum(y1[i], y1[i + 1 :]))
        inter = w * h
        union = area[i] + area[i + 1 :] - inter
        alive[i + 1 :] &= ~(inter > min_iou * union)
    return np.array(kept, dtype=int)


class _Kept:
    """Boxes of one group that were kept so far, found again by the cells of the box grid.

    Boxes kept of late are compared as they are; the others are sorted by a hash of their cell, and a box meets those of
    the cells around it. Equal hashes of different cells only add comparisons.
    """

    def __init__(self, min_iou: float):
        self.min_iou = min_iou
        self.late = self.sorted = np.empty((0, 4))
        self.cells = np.empty(0, dtype=np.int64)
        reach = math.ceil(math.log2(1 / min_iou)) if 0 < min_iou < 1 else 0
        self.around = [(dl, dx, dy) for dl in range(-reach, reach + 1) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]

    def _cell(self, boxes: np.ndarray, level: np.ndarray, dx: int, dy: int) -> np.ndarray:
        width = (1 - self.min_iou) / self.min_iou * np.exp2(level + 1)
        x, y = ((np.floor(boxes[:, i] / width)).astype(np.int64) + d for i, d in ((0, dx), (1, dy)))
        with np.errstate(over="ignore"):
            return (level.astype(np.int64) * 1_000_003 + x) * 2_654_435_761 ^ y * 40_503_000_007

    @staticmethod
    def _level(boxes: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(np.maximum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])))

    def add(self, boxes: np.ndarray) -> None:
        self.late = np.concatenate([self.late, boxes])
        if 0 < self.min_iou < 1 and len(self.late) > max(LATE_BOXES, len(self.sorted) // 8):
            cells = np.concatenate([self.cells, self._cell(self.late, self._level(self.late), 0, 0)])
            order = np.argsort(cells, kind="stable")
            self.sorted, self.cells = np.concatenate([self.sorted, self.late])[order], cells[order]
            self.late = np.empty((0, 4))

    def suppress(self, boxes: np.ndarray) -> np.ndarray:
        """Which boxes overlap a kept one by more than the limit."""
        gone = np.zeros(len(boxes), dtype=bool)
        for start in range(0, len(self.late), LATE_BOXES):
            open_ = np.flatnonzero(~gone)
            late = self.late[start : start + LATE_BOXES]
            gone[open_] = _suppressed(boxes[open_, None], late[None], self.min_iou).any(axis=1)
        if not len(self.cells):
            return gone
        level = self._level(boxes)
        for dl, dx, dy in self.around:
            open_ = np.flatnonzero(~gone)
            cells = self._cell(boxes[open_], level[open_] + dl, dx, dy)
            first, last = (np.searchsorted(self.cells, cells, side=side) for side in ("left", "right"))
            n = last - first
            each = np.repeat(np.arange(len(open_)), n)
            others = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            for at in range(0, len(each), BOX_PAIRS):
                i, j = each[at : at + BOX_PAIRS], others[at : at + BOX_PAIRS]
                gone[open_[i[_suppressed(boxes[open_[i]], self.sorted[j], self.min_iou)]]] = True
        return gone


def _suppressed(boxes: np.ndarray, kept: np.ndarray, min_iou: float) -> np.ndarray:
    w = np.maximum(0.0, np.minimum(boxes[..., 2], kept[..., 2]) - np.maximum(boxes[..., 0], kept[..., 0]))
    h = np.maximum(0.0, np.minimum(boxes[..., 3], kept[..., 3]) - np.maximum(boxes[..., 1], kept[..., 1]))
    inter = w * h
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    return inter > min_iou * (area(kept) + area(boxes) - inter)


def _suppress(batches: Iterator[pa.RecordBatch], key: str, min_iou: float) -> Iterator[pa.RecordBatch]:
    """Rows of sorted groups, best first, that no better kept row of their group suppresses."""
    last, kept = None, _Kept(min_iou)
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(key).flatten()
        new = np.zeros(batch.num_rows, dtype=bool)
        for part in parts:
            before, after = part.slice(0, len(part) - 1), part.slice(1)
            differ = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
            if pa.types.is_floating(part.type):
                differ = differ & ~pc.fill_null(pc.and_(pc.is_nan(before), pc.is_nan(after)), False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (np.asarray(before.is_null()) != np.asarray(after.is_null()))
        first = [repr(part[0].as_py()) for part in parts]
        new[0] = first != last
        last = [repr(part[-1].as_py()) for part in parts]
        number = lambda c: pc.fill_null(batch.column(c).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        boxes = np.stack([number(c) for c in _BOX], axis=1)
        # A box without an end overlaps nothing by a share of its area.
        finite = np.isfinite(boxes).all(axis=1)
        stays = np.ones(len(boxes), dtype=bool)
        edges = [0, *np.flatnonzero(new[1:]) + 1, len(boxes)]
        for start, stop in zip(edges, edges[1:]):
            if new[start]:
                kept = _Kept(min_iou)
            for block in range(start, stop, BLOCK_BOXES):
                rows = block + np.flatnonzero(finite[block : min(stop, block + BLOCK_BOXES)])
                stays[rows] = False
                rows = rows[~kept.suppress(boxes[rows])]
                rows = rows[_greedy(boxes[rows], min_iou)]
                kept.add(boxes[rows])
                stays[rows] = True
        yield batch.filter(pa.array(stays))


def _nms_groups(dets: DataFrame, min_iou: float, keys: list[str], order: list[str]) -> DataFrame:
    """Suppression group by group over sorted rows; what is held of a group are the boxes it keeps."""
    (key,) = keys
    place = [(-F.col(order[0])).asc(), *[F.col(c).asc() for c in order[1:]], *[F.col(c).asc() for c in dets.columns]]
    ordered = dets.repartition(key).sortWithinPartitions(F.col(key), *place)
    limit = float(min_iou)
    return ordered.mapInArrow(lambda batches: _suppress(batches, key, limit), dets.schema)


def _nms_rounds(dets: DataFrame, min_iou: float, keys: list[str], order: list[str], group_limit: int) -> DataFrame:
    """Suppression of very large groups, in rounds over the box grid.

    Each round takes the best box of every cell. Where no neighbouring cell has a better one it is kept, and the boxes
    around it that overlap it go. The best box left is always kept, so the rounds end; the result is that of the greedy
    order. What is left is finished group by group as soon as no group is large any more. A cell meets a bounded number of kept boxes per round, never all pairs of its boxes.
    """
    cell = ["__lv", "__cx", "__cy"]
    place = F.struct((-F.col(order[0])).alias("s"), *[F.col(c) for c in order[1:]])
    columns = dets.columns
    # Exact copies overlap fully: only the best one can stay.
    row = F.struct(*columns)
    single = dets.groupBy(*keys, *_BOX).agg(F.min_by(row, place).alias("r")).select("r.*")
    alive = pin(single.withColumns(_home(min_iou)).withColumn("__place", place))
    kept_parts = []
    while not alive.groupBy(*keys).count().filter(F.col("count") > group_limit).isEmpty():
        whole = F.struct(*alive.columns)
        champions = pin(alive.groupBy(*keys, *cell).agg(F.min_by(whole, "__place").alias("r")).select("r.*"))
        around = _around(champions.select(*keys, *_BOX, "__place"), min_iou)
        others = champions.select(*keys, *cell, F.col("__place").alias("__other"))
        beaten = (
            around.join(others, [*keys, *cell])
            .filter(F.col("__other") < F.col("__place"))
            .select(*keys, "__place")
            .distinct()
        )
        winners = pin(champions.join(beaten, [*keys, "__place"], "left_anti").select(*alive.columns))
        kept_parts.append(winners.select(*columns))
        reach = (
            _around(winners.select(*keys, *_BOX), min_iou)
            .select(*keys, *cell, F.struct(*_BOX).alias("__box"))
            .groupBy(*keys, *cell)
            .agg(F.collect_list("__box").alias("__kept"))
        )
        near = alive.join(reach, [*keys, *cell], "left")
        alive = pin(near.filter(~F.coalesce(F.exists("__kept", lambda b: _overlaps(b, min_iou)), F.lit(False))).drop("__kept"))
    result = _nms_groups(alive.select(*columns), min_iou, keys, order)
    for part in kept_parts:
        result = result.unionByName(part)
    return result


def _overlaps(box: Column, min_iou: float) -> Column:
    side = lambda lo, hi: F.greatest(
        F.lit(0.0), F.least(F.col(hi), box[hi]) - F.greatest(F.col(lo), box[lo])
    )
    inter = side("x1", "x2") * side("y1", "y2")
    own = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    other = (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])
    return inter > F.lit(min_iou) * (own + other - inter)


def nms(
    dets: DataFrame,
    min_iou: float = NMS_IOU,
    keys: Sequence[str] = ("image_id", "class"),
    order: Sequence[str] = ("score", "det_idx"),
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Class-wise non-maximum suppression per image.

    ``order`` is the score (best is highest) and the columns that break ties (lowest first). Groups of up to
    ``group_limit`` boxes go through one task in order; larger ones in distributed rounds with the same result. A box
    without a positive area, or with a null side, neither suppresses nor is suppressed. Rows whose keys are null are a
    group like any other.
    """
    # A struct of nulls equals another, so null keys are joined and split as other keys are.
    keyed = dets.withColumn("__keys", F.struct(*keys))
    keys, order = ["__keys"], list(order)
    solid = F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    boxes = keyed.filter(solid)
    hot = pin(boxes.groupBy(*keys).count().filter(F.col("count") > group_limit).select(*keys))
    if hot.isEmpty():
        kept = _nms_groups(boxes, min_iou, keys, order)
    else:
        usual = _nms_groups(boxes.join(hot, keys, "left_anti").select(*keyed.columns), min_iou, keys, order)
        crowded = boxes.join(hot, keys, "left_semi").select(*keyed.columns)
        kept = usual.unionByName(_nms_rounds(crowded, min_iou, keys, order, group_limit))
    return kept.unionByName(keyed.filter(~solid)).drop("__keys")


def topk_per_image(
    dets: DataFrame,
    k: int = MAX_DETECTIONS,
    keys: Sequence[str] = ("image_id",),
    order: Sequence[str] = ("score", "det_idx"),
    rank: str | None = None,
) -> DataFrame:
    """Best k detections per image, with their rank if that is given a name. Spark cuts each partition to k rows per
    image before the shuffle."""
    best_first = Window.partitionBy(*keys).orderBy(F.col(order[0]).desc(), *[F.col(c) for c in order[1:]])
    ranked = dets.withColumn(rank or "__rank", F.row_number().over(best_first)).filter(F.col(rank or "__rank") <= k)
    return ranked if rank else ranked.drop("__rank")
