"""Detection quality by the public COCO protocol (boxes)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from heliotab.operators.detections import MAX_DETECTIONS, topk_per_image
from heliotab.operators.skew import SLICE
from heliotab.session import pin, release

# Fixed values of the protocol.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
RECALL_POINTS = 101
RECALL_STEP = 0.01
GT_BLOCK = 20_000  # boxes of an image and class that meet its detections in one group
GROUP_BUCKETS = 1 << 17  # groups are counted by buckets of their hash
SLICES_A_PARTITION, SAMPLES_A_SLICE, MOST_SAMPLES = 2, 8, 4096
MOST_PAIRS = 2_000_000  # compared at a time

_CURVES = [(t, a) for t in range(len(THRESHOLDS)) for a in AREAS]
_EPS = float(np.spacing(1))


# ------------------------------------------------------------------------------------------------------ matching
#
# A curve, that is a threshold and an area range, is a bit. The matching of all curves is done at once: what a box still
# is free for, and what a detection has met, are masks.

_ALL = (1 << len(_CURVES)) - 1
_BOX = ("x1", "y1", "x2", "y2")


def _reach(overlap: np.ndarray) -> np.ndarray:
    """Curves whose threshold an overlap reaches."""
    reached = np.searchsorted(np.array(THRESHOLDS) - 1e-10, overlap, side="right")
    return (np.int64(1) << (reached * len(AREAS))) - 1


def _inside(area: np.ndarray) -> np.ndarray:
    """Curves whose area range holds an area."""
    every = sum(1 << (t * len(AREAS)) for t in range(len(THRESHOLDS)))
    masks = [np.where((area >= low) & (area <= high), every << i, 0) for i, (low, high) in enumerate(AREAS.values())]
    return np.bitwise_or.reduce(np.array(masks, dtype=np.int64).reshape(len(masks), -1))


def _settle(dets: list[tuple[float, list[tuple]]]) -> list[tuple[int, int]]:
    """Greedy matching of one image and class: masks of the curves in which a detection, best first, is matched, and
    in which it is matched to a box outside the area range.

    A detection is its crowd share and the boxes near it, best first, each with overlap, key, reached curves and curves
    whose area range it is in.
    """
    taken: dict = {}
    out = []
    for crowd, near in dets:
        hit = skip = 0
        for _, gt, reached, inside in near:
            got = reached & inside & ~hit & ~taken.get(gt, 0)
            if got:
                taken[gt] = taken.get(gt, 0) | got
                hit |= got
        rest = _ALL & ~hit
        for overlap, gt, reached, inside in near:
            outer = rest & reached & ~inside & ~taken.get(gt, 0)
            rest &= ~outer
            # Among ignored boxes a crowd with the larger share is met instead, and leaves the others free.
            if outer and crowd < overlap:
                taken[gt] = taken.get(gt, 0) | outer
                skip |= outer
        out.append((hit, skip))
    return out


def _masks(settled: list[tuple[int, int]], share: np.ndarray, area: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks ``hits`` and ``ignored`` of detections: what is unmatched is ignored in a crowd or outside the area range."""
    hit, skip = (np.array([m[i] for m in settled], dtype=np.int64) for i in (0, 1))
    unmatched = _reach(share) | (_ALL & ~_inside(area))
    return hit, skip | (unmatched & ~(hit | skip))


def _pairs(det: np.ndarray, gt: np.ndarray, det_group: np.ndarray, gt_start: np.ndarray, gt_end: np.ndarray) -> Iterator[tuple]:
    """Numbers of all (detection, box) of equal groups, some MOST_PAIRS at a time."""
    each = (gt_end - gt_start)[det_group]
    before = np.concatenate([[0], np.cumsum(each)])
    start = 0
    while start < len(det):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + MOST_PAIRS, side="right")) - 1)
        n = each[start:stop]
        first = np.repeat(gt_start[det_group[start:stop]] - (np.cumsum(n) - n), n)
        yield np.repeat(np.arange(start, stop), n), first + np.arange(n.sum())
        start = stop


def _overlaps(det: np.ndarray, gt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common area of boxes, 0 where they don't overlap, and the area of the first ones."""
    width = np.minimum(det[:, 2], gt[:, 2]) - np.maximum(det[:, 0], gt[:, 0])
    height = np.minimum(det[:, 3], gt[:, 3]) - np.maximum(det[:, 1], gt[:, 1])
    return np.where((width > 0) & (height > 0), width * height, 0.0), (det[:, 2] - det[:, 0]) * (det[:, 3] - det[:, 1])


@dataclass
class _Groups:
    """Rows of whole groups, detections before boxes: detections with their crowd share and the boxes near them."""

    det: np.ndarray  # row numbers
    group: np.ndarray  # of each detection
    share: np.ndarray
    area: np.ndarray
    near: list[list[tuple]]

    @classmethod
    def of(cls, batch: pa.RecordBatch, starts: np.ndarray) -> _Groups:
        number = lambda n: pc.fill_null(batch.column(n).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        boxes = np.stack([number(c) for c in _BOX], axis=1)
        kind = batch.column("__kind").to_numpy(zero_copy_only=False)
        group = np.cumsum(np.isin(np.arange(batch.num_rows), starts)) - 1
        det, gt, crowd = (np.flatnonzero(kind == k) for k in range(3))
        found = cls(det, group[det], np.zeros(len(det)), _overlaps(boxes[det], boxes[det])[1], [[] for _ in det])
        edges = lambda rows: [np.searchsorted(group[rows], np.arange(len(starts)), side=s) for s in ("left", "right")]
        for d, c in _pairs(det, crowd, found.group, *edges(crowd)):
            common, own = _overlaps(boxes[det[d]], boxes[crowd[c]])
            np.maximum.at(found.share, d[common > 0], (common / np.where(own == 0, 1, own))[common > 0])
        areas = number("__area")
        for d, g in _pairs(det, gt, found.group, *edges(gt)):
            common, own = _overlaps(boxes[det[d]], boxes[gt[g]])
            union = own + _overlaps(boxes[gt[g]], boxes[gt[g]])[1] - common
            overlap = np.where(common > 0, common / np.where(union == 0, 1, union), 0.0)
            kept = np.flatnonzero(overlap >= THRESHOLDS[0])
            kept = kept[np.lexsort((-g[kept], -overlap[kept], d[kept]))]
            row = gt[g[kept]]
            columns = (overlap[kept], row, _reach(overlap[kept]), _inside(areas[row]))
            for i, near in zip(d[kept].tolist(), zip(*[c.tolist() for c in columns])):
                found.near[i].append(near)
        return found


def _group_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a new group starts in sorted rows; nulls are equal."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        column = batch.column(key)
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (np.asarray(before.is_null()) != np.asarray(after.is_null()))
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows again, in batches that end where a group does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        starts = _group_starts(rows, keys)
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts[:-1]
        held = [rows.slice(int(starts[-1]))]
    if held:
        yield held[0], np.zeros(1, dtype=np.int64)


def _best_of_groups(batch: pa.RecordBatch, starts: np.ndarray, most: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Whole groups with their first ``most`` detections."""
    place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(starts, append=batch.num_rows))
    keep = (place < most) | (batch.column("__kind").to_numpy(zero_copy_only=False) > 0)
    if keep.all():
        return batch, starts
    return batch.filter(pa.array(keep)), (np.cumsum(keep) - keep)[starts]


def _crowded(df: DataFrame, keys: list[str]) -> Column | None:
    """Test that holds for all rows of groups with more than GT_BLOCK rows, and few others; None if no group has so many.

    Groups are counted by buckets of their hash, so no task hands on more than GROUP_BUCKETS counts.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(GROUP_BUCKETS)).cast("int")
    counts = df.groupBy(bucket.alias("__bucket")).count().filter(F.col("count") > GT_BLOCK)
    found = [r[0] for r in counts.select("__bucket").collect()]
    del counts
    release(df.sparkSession)
    if not found:
        return None
    return bucket.isin(found) if len(found) <= 1000 else F.lit(True)


def match_detections(
    dets: DataFrame, gts: DataFrame, keys: Sequence[str] = ("image_id", "class"), max_dets: int = MAX_DETECTIONS
) -> DataFrame:
    """Detections (the best ``max_dets`` per image and class) with the bit masks ``hits`` and ``ignored``, one bit per
    threshold and area range.

    ``dets`` has x1..y2, score and det_key; ``gts`` has x1..y2, area, iscrowd and gt_key; the keys break ties. Rows with
    a null key match nothing.

    Detections and boxes are shuffled once, and those of an image and class meet in one pass over sorted rows; no pair
    becomes a row. Detections of groups with more than GT_BLOCK rows are cut to the best before. Boxes of one beyond
    GT_BLOCK go in blocks, to each of which its detections are sent. A detection meets at most ``max_dets - 1`` boxes
    taken by others, so its best ``max_dets`` partners of each size class contain its match in every area range; the
    blocks hand on these, and one more pass settles them.
    """
    keys = list(keys)
    boxes = gts.filter("iscrowd IN (0, 1)").filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    boxes = boxes.select(
        *keys, *_BOX, F.col("area").alias("__area"), (F.col("iscrowd") + 1).cast("int").alias("__kind"), F.col("gt_key").alias("__gt")
    )
    many, large = _crowded(dets, keys), _crowded(boxes, keys)
    group, order, best, whole_groups = keys, [F.col("score").desc(), F.col("det_key")], dets, large is None
    if many is not None or large is not None:
        hot = large if many is None else many if large is None else many | large
        ranked = topk_per_image(dets.filter(hot), max_dets, keys, ("score", "det_key"), "__rank")
        best = dets.filter(~hot).unionByName(ranked, allowMissingColumns=True)
        order = [F.col("__rank"), *order]
    if not whole_groups:
        # One row at most for each GT_BLOCK boxes.
        blocks = boxes.filter(large).groupBy(*keys).count().filter(F.col("count") > GT_BLOCK)
        blocks = F.broadcast(blocks.select(*keys, F.ceil(F.col("count") / GT_BLOCK).cast("int").alias("__blocks")))
        count = F.coalesce("__blocks", F.lit(1))
        boxes = boxes.join(blocks, keys, "left").withColumn("__block", F.pmod(F.xxhash64("__gt", *_BOX), count).cast("int"))
        best = best.join(blocks, keys, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), count - 1)))
        boxes, best = (rows.withColumn("__blocks", count) for rows in (boxes, best))
        group = [*keys, "__block"]
    met = best.withColumn("__kind", F.lit(0)).unionByName(boxes, allowMissingColumns=True)
    parts = int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = met.repartition(parts, *group).sortWithinPartitions(*group, "__kind", *order, "__gt")

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    kept = [*dets.columns, *([] if whole_groups else ["__rank"])]
    whole = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    # What a block hands on: its share of the crowds and the boxes near each detection.
    partial = f"__share double, __overlap array<double>, __area array<double>, __gt array<{kinds['__gt']}>"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, group):
            batch, starts = _best_of_groups(batch, starts, max_dets)
            found = _Groups.of(batch, starts)
            rows = batch.select(kept).take(pa.array(found.det))
            known = np.ones(len(found.det), dtype=bool)
            for key in keys:
                known &= np.asarray(rows.column(key).is_valid())
            near = [n if k else [] for n, k in zip(found.near, known)]
            share = np.where(known, found.share, 0.0)
            settled: list[tuple[int, int]] = []
            edges = np.flatnonzero(np.diff(found.group, prepend=-1)).tolist() + [len(found.group)]
            for a, b in zip(edges, edges[1:]):
                settled += _settle(list(zip(share[a:b].tolist(), near[a:b])))
            hits, ignored = _masks(settled, share, found.area)
            columns, names = [*rows.columns, pa.array(hits), pa.array(ignored)], [*kept, "hits", "ignored"]
            if whole_groups:
                yield pa.RecordBatch.from_arrays(columns, names)
                continue
            split = batch.column("__blocks").take(pa.array(found.det)).to_numpy(zero_copy_only=False) > 1
            empty = pa.nulls(len(found.det), pa.float64())
            lists = [pa.nulls(len(found.det), pa.list_(t)) for t in (pa.float64(), pa.float64(), batch.column("__gt").type)]
            if split.any():
                handed = [_best_partners(n, batch, max_dets) if s else None for n, s in zip(near, split)]
                types = (pa.float64(), pa.float64(), batch.column("__gt").type)
                lists = [pa.array([h and h[i] for h in handed], pa.list_(t)) for i, t in enumerate(types)]
                empty = pa.array(share, mask=~split)
            yield pa.RecordBatch.from_arrays([*columns, empty, *lists], [*names, "__share", "__overlap", "__area", "__gt"])

    if whole_groups:
        return ordered.mapInArrow(match, f"{whole}, hits bigint, ignored bigint")
    matched = pin(ordered.mapInArrow(match, f"{whole}, hits bigint, ignored bigint, {partial}"))
    result = [*dets.columns, "hits", "ignored"]
    done = matched.filter("__share IS NULL").select(*result)
    handed = matched.filter("__share IS NOT NULL")
    if handed.isEmpty():
        return done
    again = handed.repartition(parts, *keys).sortWithinPartitions(*keys, "__rank")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, keys):
            yield _merged(batch, starts, kept, max_dets)

    return done.unionByName(again.mapInArrow(merge, f"{whole}, hits bigint, ignored bigint").select(*result))


def _size_class(area: float) -> int:
    """Area ranges include both ends, so an area on an edge is a class of its own."""
    edges = sorted({e for low, high in AREAS.values() for e in (low, high)})
    return sum((area >= e) + (area > e) for e in edges)


def _of_each_class(near: list[tuple], most: int) -> list[tuple]:
    """The first ``most`` of each size class of (overlap, area, key), best first."""
    seen: dict[int, int] = {}
    out = []
    for entry in near:
        size = _size_class(entry[1])
        seen[size] = seen.get(size, 0) + 1
        if seen[size] <= most:
            out.append(entry)
    return out


def _best_partners(near: list[tuple], batch: pa.RecordBatch, most: int) -> tuple[list, list, list]:
    area, key = batch.column("__area"), batch.column("__gt")
    listed = [(overlap, area[row].as_py(), key[row].as_py()) for overlap, row, _, _ in near]
    return tuple(zip(*_of_each_class(listed, most))) or ((), (), ())


def _merged(batch: pa.RecordBatch, starts: np.ndarray, kept: list[str], most: int) -> pa.RecordBatch:
    """Detections of groups that went in blocks, settled on what the blocks have handed on."""
    columns = [batch.column(c).to_pylist() for c in ("__share", "__overlap", "__area", "__gt")]
    first, share, settled, area = [], [], [], []
    corner = [batch.column(c).to_pylist() for c in _BOX]
    rank = batch.column("__rank").to_pylist()
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        dets: list[tuple[float, list[tuple]]] = []
        for row in range(start, stop):
            listed = list(zip(*[columns[i][row] for i in (1, 2, 3)]))
            if row > start and rank[row] == rank[row - 1]:
                crowd, near = dets[-1]
                dets[-1] = max(crowd, columns[0][row]), near + listed
                continue
            first.append(row)
            dets.append((columns[0][row], listed))
            area.append((corner[2][row] - corner[0][row]) * (corner[3][row] - corner[1][row]))
        ready = []
        for crowd, near in dets:
            near = _of_each_class(sorted(near, key=lambda e: (e[0], e[2]), reverse=True), most)
            overlap, size = np.array([e[0] for e in near]), np.array([e[1] for e in near])
            ready.append((crowd, [(e[0], e[2], r, i) for e, r, i in zip(near, _reach(overlap).tolist(), _inside(size).tolist())]))
        share += [crowd for crowd, _ in ready]
        settled += _settle(ready)
    hits, ignored = _masks(settled, np.array(share), np.array(area))
    rows = batch.select(kept).take(pa.array(first))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(hits), pa.array(ignored)], [*kept, "hits", "ignored"])


def _slice_points(batches: Iterator[pa.RecordBatch], class_key: str, before: dict) -> Iterator[pa.RecordBatch]:
    """Best precision per curve and recall step of each class in a slice of sorted rows, given the totals of the slices
    before it. What is held is a running total and a best precision per curve and step of one class."""
    grid = np.arange(RECALL_POINTS) * RECALL_STEP
    names_ = ["iou", "area", "step", "precision", class_key]
    now, kind, totals, best = None, None, None, None

    def points() -> Iterator[pa.RecordBatch]:
        if totals is None or not best.any():
            return
        curve, step = np.nonzero(best)
        columns = [
            pa.array([THRESHOLDS[_CURVES[c][0]] for c in curve.tolist()], pa.float64()),
            pa.array([_CURVES[c][1] for c in curve.tolist()], pa.string()),
            pa.array(step, pa.int32()),
            pa.array(best[curve, step]),
            pa.array([now[0]] * len(curve), kind),
        ]
        yield pa.RecordBatch.from_arrays(columns, names_)

    for batch in batches:
        kind = batch.column(class_key).type
        starts = [*_group_starts(batch, [class_key, SLICE]).tolist(), batch.num_rows]
        hits, ignored = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hits", "ignored"))
        for start, stop in zip(starts, starts[1:]):
            key = (batch.column(class_key)[start].as_py(), batch.column(SLICE)[start].as_py())
            if key != now:
                yield from points()
                now, best = key, np.zeros((len(_CURVES), RECALL_POINTS))
                found = before.get(key)
                totals = found and (np.array(found[0]), np.array(found[1]), found[2])
            if totals is None:
                continue
            tp_before, fp_before, n = totals
            for c, (_, name) in enumerate(_CURVES):
                of_range = n[list(AREAS).index(name)]
                counted = (ignored[start:stop] >> c & 1) == 0
                matched = (hits[start:stop] >> c & 1) == 1
                tp = tp_before[c] + np.cumsum(matched & counted)
                fp = fp_before[c] + np.cumsum(~matched & counted)
                tp_before[c], fp_before[c] = tp[-1], fp[-1]
                if not of_range or not tp[-1]:
                    continue
                # Steps only rise along a curve.
                step = np.searchsorted(grid, tp / of_range, side="right") - 1
                first = np.flatnonzero(np.diff(step, prepend=-1))
                top = np.maximum.reduceat(tp / (tp + fp + _EPS), first)
                best[c, step[first]] = np.maximum(best[c, step[first]], top)
    yield from points()


_TOTALS = "__totals"  # 64-bit counts of hits, then of false alarms, by curve


class _Earlier(dict):
    """Totals (tp, fp, boxes in each area range) before a slice, by (class, slice), of rows that are added up."""

    def __init__(self, boxes: dict):
        super().__init__()
        self.boxes = boxes

    def add(self, rows: pa.RecordBatch, class_key: str) -> None:
        for key, number, totals in zip(*[rows.column(c).to_pylist() for c in (class_key, SLICE, _TOTALS)]):
            self[key, number] = np.frombuffer(totals, np.int64).reshape(2, -1) + self.pop((key, number), 0)

    def get(self, key):
        tp, fp = self.pop(key, np.zeros((2, len(_CURVES)), dtype=np.int64))
        boxes = self.boxes.get(key[0])
        return boxes and (tp, fp, boxes)


class _Slices:
    """Cuts the detections of each class, of falling score and rising first key, at given places (score, first key)."""

    def __init__(self, cuts: dict, class_key: str, first: str):
        self.cuts, self.class_key, self.first = cuts, class_key, first

    def numbers(self, rows: pa.RecordBatch, cuts: list[tuple]) -> np.ndarray:
        """Number of the cuts at or before each row."""
        scores = rows.column("score").cast(pa.float64())
        # Nulls come last and what is not a number first, as Spark sorts them.
        fall = pc.fill_null(pc.negate(scores), np.inf).to_numpy(zero_copy_only=False)
        fall = np.where(np.isnan(fall), -np.inf, fall)
        places = np.array([-score for score, _ in cuts])
        first, last = (np.searchsorted(places, fall, side=s) for s in ("left", "right"))
        keys, own = [key for _, key in cuts], rows.column(self.first)
        # Rows among cuts of their own score; null keys come last.
        for row in np.flatnonzero(last > first).tolist():
            if (key := own[row].as_py()) is not None:
                last[row] = bisect_right(keys, key, int(first[row]), int(last[row]))
        return last

    def cut(self, batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows with their slice; at the end a row of totals for each slice that has rows of the task before it."""
        totals: dict = {}
        for batch in batches:
            names = batch.column(self.class_key).dictionary_encode()
            places = names.indices.to_numpy(zero_copy_only=False)
            for at, key in enumerate(names.dictionary.to_pylist()):
                rows = batch.filter(pa.array(places == at))
                cuts = self.cuts.get(key, [])
                number = self.numbers(rows, cuts)
                hits, ignored = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("hits", "ignored"))
                if key not in totals:
                    totals[key] = np.zeros((2, len(cuts) + 1, len(_CURVES)), dtype=np.int64)
                order = np.argsort(number, kind="stable")
                starts = np.flatnonzero(np.diff(number[order], prepend=-1))
                for i, mask in enumerate((hits & ~ignored, ~hits & ~ignored)):
                    bits = np.unpackbits(mask[order].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(_CURVES)]
                    totals[key][i, number[order][starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                made = {**dict(zip(rows.schema.names, rows.columns)), SLICE: pa.array(number.astype(np.int32))}
                yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(number), f.type)) for f in fields], schema=fields)
        for key, counts in totals.items():
            before = np.cumsum(counts, axis=1) - counts
            later = np.flatnonzero(before.any(axis=(0, 2)))
            packed = [before[:, number].tobytes() for number in later]
            made = {self.class_key: [key] * len(later), SLICE: later, _TOTALS: packed}
            made = {name: pa.array(values, fields.field(name).type) for name, values in made.items()}
            yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(later), f.type)) for f in fields], schema=fields)


def _cuts(rows: DataFrame, class_key: str, first: str, identity: list[str], parts: int) -> dict:
    """Where to cut each class, so that the slices of all classes are about as large: rows of lowest hash in their order."""
    wanted = parts * SLICES_A_PARTITION
    least = F.xxhash64(*identity, F.lit(1)).alias("__hash")
    usual = rows.filter(F.col(class_key).isNotNull() & F.col(first).isNotNull() & (F.abs("score") < np.inf))
    drawn = usual.select(class_key, F.col("score").cast("double").alias("score"), first, least)
    drawn = drawn.orderBy("__hash").limit(min(MOST_SAMPLES, wanted * SAMPLES_A_SLICE))
    # Rows (class, score, first key).
    sample = sorted(((r[0], r[1], r[2]) for r in drawn.collect()), key=lambda r: (r[0], -r[1], r[2]))
    del drawn
    release(rows.sparkSession)
    cuts: dict = {}
    for name, *place in sample[:: max(1, len(sample) // wanted)][1:]:
        if tuple(place) not in cuts.setdefault(name, [])[-1:]:
            cuts[name].append(tuple(place))
    return cuts


def average_precision(
    matches: DataFrame,
    gts: DataFrame,
    class_key: str = "class",
    order: Sequence[str] = ("image_id", "det_key"),
    alike: DataFrame | None = None,
) -> DataFrame:
    """AP per class, threshold and area range, for classes that have ground truth in the range.

    Detections are cut into slices of falling score, at places drawn from the detections (or from ``alike``, which has
    their columns but the masks and is cheaper to read). A task counts what it sends to each slice, and sends its totals
    of the slices before along. They give the recall and precision of every detection of a slice; so the detections are
    shuffled once and no copy of them is kept. The precision at a recall point is the best of all detections that reach
    it, so a slice only reports the best precision of each recall step.
    """
    order, spark = list(order), matches.sparkSession
    in_range = [((F.col("area") >= low) & (F.col("area") <= high)).cast("bigint") for low, high in AREAS.values()]
    n_gt = gts.filter("iscrowd = 0").groupBy(class_key).agg(
        *[F.sum(flag).alias(f"n_{name}") for name, flag in zip(AREAS, in_range)]
    )
    # One row per class.
    n_gt = spark.createDataFrame(n_gt.collect(), n_gt.schema)
    release(spark)
    boxes = {r[0]: list(r[1:]) for r in n_gt.collect() if r[0] is not None}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    identity = [class_key, "score", *order]
    cuts = _cuts(matches if alike is None else alike, class_key, order[0], identity, parts)
    slices = spark.sparkContext.broadcast(_Slices(cuts, class_key, order[0]))
    rows = matches.select(*identity, "hits", "ignored").filter(F.col(class_key).isNotNull())
    schema = StructType([*rows.schema.fields, StructField(SLICE, IntegerType()), StructField(_TOTALS, BinaryType())])
    fields = to_arrow_schema(schema)
    totals_first = [F.col(_TOTALS).isNull(), F.col("score").desc(), *[F.asc_nulls_last(c) for c in order]]
    sliced = (
        rows.mapInArrow(lambda batches: slices.value.cut(batches, fields), schema)
        .repartition(parts, class_key, SLICE)
        .sortWithinPartitions(class_key, SLICE, *totals_first)
        .select(class_key, SLICE, "hits", "ignored", _TOTALS)
    )
    key_type = matches.schema[class_key].dataType.simpleString()

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier = _Earlier(boxes)

        def detections() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                totals = batch.column(_TOTALS).is_valid()
                earlier.add(batch.filter(totals), class_key)
                found = batch.filter(pc.invert(totals))
                if found.num_rows:
                    yield found

        yield from _slice_points(detections(), class_key, earlier)

    # At most 101 rows per curve.
    best = pin(
        sliced.mapInArrow(points, f"iou double, area string, step int, precision double, `{class_key}` {key_type}")
        .groupBy(class_key, "iou", "area", "step")
        .agg(F.max("precision").alias("precision"))
    )
    # A row covers the recall points above the step below it.
    up = Window.partitionBy(class_key, "iou", "area").orderBy("step")
    envelope = F.max("precision").over(up.rowsBetween(0, Window.unboundedFollowing))
    below = F.coalesce(F.lag("step").over(up), F.lit(-1))
    areas = best.select(
        class_key, "iou", "area", (envelope * (F.col("step") - below)).alias("part")
    ).groupBy(class_key, "iou", "area").agg((F.sum("part") / RECALL_POINTS).alias("ap"))
    sizes = n_gt.select(
        class_key,
        F.explode(F.array(*[F.struct(F.lit(a).alias("area"), F.col(f"n_{a}").alias("n")) for a in AREAS])).alias("s"),
    ).select(class_key, "s.*").filter("n > 0")
    wanted = sizes.withColumn("iou", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    return wanted.join(areas, [class_key, "iou", "area"], "left").select(
        class_key, "iou", "area", "n", F.coalesce("ap", F.lit(0.0)).alias("ap")
    )


def summary(aps: DataFrame, class_key: str = "class") -> DataFrame:
    """Rows (metric, class, value): AP, AP50, AP75, APs, APm, APl over all classes and AP per class, as fractions."""
    whole = F.col("area") == "all"
    picks = {
        "AP": whole,
        "AP50": whole & (F.col("iou") == 0.5),
        "AP75": whole & (F.col("iou") == 0.75),
        "APs": F.col("area") == "small",
        "APm": F.col("area") == "medium",
        "APl": F.col("area") == "large",
    }
    overall = aps.agg(*[F.avg(F.when(test, F.col("ap"))).alias(name) for name, test in picks.items()])
    rows = overall.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in picks])).alias("r")
    ).select("r.metric", F.lit(None).cast("string").alias(class_key), "r.value")
    per_class = aps.filter(whole).groupBy(F.col(class_key).cast("string").alias(class_key)).agg(F.avg("ap").alias("value"))
    return rows.unionByName(per_class.select(F.lit("AP").alias("metric"), class_key, "value"))


def coco_eval(dets: DataFrame, gts: DataFrame, max_dets: int = MAX_DETECTIONS) -> DataFrame:
    """Quality of detections against ground truth; see :func:`match_detections` for the columns."""
    dets = dets.select("image_id", "class", *_BOX, "score", "det_key")
    return summary(average_precision(match_detections(dets, gts, max_dets=max_dets), gts, alike=dets))
