"""Box geometry: conversions, clipping, augmentation and resize arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Resize settings of the detector.
TRAIN_SIZES = (640, 672, 704, 736, 768, 800)
TEST_SIZES = (800,)
MAX_SIZE = 1333
THUMB_WIDTH = 420


def xywh_to_xyxy(bbox: Column) -> Column:
    return F.array(bbox[0], bbox[1], bbox[0] + bbox[2], bbox[1] + bbox[3])


def rotated_to_xyxy(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """Axis-aligned hull of a box rotated by ``angle`` degrees about its centre."""
    theta = F.radians(angle)
    cos, sin = F.abs(F.cos(theta)), F.abs(F.sin(theta))
    half_w = (cos * w + sin * h) / F.lit(2.0)
    half_h = (cos * h + sin * w) / F.lit(2.0)
    return F.array(cx - half_w, cy - half_h, cx + half_w, cy + half_h)


def box_to_xyxy(bbox: Column) -> Column:
    """Four numbers are x, y, width, height; five are a rotated box; other lengths give null."""
    part = [F.get(bbox, F.lit(i)) for i in range(5)]
    return F.when(F.size(bbox) == 4, F.array(part[0], part[1], part[0] + part[2], part[1] + part[3])).when(
        F.size(bbox) == 5, rotated_to_xyxy(*part)
    )


def yolo_to_xyxy(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.array(
        (cx - w / F.lit(2.0)) * width,
        (cy - h / F.lit(2.0)) * height,
        (cx + w / F.lit(2.0)) * width,
        (cy + h / F.lit(2.0)) * height,
    )


def corners(df: DataFrame, box: str) -> DataFrame:
    """Spread an XYXY array over the columns x1, y1, x2, y2."""
    return df.withColumns({name: F.col(box)[i] for i, name in enumerate(("x1", "y1", "x2", "y2"))})


def clip_boxes(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    within = lambda value, limit: F.greatest(F.lit(0.0), F.least(F.col(value), F.col(limit).cast("double")))
    return df.withColumns(
        {"x1": within("x1", width), "y1": within("y1", height), "x2": within("x2", width), "y2": within("y2", height)}
    )


def drop_empty(df: DataFrame) -> DataFrame:
    return df.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def drop_crowd(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.col("iscrowd"), F.lit(0)) == 0)


def box_area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x2") - F.col(f"{prefix}x1")) * (F.col(f"{prefix}y2") - F.col(f"{prefix}y1"))


def coin(key: Column, epoch: int, salt: str, sides: int = 2) -> Column:
    """Repeatable draw from the row's key; stays the same under re-partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(epoch), F.lit(salt)), F.lit(sides))


def drawn_size(key: Column, sizes: tuple[int, ...], style: str, epoch: int = 0) -> Column:
    """Shortest-edge target per row: one of ``sizes`` (choice) or any between their ends (range)."""
    if style == "range":
        low, high = min(sizes), max(sizes)
        return (coin(key, epoch, "resize", high - low + 1) + F.lit(low)).cast("int")
    if style == "choice":
        listed = F.array(*[F.lit(s) for s in sizes])
        return F.element_at(listed, (coin(key, epoch, "resize", len(sizes)) + 1).cast("int"))
    raise ValueError(f"unknown sampling style {style!r}")


def resize_shortest_edge(
    df: DataFrame,
    sizes: tuple[int, ...] = TRAIN_SIZES,
    max_size: int = MAX_SIZE,
    style: str = "choice",
    key: str = "image_id",
    epoch: int = 0,
    size: Column | None = None,
) -> DataFrame:
    """New height and width with the shorter edge at the target and the longer one at most ``max_size``.

    Adds new_h, new_w and, where x1..y2 exist, scales the boxes. ``size`` overrides the draw.
    """
    target = (size if size is not None else drawn_size(F.col(key), sizes, style, epoch)).cast("double")
    h, w = F.col("height").cast("double"), F.col("width").cast("double")
    scale = target / F.least(h, w)
    raw_h = F.when(h < w, target).otherwise(scale * h)
    raw_w = F.when(h < w, scale * w).otherwise(target)
    longest = F.greatest(raw_h, raw_w)
    shrink = F.when(longest > max_size, F.lit(float(max_size)) / longest).otherwise(F.lit(1.0))
    out = df.withColumns(
        {
            "new_h": (raw_h * shrink + F.lit(0.5)).cast("int"),
            "new_w": (raw_w * shrink + F.lit(0.5)).cast("int"),
        }
    )
    if "x1" not in df.columns:
        return out
    by_w, by_h = F.col("new_w") / w, F.col("new_h") / h
    return out.withColumns(
        {
            "x1": F.col("x1") * by_w,
            "y1": F.col("y1") * by_h,
            "x2": F.col("x2") * by_w,
            "y2": F.col("y2") * by_h,
        }
    )


def flip_boxes(
    df: DataFrame, flip: Column, axis: str = "horizontal", width: str = "width", height: str = "height"
) -> DataFrame:
    """Mirror the boxes of the rows where ``flip`` holds."""
    low, high, limit = ("x1", "x2", width) if axis == "horizontal" else ("y1", "y2", height)
    extent = F.col(limit).cast("double")
    return df.withColumns(
        {
            low: F.when(flip, extent - F.col(high)).otherwise(F.col(low)),
            high: F.when(flip, extent - F.col(low)).otherwise(F.col(high)),
        }
    )


def random_flip(df: DataFrame, axis: str = "horizontal", seed: int = 0, key: str = "image_id") -> DataFrame:
    return flip_boxes(df, coin(F.col(key), seed, f"flip-{axis}") == 0, axis)


def rotate_boxes(df: DataFrame, angle: Column, width: str = "width", height: str = "height") -> DataFrame:
    """Rotate boxes about the image centre on an unchanged canvas: hull of the four corners, then clipped."""
    theta = F.radians(angle.cast("double"))
    cos, sin = F.cos(theta), F.sin(theta)
    cx, cy = F.col(width) / F.lit(2.0), F.col(height) / F.lit(2.0)
    xs, ys = [], []
    for x_name, y_name in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")):
        dx, dy = F.col(x_name) - cx, F.col(y_name) - cy
        xs.append(cos * dx + sin * dy + cx)
        ys.append(cos * dy - sin * dx + cy)
    turned = df.withColumns(
        {"x1": F.least(*xs), "y1": F.least(*ys), "x2": F.greatest(*xs), "y2": F.greatest(*ys)}
    )
    return clip_boxes(turned, width, height)


def random_rotate(df: DataFrame, low: float = -5, high: float = 5, seed: int = 0, key: str = "image_id") -> DataFrame:
    steps = 1 << 20
    fraction = coin(F.col(key), seed, "rotate", steps) / F.lit(float(steps - 1))
    return rotate_boxes(df, F.lit(float(low)) + fraction * F.lit(float(high - low)))


def thumb_size(width: Column, height: Column) -> Column:
    """``struct<w,h>`` of a thumbnail with fixed width."""
    ratio = F.lit(float(THUMB_WIDTH)) / F.greatest(F.lit(1), width)
    return F.struct(
        F.lit(THUMB_WIDTH).alias("w"), F.greatest(F.lit(1), (height * ratio).cast("int")).alias("h")
    )


def draw_list(dets: DataFrame) -> DataFrame:
    """Integer corners and the label anchor of each detection."""
    ints = dets.withColumns({f"{c}i": F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")})
    return ints.withColumns({"label_x": F.col("x1i"), "label_y": F.greatest(F.lit(0), F.col("y1i") - 6)})
