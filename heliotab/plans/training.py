"""Training-set preparation: annotations, thermal planes and channels of every image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.functions import boxes, planes
from heliotab.operators.joins import filter_empty


def training_boxes(
    images: DataFrame, annotations: DataFrame, augment=None, colour_only: bool = False
) -> DataFrame:
    """Boxes of the training images in pixels: crowds dropped (thermal mapper only), converted, augmented, clipped.

    ``augment`` maps a table with image_id, width, height and x1..y2 to one of the same columns; afterwards new_h and
    new_w, where present, are the image size.
    """
    usable = annotations if colour_only else boxes.drop_crowd(annotations)
    shaped = usable.withColumn("__xyxy", boxes.box_to_xyxy(F.col("bbox")))
    joined = boxes.corners(shaped, "__xyxy").drop("__xyxy", "bbox").join(
        images.select("image_id", "width", "height"), "image_id"
    )
    if augment is not None:
        joined = augment(joined)
    sized = joined
    if "new_w" in joined.columns:
        sized = joined.withColumns({"width": F.col("new_w"), "height": F.col("new_h")}).drop("new_w", "new_h")
    return boxes.drop_empty(boxes.clip_boxes(sized))


def thermal_augment(seed: int = 0, style: str = "choice"):
    """Augmentation of the thermal mapper: resize, then horizontal flip."""

    def apply(df: DataFrame) -> DataFrame:
        sized = boxes.resize_shortest_edge(df, style=style, epoch=seed)
        flip = boxes.coin(F.col("image_id"), seed, "flip-horizontal") == 0
        return boxes.flip_boxes(sized, flip, "horizontal", "new_w", "new_h")

    return apply


def colour_augment(seed: int = 0):
    """Augmentation of the colour mapper: horizontal flip, then rotation by up to five degrees."""
    return lambda df: boxes.random_rotate(boxes.random_flip(df, "horizontal", seed), seed=seed)


def training_tensors(rasters: DataFrame, thermal: DataFrame, pixel: str = "float") -> DataFrame:
    """Four-channel tensors (CHW, of ``pixel``) per image; images without a plane get zeros in the thermal channel.

    ``rasters`` has image_id, height, width, red, green, blue; ``thermal`` has image_id, path, h, w, px.
    """
    side = thermal.select(
        "image_id", F.col("path").alias("thermal_path"), F.col("h").alias("th"), F.col("w").alias("tw"), F.col("px").alias("tpx")
    )
    joined = rasters.join(side, "image_id", "left")
    colours = [F.col(c) for c in ("red", "green", "blue")]
    return joined.select(
        "image_id",
        "height",
        "width",
        planes.thermal_kind(F.col("thermal_path"), F.col("tpx")).alias("kind"),
        planes.training_tensor(colours, *[F.col(c) for c in ("tpx", "th", "tw", "height", "width")], pixel).alias("px"),
    ).withColumn("channels", (F.size("px") / (F.col("height") * F.col("width"))).cast("int"))


def training_set(images: DataFrame, annotations: DataFrame, rasters: DataFrame, thermal: DataFrame, seed: int = 0, pixel: str = "float") -> tuple[DataFrame, DataFrame]:
    """Tensors and boxes of the images that have a usable annotation."""
    kept = filter_empty(images, annotations)
    tensors = training_tensors(rasters.join(kept.select("image_id"), "image_id", "left_semi"), thermal, pixel)
    return tensors, training_boxes(kept, annotations, thermal_augment(seed))


def training_mode(stats: DataFrame, use_thermal: bool = True) -> DataFrame:
    """Per split: train with thermal data only if any image decoded, else in colour with the reason."""
    thermal = F.lit(use_thermal) & (F.col("ok") > 0)
    fallback = F.coalesce("first_error", F.lit("No radiometric data."))
    return stats.withColumns(
        {
            "mode": F.when(thermal, "rgbtherm").otherwise("rgb"),
            "fallback_reason": F.when(F.lit(use_thermal) & (F.col("ok") == 0), fallback),
        }
    )
