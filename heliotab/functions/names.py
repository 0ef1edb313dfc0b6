"""File names, safe names, URLs and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions per listing policy.
DATASET_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")
SCAN_EXTENSIONS = (".jpg", ".jpeg", ".JPG", ".JPEG", ".png", ".PNG", ".tif", ".tiff", ".TIF", ".TIFF")
PREDICT_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")

MEDIA_PREFIX = "/media"
SAFE_NAME_LENGTH = 128
_BLANK = r"[\s\x1c-\x1f]"


def strip_rf_suffix(name: Column) -> Column:
    """Text left of the first ``.rf.`` (the export hash that labelling tools add)."""
    return F.split(name, r"\.rf\.", 2)[0]


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot belongs to the stem."""
    return F.regexp_replace(basename(path), r"(?s)^(.+)\.[^.]+$", "$1")


def suffix(path: Column) -> Column:
    """Last extension with its dot, as spelt; empty when there is none."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def suffix_lower(path: Column) -> Column:
    return F.lower(suffix(path))


def strip_blanks(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` knows the space only)."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def safe_name(name: Column) -> Column:
    cut = F.substring(strip_blanks(name), 1, SAFE_NAME_LENGTH)
    return F.coalesce(F.regexp_replace(cut, r"[^A-Za-z0-9._-]+", "_"), F.lit(""))


def slugify(name: Column, default: str = "dataset") -> Column:
    dashed = F.regexp_replace(stem(name), r"[^A-Za-z0-9._-]+", "-")
    trimmed = F.regexp_replace(dashed, r"^[-._]+|[-._]+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(default))


def is_image(path: Column, policy: str = "dataset") -> Column:
    """Extension test under one of the three listing policies."""
    if policy == "dataset":
        return suffix_lower(path).isin(*DATASET_EXTENSIONS)
    if policy == "predict":
        return suffix_lower(path).isin(*PREDICT_EXTENSIONS)
    if policy == "scan":
        return suffix(path).isin(*SCAN_EXTENSIONS) & ~basename(path).endswith("_thermal.tif")
    raise ValueError(f"unknown listing policy {policy!r}")


def media_url(session: Column, kind: str | Column, name: Column) -> Column:
    part = F.lit(kind) if isinstance(kind, str) else kind
    return F.replace(F.concat_ws("/", F.lit(MEDIA_PREFIX), session, part, name), F.lit("\\"), F.lit("/"))


def two_decimals(value: Column) -> Column:
    """Text of a double with two decimals, rounded from its exact binary value (ties to even).

    ``format_string`` rounds the shortest decimal text half-up, which differs for values such as 0.125 or 2.675.
    The product with 100 is split into its rounded value and its exact error, and the error decides apparent ties.
    """
    magnitude = F.abs(value.cast("double"))
    splitter = F.lit(134217729.0)
    hundred = F.lit(100.0)
    product = magnitude * hundred
    high = magnitude * splitter - (magnitude * splitter - magnitude)
    low = magnitude - high
    error = (high * hundred - product) + low * hundred
    base = F.floor(product)
    above_half = (product - base) - F.lit(0.5)
    round_up = (above_half > 0) | (
        (above_half == 0) & ((error > 0) | ((error == 0) & (base % 2 == 1)))
    )
    cents = base + F.when(round_up, 1).otherwise(0)
    sign = F.when(value.cast("double") < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(cents / 100).cast("string")
    return F.concat(sign, whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def box_label(name: Column, score: Column) -> Column:
    return F.concat(name, F.lit(":"), two_decimals(score))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def name_or_stamp(name: Column, ts: Column, prefix: str = "") -> Column:
    """Safe form of a user's name, or a stamp where the name is empty."""
    return F.coalesce(F.nullif(safe_name(name), F.lit("")), F.concat(F.lit(prefix), run_stamp(ts)))
