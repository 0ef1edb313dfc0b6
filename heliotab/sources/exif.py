"""GPS positions from the EXIF block of JPEG, TIFF and WebP files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab import schemas
from heliotab.functions import geo, names

# Fixed values of the EXIF format: pointer to the GPS directory and its tags.
_GPS_POINTER = 0x8825
_LAT_REF, _LAT, _LON_REF, _LON = 1, 2, 3, 4


def _exif_block(raw: bytes) -> bytes | None:
    """TIFF block of a JPEG's APP1 segment, of a WebP's EXIF chunk, or a TIFF file itself."""
    if raw[:4] in (b"II*\0", b"MM\0*"):
        return raw
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        place = 12
        while place + 8 <= len(raw):
            size = struct.unpack_from("<I", raw, place + 4)[0]
            if raw[place : place + 4] == b"EXIF":
                body = raw[place + 8 : place + 8 + size]
                return body[6:] if body[:6] == b"Exif\0\0" else body
            place += 8 + size + size % 2
        return None
    place = 2
    while raw[:2] == b"\xff\xd8" and place + 4 <= len(raw) and raw[place] == 0xFF:
        marker, size = raw[place + 1], struct.unpack_from(">H", raw, place + 2)[0]
        body = raw[place + 4 : place + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            return body[6:]
        if marker == 0xDA:
            break
        place += 2 + size
    return None


def _entries(block: bytes, order: str, start: int) -> dict[int, tuple[int, int, int]]:
    (count,) = struct.unpack_from(order + "H", block, start)
    found = {}
    for entry in range(start + 2, start + 2 + 12 * count, 12):
        tag, _, n = struct.unpack_from(order + "HHI", block, entry)
        found[tag] = (n, entry + 8, struct.unpack_from(order + "I", block, entry + 8)[0])
    return found


def _gps(raw: bytes) -> tuple | None:
    block = _exif_block(raw)
    if block is None:
        return None
    order = {b"II": "<", b"MM": ">"}[block[:2]]
    root = _entries(block, order, struct.unpack_from(order + "I", block, 4)[0])
    if _GPS_POINTER not in root:
        return None
    tags = _entries(block, order, root[_GPS_POINTER][2])

    def rationals(tag):
        if tag not in tags:
            return None
        parts = struct.unpack_from(f"{order}{tags[tag][0] * 2}I", block, tags[tag][2])
        return [{"num": n, "den": d} for n, d in zip(parts[::2], parts[1::2])]

    def letter(tag):
        return chr(block[tags[tag][1]]) if tag in tags else None

    return rationals(_LAT), letter(_LAT_REF), rationals(_LON), letter(_LON_REF)


def decode_exif_gps(files: DataFrame) -> DataFrame:
    """Raw rationals of files given as (path, content); files without a readable position keep nulls."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"]):
                try:
                    found = _gps(raw) if raw is not None else None
                except (KeyError, IndexError, struct.error):
                    found = None
                rows.append((path, *(found or (None,) * 4)))
            yield pd.DataFrame(rows, columns=["path", "lat_dms", "lat_ref", "lon_dms", "lon_ref"])

    return files.select("path", "content").mapInPandas(decode, schemas.GPS)


def positions(gps: DataFrame) -> DataFrame:
    """Add lat and lon; both are null unless both can be computed."""
    part = lambda c, i: F.get(F.col(c), F.lit(i))
    side = lambda c: geo.dms_to_deg(part(f"{c}_dms", 0), part(f"{c}_dms", 1), part(f"{c}_dms", 2), F.col(f"{c}_ref"))
    rows = gps.withColumns({"__lat": side("lat"), "__lon": side("lon")})
    both = F.col("__lat").isNotNull() & F.col("__lon").isNotNull()
    return rows.withColumns({"lat": F.when(both, F.col("__lat")), "lon": F.when(both, F.col("__lon"))}).drop(
        "__lat", "__lon"
    )


def read_exif_gps(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    located = positions(decode_exif_gps(raw))
    return located.withColumn("name", names.basename(F.col("path")))
