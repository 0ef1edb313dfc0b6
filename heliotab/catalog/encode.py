"""File bytes derived from table rows, as input of the byte readers' queries."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def tiff_bytes(plane: np.ndarray) -> bytes:
    """Uncompressed 32-bit float TIFF with one strip."""
    h, w = plane.shape
    body = plane.astype("<f4").tobytes()
    entries = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(body)), (339, 3, 3)]
    table = b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries)
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(entries)) + table + b"\0" * 4


def npy_bytes(plane: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, plane)
    return out.getvalue()


def npz_bytes(plane: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, plane=plane)
    return out.getvalue()


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in members:
            archive.writestr(name, content)
    return out.getvalue()


def jpeg_with_gps(lat: list[tuple[int, int]], lat_ref: str, lon: list[tuple[int, int]], lon_ref: str) -> bytes:
    """JPEG start with an EXIF block that holds a position."""
    gps_at = 8 + 2 + 12 + 4
    data_at = gps_at + 2 + 4 * 12 + 4
    letter = lambda ref: ref.encode().ljust(4, b"\0")
    root = struct.pack("<HHHII", 1, 0x8825, 4, 1, gps_at) + b"\0" * 4
    gps = struct.pack("<H", 4)
    gps += struct.pack("<HHI", 1, 2, 2) + letter(lat_ref) + struct.pack("<HHII", 2, 5, 3, data_at)
    gps += struct.pack("<HHI", 3, 2, 2) + letter(lon_ref) + struct.pack("<HHII", 4, 5, 3, data_at + 24)
    values = b"".join(struct.pack("<II", n, d) for n, d in [*lat, *lon])
    body = b"Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + root + gps + b"\0" * 4 + values
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def encode_planes(planes: DataFrame) -> DataFrame:
    """Files (path, content) of planes given as (vec_id, label, h, w, px); label 9 gives a cut file."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, label, h, w, px in batch[["vec_id", "label", "h", "w", "px"]].itertuples(index=False):
                plane = np.asarray(px, dtype=np.float32).reshape(h, w)
                write, ext = [(npy_bytes, "npy"), (npz_bytes, "npz"), (tiff_bytes, "tif")][key % 3]
                content = write(plane)
                rows.append((f"/p/{key}.{ext}", content[:20] if label == 9 else content))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return planes.mapInPandas(encode, "path string, content binary")


def encode_archives(orders: DataFrame) -> DataFrame:
    """Archives (archive, content) of orders: o_orderkey % 4 + 1 members in folders, each second one a text."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch["o_orderkey"]:
                members = [
                    (f"f{i}/im_{key}_{i}" + (".jpg" if i % 2 == 0 else ".txt"), str(key).encode() * (i + 1))
                    for i in range(key % 4 + 1)
                ]
                rows.append((f"a_{key}.zip", zip_bytes(members)))
            yield pd.DataFrame(rows, columns=["archive", "content"])

    return orders.mapInPandas(encode, "archive string, content binary")


def encode_jpegs(gps: DataFrame) -> DataFrame:
    """JPEG heads (path, content) of positions in v_gps."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                lat = [(r.lat_d, 1), (r.m, 1), (r.s_num, r.s_den)]
                lon = [(r.lon_d, 1), (r.m, 1), (r.s_num, r.s_den)]
                rows.append((r.name, jpeg_with_gps(lat, r.lat_ref, lon, r.lon_ref)))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return gps.mapInPandas(encode, "path string, content binary")
