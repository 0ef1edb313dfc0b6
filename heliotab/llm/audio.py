"""Operator 2: media columns of MPEG audio.

``probe_audio`` reads the bytes of a column: tags (ID3v2, ID3v1), the variable-bitrate table (Xing/Info or VBRI), every
frame header, resynchronised over damaged parts, and the checksums of protected Layer I and III frames. It gives the
exact duration as a fraction and the offset of every frame, to seek by. ``store_audio`` keeps any bytes without loss in
the main data of silent Layer III frames of varying bitrate, and ``stored_bytes`` reads them back.
"""

from __future__ import annotations

import struct
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from heliotab.llm.common import drop_clashing, whole_text

# Fixed values of the format: kbit/s by version and layer, Hz by version, samples a frame.
_KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits
_SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


@lru_cache(maxsize=1 << 16)
def parse_header(head: bytes) -> tuple[int, int, int, int, int, int] | None:
    """(length, samples, rate, layer, bytes of side information, checksum 0/1) of a frame header, None if it is none."""
    word = int.from_bytes(head, "big")
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, kbits = word >> 10 & 3, word >> 12 & 15
    if len(head) < 4 or word >> 21 != 0x7FF or version == 1 or layer == 4 or rate == 3 or kbits in (0, 15):
        return None
    kind = 1 if version == 3 else 2
    hertz = _RATES[version][rate]
    bits = _KBITS[kind, layer][kbits - 1] * 1000
    samples, pad = _SAMPLES[kind, layer], word >> 9 & 1
    length = (12 * bits // hertz + pad) * 4 if layer == 1 else samples // 8 * bits // hertz + pad
    mono = word >> 6 & 3 == 3
    side = 0
    if layer == 3:
        side = (17 if mono else 32) if kind == 1 else (9 if mono else 17)
    elif layer == 1:  # 4 bits of allocation a band; above the bound both channels share them
        bound = 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 32
        side = 16 if mono else (bound * 8 + (32 - bound) * 4) // 8
    return length, samples, hertz, layer, side, 1 - (word >> 16 & 1)


@lru_cache(maxsize=1 << 14)
def checksum(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005 from 0xFFFF, over the last header bytes and the side information."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _syncsafe(raw: bytes) -> int:
    return sum((b & 127) << 7 * k for k, b in enumerate(reversed(raw)))


def _words(raw: bytes, encoding: int) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(encoding, "latin-1")
    return raw.decode(code, errors="replace").rstrip("\0")


def read_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text tags, and where audio begins and ends."""
    tags: dict[str, str] = {}
    begin, end = 0, len(data)
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= len(data):
        major, flags = data[begin + 3], data[begin + 5]
        stop = min(len(data), begin + 10 + _syncsafe(data[begin + 6 : begin + 10]))
        at = begin + 10
        if flags & 0x40 and at + 4 <= stop:
            extended = data[at : at + 4]
            at += _syncsafe(extended) if major == 4 else 4 + int.from_bytes(extended, "big")
        head = 6 if major == 2 else 10
        while at + head <= stop and data[at]:
            if major == 2:
                name, size = data[at : at + 3], int.from_bytes(data[at + 3 : at + 6], "big")
            else:
                raw = data[at + 4 : at + 8]
                name, size = data[at : at + 4], _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
            body = data[at + head : min(stop, at + head + size)]
            if name[:1] == b"T" and body:
                key, value = name.decode("latin-1"), _words(body[1:], body[0])
                if name in (b"TXXX", b"TXX"):
                    key, _, value = value.partition("\0")
                tags.setdefault(key, value)
            at += head + size
        begin = stop + (10 if flags & 0x10 and major == 4 else 0)
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            value = data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip()
            if value:
                tags.setdefault(key, value)
    return tags, min(begin, end), end


def read_table(frame: bytes, side: int, protected: int) -> dict | None:
    """Frames, bytes and table of contents of a Xing, Info or VBRI header, None if the frame has none."""
    for at in (4 + side, 6 + side) if protected else (4 + side,):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags = int.from_bytes(frame[at + 4 : at + 8], "big")
            out, at = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "toc": None}, at + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and at + 4 <= len(frame):
                    out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4 and at + 100 <= len(frame):
                out["toc"] = list(frame[at : at + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = *struct.unpack(">II", frame[46:54]), *struct.unpack(">HHH", frame[54:60])
        at, toc = 62, []
        if 1 <= width <= 4:
            for _ in range(min(entries, (len(frame) - at) // width)):
                toc.append(int.from_bytes(frame[at : at + width], "big") * scale)
                at += width
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def _synced(data: bytes, at: int, end: int) -> tuple | None:
    """The header at ``at`` if a whole frame stands there and another, or the end, follows."""
    head = parse_header(data[at : at + 4])
    if head is None or at + head[0] > end:
        return None
    after = at + head[0]
    return head if after >= end or (after + 4 <= end and parse_header(data[after : after + 4])) else None


def probe(data: bytes) -> dict:
    """What ``probe_audio`` tells of one file."""
    tags, at, end = read_tags(data)
    out = {"tags": tags, "vbr": None, "offsets": [], "layer": None, "rate": None, "samples": 0}
    out |= {"checked": 0, "bad_checksums": 0, "resyncs": 0, "skipped_bytes": 0}
    duration, lost, first, by_rate = Fraction(0), False, True, {}
    while at < end:
        head = parse_header(data[at : at + 4])
        # In step with the frames before, a whole frame is enough; else the next header must agree too.
        if head is None or at + head[0] > end or (lost or first) and _synced(data, at, end) is None:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out["skipped_bytes"] += step - at
            out["resyncs"] += not lost
            at, lost = step, True
            continue
        length, samples, rate, layer, side, protected = head
        good, frame = True, data[at : at + length]
        if protected and layer != 2 and 6 + side <= length:
            good = checksum(frame[2:4] + frame[6 : 6 + side]) == int.from_bytes(frame[4:6], "big")
            out["checked"] += 1
            out["bad_checksums"] += not good
        table = read_table(frame, side, protected) if first else None
        if table:
            out["vbr"] = table
        else:
            out["offsets"].append(at)
            out["layer"], out["rate"] = out["layer"] or layer, out["rate"] or rate
            out["samples"] += samples
            by_rate[rate] = by_rate.get(rate, 0) + samples
        first = lost = False
        at += length
    for rate, samples in by_rate.items():
        duration += Fraction(samples, rate)
    return out | {"duration_num": duration.numerator, "duration_den": duration.denominator}


PROBED = (
    "frames bigint, samples bigint, rate int, layer int, duration_num bigint, duration_den bigint, checked bigint, "
    "bad_checksums bigint, resyncs bigint, skipped_bytes bigint, offsets array<bigint>, tags map<string,string>, "
    "vbr_kind string, vbr_frames bigint, vbr_bytes bigint, vbr_toc array<bigint>"
)


def _rows(data: bytes | None) -> dict | None:
    if data is None:
        return None
    x = probe(data)
    vbr = x.pop("vbr") or {"kind": None, "frames": None, "bytes": None, "toc": None}
    x["tags"] = list(x["tags"].items())
    return x | {"frames": len(x["offsets"])} | {f"vbr_{k}": v for k, v in vbr.items()}


_ARROW = pa.struct(
    [(n, pa.int64()) for n in ("frames", "samples")]
    + [("rate", pa.int32()), ("layer", pa.int32())]
    + [(n, pa.int64()) for n in ("duration_num", "duration_den", "checked", "bad_checksums", "resyncs")]
    + [("skipped_bytes", pa.int64()), ("offsets", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))]
    + [("vbr_kind", pa.string()), ("vbr_frames", pa.int64()), ("vbr_bytes", pa.int64())]
    + [("vbr_toc", pa.list_(pa.int64()))]
)


def _probe_column(column: pa.Array) -> pa.Array:
    return pa.array([_rows(x.as_py()) for x in column], _ARROW)


_probe_column.__annotations__ = {"column": pa.Array, "return": pa.Array}


def probe_audio(df: DataFrame, media: str = "media", out: str = "audio") -> DataFrame:
    """Add a struct with what the bytes of ``media`` hold.

    Null bytes give a null struct; bytes without a frame give 0 frames, a duration of 0/1 and no offsets. A frame cut
    off by the end of the file doesn't count. Layer II checksums aren't verified (``checked`` says how many were).
    A column with the name of the result is replaced. No shuffle, one row for each row.
    """
    fn = F.arrow_udf(_probe_column, PROBED_TYPE)
    return drop_clashing(df.withColumn("__audio", fn(F.col(media))), out).withColumnRenamed("__audio", out)


PROBED_TYPE = f"struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in PROBED.split(', ')))}>"

# Storage: Layer III, 32 kHz, one channel. At 32 kHz a frame has 4.5 bytes a kbit/s, so no padding is needed.
_SIDE, _RATE_INDEX, _MONO = 17, 2, 0xC0
_SIZES = [144 * k * 1000 // 32000 for k in _KBITS[1, 3]]


@lru_cache(maxsize=32)
def _frame_head(index: int, protected: bool) -> bytes:
    head = bytes((0xFF, 0xFA if protected else 0xFB, index + 1 << 4 | _RATE_INDEX << 2, _MONO))
    side = bytes(_SIDE)
    return head + (checksum(head[2:] + side).to_bytes(2, "big") if protected else b"") + side


def store(payload: bytes, notes: dict[str, int | str]) -> bytes:
    """An audio file of silence whose frames carry ``payload``; equal payloads and notes give equal files."""
    head_size = len(_frame_head(0, True))
    room = [size - head_size for size in _SIZES]
    frames, at = [], 0
    while at < len(payload):
        index = next((k for k, r in enumerate(room) if r >= len(payload) - at), len(room) - 1)
        part = payload[at : at + room[index]]
        frames.append(_frame_head(index, True) + part.ljust(room[index], b"\0"))
        at += room[index]
    bare = _frame_head(0, False)
    total = _SIZES[0] + sum(map(len, frames))
    ends, toc = [_SIZES[0]], bytearray()
    for frame in frames:
        ends.append(ends[-1] + len(frame))
    for k in range(100):
        toc.append(min(255, 256 * ends[len(frames) * k // 100] // total))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)
    body = b""
    for key, value in {"payload_bytes": len(payload), **notes}.items():
        text = b"\3" + key.encode() + b"\0" + str(value).encode()
        body += b"TXXX" + _safe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + _safe(len(body)) + body + (bare + table).ljust(_SIZES[0], b"\0") + b"".join(frames)


def _safe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def unstore(data: bytes) -> bytes | None:
    """The payload of a stored file, None if the file isn't one or is damaged."""
    found = probe(data)
    size = found["tags"].get("payload_bytes", "")
    if not size.isdecimal() or found["bad_checksums"] or found["layer"] not in (3, None):
        return None
    parts = []
    for at in found["offsets"]:
        length, _, _, _, side, protected = parse_header(data[at : at + 4])
        parts.append(data[at + 4 + 2 * protected + side : at + length])
    payload = b"".join(parts)
    return payload[: int(size)] if len(payload) >= int(size) else None


def _store_column(column: pa.Array) -> pa.Array:
    out = []
    for x in column:
        raw = (x.as_py() or "").encode()
        out.append(store(raw + bytes(-len(raw) % 64 if raw else 64), {"text_bytes": len(raw)}))
    return pa.array(out, pa.binary())


def _unstore_column(column: pa.Array) -> pa.Array:
    return pa.array([None if x.as_py() is None else unstore(x.as_py()) for x in column], pa.binary())


for _fn in (_store_column, _unstore_column):
    _fn.__annotations__ = {"column": pa.Array, "return": pa.Array}


def store_audio(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add audio files that hold the texts in UTF-8, filled up with bytes 0 to a positive multiple of 64.

    Null counts as the empty text. Texts are taken whole; equal texts give equal files; repeated rows stay.
    """
    fn = F.arrow_udf(_store_column, BinaryType())
    made = df.withColumn("__media", fn(F.col(text).cast("string")))
    return drop_clashing(made, out).withColumnRenamed("__media", out)


def stored_bytes(df: DataFrame, media: str = "media", out: str = "payload") -> DataFrame:
    """Add the bytes that ``store_audio`` put in; null where the file is null, damaged or another one."""
    fn = F.arrow_udf(_unstore_column, BinaryType())
    made = df.withColumn("__payload", fn(F.col(media)))
    return drop_clashing(made, out).withColumnRenamed("__payload", out)


def media_digests(docs: DataFrame) -> DataFrame:
    """Per document the sizes and digests of its stored form and of the bytes read back, with features of the audio."""
    stored = store_audio(docs.select("doc_id", whole_text().alias("text")))
    read = probe_audio(stored_bytes(stored))
    a = "audio."
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), F.col(a + "frames")),
        F.concat(F.lit("duration="), F.col(a + "duration_num"), F.lit("/"), F.col(a + "duration_den")),
        F.concat(F.lit("rate="), F.col(a + "rate")),
        F.concat(F.lit("checked="), F.col(a + "checked") - F.col(a + "bad_checksums")),
        F.concat(F.lit("vbr="), F.col(a + "vbr_frames"), F.lit(":"), F.col(a + "vbr_bytes")),
        F.concat(F.lit("seek="), F.sha1(F.array_join(a + "offsets", ","))),
    )
    return read.select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
