"""Operators 1, 2 and 3."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from heliotab.llm import audio, mixing
from heliotab.llm.piece_codec import Pieces, decode_pieces, encode_pieces, piece_digests, round_trip

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    with open(MODEL, "rb") as file:
        return Pieces(file.read())


def odd_texts():
    rng = random.Random(1)
    letters = "abcdeéß日 \n.,-=<>0ÀЖ▁\U0001f984the\0"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 150))) for _ in range(600)]
    fixed = ["", " ", "a", " a", "  a  b ", "▁x▁▁y", "<s></s><0x41>", "a" * 3000, " " * 999, "=-" * 500 + "====", "ab" * 999]
    return fixed + made


def test_encoding_equals_the_library(pieces, library):
    for text in odd_texts():
        assert pieces.encode(text, True) == library.encode(text, add_eos=True)


def test_decoding_equals_the_library(pieces, library):
    rng = random.Random(2)
    for text in odd_texts():
        ids = library.encode(text, add_eos=True)
        assert pieces.decode(ids) == library.decode(ids)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), 0, 1, 2]) for _ in range(rng.randrange(12))]
        assert pieces.decode(np.array(ids, dtype=int)) == library.decode(ids)


def test_other_models_are_refused():
    with pytest.raises(Exception):
        Pieces(b"\x08not a model")


def test_codec_on_awkward_rows(spark, awkward, empty, library):
    got = round_trip(awkward, MODEL).select("text", "ids", "decoded").collect()
    assert len(got) == awkward.count()
    for r in got:
        want = library.encode(r.text or "", add_eos=True)
        assert r.ids == want and r.decoded == library.decode(want)
    apart = decode_pieces(encode_pieces(awkward, MODEL), MODEL)
    assert sorted(r.decoded for r in apart.collect()) == sorted(r.decoded for r in got)
    assert "size" in apart.columns
    assert piece_digests(empty, MODEL).count() == 0
    nulls = spark.createDataFrame([(None,), ([],), ([None, 264],)], "ids array<int>")
    assert [r.decoded for r in decode_pieces(nulls, MODEL).collect()] == ["", "", library.decode([0, 264])]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1416, 1417, 5000, 200_000])
def test_audio_holds_any_bytes(size):
    raw = random.Random(size).randbytes(size - size % 2) + b"\xff" * (size % 2)
    stored = audio.store(raw, {"note": "é"})
    assert audio.unstore(stored) == raw
    found = audio.probe(stored)
    assert found["tags"]["note"] == "é" and found["bad_checksums"] == 0 and found["resyncs"] == 0
    assert found["vbr"]["frames"] == len(found["offsets"]) == found["checked"]
    assert found["duration_num"] * 32000 == 1152 * len(found["offsets"]) * found["duration_den"]
    assert all(audio.parse_header(stored[a : a + 4]) for a in found["offsets"])


def test_audio_resynchronises_and_checks():
    stored = audio.store(bytes(range(256)) * 40, {})
    offsets = audio.probe(stored)["offsets"]
    cut = stored[: offsets[3]] + b"\xff\xfb\x00junk" * 9 + stored[offsets[3] :]
    found = audio.probe(cut)
    assert found["resyncs"] == 1 and found["skipped_bytes"] == 63 and len(found["offsets"]) == len(offsets)
    bad = bytearray(stored)
    bad[offsets[2] + 8] ^= 1  # side information
    assert audio.probe(bytes(bad))["bad_checksums"] == 1
    assert audio.unstore(bytes(bad)) is None
    assert audio.unstore(b"nothing") is None and audio.probe(b"")["duration_den"] == 1
    title = b"TAG" + b"Song".ljust(30, b"\0") + bytes(95)
    assert audio.probe(stored + title)["tags"]["title"] == "Song"
    assert len(audio.probe(stored + title)["offsets"]) == len(offsets)


def test_checksum_of_the_format():
    # CRC-16 with polynomial 0x8005 from 0xFFFF, written bit by bit.
    def plain(data):
        crc = 0xFFFF
        for bit in (b >> s & 1 for b in data for s in range(7, -1, -1)):
            top = crc >> 15 ^ bit
            crc = (crc << 1) & 0xFFFF
            crc ^= 0x8005 if top else 0
        return crc

    for data in (b"", b"\0", b"123456789", bytes(range(40))):
        assert audio.checksum(data) == plain(data)


def test_audio_on_awkward_rows(spark, awkward, empty):
    got = audio.media_digests(awkward).collect()
    assert len(got) == awkward.count()
    texts = Counter((r.doc_id, len((r.text or "").encode())) for r in awkward.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_bytes) for r in got) == texts
    for r in got:
        assert r.payload_bytes == max(64, -(-r.n_bytes // 64) * 64)
    blank = [r for r in got if r.n_bytes == 0]
    assert {r.tail_crc32 for r in blank} == {zlib.crc32(bytes(64))} and len({r.media_sha256 for r in blank}) == 1
    assert audio.media_digests(empty).count() == 0
    nulls = spark.createDataFrame([(None,), (b"\xff\xfb",)], "media binary")
    assert [r.payload for r in audio.stored_bytes(nulls).collect()] == [None, None]
    assert [r.audio and r.audio.frames for r in audio.probe_audio(nulls).collect()] == [None, 0]


def water(sizes: dict, weights=(5, 2, 1)):
    """Targets by handing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    free = set(names)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        add = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += add[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_mix_targets_and_draws(spark, awkward, empty):
    rows = mixing.plan_mix(awkward).select("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()
    assert len(rows) == awkward.count()
    sizes = Counter()
    for r in rows:
        words = len([w for w in (r.text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
        assert r.size == words
        sizes[r.source] += words
    want = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.copies <= 2
    again = mixing.plan_mix(awkward.repartition(5)).select("doc_id", "text", "copies").collect()
    assert Counter((r.doc_id, r.text, r.copies) for r in again) == Counter((r.doc_id, r.text, r.copies) for r in rows)
    emitted = mixing.emit_mix(awkward)
    assert emitted.columns == awkward.columns and emitted.count() == sum(r.copies for r in rows)
    assert {r["size"] for r in emitted.select("size").collect()} == {"taken"}
    assert mixing.plan_mix(empty).count() == 0 and mixing.emit_mix(empty).count() == 0


def test_mix_comes_near_its_targets_and_joins_many_sources(spark, monkeypatch):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"),
        F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5)).alias("source"),
    )
    wide = mixing.plan_mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("target").alias("t"))
    for r in wide.collect():
        assert abs(r.n - r.t) < 0.1 * r.t
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    other = mixing.plan_mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("target").alias("t"))
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, wide.collect()))
