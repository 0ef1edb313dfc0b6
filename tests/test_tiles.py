"""Tiles against a plain lookup in the whole plane."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliotab.functions import geo, planes
from heliotab.operators import aggregates, tiles
from heliotab.plans import maps

SCHEMA = "source string, band int, h int, w int, epsg int, x0 double, y0 double, dx double, dy double, px array<double>"


def plain_tile(row, z, x, y, n):
    """Bilinear values pixel by pixel."""
    source, band, h, w, epsg, x0, y0, dx, dy, px = row
    side = 2 * geo.HALF_WORLD / (1 << z)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            gx = x * side - geo.HALF_WORLD + (j + 0.5) * side / n
            gy = geo.HALF_WORLD - y * side - (i + 0.5) * side / n
            if epsg == 4326:
                gx = math.degrees(gx / geo.EARTH_RADIUS)
                gy = math.degrees(2 * math.atan(math.exp(gy / geo.EARTH_RADIUS)) - math.pi / 2)
            u, v = (gx - x0) / dx, (y0 - gy) / dy
            if not (0 <= u < w and 0 <= v < h):
                continue
            fu, fv = min(max(u - 0.5, 0), w - 1), min(max(v - 0.5, 0), h - 1)
            c, r = int(fu), int(fv)
            a, b = fu - c, fv - r
            at = lambda rr, cc: px[min(rr, h - 1) * w + min(cc, w - 1)]  # noqa: B023, E731
            out[i, j] = (at(r, c) * (1 - a) + at(r, c + 1) * a) * (1 - b) + (at(r + 1, c) * (1 - a) + at(r + 1, c + 1) * a) * b
    return out.ravel()


def plane(name, h, w, epsg, x0, y0, step, seed=0):
    px = np.random.default_rng(seed).normal(size=h * w).round(3).tolist()
    return (name, 0, h, w, epsg, x0, y0, step, step, px)


@pytest.mark.parametrize("block, lot", [(4, 1024), (4, 3), (16, 2), (256, 1024)])
def test_tiles_equal_a_plain_lookup(spark, monkeypatch, block, lot):
    monkeypatch.setattr(tiles, "LOT", lot)
    rows = [
        plane("metres", 13, 9, 3857, 1.1e6, 3.3e6, 40_000.0, 1),
        plane("degrees", 8, 17, 4326, -20.0, 61.0, 1.3, 2),
        plane("one", 1, 1, 3857, 0.0, 0.0, 5e5, 3),
        plane("edge", 4, 4, 3857, -geo.HALF_WORLD, geo.HALF_WORLD, geo.HALF_WORLD / 2, 4),
        plane("metres", 13, 9, 3857, 1.1e6, 3.3e6, 40_000.0, 5)[:1] + (1,) + plane("m", 13, 9, 3857, 1.1e6, 3.3e6, 40_000.0, 5)[2:],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for zoom in (0, 4, 6):
        got = {(r.source, r.band, r.x, r.y): np.array(r.px) for r in tiles.reproject_tiles(df, zoom, 8, block=block).collect()}
        touched = tiles.covering_tiles(tiles.source_bounds(df), zoom).select("source", "band", "x", "y").collect()
        assert set(got) == {tuple(r) for r in touched} and len(got) == len(touched)
        for row in rows:
            for (source, band, x, y), px in got.items():
                if (source, band) == row[:2]:
                    assert np.allclose(px, plain_tile(row, zoom, x, y, 8), atol=1e-9)


def test_unreadable_planes_give_tiles_of_0(spark):
    good = plane("good", 3, 3, 3857, 0.0, 0.0, 1e5)
    rows = [good, ("null", *good[1:-1], None), ("short", *good[1:-1], [1.0]), ("none", 0, 0, 0, *good[4:-1], [])]
    got = tiles.reproject_tiles(spark.createDataFrame(rows, SCHEMA), 5, 16).collect()
    assert {r.source for r in got} == {"good", "null", "short", "none"}
    assert any(any(r.px) for r in got if r.source == "good") and not any(any(r.px) for r in got if r.source != "good")
    assert tiles.reproject_tiles(spark.createDataFrame(rows[:0], SCHEMA), 3, 4).count() == 0


def test_full_plane_at_zoom_20_is_cut_into_blocks(spark):
    h, w, step = 512, 640, 0.15
    rng = np.random.default_rng(7)
    px = rng.normal(size=h * w).round(3)
    row = ("s", 0, h, w, 3857, 1000.0, 2000.0, step, step, px.tolist())
    df = spark.createDataFrame([row], SCHEMA)
    blocks = tiles.plane_blocks(df, 256).select("block_row", "block_col", F.length("cells").alias("n")).collect()
    assert sorted((r.block_row, r.block_col) for r in blocks) == [(r, c) for r in range(2) for c in range(3)]
    assert sum(r.n for r in blocks) < 1.02 * h * w * 8
    got = {(r.x, r.y): np.array(r.px) for r in tiles.reproject_tiles(df, 20, block=256).collect()}
    assert len(got) in (9, 12, 16)
    whole = {(r.x, r.y): np.array(r.px) for r in tiles.reproject_tiles(df, 20).collect()}
    assert whole.keys() == got.keys() and all(np.array_equal(whole[k], got[k]) for k in got)
    for (x, y), found in got.items():
        grid = np.add.outer(np.arange(0, 256, 51) * 256, np.arange(0, 256, 51)).ravel()
        want = plain_corner(row, x, y, grid)
        assert np.allclose(found[grid], want, atol=1e-9)


def plain_corner(row, x, y, places):
    """Some pixels of a 256 x 256 tile at zoom 20."""
    side = 2 * geo.HALF_WORLD / (1 << 20)
    _, _, h, w, _, x0, y0, dx, dy, px = row
    out = []
    for p in places:
        i, j = divmod(int(p), 256)
        u = (x * side - geo.HALF_WORLD + (j + 0.5) * side / 256 - x0) / dx
        v = (y0 - (geo.HALF_WORLD - y * side - (i + 0.5) * side / 256)) / dy
        if not (0 <= u < w and 0 <= v < h):
            out.append(0.0)
            continue
        fu, fv = min(max(u - 0.5, 0), w - 1), min(max(v - 0.5, 0), h - 1)
        c, r = int(fu), int(fv)
        at = lambda rr, cc: px[min(rr, h - 1) * w + min(cc, w - 1)]
        a, b = fu - c, fv - r
        out.append((at(r, c) * (1 - a) + at(r, c + 1) * a) * (1 - b) + (at(r + 1, c) * (1 - a) + at(r + 1, c + 1) * a) * b)
    return out


def test_stretch_equals_the_columns(spark):
    nan, inf = float("nan"), float("inf")
    cases = [[1.0, 2.0, 3.0, 50.0], [5.0] * 9, [nan, 1.0, 2.0], [inf, 1.0, -3.0, -inf], [nan, inf], [0.1] * 30 + [0.7]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, px array<double>")
    column = planes.stretch_plane(F.col("px"), aggregates.tile_percentiles(F.col("px")))
    for r in df.select("i", column.alias("u8")).collect():
        assert tiles.stretched(np.array(cases[r.i])).tolist() == r.u8


def test_planes_of_floats_are_sent_as_floats(spark):
    row = plane("s", 20, 30, 3857, 0.0, 0.0, 1e5, 3)
    row = (*row[:-1], [float(np.float32(v)) for v in row[-1]])
    wide = spark.createDataFrame([row], SCHEMA)
    narrow = spark.createDataFrame([row], SCHEMA.replace("px array<double>", "px array<float>"))
    size = lambda df: tiles.plane_blocks(df, 8).select(F.sum(F.length("cells"))).first()[0]
    assert size(wide) == 2 * size(narrow)
    rows = [sorted(map(tuple, tiles.reproject_tiles(df, 5, 16, block=8).collect())) for df in (wide, narrow)]
    assert rows[0] == rows[1] and any(any(r[-1]) for r in rows[0])


def test_map_tiles_are_whole_numbers(spark):
    df = spark.createDataFrame([plane("s", 30, 40, 4326, 10.0, 50.0, 0.01)], SCHEMA)
    rows = maps.map_tiles(df, 10, 32).collect()
    assert rows and all(len(r.px) == 1024 and 0 <= min(r.px) and max(r.px) <= 255 for r in rows)
    assert max(max(r.px) for r in rows) == 255
