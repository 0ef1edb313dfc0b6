"""The substring stage of the thermal match against all pairs."""

import random

import pytest

from heliotab.operators import joins


def best_by_pairs(images, files):
    """Longest name first, then the smaller name, of the files that contain an image's name or lie in it."""
    out = {}
    for folder, stem in images:
        fits = [(-len(n), n, f"/{f}/thermal/{n}") for f, n in files if f == folder for s in [n.rsplit(".", 1)[0].lower()] if s in stem.lower() or stem.lower() in s]
        out[folder, stem] = min(fits)[2] if fits else None
    return out


@pytest.mark.parametrize("block", [3, 20_000])
def test_substrings_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "PATTERNS", block)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randint(1, n)))
    # One folder holds most of the names; one has no thermal files, one no images.
    images = sorted({(rng.choice("AAAAB") if k % 9 else "C", "I" + word(9)) for k in range(250)})
    files = sorted({(rng.choice("AAAAB") if k % 9 else "D", f"{rng.choice(['i', 'x', ''])}{word(5)}{rng.choice(['.tif', '.tiff'])}") for k in range(120)})
    rgb = spark.createDataFrame([(f"/{f}/{s}.jpg",) for f, s in images for _ in range(2)], "path string")
    thermal = spark.createDataFrame([(f"/{f}/thermal/{n}",) for f, n in files], "path string")
    want = best_by_pairs(images, files)
    got = joins.match_thermal(rgb, thermal).collect()
    assert len(got) == 2 * len(images)
    seen = 0
    for r in got:
        key = r.path.split("/")[1], r.path.split("/")[2][:-4]
        if r.stage in (None, "substring"):
            assert r.thermal_path == want[key], r
            seen += r.stage == "substring"
    assert seen > 50
    assert any(r.stage is None for r in got)


def test_the_empty_name_lies_in_every_other(spark):
    rgb = spark.createDataFrame([("/A/.rf.h.jpg",), ("/B/abc.jpg",)], "path string")
    thermal = spark.createDataFrame([("/A/thermal/x.tif",), ("/A/thermal/xy.tif",), ("/B/thermal/.rf.h.tif",)], "path string")
    got = {r.path: r.thermal_path for r in joins.match_thermal(rgb, thermal).collect()}
    assert got["/A/.rf.h.jpg"] == "/A/thermal/xy.tif"


def test_no_files_and_no_images(spark):
    none = spark.createDataFrame([], "path string")
    some = spark.createDataFrame([("/A/thermal/x.tif",)], "path string")
    assert joins.match_thermal(none, some).count() == 0
    assert [r.thermal_path for r in joins.match_thermal(some, none).collect()] == [None]
