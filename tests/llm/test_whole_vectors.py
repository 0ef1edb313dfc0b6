"""Operators 11 to 13 against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliotab.llm import bit_slices, gnat_codes, subvector_clusters

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<double>, label int"
CLASHING = ("v", "asks", "rank", "score", "query_id", "width", "part", "code", "error", "label_error", "cluster", "distance",
            "inertia", "codebooks_sha256", "ids", "known", "planes", "of")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("taken") for n in CLASHING})


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]


def whole(vector, scale):
    return [int(np.floor(scale * x)) for x in vector]


def drawn(seed, n, width, spread=1.0, few=False):
    """Rows with repeated vectors, rows and labels; ``few``: few different components, so that much ties."""
    rng = random.Random(seed)
    value = (lambda: rng.choice([-0.5, 0.0, 0.25])) if few else (lambda: rng.gauss(0, spread))
    rows = []
    for k in range(n):
        rows.append((k, [value() for _ in range(width)], rng.choice([None, 0, 1, 2])))
        if k % 7 == 3:
            rows.append((k, rows[rng.randrange(len(rows))][1], 1))
        if k % 11 == 5:
            rows.append((n + k, rows[0][1], 0))
    rng.shuffle(rows)
    return rows


ODD = [
    (0, [0.5, -0.25, 0.125, 1.0], 1), (0, [0.5, -0.25, 0.125, 1.0], 1), (0, [0.25, 0.0, 0.0, 1.0], None), (1, None, 1),
    (2, [], 1), (3, [NAN, 0.0, 0.0, 0.0], 1), (4, [INF, 0.0, 0.0, 0.0], 1), (5, [None, 0.0, 0.0, 0.0], 1), (6, [0.0] * 4, None),
    (7, [1.0, 2.0], 1), (None, [0.5, -0.25, 0.125, 1.0], 2), (None, [-0.001, 0.001, -9.0, 9.0], None), (100, [0.0] * 4, 1),
    (200, [], 1), (300, [2.0, 1.0], 1), (400, [1.0] * 8, 0),
]


# ------------------------------------------------------------------------------------------------- operator 11


def best_rows(rows, step, k, scale=1024):
    """(query_id, rank, vec_id, score) by comparing all with all."""
    kept = usable(rows)
    asked = {}
    for i, v, _ in kept:
        if i is not None and i % step == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        score = [
            (-sum(a * b for a, b in zip(whole(v, scale), whole(w, scale))), i is None, i or 0)
            for i, w, _ in kept if i != q and len(w) == len(v)
        ]
        out += [(q, n + 1, None if unknown else i, -s) for n, (s, unknown, i) in enumerate(sorted(score)[:k])]
    return sorted(out, key=lambda r: r[:2])


def found_rows(df, step, k):
    return sorted((tuple(r) for r in bit_slices.top_scores(df, F.col("vec_id") % step == 0, k).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed, width, few", [(1, 16, False), (2, 5, True), (3, 64, False), (4, 1, True)])
def test_top_scores_equal_all_pairs(spark, monkeypatch, seed, width, few):
    monkeypatch.setattr(bit_slices, "PART", 200)
    rows = drawn(seed, 500, width, 0.2, few)
    assert found_rows(table(spark, rows), 10, 7) == best_rows(rows, 10, 7)


def test_top_scores_of_odd_rows(spark):
    assert found_rows(table(spark, ODD), 100, 3) == best_rows(ODD, 100, 3)
    assert found_rows(table(spark, ODD), 100, 50) == best_rows(ODD, 100, 50)
    assert found_rows(table(spark, ODD).limit(0), 100, 3) == []
    assert found_rows(table(spark, [(0, [1.0], 1)]), 100, 3) == []


def test_top_scores_need_room(spark):
    df = table(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)])
    with pytest.raises(Exception, match="must lie within"):
        found_rows(df, 100, 3)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 200), st.integers(0, 6), st.integers(0, 40), st.integers(0, 2**32), st.integers(1, 8))
def test_blocks_add_and_bound(n, width, spread, seed, slices):
    rng = np.random.default_rng(seed)
    values = rng.integers(-(1 << spread % 26), 1 << spread % 26, size=(n, width), endpoint=True)
    weights = rng.integers(-(1 << spread % 20), 1 << spread % 20, size=width, endpoint=True)
    block = bit_slices.Block(np.arange(n), np.ones(n, bool), values, slices)
    again = bit_slices.Block.loads(width, **block.dumps())
    assert again.shift == block.shift and (again.planes == block.planes).all() and (again.every == block.every).all()
    added = block.add(weights)
    flags = [np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(object) for s in added]
    sums = sum((f << p for p, f in enumerate(flags)), np.zeros(n, dtype=object))
    a, least, spare = block.bounds(weights)
    score = values @ weights
    floor_ = np.array([(s - a) * (1 << block.shift) + least for s in sums], dtype=object)
    assert (floor_ <= score).all() and (score <= floor_ + spare).all()
    for k in (1, 3, n):
        cut = sorted(sums)[-min(k, n)]
        assert bit_slices._rows(bit_slices.largest(added, block.every, k)).tolist() == np.flatnonzero(sums >= cut).tolist()
    for bound in (0, 1, int(sums[0]), int(sums[0]) + 1, int(max(sums)) + 1):
        assert bit_slices._rows(bit_slices.reaching(added, block.every, bound)).tolist() == np.flatnonzero(sums >= bound).tolist()


# ------------------------------------------------------------------------------------------------- operator 12


def codes_by_hand(rows, parts, entries, rounds, scale):
    """Plain rounds over Python integers: ([(vec_id, code, error, label_error)], digest)."""
    kept = usable(rows)
    lengths = [len(v) for _, v, _ in kept if v and len(v) % parts == 0]
    width = min(set(lengths), key=lambda w: (-lengths.count(w), w))
    each = width // parts
    cut = lambda v: [whole(v, scale)[p * each : (p + 1) * each] for p in range(parts)]
    alike = [(i, cut(v), v) for i, v, _ in kept if len(v) == width]
    first = {}
    for i, c, v in alike:
        if i not in first or v < first[i][1]:
            first[i] = (c, v)
    start = [first[i][0] for i in sorted(first, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[s[p] for s in start] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, s: min((apart(s, e), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            held = {}
            for _, c, _ in alike:
                held.setdefault(near(p, c[p])[1], []).append(c[p])
            fresh.append([[sum(x) // len(held[n]) for x in zip(*held[n])] if n in held else e for n, e in enumerate(books[p])])
        books = fresh
    out = []
    for i, v, label in kept:
        if len(v) != width:
            out.append((i, None, None, label))
            continue
        best = [near(p, s) for p, s in enumerate(cut(v))]
        out.append((i, "".join(f"{n:02x}" for _, n in best), sum(d for d, _ in best), label))
    of = lambda label: [e for _, _, e, l in out if l == label and e is not None]  # noqa: E731, E741
    whole_book = ",".join(str(x) for book in books for e in book for x in e)
    rows = [(i, c, e, sum(of(label)) if of(label) else None) for i, c, e, label in out]
    return rows, hashlib.sha256(whole_book.encode()).hexdigest()


def order(row):
    return [(x is None, x if x is not None else 0) if not isinstance(x, str) else (False, x) for x in row]


@pytest.mark.parametrize("seed, width, few", [(1, 16, False), (2, 8, True), (3, 24, True)])
def test_codes_equal_plain_rounds(spark, seed, width, few):
    rows = drawn(seed, 300, width, 0.3, few)
    got = gnat_codes.vector_codes(table(spark, rows), 8, 16, 3).collect()
    want, digest = codes_by_hand(rows, 8, 16, 3, 4096)
    assert sorted((tuple(r)[:4] for r in got), key=order) == sorted(want, key=order)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_of_odd_rows(spark):
    got = gnat_codes.vector_codes(table(spark, ODD), 2, 4, 2).collect()
    want, digest = codes_by_hand(ODD, 2, 4, 2, 4096)
    assert sorted((tuple(r)[:4] for r in got), key=order) == sorted(want, key=order)
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert gnat_codes.vector_codes(table(spark, ODD).limit(0)).count() == 0
    one = gnat_codes.vector_codes(table(spark, [(None, [1.0] * 8, None), (3, None, 1)])).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(None, "00" * 8, 0, 0)]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(1, 8), st.sampled_from([1, 3, 900, 1 << 26]), st.integers(0, 2**32), st.integers(2, 5))
def test_trees_lose_no_nearest_entry(n, width, spread, seed, degree):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-spread, spread, size=(n, width), endpoint=True)
    x = np.concatenate([entries, rng.integers(-spread, spread, size=(80, width), endpoint=True)])
    code, squared, measured = gnat_codes.Codebook(entries, degree).nearest(x)
    full = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == full.argmin(axis=1)).all() and (squared == full.min(axis=1)).all()
    assert measured <= n * len(x)


def test_trees_rule_subtrees_out():
    rng = np.random.default_rng(0)
    entries = rng.integers(-1000, 1000, size=(64, 2))
    x = entries[rng.integers(0, 64, 5000)] + rng.integers(-9, 9, size=(5000, 2))
    assert gnat_codes.Codebook(entries).nearest(x)[2] < 0.3 * 64 * len(x)


# ------------------------------------------------------------------------------------------------- operator 13


def clusters_by_hand(rows, clusters, rounds, width, scale=1024):
    kept = [(i, whole(v, scale), v) for i, v, _ in usable(rows) if len(v) == width]
    hashed = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[2])
    centroids = [v for _, v, _ in sorted(kept, key=hashed)[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        held = {}
        for _, v, _ in kept:
            held.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(held[n]) for x in zip(*held[n])] if n in held else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v, _ in kept]
    spent = lambda c: sum(d for _, n, d in found if n == c)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, spent(c), sum(f[2] for f in found), digest[c]) for i, c, d in found]


@pytest.mark.parametrize("seed, width, few, block", [(1, 16, False, 2), (2, 5, True, 2), (3, 9, True, 4), (4, 1, False, 3)])
def test_clusters_equal_plain_rounds(spark, monkeypatch, seed, width, few, block):
    monkeypatch.setattr(subvector_clusters, "CHUNK", 100)
    rows = drawn(seed, 400, width, 0.3, few)
    got = subvector_clusters.subvector_clusters(table(spark, rows), 8, 4, width, block=block).collect()
    assert sorted(map(tuple, got), key=order) == sorted(clusters_by_hand(rows, 8, 4, width), key=order)


def test_clusters_of_odd_rows(spark):
    for clusters in (2, 8, 40):
        got = subvector_clusters.subvector_clusters(table(spark, ODD), clusters, 3, 4).collect()
        assert sorted(map(tuple, got), key=order) == sorted(clusters_by_hand(ODD, clusters, 3, 4), key=order)
    none = subvector_clusters.subvector_clusters(table(spark, ODD).limit(0))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert none.count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 90), st.integers(1, 9), st.sampled_from([1, 4, 1 << 26]), st.integers(0, 2**32), st.integers(1, 4))
def test_dictionaries_lose_nothing(n, width, spread, seed, block):
    rng = np.random.default_rng(seed)
    values = rng.integers(-spread, spread, size=(n, width), endpoint=True)
    chunk = subvector_clusters.Chunk.encode(np.arange(n), np.ones(n, bool), values, block)
    chunk = subvector_clusters.Chunk.loads(width, block, **chunk.dumps())
    assert (chunk.values() == values).all()
    assert all(len(np.unique(e, axis=0)) == len(e) for e in chunk.entries)
    centroids = rng.integers(-spread, spread, size=(5, width), endpoint=True)
    owner, squared = chunk.nearest(centroids)
    full = ((values[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (owner == full.argmin(axis=1)).all() and (squared == full.min(axis=1)).all()
    assert (chunk.sums(owner, 5) == np.stack([values[owner == c].sum(axis=0) for c in range(5)])).all()
