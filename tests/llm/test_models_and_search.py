"""Operators 5, 6, 8 and 9, and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliotab.llm import license_scan, neighbours, quality, toxic_spans

from .conftest import SCHEMA, prose

SF = "/root/testdata/sf0.01"


def exact(ids, x, k=5):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = y @ y[q]
        score[q] = -2
        order = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        out[int(ids[q])] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("chunk", [neighbours.CHUNK, 100])
def test_neighbours_reach_their_recall(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "QUERY_CHUNK", 7)
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.nearest_neighbours(docs, F.col("vec_id") % 50 == 0).collect()
    rows = docs.collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float))
    hits = sum(len({v for v, _ in w} & {r.vec_id for r in got if r.query_id == q}) for q, w in want.items())
    assert hits >= 0.9 * 5 * len(want)
    assert Counter(r.query_id for r in got) == dict.fromkeys(want, 5)
    for r in got:
        best = dict(want[r.query_id])
        assert r.vec_id not in best or abs(best[r.vec_id] - r.score) < 1e-12


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1e30, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 1.0, 1.0]), (50, [0.0, 0.0]), (None, [1.0, 0.0]),
            (100, [-1.0, 0.0]), (100, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("taken"))
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [
        (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 100), (0, 5, 100), (100, 1, 3), (100, 2, 0), (100, 3, 1), (100, 4, 2),
    ]
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("chunk", [neighbours.CHUNK, 37])
def test_equal_vectors_are_ranked_by_id(spark, monkeypatch, chunk):
    """Groups of 61 vectors, all but the query equal, over several chunks."""
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(40):
        base = rng.normal(size=64)
        rows += [(g * 61 + k, (base + (0.01 * rng.normal(size=64) if (g * 61 + k) % 50 == 0 else 0)).tolist()) for k in range(61)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    for q, found in got.items():
        equal = [i for i in range(q // 61 * 61, q // 61 * 61 + 61) if i % 50][:5]
        assert [r.vec_id for r in found] == equal
        assert len({r.score for r in found}) == 1
    assert len(got) == 49


def test_abandoning_candidates_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64))
    index = neighbours.fit(x, len(x), 5)
    number, found, _ = neighbours.scan(index, x, np.arange(3000), q, np.full(20, -1), 5)
    score = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    want = np.argsort(-score, axis=1)[:, :5]
    assert sum(len(set(found[number == k]) & set(want[k])) for k in range(20)) >= 97


def aligned(template, text):
    """Best local alignment without a band: (score, matched)."""
    best, before = (0, 0), [(0, 0)] * (len(text) + 1)
    for a in template:
        now = [(0, 0)]
        for j, b in enumerate(text):
            s, m = before[j]
            options = [(s + (1 if a == b else -1), m + (a == b))]
            options += [(o[0] - 1, o[1]) for o in (before[j + 1], now[-1])]
            top = max(options, key=lambda o: o[0])
            now.append(top if top[0] > 0 else (0, 0))
            best = max(best, now[-1], key=lambda o: o[0])
        before = now
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        template = [rng.randrange(1, 40) for _ in range(24)]
        text = list(template)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(text))
            text[k : k + 1] = rng.choice([[], [99], [text[k], 98]])
        wide = 4
        text = ([0] * wide + text + [0] * 99)[: len(template) + 2 * wide]
        got = license_scan.align(np.array(template), np.array([text]), wide)
        assert (got[0][0], got[1][0]) == aligned(template, [t if t else -1 for t in text])


def test_license_matches_and_spans(spark, awkward, empty):
    mit = license_scan.LICENSES["mit"]
    changed = mit.replace("free of charge, ", "").replace("merge", "combine")
    rows = [(1, f"{prose(1, 30)} {changed} {prose(2, 30)}\nReleased under the MIT License.", "", "", 0),
            (2, "ALL RIGHTS   RESERVED! All rights reserved", "", "", 0), (3, prose(3, 500), "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = license_scan.scan_licenses(docs).collect()
    text = {r[0]: r[1].encode() for r in rows}
    found = Counter((r.doc_id, r.template) for r in got)
    assert found == {(1, "mit"): 1, (1, "mit-line"): 1, (2, "all-rights-reserved"): 2}
    long = next(r for r in got if r.template == "mit")
    assert long.matched == len(license_scan.Index(["mit"], [mit]).words[0]) - 4
    span = text[1][long.start_byte : long.end_byte].decode()
    assert span.startswith("Permission") and span.endswith("Software")
    table = spark.createDataFrame([("own", rows[2][1][:300]), (None, "x"), ("short", "two words")], "template string, text string")
    assert [(r.doc_id, r.template) for r in license_scan.scan_licenses(docs, table).collect()] == [(3, "own")]
    odd = license_scan.scan_licenses(awkward)
    assert odd.count() == 0 and odd.columns.count("coverage") == 1
    assert license_scan.scan_licenses(empty).count() == 0


def test_marginals_equal_plain_sums():
    rng = np.random.default_rng(0)
    n = 500
    evidence, first = rng.normal(size=n) * 2, rng.random(n) < 0.1
    first[0] = True
    change, begin = rng.normal(size=(2, 2)), rng.normal(size=2)
    chain = toxic_spans.Chain(evidence, first, change, begin)
    edges = [*np.flatnonzero(first), n]
    for a, b in zip(edges, edges[1:]):
        odds = np.stack([np.ones(b - a), np.exp(evidence[a:b])], axis=1)
        forward = [np.exp(begin) * odds[0]]
        for t in range(1, b - a):
            forward.append(forward[-1] @ np.exp(change) * odds[t])
        backward = [np.ones(2)]
        for t in range(b - a - 1, 0, -1):
            backward.append(np.exp(change) @ (odds[t] * backward[-1]))
        for t, (x, y) in enumerate(zip(forward, backward[::-1])):
            assert abs(chain.marginal[a + t] - x[1] * y[1] / (x @ y)) < 1e-12


def accuracy(spark, scored, label, limit):
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    assert len(rows) > 300
    return sum(r.predicted == r[label] for r in rows) / len(rows) >= limit


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    toxic = toxic_spans.toxicity(docs, labels).cache()
    assert accuracy(spark, toxic, "toxic", 0.97)
    good = quality.quality(docs, labels).cache()
    assert accuracy(spark, good, "quality", 0.97)
    for scored, folds, held in ((toxic, 5, 0), (good, 4, 2)):
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)


def test_models_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame(
        [(1, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1), (7, None, None), (11, 0, 1)], "doc_id bigint, quality int, toxic int"
    )
    none = labels.limit(0)
    for docs in (awkward, empty):
        for known in (labels, none):
            for scored in (toxic_spans.toxicity(docs, known), quality.quality(docs, known)):
                rows = scored.collect()
                assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_toxic_spans_are_byte_offsets():
    rng = random.Random(2)
    clean = [prose(k, 60) for k in range(200)]
    toxic = []
    for k in range(200):
        parts = prose(500 + k, 60).split(" ")
        parts.insert(rng.randrange(len(parts)), "nasté")
        toxic.append(" ".join(parts))
    model = toxic_spans.fit(pa.array(clean + toxic), np.array([0] * 200 + [1] * 200), 0.5)
    made = pa.struct([("score", pa.float64()), ("spans", toxic_spans._SPAN)])
    text = "é a very NASTé thing\nand a nasté"
    got = toxic_spans._tag(pa.array([text, "", prose(999, 50)]), model, made).to_pylist()
    raw = text.encode()
    assert [raw[s["start"] : s["end"]].decode().lower() for s in got[0]["spans"]] == ["nasté", "nasté"]
    assert got[0]["score"] > 0.5 > got[1]["score"] and got[1]["spans"] == [] and got[2]["score"] < 0.5


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input: columns kept, its decision taken, the rest left alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        if name == "quality classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
            good = labels.join(before, "doc_id").count()
            assert docs.count() < before.count() and labels.join(docs, "doc_id").count() >= 0.97 * good
        if name == "near copies":
            assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.filter("n_tokens < 1").count() == 0


def test_pipeline_of_no_documents(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
