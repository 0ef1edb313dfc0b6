"""Operators 4, 7 and 10."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from heliotab.llm import line_templates, near_copies, repeats
from heliotab.llm.components import components

from .conftest import SCHEMA, prose


def test_index_finds_every_later_string():
    rng = random.Random(3)
    for trial in range(15):
        base = bytes(rng.choice(b"ab \0\xc3") for _ in range(500))
        texts = []
        for _ in range(rng.randrange(1, 10)):
            low = rng.randrange(300)
            part = bytearray(base[low : low + rng.randrange(100, 300)])
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = 65
            texts += [bytes(part)] if len(part) >= 100 else []
        texts.append((b"abc1234" * 60)[: rng.randrange(100, 400)])
        seen, want = set(), []
        for t in texts:
            want.append([i for i in range(len(t) - 99) if t[i : i + 100] in seen or seen.add(t[i : i + 100])])
        assert [list(x) for x in repeats.later_strings(texts)] == want


def test_index_statistics_are_those_of_the_text():
    texts = [bytes(random.Random(k % 2).choices(b"xy", k=150)) for k in range(4)]
    index = repeats.RunIndex(texts)
    assert len(index.sample) == len(index.head) < index.n
    joined = "".join(chr(c) for c in index.text)
    for text, start, _, size, found in index.stream():
        for t, s, n, f in zip(text, start, size, found):
            low = index.start[t] + s
            string = joined[low : low + 100]
            assert n == sum(joined.startswith(string, k) for k in range(index.n))
            assert joined[f : f + 100] == string


def covered_bytes(rows):
    """Kept bytes, removed bytes and runs by brute force; rows are (order, text)."""
    seen, out = set(), {}
    for key, raw in sorted(set(rows)):
        mark = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                mark[i : i + 100] = b"\1" * 100
            else:
                seen.add(raw[i : i + 100])
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out[key] = (sum(mark), len(re.findall(b"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 500])
def test_repeats_equal_brute_force(spark, awkward, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    passage = prose(9, 40)
    more = [(100 + k, prose(20 + k, 30) + passage + prose(40 + k, 10), "en", "s", 1) for k in range(12)]
    more += [(90, "abcdefg " * 100, "en", "s", 1), (91, "abcdefg " * 100, "en", "s", 1), (92, "é" * 300, "en", "s", 1)]
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, SCHEMA))
    got = repeats.repeat_digests(docs).collect()
    keyed = docs.select(*repeats.row_key(), "text").collect()
    want = covered_bytes([((r.k_id is None, r.k_id or 0, r.k_text), (r.text or "").encode()) for r in keyed])
    found = Counter((r.doc_id, (r.n_removed, r.n_spans, r.kept_sha256)) for r in got)
    assert found == Counter((r.k_id, want[r.k_id is None, r.k_id or 0, r.k_text]) for r in keyed)


def test_repeats_keep_other_columns(awkward, empty):
    out = repeats.remove_repeats(awkward)
    assert {"size", "label"} <= set(out.columns) and out.columns.count("kept") == 1
    assert out.schema["kept"].dataType.typeName() == "binary"
    assert repeats.repeat_digests(empty).count() == 0


def connect(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[top(a)] = top(b)
    return [top(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    root = connect(300, links)
    least = {}
    for x in range(300):
        least.setdefault(root[x], x)
    assert all(c == least[root[x]] for x, c in got.items())
    assert set(got) == {x for a, b in links for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_rounds_over_few_links_take_few_tasks(spark):
    """Shuffles are dealt over 64 partitions that stay apart; a path of 40 nodes takes several rounds."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        spark.sparkContext.setJobGroup("few links", "few links")
        assert {tuple(r) for r in components(links).collect()} == {(k, 0) for k in range(41)}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup("few links")]
    stages = [tracker.getStageInfo(stage) for job in jobs for stage in job.stageIds]
    assert sum(stage.numCompletedTasks for stage in stages if stage) < 2500


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(5)
    hashed = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    wa, wb = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    a, b = (near_copies.samples(hashed, w, np.array([300]), 4000)[0] for w in (wa, wb))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - want) < 0.03


def weighted_classes(docs):
    """Classes by comparing all pairs."""
    weights = near_copies.shingle_weights(docs)
    rows = docs.select(*near_copies.row_key(), near_copies.F.lower(near_copies.whole_text()).alias("text")).collect()
    hashed, count, sizes, digests = near_copies.shingles(pa.array([r.text for r in rows]))
    weight = count * weights[(hashed & np.uint64(near_copies.BUCKETS - 1)).astype(int)]
    ends = np.cumsum(sizes)
    bags = [dict(zip(hashed[e - n : e].tolist(), weight[e - n : e].tolist())) for e, n in zip(ends, sizes)]
    links = []
    for i, a in enumerate(bags):
        for j in range(i):
            shared = sum(min(w, bags[j].get(s, 0)) for s, w in a.items())
            total = sum(a.values()) + sum(bags[j].values()) - shared
            if digests[i] == digests[j] or shared >= 0.8 * total > 0:
                links.append((i, j))
    root = connect(len(rows), links)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[root[k]].append(r)
    out = Counter()
    for group in groups.values():
        ids = [r.k_id for r in group if r.k_id is not None]
        for r in group:
            out[r.k_id, r.k_text, min(ids) if ids else None] += 1
    return out


def edited(base: str, seed: int, words: int) -> str:
    rng, parts = random.Random(seed), base.split(" ")
    for _ in range(words):
        parts[rng.randrange(len(parts))] = f"edit{rng.randrange(10**6)}"
    return " ".join(parts)


@pytest.mark.parametrize("rounds", [near_copies.ROUNDS, 1])
def test_near_copies_equal_brute_force(spark, awkward, monkeypatch, rounds):
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    base, chain, more = prose(7, 300), prose(8, 300), []
    for k in range(40):
        more.append((200 + k, edited(base, k, k % 9), "en", "s", 1))
    for k in range(8):  # each near the one before only
        chain = edited(chain, 50 + k, 4)
        more.append((300 + k, chain, "en", "s", 1))
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, SCHEMA))
    got = near_copies.near_copy_classes(docs).collect()
    assert Counter((r.k_id, r.k_text, r.class_id) for r in got) == weighted_classes(docs)
    heads = defaultdict(set)
    for r in got:
        if r.first and r.class_id not in (None, 9):  # 9 is the id of two texts, and so of two classes
            heads[r.class_id].add((r.k_id, r.k_text))
    assert heads and all(len(h) == 1 for h in heads.values())


def test_links_of_a_cell_equal_brute_force():
    rng, base = random.Random(5), prose(20, 120)
    texts = [edited(base, k, rng.randrange(9)).lower() for k in range(60)] + ["", "two words", "two words", base.lower() * 3]
    weights = np.random.default_rng(1).uniform(0.2, 1, near_copies.BUCKETS).astype(np.float32)
    bags = []
    for text in texts:
        hashed, count, _, _ = near_copies.shingles(pa.array([text]))
        weight = weights[(hashed & np.uint64(near_copies.BUCKETS - 1)).astype(int)].astype(float)
        bags.append(dict(zip(hashed.tolist(), (count * weight).tolist())))
    part = np.array([rng.randrange(2) for _ in texts])
    for parts in (part, np.zeros_like(part)):
        want = {}
        for i, a in enumerate(bags):
            for j, b in enumerate(bags):
                shared = sum(min(w, b.get(s, 0)) for s, w in a.items())
                total = sum(a.values()) + sum(b.values()) - shared
                if (parts[i] < parts[j] or (not parts.any() and i < j)) and shared >= 0.8 * total > 0:
                    want[i, j] = shared / total
        x, y, found = near_copies.linked_pairs(pa.array(texts), parts, weights, 0.8)
        assert len(want) > 50 and sorted(want) == list(zip(x.tolist(), y.tolist()))
        assert np.allclose(found, [want[p] for p in zip(x.tolist(), y.tolist())])


def test_pairs_of_a_large_bucket_are_no_rows(spark, monkeypatch):
    """Copies that are mostly not similar enough to each other: no table grows with the square of their number."""
    monkeypatch.setattr(near_copies, "CELL_ROWS", 30, raising=False)
    made = []

    def counted(df, pin=near_copies.pin):
        made.append((fixed := pin(df)).count())
        return fixed

    monkeypatch.setattr(near_copies, "pin", counted)
    base = prose(21, 200)
    texts = [edited(base, 300 + k, 1 + k % 8) for k in range(300)]
    docs = spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], SCHEMA)
    got = near_copies.near_copy_classes(docs).collect()
    assert Counter((r.k_id, r.k_text, r.class_id) for r in got) == weighted_classes(docs)
    assert 1 < len({r.class_id for r in got}) < 300
    assert max(made) <= near_copies.BANDS * len(texts)


def test_one_of_each_class_stays(awkward, empty):
    kept = near_copies.drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # 1 and 2 are equal; 3, 4 and a null id nearly so; 5, 6 and 10 have no words; 7 and 8 are long and nearly equal.
    assert sorted(x for x in ids if x is not None) == [1, 3, 5, 7, 9, 9, 11] and ids.count(None) == 1
    assert near_copies.drop_near_copies(empty).count() == 0
    assert near_copies.near_copy_classes(empty).count() == 0


def test_lines_of_recurring_templates_are_dropped(spark):
    stamp = "2024-01-0{} worker {} finished the nightly job without any error"
    rows = [(k, f"{prose(60 + k, 10)}\n{stamp.format(k, k)}\nlogin of {n} came from the main office today at noon\nEnd.", "", "", 0)
            for k, n in enumerate(["ann", "bob", "cleo", "dan", "ann"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    for k in range(1, 5):
        assert "worker" not in got[k].text and "login" not in got[k].text
        assert got[k].n_dropped == 2 and got[k].text.endswith("End.")
    texts = line_templates.template_texts(docs, line_templates.line_templates(docs)).collect()
    assert ["login", "of", "<*>"] in [r.tokens[:3] for r in texts]


def test_few_lines_of_a_leaf_are_compared_without_blocks(spark, monkeypatch):
    """Lines that share a leaf by chance have no blocks; the templates of small leaves are those of all pairs."""
    cut = []

    def counted(left, similar, blocks=line_templates._blocks):
        cut.append(left.count())
        return blocks(left, similar)

    monkeypatch.setattr(line_templates, "_blocks", counted)
    fields = ["one two three four five six", "one two three four five SIX", "a b c d e f", "a b c d e F", "u v w x y z"]
    lines = [f"job {leaf} {tail}" for leaf in ("north", "south") for tail in fields]
    rows = [(k, line, "", "", 0) for k, line in enumerate(lines)] + [(90, "job north a b c d e G\njob west q r s t u v", "", "", 0)]
    got = line_templates.line_templates(spark.createDataFrame(rows, SCHEMA)).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.template].add(r.k_id)
    assert sorted(map(sorted, groups.values())) == [[2, 3, 90]]
    assert not any(cut)


def test_lines_on_awkward_rows(awkward, empty):
    got = line_templates.drop_recurring_lines(awkward)
    assert got.count() == awkward.count() and got.columns.count("n_lines") == 1
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert rows[6, None].n_lines == 0 and rows[5, ""].n_lines == 1
    kept = sum(r.n_lines - r.n_dropped for r in rows.values())
    assert kept > 0 and any(r.n_dropped for r in rows.values())
    assert line_templates.drop_recurring_lines(empty).count() == 0


def test_every_family_of_a_leaf_is_found(spark):
    families = ["in the office of {} the lights went out at noon today", "in the report {} found three new faults on every flat roof",
                "in the end {} sold all of the old panels to a"]
    names = [["ann"] * 4 + ["bob"], ["cleo", "dan", "eve", "fay", "gus"], ["hal", "ian", "joy", "kim", "lee"]]
    rows = [(k, "\n".join(f.format(n[k]) for f, n in zip(families, names)), "", "", 0) for k in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len({(len(f.split()), *f.split()[:2]) for f in families}) == 1
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_templates.drop_recurring_lines(docs).collect()}
    assert got == {0: (0, rows[0][1])} | {k: (3, "") for k in range(1, 5)}


@pytest.mark.parametrize("rounds, pairs", [(line_templates.ROUNDS, line_templates.OPEN_PAIRS), (20, -1), (0, 0)])
def test_seeds_equal_those_taken_one_by_one(spark, monkeypatch, rounds, pairs):
    monkeypatch.setattr(line_templates, "ROUNDS", rounds)
    monkeypatch.setattr(line_templates, "OPEN_PAIRS", pairs)
    rng, lines = random.Random(6), []
    bases = [[rng.choice("abcd") for _ in range(n)] for n in (8, 9, 14) for _ in range(6)]
    for _ in range(250):
        line = list(rng.choice(bases))
        for _ in range(rng.randrange(5)):
            line[rng.randrange(2, len(line))] = rng.choice("abcdxyz")
        lines.append(" ".join(["to", "be", *line[2:]]))
    docs = spark.createDataFrame([(k, x, "", "", 0) for k, x in enumerate(lines)], SCHEMA)
    got = {r.k_id: r.template for r in line_templates.line_templates(docs, min_docs=1).collect()}
    digest = {x: hashlib.md5(x.encode()).digest() for x in lines}
    seeds = []
    for x in sorted(set(lines), key=lambda x: (lines.count(x), digest[x]), reverse=True):
        agree = [s for s in seeds if len(s) == len(x) and sum(map(str.__eq__, x.split(), s.split())) >= 0.75 * len(x.split())]
        joined = {bytes(got[k]) for k, y in enumerate(lines) if y == x}
        assert joined <= {digest[s] for s in agree or [x]} and len(joined) == 1
        seeds += [] if agree else [x]
    assert len(seeds) > 20


def test_rows_of_numbers_stay(spark):
    rows = [(k, f"{k} 40{k} 7\n2021-03-0{k + 1} 17:20 {k}.1\nkWh {k} {k + 5} 1{k} 3 4 2 9\nsum 1 2 3\npage {k} of 9", "", "", 0) for k in range(5)]
    # Three of four tokens are numbers, the fourth is a name.
    rows += [(10 + k, f"{n} stood at 1{k} 2 3 5{k} 8 13 21 3{k} 5", "", "", 0) for k, n in enumerate(["ann"] * 5)]
    # Nearly all that two lines have in common are numbers' places.
    rows += [(20 + k, f"row of {a} {b} {c} 1 2 3 4", "", "", 0) for k, (a, b, c) in enumerate(["xyz", "xuv", "xpq"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()}
    want = {r[0]: r[1] for r in rows}
    for k in range(1, 5):  # equal rows and lines with enough words still recur
        want[k] = want[k].replace("\nsum 1 2 3", "").replace(f"\npage {k} of 9", "")
    assert got == want


def test_links_do_not_depend_on_the_number_of_copies(spark):
    base = prose(70, 103)
    copies = [base, *[edited(base, 900 + k, 2) for k in range(100)]]
    bags = [set(near_copies.shingles(pa.array([t.lower()]))[0].tolist()) for t in copies]
    near = {k for k in range(1, 101) if len(bags[0] & bags[k]) >= 0.81 * len(bags[0] | bags[k])}
    assert len(near) > 50
    for rows in (2020, 303, 202):  # 5, 33 and 50 %
        others = [prose(2000 + k, 30) for k in range(rows - len(copies))]
        docs = spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(copies + others)], SCHEMA)
        got = {r.k_id: r.class_id for r in near_copies.near_copy_classes(docs).collect()}
        assert all(got[k] == 0 for k in near)
        weights = near_copies.shingle_weights(docs)
        hashed = near_copies.shingles(pa.array([base.lower()]))[0]
        assert weights[(hashed & np.uint64(near_copies.BUCKETS - 1)).astype(int)].min() > 0.9


@pytest.mark.parametrize("piece", [1, 7, 512])
@pytest.mark.parametrize("seed", range(4))
def test_texts_that_share_nothing_are_left_out(monkeypatch, seed, piece):
    """Segments of a few keys, cut out of edited copies: marks equal those of the whole index."""
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = random.Random(seed)
    bases = [bytes(rng.choice(b"abcdefgh ") for _ in range(700)) for _ in range(5)]
    rows = []
    for k in range(60):
        raw = bytearray(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 3])):
            raw[rng.randrange(len(raw))] = rng.choice(b"xyz")
        if k % 9 == 0:
            raw += raw[200:420] * 2
        data, offsets = np.frombuffer(bytes(raw), np.uint8), np.array([0, len(raw)])
        key, _, start, n, digest, _ = repeats.segments(data, offsets)
        rows += [(int(a.astype(np.int64)), k, int(s), bytes(raw[s : s + m + repeats.MATCH - 1]), int(d)) for a, s, m, d in zip(key, start, n, digest)]
    rows.sort()
    once = {}
    for row in rows:
        once.setdefault((row[0], row[4]), row)
    rows = sorted(once.values())
    texts, keys = [r[3] for r in rows], np.array([r[0] for r in rows])
    want = repeats.later_strings(texts)
    got = repeats._later_of_keys(texts, keys)
    assert [x.tolist() for x in got] == [x.tolist() for x in want] and sum(map(len, want)) > 100
    shared, head = repeats._may_share(texts, keys)
    assert not shared.all() and head.any()


def test_kept_bytes_equal_plain_cutting():
    rng = random.Random(6)
    texts, spans = [], []
    for _ in range(60):
        text = rng.choice([None, "", prose(rng.randrange(9), rng.randrange(1, 60))])
        n = len((text or "").encode())
        cut = sorted(rng.sample(range(n + 1), 2)) if n > 3 else None
        spans.append(None if cut is None else [dict(lo=cut[0], hi=cut[1])] + [dict(lo=a, hi=min(n, a + 9)) for a in rng.sample(range(n), 2)] + [dict(lo=0, hi=2)])
        texts.append(text)
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    got = repeats._keep(pa.array(texts, pa.string()), pa.array(spans, kind)).to_pylist()
    for text, listed, row in zip(texts, spans, got):
        raw = (text or "").encode()
        gone = [any(s["lo"] <= i < s["hi"] for s in listed or []) for i in range(len(raw))]
        assert row["kept"] == bytes(b for b, g in zip(raw, gone) if not g)
        runs = [i for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1])]
        assert [s["lo"] for s in row["spans"]] == runs and sum(s["hi"] - s["lo"] for s in row["spans"]) == sum(gone)
