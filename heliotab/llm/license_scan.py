"""Operator 6: license scan.

Winnowed fingerprints of template texts stand in an inverted index. Every run of GRAM words of a document is looked up
in it; hits on one template that lie on about the same diagonal make a candidate. A banded alignment of the words of the
template with the words around the hits then tells how much of the template is matched, and where.

Winnowing keeps a fingerprint in every window of WINDOW runs of a template, so any GRAM + WINDOW - 1 words in common
are found.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.llm.common import LOWER, Prefix, mix64, ragged, slices_by_bytes, text_buffer, token_spans, whole_text

GRAM, WINDOW = 3, 4  # words a fingerprint, fingerprints a window
COVERED = 0.8  # part of the template's words that has to match
INDEX_BYTES = 8 << 20  # of template text in one broadcast index; more templates make more passes
MIXER = np.uint64(0x9E3779B97F4A7C15)

# Customary notices, word for word.
LICENSES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit-line": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def words(column: pa.Array):
    """Word hashes of a batch of texts in lower case, row of each, and its start and end in the batch's bytes."""
    data, offsets = text_buffer(column)
    start, end, row = token_spans(data, offsets)
    hashed = Prefix(LOWER[data]).parts(start, end) if len(start) else np.zeros(0, np.uint64)
    return hashed, row, start, end, offsets


def grams(hashed: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every run of GRAM words of one text."""
    n = len(hashed) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        mixed = mixed * MIXER + hashed[k : k + n]
    at = np.flatnonzero(row[:n] == row[GRAM - 1 :])
    return mix64(mixed[at]), at


def band(n: int) -> int:
    return max(2, n // 8)


class Index:
    """Fingerprints of templates. A template with fewer than GRAM words can't be found."""

    def __init__(self, names: list[str], texts: list[str]):
        self.names, self.words = [], []
        fingerprint, template, place = [], [], []
        for name, text in zip(names, texts):
            hashed, row, *_ = words(pa.array([text]))
            gram, at = grams(hashed, row)
            if not len(gram):
                continue
            chosen = set()
            for low in range(max(1, len(gram) - WINDOW + 1)):
                part = gram[low : low + WINDOW]
                chosen.add(low + len(part) - 1 - int(np.argmin(part[::-1])))  # the last of the least
            number = len(self.names)
            self.names.append(name)
            self.words.append(hashed)
            for k in sorted(chosen):
                fingerprint.append(int(gram[k]))
                template.append(number)
                place.append(int(at[k]))
        order = np.argsort(np.array(fingerprint, dtype=np.uint64), kind="stable")
        self.fingerprint = np.array(fingerprint, dtype=np.uint64)[order]
        self.template = np.array(template, dtype=np.int64)[order]
        self.place = np.array(place, dtype=np.int64)[order]
        self.quick = np.zeros(1 << 16, dtype=bool)
        self.quick[(self.fingerprint & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number in the batch, template and place in it for every pair of equal fingerprints."""
        maybe = np.flatnonzero(self.quick[(gram & np.uint64(0xFFFF)).astype(np.int64)])
        low = np.searchsorted(self.fingerprint, gram[maybe], side="left")
        count = np.searchsorted(self.fingerprint, gram[maybe], side="right") - low
        entry = ragged(low, count)
        return np.repeat(at[maybe], count), self.template[entry], self.place[entry]


def align(template: np.ndarray, texts: np.ndarray, wide: int):
    """Local alignment in a band, of one template with many texts of its length plus twice ``wide`` words.

    A match counts 1, another word, a missing and an extra word -1. Gives score, matched words, and the first and last
    word of the text in the best alignment (-1 where nothing matches), for each text. A value of 0 in a text is no word.
    """
    n, many = len(template), len(texts)
    reach = 2 * wide + 1
    zero = np.zeros(many, dtype=np.int64)
    # By place in the band: score, matched words, first word of the alignment that ends there.
    before = [(zero, zero, zero - 1)] * (reach + 1)
    best = [zero.copy(), zero.copy(), zero - 1, zero - 1]
    for i in range(n):
        now = []
        left = (zero, zero, zero - 1)
        for j in range(reach):
            at = i + j  # word of the text
            same = texts[:, at] == template[i]
            score, matched, first = before[j]
            s = score + np.where(same, 1, -1)
            m = matched + same
            f = np.where(score > 0, first, at)
            for other, m2, f2 in (before[j + 1], left):
                better = other - 1 > s
                s, m, f = np.where(better, other - 1, s), np.where(better, m2, m), np.where(better, f2, f)
            dead = s <= 0
            left = (np.where(dead, 0, s), np.where(dead, 0, m), np.where(dead, -1, f))
            now.append(left)
            top = left[0] > best[0]
            for slot, value in enumerate((*left, at)):
                best[slot] = np.where(top, value, best[slot])
        before = [*now, (zero, zero, zero - 1)]
    return best


def scan(column: pa.Array, index: Index, covered: float = COVERED):
    """Matches in a batch: row, template, matched words, score, start and end in the row's bytes."""
    hashed, row, start, end, offsets = words(column)
    word, template, place = index.hits(*grams(hashed, row))
    found = []
    for t in np.unique(template):
        mine = template == t
        text = index.words[t]
        n, wide = len(text), band(len(text))
        # Candidates: hits of one row whose diagonals are near each other.
        diagonal, owner = word[mine] - place[mine], row[word[mine]]
        order = np.lexsort((diagonal, owner))
        diagonal, owner = diagonal[order], owner[order]
        apart = np.r_[True, (owner[1:] != owner[:-1]) | (np.diff(diagonal) > wide)]
        heads = np.flatnonzero(apart)
        sizes = np.diff(np.r_[heads, len(diagonal)])
        # A cluster of hits that drifts further than the band is covered by several bands.
        low, high = diagonal[heads], diagonal[heads + sizes - 1]
        steps = (high - low) // (wide + 1) + 1
        centre = np.repeat(low, steps) + (ragged(np.zeros(len(steps), np.int64), steps)) * (wide + 1) + wide // 2
        who = np.repeat(owner[heads], steps)
        for a in range(0, len(centre), 4096):
            c, r = centre[a : a + 4096], who[a : a + 4096]
            spots = (c - wide)[:, None] + np.arange(n + 2 * wide)
            inside = (spots >= 0) & (spots < len(hashed))
            spots = np.clip(spots, 0, len(hashed) - 1)
            inside &= row[spots] == r[:, None]
            score, matched, first, last = align(text, np.where(inside, hashed[spots], 0), wide)
            good = np.flatnonzero(matched >= covered * n)
            line = np.arange(len(c))
            found.append((r[good], np.full(len(good), t), matched[good], score[good],
                          spots[line, first.clip(0)][good], spots[line, last.clip(0)][good]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    r, t, matched, score, first, last = map(np.concatenate, zip(*found))
    # Of matches of one template that overlap, the best stays: most words, then the earliest.
    kept: list[int] = []
    ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in np.lexsort((first, -matched, t, r)).tolist():
        spans = ends.setdefault((int(r[k]), int(t[k])), [])
        at = np.searchsorted([s[0] for s in spans], last[k], side="right") if spans else 0
        if not at or spans[at - 1][1] < first[k]:
            spans.insert(at, (int(first[k]), int(last[k])))
            kept.append(k)
    kept = np.array(sorted(kept), dtype=np.int64)
    r = r[kept]
    return r, t[kept], matched[kept], score[kept], start[first[kept]] - offsets[r], end[last[kept]] - offsets[r]


def scan_licenses(
    docs: DataFrame, templates: DataFrame | Mapping[str, str] = LICENSES, covered: float = COVERED, text: str = "text"
) -> DataFrame:
    """One row a match: the columns of ``docs`` but the text, with template, matched (words), coverage, score, and the
    span ``start_byte`` to ``end_byte`` in the UTF-8 text.

    ``templates`` are texts by name, or a table (template, text); nulls in it and templates with fewer than three words
    match nothing. Null and empty texts have no match; repeated rows have the same ones. Matches of one template in a
    document don't overlap. Columns of ``docs`` that have the names of results are replaced. No shuffle: templates are
    broadcast in blocks of at most INDEX_BYTES of text, each a pass over the documents.
    """
    spark = docs.sparkSession
    added = ("template", "matched", "coverage", "score", "start_byte", "end_byte")
    taken = {*added, text.lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in taken]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += (", " if kept else "") + "template string, matched int, coverage double, score int"
    schema += ", start_byte bigint, end_byte bigint"
    sent_docs = docs.select(*[docs[f.name] for f in kept], whole_text(docs[text]).alias("__text"))

    def blocks() -> Iterator[Index]:
        if not isinstance(templates, DataFrame):
            yield Index(list(templates), list(templates.values()))
            return
        known = templates.filter("template IS NOT NULL AND text IS NOT NULL").select("template", "text")
        size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        many = -(-int(size) // (INDEX_BYTES // 2)) or 1
        for k in range(many):
            part = known.filter(F.pmod(F.xxhash64("template", "text"), F.lit(many)) == k)
            rows = part.orderBy("template", "text").toArrow()
            yield Index(rows["template"].to_pylist(), rows["text"].to_pylist())

    def passed(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part in slices_by_bytes(batch, "__text", 2_000_000):
                    r, t, matched, score, first, last = scan(part.column(part.num_columns - 1), index, covered)
                    columns = [c.take(pa.array(r)) for c in part.columns[:-1]]
                    n = np.array([len(w) for w in index.words] or [1])
                    columns += [
                        pa.array([index.names[k] for k in t], pa.string()),
                        pa.array(matched.astype(np.int32)),
                        pa.array(matched / n[t] if len(t) else np.zeros(0)),
                        pa.array(score.astype(np.int32)),
                        pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], *added])

        return sent_docs.mapInArrow(run, schema)

    out = None
    for index in blocks():
        made = passed(index)
        out = made if out is None else out.union(made)
    return out
