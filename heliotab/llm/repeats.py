"""Operator 4: removal of long repeats with run-length indexes.

A string of MATCH bytes that starts earlier too is a repeat. Strings are dealt out by the least hash of the byte runs of
GRAM bytes in them: equal strings have equal least hashes, so all copies of a string have one key, and neighbouring
strings with one key form a segment. Most segments have a key of their own and end here. Of the others, segments that
are equal are one, with its first place; every later place is a repeat as a whole.

Where different segments share a key, or a segment repeats within itself, blocks of segments are indexed: a suffix
array gives the Burrows-Wheeler transform, kept as runs, with the suffix at each run's end as a sample. The segments are
streamed through the index, which tells for each string of MATCH bytes the interval of its occurrences; the occurrence
that comes first stays, the others are marked. Blocks have a bounded size. A key with more segments than a block takes
(a phrase in very many surroundings) is split by the strings themselves, whose first places are found by aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab.llm.common import Prefix, mix64, ragged, release, row_key, slices_by_bytes, text_buffer, whole_text
from heliotab.session import pin

MATCH = 100  # bytes
GRAM = 24  # bytes
RUNS = MATCH - GRAM + 1  # in a string
SIDE = -(-(MATCH - GRAM) // 2)  # bytes that a string has before its key's run, or behind it
PIECE = 512  # strings of a text that are streamed together
BLOCK = 1 << 20  # bytes of segments in one index, about
HOT = 4 << 20  # bytes of segments of one key from which it is split
KEY = ("k_id", "k_text")


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """Best (minimum or maximum) of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return best(x[:-rest], x[rest:]) if rest else x


def segments(data: np.ndarray, offsets: np.ndarray):
    """Key, row, start in the batch, number of strings, digest of the bytes, and whether the key's run stands twice."""
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64), none.astype(bool)
    prefix = Prefix(data)
    run = prefix.every(GRAM)
    least = _slide(run, RUNS, np.minimum)  # by start of the string
    strings = np.maximum(np.diff(offsets) - MATCH + 1, 0)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[offsets[:-1] + strings] = True
    edge[1 : len(least)] |= least[1:] != least[:-1]
    cuts = np.flatnonzero(edge)
    row = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    keep = cuts[:-1] < (offsets[:-1] + strings)[row]
    start, stop, row = cuts[:-1][keep], cuts[1:][keep], row[keep]
    if not len(start):
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64), none.astype(bool)
    key, digest = least[start], prefix.parts(start, stop + MATCH - 1)
    # Places of runs that are the least of a string. Strings across texts don't count.
    whole = np.repeat(np.arange(2 * len(strings)) % 2 == 0, np.c_[strings, np.diff(offsets) - strings].ravel())
    least = np.where(whole[: len(least)], least, np.uint64(0))
    pad = np.zeros(RUNS - 1, dtype=np.uint64)
    chosen = np.flatnonzero(run == _slide(np.r_[pad, least, pad], RUNS, np.maximum))
    low = np.searchsorted(chosen, start)
    count = np.searchsorted(chosen, stop + RUNS - 2, side="right") - low
    own = run[chosen[ragged(low, count)]] == np.repeat(key, count)
    twice = np.bincount(np.repeat(np.arange(len(start)), count), own, minlength=len(start)) > 1
    return key, row, start, stop - start, digest, twice


class RunIndex:
    """Run-length Burrows-Wheeler transform of texts, with the suffix at the end of each run."""

    def __init__(self, texts: list[bytes]):
        many = len(texts)
        joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64) + many
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        joined[ends] = np.arange(many)  # each text has an end mark of its own, so no match crosses it
        self.text, self.start, self.lengths = joined, ends - lengths, lengths
        n = len(joined)
        suffix, at64 = self._sort(joined, many)
        # Where the first MATCH symbols of neighbouring suffixes differ.
        tail = np.minimum(suffix + MATCH - 64, n - 1)
        a, b = at64[suffix], at64[tail]
        b = np.where(suffix + MATCH <= n, b, -1 - suffix)
        self.breaks = np.r_[np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]), n]
        self.break_sample = suffix[self.breaks[1:] - 1]
        last = joined[suffix - 1]
        heads = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        sizes = np.diff(np.r_[heads, n])
        symbol = last[heads]
        # Runs by symbol and place, with the symbols of the kind before each.
        by = np.lexsort((heads, symbol))
        self.n, self.head, self.size, self.symbol = n, heads[by], sizes[by], symbol[by]
        self.place = self.symbol * (n + 1) + self.head
        before = np.cumsum(self.size) - self.size
        kind = np.r_[True, self.symbol[1:] != self.symbol[:-1]]
        self.before = before - np.maximum.accumulate(np.where(kind, before, 0))
        self.sample = suffix[heads + sizes - 1][by]  # the suffix at the end of each run
        self.first = np.searchsorted(np.sort(joined), np.arange(many + 257))  # rows of smaller symbols
        self.end_suffix = suffix[self.first[1:] - 1]

    @staticmethod
    def _sort(joined: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array by doubling, and the ranks of the suffixes by their first 64 symbols.

        Ranks are the number of smaller suffixes; a round only sorts suffixes whose ranks aren't single yet.
        """
        n = len(joined)
        bits = int(many + 256).bit_length()
        step = 1
        word = joined
        while 2 * step * bits <= 62:  # several symbols in one number
            word = word << bits * step | np.r_[word[step:], np.zeros(min(step, n), np.int64)][:n]
            step *= 2
        order = np.argsort(word)
        rank, at64 = np.empty(n, dtype=np.int64), None
        heads = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0])
        sizes = np.diff(np.r_[heads, n])
        rank[order] = np.repeat(heads, sizes)
        left = order[np.repeat(sizes > 1, sizes)]  # in the order of their ranks
        while len(left):
            if step == 64:
                at64 = rank.copy()
            after = np.where(left + step < n, rank[np.minimum(left + step, n - 1)] + 1, 0)
            own = rank[left]
            by = np.argsort(own * (n + 1) + after)
            left, own, after = left[by], own[by], after[by]
            heads = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(after) != 0)])
            sizes = np.diff(np.r_[heads, len(left)])
            group = np.flatnonzero(np.r_[True, np.diff(own) != 0])
            base = np.repeat(group, np.diff(np.r_[group, len(left)]))  # where the suffixes of one rank begin
            rank[left] = own + np.repeat(heads, sizes) - base
            left = left[np.repeat(sizes > 1, sizes)]
            step *= 2
        suffix = np.empty(n, dtype=np.int64)
        suffix[rank] = np.arange(n)
        return suffix, rank if at64 is None else at64

    def _seen(self, symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often a symbol stands in the transform before a row, and the last run of it that begins before."""
        k = np.searchsorted(self.place, symbol * (self.n + 1) + row, side="left") - 1
        good = (k >= 0) & (self.symbol[k] == symbol)
        return np.where(good, self.before[k] + np.minimum(self.size[k], row - self.head[k]), 0), k

    def stream(self, chosen: np.ndarray | None = None):
        """Matching statistics of the texts (those ``chosen``), from right to left, all in step, up to MATCH symbols.

        A long text goes in pieces of PIECE strings, each of which reads on to the end of its last one. Yields, for each
        step that has strings of MATCH bytes, their texts, their starts, the first row and the size of the interval of
        their occurrences, and the place of one occurrence, found by the samples.
        """
        texts = np.arange(len(self.lengths)) if chosen is None else np.asarray(chosen)
        strings = np.maximum(self.lengths[texts] - MATCH + 1, 0)
        many = -(-strings // PIECE)
        text, part = np.repeat(texts, many), ragged(np.zeros(len(texts), np.int64), many) * PIECE
        lengths = np.minimum(PIECE, np.repeat(strings, many) - part) + MATCH - 1
        by = np.argsort(-lengths, kind="stable")
        text, lengths = text[by], lengths[by]
        ends = self.start[text] + part[by] + lengths
        symbol = self.text[ends - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        found = self.end_suffix[symbol]
        for step in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
            if step >= MATCH:
                yield text, ends - step - self.start[text], low, high - low, found
            live = int(np.searchsorted(-lengths, -step, side="left"))  # pieces longer than the step
            if not live:
                return
            text, lengths, ends = text[:live], lengths[:live], ends[:live]
            low, high, found = low[:live], high[:live], found[:live]
            symbol = self.text[ends - step - 1]
            seen, k = self._seen(np.r_[symbol, symbol], np.r_[low, high])
            k = k[live:]
            # The symbol stands at the end of the interval, or at the end of its last run before: there is the sample.
            at_end = self.head[k] + self.size[k] >= high
            found = np.where(at_end, found - 1, self.sample[k] - 1)
            low, high = self.first[symbol] + seen[:live], self.first[symbol] + seen[live:]
            if step >= MATCH:  # back to the interval of the first MATCH symbols
                b = np.searchsorted(self.breaks, low, side="right")
                low, high, found = self.breaks[b - 1], self.breaks[b], self.break_sample[b - 1]


def later_strings(texts: list[bytes], unread: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text the starts of its strings of MATCH bytes that occur in a text before, or earlier in the same.

    Texts marked ``unread`` are only indexed. They must hold no string twice, nor one that is in a text before.
    """
    index = RunIndex(texts)
    first, read = np.full(index.n, index.n, dtype=np.int64), np.zeros(index.n, dtype=np.int64)
    steps = []
    for text, start, row, size, found in index.stream(None if unread is None else np.flatnonzero(~unread)):
        repeated = size > 1
        text, start, row, size = text[repeated], start[repeated], row[repeated], size[repeated]
        place = index.start[text] + start
        np.minimum.at(first, row, np.minimum(place, found[repeated]))
        np.add.at(read, row, 1)
        steps.append((text, start, row, size, place))
    if not steps:
        return [np.zeros(0, np.int64) for _ in texts]
    text, start, row, size, place = map(np.concatenate, zip(*steps))
    # An occurrence that wasn't read comes before all that were.
    later = (place > first[row]) | (read[row] < size)
    text, start = text[later], start[later]
    order = np.lexsort((start, text))
    counts = np.bincount(text, minlength=len(texts))
    return np.split(start[order], np.cumsum(counts)[:-1])


def _may_share(texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts may have a string in common with another of their key or with themselves, and which of these come
    first of their key and need not be read.

    A string has its key's run in it, so at least SIDE bytes before the run or behind it. A text whose key's run has
    other bytes on both sides than in every other text of the key has no string in common with any.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    prefix = Prefix(np.frombuffer(b"".join(texts), dtype=np.uint8))
    run = prefix.every(GRAM)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(run)]
    ends = starts + lengths
    at = np.flatnonzero(run == keys.astype(np.uint64)[owner])
    at = at[at + GRAM <= ends[owner[at]]]
    many = np.bincount(owner[at], minlength=len(texts))
    _, group = np.unique(keys, return_inverse=True)
    # Keys whose run stands several times in a text are left whole.
    whole = np.bincount(group, many != 1) > 0
    shared = whole[group]
    one = at[many[owner[at]] == 1]
    for low, high in ((one - SIDE, one), (one + GRAM, one + GRAM + SIDE)):
        text = owner[one]
        inside = (low >= starts[text]) & (high <= ends[text])
        text, low, high = text[inside], low[inside], high[inside]
        _, place, n = np.unique(mix64(prefix.parts(low, high) ^ keys[text].astype(np.uint64)), return_inverse=True, return_counts=True)
        shared[text[n[place] > 1]] = True
    kept = np.flatnonzero(shared)
    head = np.zeros(len(texts), dtype=bool)
    head[kept[np.unique(group[kept], return_index=True)[1]]] = True
    return shared, head & ~whole[group]


def _later_of_keys(texts: list[bytes], keys: np.ndarray) -> list[np.ndarray]:
    """:func:`later_strings` of whole keys, of which only texts that can matter are indexed."""
    shared, head = _may_share(texts, keys)
    out = [np.zeros(0, np.int64)] * len(texts)
    kept = np.flatnonzero(shared)
    if len(kept):
        for i, starts in zip(kept.tolist(), later_strings([texts[i] for i in kept], head[kept])):
            out[i] = starts
    return out


SEGMENT = "key bigint, digest bigint, start int, n int, twice boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices_by_bytes(batch, "text", 1_500_000):
            data, offsets = text_buffer(part.column(2))
            key, row, start, n, digest, twice = segments(data, offsets)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(take),
                    part.column(1).take(take),
                    pa.array(key.astype(np.int64)),
                    pa.array(digest.astype(np.int64)),
                    pa.array((start - offsets[row]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(twice),
                ],
                [*KEY, "key", "digest", "start", "n", "twice"],
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices_by_bytes(batch, "text", 1_500_000):
            key, *_, twice = segments(*text_buffer(part.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(twice.astype(np.int32) + 1)], ["key", "n"])


RANGES = "array<struct<a:int,b:int>>"
_RANGE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _ranges(starts: np.ndarray) -> list[dict]:
    cut = np.flatnonzero(np.r_[True, np.diff(starts) > 1]) if len(starts) else []
    return [{"a": int(starts[a]), "b": int(starts[b - 1])} for a, b in zip(cut, [*cut[1:], len(starts)])]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indexes blocks of whole keys; the rows come sorted by key and first place."""
    block: list[tuple] = []
    size = 0

    def done() -> pa.RecordBatch:
        keys, digests, texts = (list(c) for c in zip(*block))
        marks = [_ranges(x) for x in _later_of_keys(texts, np.array(keys, dtype=np.int64))]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(digests, pa.int64()), pa.array(marks, _RANGE)], ["key", "digest", "marks"]
        )

    for batch in batches:
        for key, digest, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if block and block[-1][:2] == (key, digest):
                continue  # a repeated row
            if size >= BLOCK and key != block[-1][0]:
                yield done()
                block, size = [], 0
            block.append((key, digest, raw))
            size += len(raw)
    if block:
        yield done()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, digest, raw in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(raw) - MATCH + 1
            for low in range(0, n, 4096):
                at = range(low, min(n, low + 4096))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(at), pa.int64()),
                        pa.array([digest] * len(at), pa.int64()),
                        pa.array(at, pa.int32()),
                        pa.array([hashlib.blake2b(raw[k : k + MATCH], digest_size=16).digest() for k in at], pa.binary()),
                    ],
                    ["key", "digest", "at", "string"],
                )


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (k_id, k_text, lo, hi): byte ranges that strings starting earlier cover; they may overlap."""
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(*row_key(doc_id, text), whole_text(text).alias("text"))
    places = _repeated_places(spark, keyed, id_type)
    release(spark)
    order = F.struct(F.col("k_id").isNull().alias("no_id"), *KEY, "start").alias("first")
    kinds = places.groupBy("key", "digest").agg(
        F.min(order).alias("first"), F.max("twice").alias("twice"), F.max("n").alias("n")
    )
    kinds = pin(kinds)
    release(spark)
    size = F.sum(F.col("n") + MATCH).alias("bytes")
    keys = kinds.groupBy("key").agg(F.count("*").alias("many"), F.max("twice").alias("any_twice"), size)
    keys = keys.filter("many > 1 OR any_twice").select("key", (F.col("bytes") > HOT).alias("hot"))
    raw = pin(_bytes(keyed, kinds.join(keys, "key")))
    release(spark)
    calm = raw.filter("NOT hot").repartition("key").sortWithinPartitions("key", "first", "digest")
    marks = calm.select("key", "digest", "raw").mapInArrow(_mark, f"key bigint, digest bigint, marks {RANGES}")
    strings = raw.filter("hot").select("key", "digest", "raw").mapInArrow(
        _strings, "key bigint, digest bigint, at int, string binary"
    )
    firsts = raw.filter("hot").select("key", "digest", "first").dropDuplicates(["key", "digest"])
    placed = strings.distinct().join(firsts, ["key", "digest"]).withColumn("place", F.struct("first", "at"))
    earliest = placed.groupBy("key", "string").agg(F.min("place").alias("earliest"))
    later = placed.join(earliest, ["key", "string"]).filter("place <> earliest")
    one = F.struct(F.col("at").alias("a"), F.col("at").alias("b"))
    split = later.groupBy("key", "digest").agg(F.collect_list(one).alias("marks"))
    marks = pin(marks.filter(F.size("marks") > 0).union(split))
    release(spark)

    told = kinds.select("key", "digest", "first").join(marks, ["key", "digest"], "left")
    each = places.join(told, ["key", "digest"])
    is_first = (
        F.col("k_id").eqNullSafe(F.col("first.k_id"))
        & (F.col("k_text") == F.col("first.k_text"))
        & (F.col("start") == F.col("first.start"))
    )
    whole = F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n") + MATCH - 1).alias("hi")))
    start = F.col("start")
    inner = F.transform(
        "marks", lambda r: F.struct((start + r["a"]).alias("lo"), (start + r["b"] + MATCH).alias("hi"))
    )
    ranges = F.when(is_first, inner).otherwise(whole)
    return each.select(*KEY, F.explode(ranges).alias("r")).select(*KEY, "r.lo", "r.hi")


def _repeated_places(spark: SparkSession, keyed: DataFrame, id_type: str) -> DataFrame:
    """Segments whose key stands more than once."""
    counted = keyed.select("text").mapInArrow(_count, "key bigint, n int")
    repeated = counted.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    placed = keyed.mapInArrow(_cut, f"k_id {id_type}, k_text bigint, {SEGMENT}")
    return pin(placed.join(repeated, "key", "left_semi").select(*KEY, "key", "digest", "start", "n", "twice"))


def _bytes(keyed: DataFrame, kinds: DataFrame) -> DataFrame:
    """The bytes of segments, cut out of the document of their first place."""
    wanted = kinds.groupBy(F.col("first.k_id").alias("w_id"), F.col("first.k_text").alias("w_text")).agg(
        F.collect_list(F.struct("key", "digest", "first", "n", "hot")).alias("parts")
    )
    same = F.col("k_id").eqNullSafe(F.col("w_id")) & (F.col("k_text") == F.col("w_text"))
    cut = keyed.join(wanted, same).select(F.col("text").cast("binary").alias("raw"), F.explode("parts").alias("p"))
    part = F.expr(f"substring(raw, p.first.start + 1, p.n + {MATCH - 1})")
    return cut.select("p.key", "p.digest", "p.first", "p.hot", part.alias("raw"))


_KEPT = pa.struct([("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), ("kept", pa.binary())])


def _kept_part(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Merged spans of each text and its other bytes."""
    data, offsets = text_buffer(text)
    row = np.repeat(np.arange(len(text)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    change = np.zeros(len(data) + 1, dtype=np.int32)
    for name, step in (("lo", 1), ("hi", -1)):
        np.add.at(change, flat.field(name).to_numpy(zero_copy_only=False) + offsets[row], step)
    covered = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    fresh = covered & (edge[:-1] | ~np.r_[False, covered[:-1]])
    ends = covered & (edge[1:] | ~np.r_[covered[1:], False])
    low, high = np.flatnonzero(fresh), np.flatnonzero(ends) + 1
    of = np.searchsorted(offsets, low, side="right") - 1
    place = lambda at: pa.array((at - offsets[of]).astype(np.int32))
    merged = pa.StructArray.from_arrays([place(low), place(high)], ["lo", "hi"])
    cuts = np.r_[0, np.cumsum(np.bincount(of, minlength=len(text)))].astype(np.int32)
    left = np.r_[0, np.cumsum(~covered)][offsets].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(left), pa.py_buffer(data[~covered].tobytes())])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(cuts), merged), kept], ["spans", "kept"]).cast(_KEPT)


def _keep(text: pa.Array, spans: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([text, spans], ["text", "spans"])
    parts = [_kept_part(p.column(0), p.column(1)) for p in slices_by_bytes(batch, "text", 2_000_000)]
    return pa.concat_arrays(parts) if parts else pa.array([], _KEPT)


_keep.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``removed`` (array of byte ranges lo to hi, merged) and ``kept`` (the other bytes, binary) to each document.

    Documents are ordered by id, null ids last, and rows of one id by a hash of the text. Rows equal in id and text are
    one document, so they are told the same. Null texts are empty. Texts are UTF-8 bytes, and what is left may not be
    UTF-8. Columns that have the names of results are replaced.
    """
    found = find_repeats(docs, doc_id, text).groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("__found"))
    found = pin(found.withColumnsRenamed({"k_id": "__k_id", "k_text": "__k_text"}))
    release(docs.sparkSession)
    plain = docs.drop(*[c for c in docs.columns if c.lower() in ("removed", "kept")])
    keyed = plain.withColumn("__hash", F.xxhash64(whole_text(text)))
    same = F.col(doc_id).eqNullSafe(F.col("__k_id")) & (F.col("__hash") == F.col("__k_text"))
    both = F.arrow_udf(_keep, "struct<spans:array<struct<lo:int,hi:int>>,kept:binary>")
    made = keyed.join(found, same, "left").withColumn("__made", both(whole_text(text), F.col("__found")))
    out = made.withColumns({"removed": F.col("__made.spans"), "kept": F.col("__made.kept")})
    return out.drop("__k_id", "__k_text", "__hash", "__found", "__made")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Per document its bytes, how many are removed in how many runs, and SHA-256 of what is left."""
    made = remove_repeats(docs.select("doc_id", "text"))
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["hi"] - r["lo"])
    return made.select(
        "doc_id",
        F.octet_length(whole_text()).cast("bigint").alias("n_bytes"),
        length.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
