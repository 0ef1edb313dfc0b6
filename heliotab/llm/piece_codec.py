"""Operator 1: encoding and decoding with the pieces of a merge-type (BPE) SentencePiece model.

A sequence of pieces is what the merges give if and only if each piece comes out of its own text and each two
neighbours come out of their joined text. So a text is encoded without running its merges: at each position the
longest piece (Aho-Corasick) that suits its left neighbour is taken, shorter ones follow, and where none suits, the
last piece is taken back and its end is marked in a bitfield of failed positions, which is never tried again.
Whether two pieces suit each other is found by merging their joined text once, and remembered.

Texts are cut where no piece has the two characters next to each other, as no merge can cross such a place.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from string import ascii_letters, punctuation

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from heliotab.llm.common import column_parts, drop_clashing, list_array

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # types of pieces in the model file
MODEL_LIMIT = 64 << 20  # bytes of a model that is sent to every executor
KEPT = 200_000  # entries in each of the two generations of a remembering table
BITS = 24  # of an id beside a length or another id
WIDTH = (1 << BITS) - 1
NOTHING = WIDTH  # in the place of a left neighbour
LETTER = 1 << 23  # ids from here stand for characters that are no pieces


class Remembered(dict):
    """A table that keeps what was used lately: two generations of bounded size."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if (
            proto.trainer_spec.model_type != 2
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not norm.add_dummy_prefix
            or not norm.escape_whitespaces
            or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}
            or proto.trainer_spec.treat_whitespace_as_suffix
        ):
            raise ValueError("only merge-type models without normalisation and without user-defined pieces")
        self.text = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.byte_ids = [byte_ids.get(b, self.unknown) for b in range(256)] if byte_ids else None
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.together = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, len(piece) << BITS | i)
        self.automaton.make_automaton()
        self.cut = self._units_of_text()
        self.suits: dict[int, bool] = {}
        self.units = Remembered(self._unit)
        self.runs = Remembered(self._run)
        self.shorter = Remembered(self._shorter)

        # What an id stands for: bytes are joined before they are read as UTF-8.
        self.shown = np.empty(len(self.text), dtype=object)
        self.byte_of = np.full(len(self.text), -1, dtype=np.int64)
        for i, p in enumerate(proto.pieces):
            surface = proto.trainer_spec.unk_surface if p.type == UNKNOWN else ""
            self.shown[i] = p.piece.replace(SPACE, " ") if p.type == NORMAL else surface
        for b, i in byte_ids.items():
            self.byte_of[i] = b
        self.spaced = np.array([t.startswith(SPACE) for t in self.text])
        self.silent = np.array([p.type == CONTROL for p in proto.pieces])

    def _units_of_text(self) -> re.Pattern:
        """Pattern of the units that a text is cut into, each in a place that no piece reaches across.

        A run of spaces and what follows it is a unit, unless a piece has a space after another character. Where no
        piece has them together, a line break is one too, and letters are apart from the marks behind them: so words are
        remembered whatever stands behind them.
        """
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            return re.compile(".+", re.DOTALL)
        breaks = "" if any("\n" in piece for piece in self.ids) else "\n"
        marks = "".join(c for c in punctuation if not any(a + c in self.together for a in ascii_letters))
        behind = re.escape(marks + breaks) + SPACE
        units = f"{SPACE}*[A-Za-z]+(?=[{behind}]|\\Z)|{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|{breaks}" if breaks else "")
        return re.compile(units, re.DOTALL)

    def merge(self, text: str) -> list[str]:
        """The merges themselves: best score first, then the leftmost. For short texts."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _suit(self, pair: int, left: int, right: int) -> bool:
        """Whether two pieces come out of their joined text, or the right one out of its own if left is NOTHING."""
        parts = [self._name(i) for i in (left, right) if i != NOTHING]
        if len(self.suits) > 1_000_000:
            self.suits.clear()
        good = self.suits[pair] = self.merge("".join(parts)) == parts
        return good

    def _name(self, i: int) -> str:
        return chr(i - LETTER) if i >= LETTER else self.text[i]

    def _run(self, run: str) -> tuple[int, ...]:
        """Ids of a text by backtracking."""
        n, suits, width = len(run), self.suits, WIDTH
        longest = [0] * n  # by start: length and id of the longest piece there; it is found last
        for last, match in self.automaton.iter(run):
            longest[last + 1 - (match >> BITS)] = match
        failed = 0  # bit k: nothing that starts at k leads to the end
        taken: list[int] = []
        left, at = NOTHING, 0
        match = longest[0] or 1 << BITS | LETTER + ord(run[0])
        while True:
            while match:
                end, right = at + (match >> BITS), match & width
                if not failed >> end & 1:
                    pair = left << BITS | right
                    good = suits.get(pair)
                    if good is None:
                        good = self._suit(pair, left, right)
                    if good:
                        break
                match = self.shorter[match]
            if match:
                taken.append(right)
                if end == n:
                    break
                left, at = right, end
                match = longest[at] or 1 << BITS | LETTER + ord(run[at])
            else:
                failed |= 1 << at
                last = taken.pop()
                match = len(self._name(last)) << BITS | last
                at -= match >> BITS
                left = taken[-1] if taken else NOTHING
                match = self.shorter[match]
        if max(taken) >= LETTER:
            taken = chain.from_iterable(self._bytes(chr(i - LETTER)) if i >= LETTER else (i,) for i in taken)
        return tuple(taken)

    def _shorter(self, match: int) -> int:
        """The longest piece, or else the character, that is shorter and begins the same; 0 if there is none."""
        name = self._name(match & WIDTH)
        for k in range(len(name) - 1, 0, -1):
            if (i := self.ids.get(name[:k])) is not None:
                return k << BITS | i
        return 1 << BITS | LETTER + ord(name[0]) if len(name) > 1 else 0

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def _unit(self, unit: str) -> tuple[int, ...]:
        together = self.together
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in together]
        if not cuts:
            return self._run(unit)
        runs = [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]
        return tuple(chain.from_iterable(map(self.runs.__getitem__, runs)))

    def encode(self, text: str, end: bool = False) -> list[int]:
        out: list[int] = []
        if text:
            units = self.cut.findall(SPACE + text.replace(" ", SPACE))
            out = list(chain.from_iterable(map(self.units.__getitem__, units)))
        if end:
            out.append(self.end)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids. Bytes that aren't UTF-8 become U+FFFD each; ids outside the model count as unknown."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = np.where((ids < 0) | (ids >= len(self.text)), self.unknown, ids)
        loud = np.flatnonzero(~self.silent[ids])
        if not len(loud):
            return ""
        values = self.byte_of[ids]
        if (values < 0).all():
            joined = "".join(self.shown[ids])
        else:
            parts: list[str] = []
            cuts = np.flatnonzero(np.diff((values >= 0).astype(np.int8))) + 1
            for part, raw in zip(np.split(ids, cuts), np.split(values, cuts)):
                parts.append("".join(self.shown[part]) if raw[0] < 0 else _utf8(bytes(raw.tolist())))
            joined = "".join(parts)
        return joined[1:] if self.spaced[ids[loud[0]]] else joined


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for width in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + width].decode())
                    k += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def _model(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        model = file.read(MODEL_LIMIT + 1)
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"a model over {MODEL_LIMIT} bytes isn't sent to executors")
    return spark.sparkContext.broadcast(model)


def _encoded(pieces: Pieces, column: pa.Array, end: bool) -> pa.Array:
    lengths, flat = np.zeros(len(column), dtype=np.int64), array("i")
    for k, value in enumerate(column):
        ids = pieces.encode(value.as_py() or "", end)
        lengths[k] = len(ids)
        flat.extend(ids)
    return list_array(np.frombuffer(flat, dtype=np.int32), lengths, pa.int32())


def _decoded(pieces: Pieces, column: pa.Array) -> pa.Array:
    flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    return pa.array([pieces.decode(flat[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist())], pa.string())


def _with(df: DataFrame, model_path: str, work, kind: DataType, source: str, out: str) -> DataFrame:
    """Add what ``work`` yields for each batch of a column."""
    model = _model(df.sparkSession, model_path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(model.value)
        for column in batches:
            yield from work(pieces, column)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = df.withColumn("__made", F.arrow_udf(run, kind)(F.col(source)))
    return drop_clashing(made, out).withColumnRenamed("__made", out)


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", out: str = "ids", end: bool = True) -> DataFrame:
    """Add the ids of ``text`` as array<int>, with the end id last if ``end``.

    Null counts as the empty text, whose ids are none (or the end id alone). Every row is kept, repeated rows too, and
    each text is taken whole. A column that has the name of the result is replaced. No shuffle.
    """

    def work(pieces: Pieces, column: pa.Array) -> Iterator[pa.Array]:
        return (_encoded(pieces, part, end) for part in column_parts(column))

    return _with(df, model_path, work, ArrayType(IntegerType()), text, out)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an array of ids. Null and empty arrays give the empty text; null ids count as unknown."""

    def work(pieces: Pieces, column: pa.Array) -> Iterator[pa.Array]:
        return (_decoded(pieces, column.slice(k, 500)) for k in range(0, len(column), 500))

    return _with(df, model_path, work, StringType(), ids, out)


def round_trip(
    df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", out: str = "decoded", end: bool = True
) -> DataFrame:
    """Both at once, in one pass through Python: the ids of ``text``, and the text that they decode to."""
    kind = StructType([StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def work(pieces: Pieces, column: pa.Array) -> Iterator[pa.Array]:
        for part in column_parts(column):
            coded = _encoded(pieces, part, end)
            yield pa.StructArray.from_arrays([coded, _decoded(pieces, coded)], ["ids", "decoded"])

    both = _with(df, model_path, work, kind, text, "__both")
    both = drop_clashing(both, ids, out).withColumns({ids: F.col("__both.ids"), out: F.col("__both.decoded")})
    return both.drop("__both")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of ids and SHA-256 of the ids and of the decoded text."""
    return round_trip(docs.select("doc_id", "text"), model_path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
