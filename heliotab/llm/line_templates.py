"""Operator 10: line dedup with a tree of log templates, in DataFrame functions only.

A line is parsed to a fixed depth: by its number of tokens, then by its leading tokens, after tokens with digits became
``<*>``. Lines that would have too few other tokens, as rows of numbers, are compared whole and unmasked. In a leaf of the tree the line of most documents is the first seed; lines that agree with it in a large enough
part of their tokens belong to its template, in which the differing tokens are variable fields. Of the lines that are
left the one of most documents is the next seed, and so on, until every line is a seed or belongs to one. Lines of a
template that recurs over documents are dropped, except in its first document.

Lines that agree in that part of their tokens have one of so many blocks of tokens in common as there may be differing
tokens, and one more. So only lines with a common block are compared. A line that has the most documents in all of its
blocks is a seed; that is repeated, and when few pairs are left, all of them are compared. Where a leaf has few such
lines, as by chance, these are fewer pairs than blocks, so all of them are compared at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotab.functions.bind import let
from heliotab.llm.common import drop_clashing, release, row_key, whole_text
from heliotab.session import pin

WILD = "<*>"
LEADING = 2  # leading tokens that lead to a leaf
SIMILAR = 0.75  # part of the tokens that agrees with the seed
LEAST_TOKENS = 3  # shorter lines are kept
GENERAL_TOKENS = 8  # lines from this length can join a seed that differs from them; shorter ones are compared whole
LEAST_FIXED = 2  # tokens without a digit that a masked line has, and at least half of all; others are compared unmasked
MIN_DOCS = 3  # documents from which a template recurs
ROUNDS = 6  # of seeds by blocks, at most; what is open then is compared pair by pair
SMALL_LEAF = 8  # lines up to which all pairs of a leaf are compared
OPEN_PAIRS = 2  # these rounds go on while more pairs than this many times the members of blocks are open

KEY = ("k_id", "k_text")


def masked_line(line: Column, digits: Column | None = None) -> Column:
    """Tokens joined by one space, those with a digit as ``<*>`` if enough others are left; else all as they are.

    Patterns only run over lines that need them.
    """
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for space in "\t\r\x0b\x0c":
        odd = odd | line.contains(space)
    even = F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)

    def known(even: Column) -> Column:
        return let(F.regexp_replace(even, "[^ ]*[0-9][^ ]*", WILD), lambda m: F.when(_enough_fixed(m), m).otherwise(even))

    return F.when(line.rlike("[0-9]") if digits is None else digits, let(even, known)).otherwise(even)


def _enough_fixed(masked: Column) -> Column:
    def enough(tokens: Column) -> Column:
        fixed = F.size(F.filter(tokens, lambda t: t != WILD))
        return (fixed >= LEAST_FIXED) & (2 * fixed >= F.size(tokens))

    return let(F.split(masked, " "), enough)


def _n_tokens(masked: Column) -> Column:
    return F.length(masked) - F.length(F.replace(masked, F.lit(" "))) + 1


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All lines: key of the document, position, masked line, number of tokens, leaf (null without one).

    No filter stands here: it would be pushed down and mask every line a second time.
    """
    split = docs.select(*row_key(doc_id, text), F.posexplode(F.split(whole_text(text), "\n")).alias("pos", "line"))
    told = split.withColumn("digits", F.col("line").rlike("[0-9]"))
    masked = told.select(*KEY, "pos", "digits", masked_line(F.col("line"), F.col("digits")).alias("masked"))
    counted = masked.withColumn("n", _n_tokens(F.col("masked")))
    # Lines without enough fixed tokens stand in no leaf: they are compared whole.
    fixed = (~F.col("digits") | ~F.col("masked").rlike("[0-9]")) & (~F.col("masked").contains(WILD) | _enough_fixed(F.col("masked")))
    leaf = F.when(fixed, F.xxhash64("n", F.substring_index("masked", " ", LEADING)))
    return counted.withColumn("leaf", leaf).drop("digits")


def _digest() -> Column:
    return F.unhex(F.md5("masked")).alias("line")


def _spread(lines: DataFrame, *by: str) -> DataFrame:
    """Documents of each line or template, and the first of them; copies in one document count once."""
    once = lines.groupBy(*by, *KEY).agg(F.lit(1).alias("one"))
    # Null ids come last.
    first = F.min(F.struct(F.col("k_id").isNull().alias("no_id"), *KEY)).alias("first")
    return once.groupBy(*by).agg(F.count("one").alias("n_docs"), first)


def _agrees(similar: float) -> Column:
    """Whether ``masked`` and ``seed_masked``, both of ``n`` tokens, agree in a large enough part of those that are fixed.

    Tokens that are ``<*>`` in both count neither as equal nor as different.
    """
    pairs = F.arrays_zip(F.split("masked", " ").alias("a"), F.split("seed_masked", " ").alias("b"))

    def agrees(equal: Column) -> Column:
        fixed = F.size(F.filter(equal, lambda p: p["a"] != WILD))
        return fixed >= F.lit(float(similar)) * (F.col("n") - F.size(equal) + fixed)

    return let(F.filter(pairs, lambda p: p["a"] == p["b"]), agrees)


def _blocks(left: DataFrame, similar: float) -> DataFrame:
    """(line, rank, bucket): one row per line and block of its tokens; equal blocks of a leaf have the same bucket.

    There is one block more than tokens may differ. Leading tokens are equal in a leaf, so blocks are cut of the others.
    """
    count = (F.floor((1 - F.lit(float(similar))) * F.col("n") + F.lit(1e-9)) + 1).cast("int")

    def hashed(tokens: Column) -> Column:
        def bucket(b: Column) -> Column:
            low, high = (F.floor(x * (F.col("n") - LEADING) / count).cast("int") for x in (b, b + 1))
            return F.xxhash64("leaf", b, F.slice(tokens, low + LEADING + 1, high - low))

        return F.transform(F.sequence(F.lit(0), count - 1), bucket)

    return left.select("line", "rank", F.explode(let(F.split("masked", " "), hashed)).alias("bucket"))


def _settled(edges: DataFrame) -> DataFrame:
    """(line, seed) of agreeing lines (line, seed, rank), ``rank`` being that of the seed, which outranks the line."""
    joined = edges.select("line", "seed").limit(0)
    while edges.limit(1).count():
        # A line that no other outranks is a seed; what agrees with it belongs to it.
        top = edges.select("seed").distinct().join(edges.select(F.col("line").alias("seed")), "seed", "left_anti")
        found = pin(edges.join(top, "seed").groupBy("line").agg(F.max_by("seed", "rank").alias("seed")))
        joined = joined.union(found)
        edges = edges.join(found.select("line"), "line", "left_anti")
        edges = pin(edges.join(found.select(F.col("line").alias("seed")), "seed", "left_anti"))
    return joined


def _further_seeds(left: DataFrame, similar: float) -> DataFrame:
    """(line, seed) of the lines that don't agree with the first seed of their leaf, but with a later one.

    ``left`` are these lines, once each: (leaf, line, n, masked, n_docs). A line outranks those of fewer documents.
    Each line that isn't a seed agrees with one that outranks it, and no two seeds agree.
    """
    kinds = pin(left.select("leaf", "line", "n", "masked", F.struct("n_docs", "line").alias("rank")))

    def agreeing(pairs: DataFrame) -> DataFrame:
        seed = kinds.select(F.col("line").alias("seed"), F.col("masked").alias("seed_masked"), "rank")
        both = pairs.join(kinds.select("line", "n", "masked"), "line").join(seed, "seed")
        return both.filter(_agrees(similar)).select("line", "seed", "rank")

    per_leaf = kinds.groupBy("leaf").agg(F.count("line").alias("lines"))
    few = kinds.join(per_leaf.filter(F.col("lines").between(2, SMALL_LEAF)), "leaf").select("leaf", "line", "rank")
    met = few.alias("x").join(few.alias("y"), (F.col("x.leaf") == F.col("y.leaf")) & (F.col("x.rank") < F.col("y.rank")))
    edges = agreeing(met.select(F.col("x.line").alias("line"), F.col("y.line").alias("seed")))
    state = _blocks(kinds.join(per_leaf.filter(F.col("lines") > SMALL_LEAF).select("leaf"), "leaf"), similar)
    shared = state.groupBy("bucket").agg(F.count("line").alias("members")).filter("members > 1").select("bucket")
    state = pin(state.join(shared, "bucket"))
    joined = kinds.select("line", F.col("line").alias("seed")).limit(0)
    for turn in range(ROUNDS + 1):
        tops = state.groupBy("bucket").agg(F.count("line").alias("members"), F.max("rank").alias("top"))
        tops = pin(tops.filter("members > 1"))
        open_ = tops.agg(F.count("members"), F.sum("members"), F.sum(F.expr("members * (members - 1) / 2"))).first()
        if not open_[0]:
            break
        live = pin(state.join(tops.select("bucket", "top"), "bucket"))
        if turn == ROUNDS or open_[2] <= OPEN_PAIRS * open_[1]:
            x, y = live.alias("x"), live.alias("y")
            met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rank") < F.col("y.rank")))
            pairs = met.select(F.col("x.line").alias("line"), F.col("y.line").alias("seed")).distinct()
            edges = edges.union(agreeing(pairs))
            break
        first = live.groupBy("line").agg(F.every(F.col("rank") == F.col("top")).alias("is_seed"))
        first = pin(first.filter("is_seed").select("line"))
        met = live.filter("rank <> top").select("line", F.col("top.line").alias("seed"))
        pairs = met.join(first.withColumnRenamed("line", "seed"), "seed", "left_semi").distinct()
        found = pin(agreeing(pairs).groupBy("line").agg(F.max_by("seed", "rank").alias("seed")))
        joined = joined.union(found)
        gone = first.union(found.select("line"))
        state = pin(live.join(gone, "line", "left_anti").select("line", "rank", "bucket"))
        release(left.sparkSession)
    return joined.union(_settled(pin(edges)))


def line_templates(
    docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per line of at least LEAST_TOKENS tokens: (k_id, k_text, pos, template, n_docs, first).

    ``template`` is the digest of the seed, ``first`` the first document of the template. Null texts have no lines.
    """
    lines = pin(_lines(docs, doc_id, text).select(*KEY, "pos", _digest(), "leaf", "n"))
    lines = lines.filter(F.col("n") >= LEAST_TOKENS)
    per_line = _spread(lines.filter((F.col("n") >= GENERAL_TOKENS) & F.col("leaf").isNotNull()), "leaf", "line")
    seeds = (
        per_line.groupBy("leaf")
        .agg(F.count("line").alias("kinds"), F.max_by("line", F.struct("n_docs", "line")).alias("seed"))
        .filter("kinds > 1")
        .drop("kinds")
    )
    # Texts are needed only in leaves with several kinds of lines; a leaf fixes the number of tokens.
    met = _lines(docs, doc_id, text).select("leaf", "n", "masked").join(seeds, "leaf").select("leaf", _digest(), "n", "masked", "seed")
    mixed = pin(met.groupBy("leaf", "line", "n", "seed").agg(F.min("masked").alias("masked")))
    release(docs.sparkSession)
    seed_text = mixed.filter("line = seed").select("leaf", F.col("masked").alias("seed_masked"))
    compared = mixed.filter("line <> seed").join(seed_text, "leaf").withColumn("agrees", _agrees(similar))
    compared = pin(compared.drop("seed_masked"))
    del mixed, seed_text
    left = compared.filter(~F.col("agrees"))
    n_docs = _spread(lines.join(left.select("leaf", "line"), ["leaf", "line"], "left_semi"), "line").drop("first")
    joined = compared.filter("agrees").select("line", "seed")
    joined = joined.union(_further_seeds(left.join(n_docs, "line"), similar))
    release(docs.sparkSession)
    named = (
        lines.join(joined, "line", "left")
        .select(*KEY, "pos", F.coalesce("seed", "line").alias("template"))
    )
    recurring = _spread(named, "template").filter(F.col("n_docs") >= min_docs)
    return named.join(recurring, "template")


def template_texts(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of the templates that ``line_templates`` found: (template, n_docs, tokens), variable tokens as ``<*>``."""
    texts = _lines(docs, doc_id, text).select(*KEY, "pos", "masked").join(templates, [*KEY, "pos"])
    token = texts.select("template", "n_docs", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    fixed = token.groupBy("template", "n_docs", "at").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    shown = fixed.withColumn("token", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(WILD))
    listed = F.array_sort(F.collect_list(F.struct("at", "token")))
    return shown.groupBy("template", "n_docs").agg(F.transform(listed, lambda s: s["token"]).alias("tokens"))


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every document with ``text`` without the recurring lines, and the counts ``n_lines`` and ``n_dropped``.

    All rows stay, in their own columns. A null text stays null with no lines; an empty text is one empty line. Rows
    equal in id and text are one document, so they lose the same lines. Of documents with the same id and other
    texts, the one whose text has the smaller hash comes first; null ids come last. Columns that have the names of
    results are replaced. Counts are combined before they are shuffled; a hot line or leaf meets one row in each join,
    so Spark can split it.
    """
    templates = line_templates(docs, min_docs, similar, doc_id, text)
    later = ~(F.col("k_id").eqNullSafe(F.col("first.k_id")) & (F.col("k_text") == F.col("first.k_text")))
    dropped = pin(templates.filter(later).groupBy(*KEY).agg(F.collect_set("pos").alias("__dropped")))
    release(docs.sparkSession)
    keyed = drop_clashing(docs, "n_lines", "n_dropped").withColumn("__text", F.xxhash64(whole_text(text)))
    dropped = dropped.withColumnsRenamed({"k_id": "__k_id", "k_text": "__k_text"})
    same = F.col(doc_id).eqNullSafe(F.col("__k_id")) & (F.col("__text") == F.col("__k_text"))
    marked = keyed.join(dropped, same, "left").drop("__k_id", "__k_text", "__text")
    parts = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(parts, lambda _, at: ~F.array_contains("__dropped", at)), "\n")
    out = marked.withColumns(
        {
            "n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("bigint"),
            "n_dropped": F.greatest(F.size("__dropped"), F.lit(0)).cast("bigint"),
            text: F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(kept),
        }
    )
    return out.drop("__dropped")
