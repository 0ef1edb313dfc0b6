"""Ordered work: unique names, last write, running counters, progress, curves and samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.functions import names
from heliotab.operators.skew import ranked, running
from heliotab.session import pin

KINDS = ("tif", "other", "missing")
PREFLIGHT_SAMPLE = 120
PREFLIGHT_SEED = 1234


_NUMBERED = r"(?s)^(.*)-([1-9][0-9]{0,17})$"
_TAIL = r"(-[1-9][0-9]{0,17})+$"


def dedupe_names(
    df: DataFrame,
    part: str = "dataset",
    order: Sequence[str] = ("member",),
    name: str = "name",
    taken: DataFrame | None = None,
    extension: bool = True,
) -> DataFrame:
    """Add ``unique_name``: the name, or ``stem-1.ext``, ``stem-2.ext``… for later rows, as if saved one by one.

    A row whose name is in use takes the smallest number that is free when its turn comes. ``taken`` (part, name) are
    names that the target has already. Without ``extension``, as for folders, the number stands behind the whole name.
    The order should be total within a part; a null name stays null.

    A row is given number j + s, where j counts the rows of its name that came before and s the numbers up to there
    that others hold. Only names that look numbered can hold one: ``a-2.jpg`` does for ``a.jpg`` if it came before the
    row that would take it, else it is itself displaced and numbered as a name of its own. So there are two running
    counts and, between them, one pass over the numbered names, whatever the clashes.
    """
    order = list(order)
    # Names of the target come first and hold their names.
    rows = df.withColumns({"__node": F.col(name), "__new": F.lit(1), "__weight": F.lit(1)})
    if taken is not None:
        held = taken.select(part, F.col(name).alias("__node")).distinct()
        rows = rows.unionByName(held.withColumns({"__new": F.lit(0), "__weight": F.lit(1)}), allowMissingColumns=True)
    first = F.min(F.struct("__new", *order)).alias("__first")
    each = rows.groupBy(part, "__node").agg(F.count("*").alias("__n"), first)

    body = names.stem(F.col("__node")) if extension else F.col("__node")
    ending = names.suffix(F.col("__node")) if extension else F.lit("")
    numbered = each.withColumns(
        {
            "__body": body,
            "__ending": ending,
            "__stem": F.regexp_extract(body, _NUMBERED, 1),
            "__k": F.nullif(F.regexp_extract(body, _NUMBERED, 2), F.lit("")).cast("bigint"),
        }
    ).filter("__k IS NOT NULL")
    parent = F.concat("__stem", "__ending")
    if extension:
        numbered = numbered.filter((names.stem(parent) == F.col("__stem")) & (names.suffix(parent) == F.col("__ending")))
    tail = F.regexp_extract(F.col("__body"), _TAIL, 0)
    numbered = numbered.select(
        F.col(part).alias("__part"),
        parent.alias("__parent"),
        "__k",
        F.col("__node").alias("__child"),
        F.concat(F.regexp_replace("__body", _TAIL, ""), "__ending").alias("__family"),
        (F.length(tail) - F.length(F.replace(tail, F.lit("-"), F.lit("")))).alias("__depth"),
        "__first",
    )
    same = F.col(part).eqNullSafe(F.col("__part")) & (F.col("__node") == F.col("__parent"))
    children = numbered.join(each.select(part, "__node", F.col("__n").alias("__above")), same)
    fields = ["__k", "__child", "__family", "__depth", "__above"]
    events = children.select(part, "__node", "__first.*", F.lit(0).alias("__weight"), *fields)
    # Rows of each name in order, and among them the first of each numbered name that could stand in their way.
    counted = running(rows.unionByName(events, allowMissingColumns=True), [part, "__node"], ["__new", *order], {"__r": F.col("__weight")})

    kids = counted.filter("__child IS NOT NULL").select(part, "__node", *fields, "__r")
    keys = [part, "__family", "__depth", "__node", "__k"]
    kind = df.schema[part].dataType.simpleString()
    marks = kids.repartition(part, "__family").sortWithinPartitions(*keys).mapInArrow(
        _displace, f"`{part}` {kind}, __node string, __place bigint, __displaced boolean"
    )
    marks = pin(marks)
    moved = marks.filter("__displaced").select(F.col(part).alias("__part"), F.col("__node").alias("__moved"))
    same = F.col(part).eqNullSafe(F.col("__part")) & F.col("__node").eqNullSafe(F.col("__moved"))
    mine = counted.filter("__new = 1 AND __weight = 1").drop(*fields).join(moved, same, "left")
    place = F.col("__r") - F.when(F.col("__moved").isNull(), 1).otherwise(0)
    mine = mine.withColumn("__place", place).withColumn("__gap", F.lit(0))
    gaps = marks.filter("__place IS NOT NULL").select(part, "__node", "__place", F.lit(1).alias("__gap"))
    if gaps.isEmpty():
        mine = mine.withColumn("__s", F.lit(0))
    else:
        both = mine.unionByName(gaps, allowMissingColumns=True)
        mine = running(both, [part, "__node"], ["__place", F.desc("__gap")], {"__s": F.col("__gap")}).filter("__gap = 0")
    number = (F.col("__place") + F.col("__s")).cast("string")
    stem, suffix = (names.stem(F.col(name)), names.suffix(F.col(name))) if extension else (F.col(name), F.lit(""))
    unique = F.when(F.col("__place") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("-"), number, suffix))
    return mine.select(*df.columns, unique.alias("unique_name"))


def _displace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which numbered names hold their number and which are displaced from it.

    Rows are a part's families of names from the shortest names on, the numbered names of a name by number, each with
    how many rows of that name came before (``__r``) and how many there are (``__above``). A name that holds its number
    gives the place from which on the numbering skips it. Kept are the displaced names of one length of a family.
    """
    here = depth = node = None
    above: set[str] = set()
    now: set[str] = set()
    skipped = 0
    for batch in batches:
        out: list[tuple] = []
        schema = batch.schema
        names_ = (schema.names[0], "__node", "__k", "__child", "__family", "__depth", "__above", "__r")
        for part, parent, k, child, family, level, n, before in zip(*[batch.column(c).to_pylist() for c in names_]):
            if (part, family) != here:
                here, depth, above, now, node = (part, family), level, set(), set(), None
            if level != depth:
                above, now, depth = (now if level == depth + 1 else set()), set(), level
            if parent != node:
                node, skipped = parent, 0
            # Rows of the parent that have to be numbered, of all and of those before this name's first.
            stays = parent not in above
            numbered, earlier = n - stays, max(0, before - stays)
            place = k - skipped
            if place <= earlier:
                now.add(child)
                out.append((part, child, None, True))
            else:
                skipped += 1
                if place <= numbered:
                    out.append((part, parent, place, False))
        kinds = [schema.field(0).type, pa.string(), pa.int64(), pa.bool_()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)]
        yield pa.RecordBatch.from_arrays(columns, [schema.names[0], "__node", "__place", "__displaced"])


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key, by partial aggregation."""
    latest = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(*key).agg(latest).select("r.*")


def first_error(results: DataFrame, key: str = "split") -> DataFrame:
    """First error per split in file order; null where all went well."""
    error = F.col("error")
    return results.groupBy(key).agg(F.min_by(error, F.when(error.isNotNull(), F.col("name"))).alias("first_error"))


def running_usage(df: DataFrame, order: Sequence[str], every: int = 50, kind: str = "kind") -> DataFrame:
    """Thermal usage counters in processing order, one row per ``every`` images."""
    ones = {k: (F.col(kind) == k).cast("bigint") for k in KINDS}
    counted = running(df.select(*order, kind), [], order, {**ones, "seen": F.lit(1).cast("bigint")})
    return counted.filter(F.col("seen") % every == 0).select("seen", *KINDS)


def progress(df: DataFrame, key: str = "session", order: Sequence[str] = ("name",), rendered: str = "rendered") -> DataFrame:
    """``done`` of ``total`` per session for each rendered image; skipped ones count in the total only."""
    totals = df.groupBy(key).agg(F.count("*").alias("total"))
    done = ranked(df.filter(F.col(rendered)), [key], order, "done")
    return done.join(totals, key)


def pr_curve(matches: DataFrame, n_gt: DataFrame, key: str = "class", order: Sequence[str] = ()) -> DataFrame:
    """Recall, precision and its envelope along falling scores.

    ``matches`` has the class, ``score`` and ``tp``; ``n_gt`` the number of ground-truth boxes per class.
    """
    falling = [F.col("score").desc(), *[F.col(c) for c in order]]
    hit = F.col("tp").cast("bigint")
    counted = running(matches, [key], falling, {"cum_tp": hit, "cum_fp": F.lit(1).cast("bigint") - hit})
    curve = counted.join(n_gt, key).withColumns(
        {
            "recall": F.col("cum_tp") / F.col("n_gt"),
            "precision": F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")),
        }
    )
    rising = [F.col("score"), *[F.col(c).desc() for c in reversed(order)]]
    # The position along the curve orders rows that agree in everything else.
    position = (F.col("cum_tp") + F.col("cum_fp")).desc()
    return running(curve, [key], [rising[0], position], maxima={"envelope": F.col("precision")}, tiebreak=False)


def preflight_sample(df: DataFrame, n: int = PREFLIGHT_SAMPLE, seed: int = PREFLIGHT_SEED, key: str = "image_id") -> DataFrame:
    """Repeatable sample of at most ``n`` rows: those with the smallest md5 of ``seed:key``, ties by key.

    Each task keeps its ``n`` smallest, so that no more leave it. Other engines can make the same draw.
    """
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(drawn, key).limit(n)
