"""Joins between images, labels, thermal planes, predictions, positions and runs.

Plain equi-joins leave the physical choice to Spark: a side is broadcast only below Spark's own size threshold, and
AQE splits skewed partitions of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotab.functions import names
from heliotab.operators.skew import collect_chunks
from heliotab.session import pin

# Columns that may name the thermal file, folder names and extensions, in order of preference.
EXPLICIT_COLUMNS = (
    "thermal_file_name",
    "thermal_path",
    "thermal",
    "t_path",
    "rjpeg_path",
    "thermal_png_path",
    "ir_path",
)
THERMAL_FOLDERS = ("thermal", "Thermal", "THERMAL", "ir", "IR")
# Endings of a stem and what may stand in their place, in the order of trial. All of BARE_ENDING goes at
# once, right after the first.
STEM_ENDINGS = (("_T_JPG", "_T"), ("_JPG", ""), ("_T", ""))
BARE_ENDING = "_T_JPG"
THERMAL_EXTENSIONS = (".tif", ".tiff", ".TIF", ".TIFF")
PATTERNS = 20_000  # names in one automaton
_BEST = ("shorter", "name", "path")  # order of preference: the longest name first
WEIGHT_NAMES = ("model_final.pth", "model_best.pth", "model.pth")
FINAL_WEIGHTS = "model_final.pth"


def _rank_in(value: Column, listed: tuple[str, ...]) -> Column:
    """Position in a list, or null."""
    place = F.array_position(F.array(*[F.lit(v) for v in listed]), value)
    return F.when(place > 0, place - 1)


def image_annotations(images: DataFrame, annotations: DataFrame, key: str = "image_id", order: tuple[str, ...] = ("ann_id",), chunk_size: int = 1000) -> DataFrame:
    """Images with their annotations as lists; images without any keep one row with an empty list.

    An image with more than ``chunk_size`` annotations gets several rows (chunk 0, 1, …), so no list is unbounded.
    """
    fields = [c for c in annotations.columns if c != key]
    lists = collect_chunks(annotations, [key], list(order), F.struct(*fields), chunk_size, "annotations")
    joined = images.join(lists, key, "left")
    empty = F.array().cast(lists.schema["annotations"].dataType)
    return joined.withColumns(
        {"chunk": F.coalesce("chunk", F.lit(0).cast("bigint")), "annotations": F.coalesce("annotations", empty)}
    )


def filter_empty(images: DataFrame, annotations: DataFrame, key: str = "image_id") -> DataFrame:
    """Images that have at least one annotation which is not a crowd."""
    usable = annotations.filter(F.coalesce(F.col("iscrowd"), F.lit(0)) == 0).select(key)
    return images.join(usable, key, "left_semi")


# --------------------------------------------------------------------------------------------- thermal match


def _root(path: Column) -> Column:
    """Base name without its extension; leading dots do not start one."""
    return F.regexp_replace(names.basename(path), r"(?s)^(.*[^.].*)\.[^.]*$", "$1")


def _explicit(rgb: DataFrame, thermal: DataFrame) -> DataFrame | None:
    given = [c for c in EXPLICIT_COLUMNS if c in rgb.columns]
    if not given:
        return None
    wanted = F.array(*[F.col(c) for c in given])
    candidates = rgb.select("path", F.posexplode(wanted).alias("rank", "thermal_file")).filter("thermal_file IS NOT NULL")
    known = thermal.select(F.col("path").alias("thermal_file")).distinct()
    found = candidates.join(known, "thermal_file")
    return found.groupBy("path").agg(F.min_by("thermal_file", "rank").alias("explicit_file"))


def _thermal_index(thermal: DataFrame) -> DataFrame:
    """Thermal files of the preferred folder of each split: (split, name, root, path)."""
    parent = names.folder(F.col("path"))
    files = thermal.select(
        names.folder(parent).alias("split"),
        _rank_in(names.basename(parent), THERMAL_FOLDERS).alias("folder_rank"),
        names.basename(F.col("path")).alias("name"),
        _root(F.col("path")).alias("root"),
        "path",
    ).filter("folder_rank IS NOT NULL")
    preferred = files.groupBy("split").agg(F.min("folder_rank").alias("folder_rank"))
    return files.join(preferred, ["split", "folder_rank"], "left_semi").drop("folder_rank")


def _stem_variants(stem: Column) -> Column:
    """Stems to try in order, each once."""
    shortened = [
        F.when(stem.endswith(ending), F.concat(F.left(stem, F.length(stem) - len(ending)), F.lit(rest)))
        for ending, rest in STEM_ENDINGS
    ]
    bare = F.when(stem.endswith(BARE_ENDING), F.replace(stem, F.lit(BARE_ENDING), F.lit("")))
    return F.array_distinct(F.array_compact(F.array(stem, shortened[0], bare, *shortened[1:])))


def _contained(images: DataFrame, files: DataFrame) -> DataFrame:
    """For each (split, low) of ``images`` the best file of that split whose ``low`` contains it or lies in it.

    ``files`` has (split, low, best). Once the images' names are sought in the files' names, once the other way round:
    the names sought go into automata of at most PATTERNS of a split, and the names to read stream past them. A task
    holds one automaton and a best file per name in it, whatever a folder holds; nothing is listed pair by pair.
    """
    kind = files.schema["best"].dataType.simpleString()
    sides = [(images.withColumn("best", F.lit(None).cast(kind)), files), (files, images.withColumn("best", F.lit(None).cast(kind)))]
    parts = []
    for side, (sought, read) in enumerate(sides):
        blocks = sought.groupBy("split").agg(F.ceil(F.count("*") / PATTERNS).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("low"), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        for turn, (names_, place) in enumerate(((sought, block), (read, every))):
            joined = names_.join(blocks, "split").withColumn("block", place)
            parts.append(joined.select("split", F.lit(side).alias("side"), "block", F.lit(turn).alias("turn"), "low", "best.*"))
    keys = ["split", "side", "block"]
    met = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    fields = ", ".join(f"{n} {met.schema[n].dataType.simpleString()}" for n in ("split", "low", *_BEST))
    found = met.sortWithinPartitions(*keys, "turn").mapInArrow(_search, fields)
    return found.groupBy("split", "low").agg(F.min(F.struct(*_BEST)).alias("best"))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (split, low, best…) from names sought (turn 0) and read (turn 1); those of one block stand together."""
    fields = ("split", "low", *_BEST)
    here = automaton = None
    best: dict[str, tuple] = {}  # of the names sought
    empty = False  # whether the empty name, which lies in every other, is sought
    out: list[tuple] = []

    def close() -> None:
        if here is not None and here[1] == 0:
            out.extend((here[0], low, *b) for low, b in best.items() if b is not None)

    for batch in batches:
        types = [batch.schema.field(n).type for n in fields]
        columns = [batch.column(n).to_pylist() for n in ("split", "side", "block", "turn", "low", *_BEST)]
        for split, side, block, turn, low, *rank in zip(*columns):
            if (split, side, block) != here:
                close()
                here, best, empty, automaton = (split, side, block), {}, False, ahocorasick.Automaton()
            if turn == 0:
                best[low] = tuple(rank) if side else None
                empty = empty or not low
                if low:
                    automaton.add_word(low, low)
                continue
            if automaton.kind == ahocorasick.TRIE:
                automaton.make_automaton()
            hits = {low_ for _, low_ in automaton.iter(low)} if len(automaton) else set()
            if empty:
                hits.add("")
            if side == 0:
                for hit in hits:
                    if best[hit] is None or tuple(rank) < best[hit]:
                        best[hit] = tuple(rank)
            elif hits:
                out.append((split, low, *min(best[hit] for hit in hits)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], fields)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], fields)


def match_thermal(rgb: DataFrame, thermal: DataFrame) -> DataFrame:
    """Thermal file of each colour image, tried in stages.

    ``rgb`` has ``path`` (and perhaps columns that name the thermal file), ``thermal`` has ``path``. Added are
    ``thermal_path`` and ``stage``: explicit, stem, case, substring, or null. The stages: a named file that exists; the
    stem and its variants; the stem in another case; a stem that contains the other, where the longest file name wins.

    All stages but the last are equi-joins; for that one see :func:`_contained`. Names are matched once per (split,
    stem), however many copies of an image there are.
    """
    stem = names.strip_rf_suffix(_root(F.col("path")))
    images = rgb.withColumns({"split": names.folder(F.col("path")), "stem": stem})
    index = pin(_thermal_index(thermal).withColumn("low", F.lower("root")))
    # The later stages see the two lower-case extensions only, .tif before .tiff.
    small = F.col("name").endswith(".tif") | F.col("name").endswith(".tiff")
    extension = _rank_in(F.expr("substring(name, length(root) + 1)"), THERMAL_EXTENSIONS)
    entry = lambda step, key, rank: F.struct(F.lit(step).alias("step"), key.alias("key"), rank.cast("int").alias("rank"))
    entries = F.array_compact(
        F.array(
            F.when(extension.isNotNull(), entry(0, F.col("root"), extension)),
            F.when(small, entry(1, F.col("low"), F.col("name").endswith(".tiff"))),
        )
    )
    listed = index.select("split", "name", "path", F.explode(entries).alias("e")).select("split", "name", "path", "e.*")
    lookup = listed.groupBy("split", "step", "key").agg(F.min_by("path", F.struct("rank", "name")).alias("file"))

    tries = F.concat(
        F.transform(_stem_variants(F.col("stem")), lambda v, i: entry(0, v, i)),
        F.array(entry(1, F.lower("stem"), F.lit(len(STEM_ENDINGS) + 2))),
    )
    keys = images.select("split", "stem").distinct().select("split", "stem", F.explode(tries).alias("t"))
    tried = keys.select("split", "stem", "t.*").join(lookup, ["split", "step", "key"], "left")
    hit = F.when(F.col("file").isNotNull(), F.struct(tried["rank"], "step", "file"))
    staged = tried.groupBy("split", "stem").agg(F.min(hit).alias("hit"))
    staged = pin(staged.select("split", "stem", F.lower("stem").alias("low"), "hit.step", "hit.file"))

    rest = staged.filter("file IS NULL").select("split", "low").distinct()
    preference = F.struct((-F.length("name")).alias("shorter"), F.col("name"), F.col("path"))  # as _BEST
    best = index.filter(small).groupBy("split", "low").agg(F.min(preference).alias("best"))
    contained = _contained(rest, best).select("split", "low", F.col("best.path").alias("part_file"))
    matches = staged.join(contained, ["split", "low"], "left").select("split", "stem", "step", "file", "part_file")
    joined = images.join(matches, ["split", "stem"], "left")
    named = _explicit(rgb, thermal)
    if named is None:
        joined = joined.withColumn("explicit_file", F.lit(None).cast("string"))
    else:
        joined = joined.join(named, "path", "left")
    stage = (
        F.when(F.col("explicit_file").isNotNull(), "explicit").when(F.col("file").isNotNull(), F.element_at(F.array(F.lit("stem"), F.lit("case")), F.col("step") + 1))
        .when(F.col("part_file").isNotNull(), "substring")
    )
    kept = [c for c in rgb.columns if c != "thermal_path"]
    return joined.select(*kept, F.coalesce("explicit_file", "file", "part_file").alias("thermal_path"), stage.alias("stage"))


def sidecar_join(rgb: DataFrame, files: DataFrame, subfolder: str | None = None) -> DataFrame:
    """Thermal file beside each image: ``<stem>_thermal.tif``, else ``.tiff``; null where there is none.

    ``subfolder`` looks into a folder below the image's own instead (decoded planes are written to ``thermal``).
    """
    side = F.regexp_extract(F.col("path"), r"_thermal(\.tiff?)$", 1)
    found = files.filter(side != "").select(
        names.folder(F.col("path")).alias("__folder"),
        F.regexp_replace(names.basename(F.col("path")), r"_thermal\.tiff?$", "").alias("__stem"),
        side.alias("ext"),
        F.col("path").alias("file"),
    )
    sidecars = found.groupBy("__folder", "__stem").agg(F.min_by("file", "ext").alias("thermal_path"))
    place = names.folder(F.col("path"))
    if subfolder:
        place = F.concat_ws("/", place, F.lit(subfolder))
    keyed = rgb.withColumns({"__folder": place, "__stem": names.stem(F.col("path"))})
    return keyed.join(sidecars, ["__folder", "__stem"], "left").drop("__folder", "__stem")


def missing_thermal(rgb: DataFrame, thermal: DataFrame, key: str = "image_id") -> DataFrame:
    """Failure rows of the images without a thermal plane."""
    absent = rgb.join(thermal.select(key), key, "left_anti")
    return absent.withColumn("reason", F.lit("no_thermal_sidecar"))


# ------------------------------------------------------------------------------------- map, runs, class names


def georeference(preds: DataFrame, images: DataFrame, geo: DataFrame, name: str = "name") -> DataFrame:
    """Predictions of images that exist and have a position.

    Camera names repeat in every flight, so tables that know their ``session`` are joined by it as well.
    """
    known = geo.filter("lat IS NOT NULL AND lon IS NOT NULL")
    located = known.select(*[c for c in ("session", name) if c in known.columns], "lat", "lon")
    joined = preds.join(images, shared_keys(preds, images, name))
    return joined.join(located, shared_keys(joined, located, name))


def shared_keys(left: DataFrame, right: DataFrame, name: str = "name") -> list[str]:
    """The name of an image, and its session where both tables have it."""
    return [c for c in ("session", name) if c in left.columns and c in right.columns]


def class_table(models: DataFrame) -> DataFrame:
    """Class names of models as rows (model, class_id, class_name)."""
    return models.select(F.col("name").alias("model"), F.posexplode("class_names").alias("class_id", "class_name"))


def _looked_up(label: Column) -> Column:
    """Id by which a class given as text is named: itself if it is all digits, else 0."""
    return F.when(label.rlike("^[0-9]+$"), label).otherwise(F.lit("0"))


def with_class_names(dets: DataFrame, classes: DataFrame, class_id: str = "class", label: str | None = None) -> DataFrame:
    """Class name of each detection, or the text of its id.

    The name goes by the text ``label`` where there is one (``1`` names class 1, ``1.0`` class 0), as :func:`resolve_class`
    has it, and by the id else. Negative ids are not plain digits, hence look up class 0.
    """
    text = F.col(class_id).cast("string") if label is None else F.coalesce(label, F.lit("0"))
    sought = dets.withColumn("__text", F.coalesce(_looked_up(text), F.lit("0")))
    named = sought.withColumn("class_id", F.col("__text").try_cast("int")).join(
        classes.select("class_id", "class_name"), "class_id", "left"
    )
    whole = F.coalesce(F.col("class_id").cast("string"), F.col("__text"))
    return named.withColumn("classname", F.coalesce("class_name", whole)).drop("class_name", "__text")


def resolve_class(value: Column, class_names: Column) -> Column:
    """``struct<class,classname>`` of a class given as text.

    The name is looked up by the value if it is all digits, else by 0; an id without a name is its own name. The class
    is the truncated number.
    """
    text = value.cast("string")
    lookup = _looked_up(text).try_cast("int")
    name = F.coalesce(F.get(class_names, lookup), lookup.cast("string"))
    number = F.coalesce(text.try_cast("double").cast("int"), F.lit(0))
    return F.struct(number.alias("class"), name.alias("classname"))


def pair_thumbs(overlays: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Overlays (session, url) with the thumbnail of the same base name, or themselves."""
    small = thumbs.select("session", names.basename(F.col("url")).alias("file"), F.col("url").alias("thumb"))
    large = overlays.select("session", names.basename(F.col("url")).alias("file"), F.col("url").alias("overlay"))
    joined = large.join(small, ["session", "file"], "left")
    return joined.withColumn("thumb", F.coalesce("thumb", "overlay"))


def trained_runs(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs (name) that have final weights among the files (run, name)."""
    final = files.filter(F.col("name") == FINAL_WEIGHTS).select(F.col("run").alias("__run"))
    return runs.join(final, runs["name"] == final["__run"], "left_semi")


def resolve_weights(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Best weights file per run (run, weights, exists); the final name stands in where there is none."""
    ranked = files.withColumn("rank", _rank_in(F.col("name"), WEIGHT_NAMES)).filter("rank IS NOT NULL")
    best = ranked.groupBy("run").agg(F.min_by("name", "rank").alias("found"))
    joined = runs.select(F.col("name").alias("run")).join(best, "run", "left")
    return joined.select(
        "run", F.coalesce("found", F.lit(FINAL_WEIGHTS)).alias("weights"), F.col("found").isNotNull().alias("exists")
    )


def resolve_num_classes(models: DataFrame, coco_counts: DataFrame, default: int) -> DataFrame:
    """Class count per model: metadata, then its annotation file, then the default; zero counts as absent."""
    joined = models.join(coco_counts.select("name", "n_categories"), "name", "left")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return joined.withColumn("classes", F.coalesce(positive("num_classes"), positive("n_categories"), F.lit(default)))


def attach_pairs(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Thermal path recorded for the image's absolute path, if any."""
    return images.join(pairs, images["path"] == pairs["rgb_path"], "left").drop("rgb_path")
