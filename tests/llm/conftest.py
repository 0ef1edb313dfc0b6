import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators give their results; a table may have them already.
CLASHING = ("size", "target", "copies", "ids", "decoded", "media", "audio", "score", "spans", "pooled", "n_lines",
            "n_dropped", "removed", "kept", "template", "coverage", "label", "node", "bands", "first", "pos", "k_id", "k_text", "line",
            "digest", "key", "masked", "seed", "class_id", "row", "asks")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = [rng.choice("alpha beta gamma delta sigma omega kappa theta zeta").title() for _ in range(1)]
    for k in range(words):
        out.append("".join(rng.choice(["ka", "lo", "mi", "ru", "te", "so", "na", "é"]) for _ in range(rng.randint(1, 4))))
        if k % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out)


def awkward_rows():
    long = prose(1, 20_000)
    near = prose(2, 200)
    return [
        (1, prose(3, 80), "en", "b", 10),
        (2, prose(3, 80), "en", "b", 10),
        (2, prose(3, 80), "en", "b", 10),
        (3, near, None, None, None),
        (4, near.replace("ka", "ko", 1), "de", "a", 7),
        (5, "", "en", "a", 0),
        (6, None, None, "a", None),
        (None, near, "en", None, 3),
        (None, "only words", "en", "c", 3),
        (7, long, "fr", "c", 5),
        (8, long + " end", "fr", "c", 5),
        (9, "\0 \t\r\n  ▁<s> \U0001f984 ß", "en", "", 9),
        (9, "another text under one id", "en", "", 9),
        (10, "!!! ... ???", "en", "b", 11),
        (11, "x" * 5000, "en", "b", 5000),
    ]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.withColumns({name: F.lit("taken") for name in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
