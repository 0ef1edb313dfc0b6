"""Registry of queries by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab.catalog.views import Tables, expand
from heliotab.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under an operator id, with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if oracle:
            ORACLES[key] = expand(oracle, 1)
        return fn

    return register


def pixels(df: DataFrame, keys: list[str], px: str | Column = "px", digits: int = 6) -> DataFrame:
    """Rows (keys…, pos, v) of an array, for comparison by value."""
    values = df.select(*keys, F.posexplode(px).alias("pos", "v"))
    return values.withColumn("v", F.round(F.col("v").cast("double"), digits) + F.lit(0.0))
