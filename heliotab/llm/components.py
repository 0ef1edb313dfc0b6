"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotab.llm.common import compact, release
from heliotab.session import pin


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of the links (a, b); the component is its smallest node.

    Links are turned to the smallest neighbour again and again: every round, each node hands the smallest node of its
    neighbourhood to the others of it. Paths shorten by half or more, so there are about log(longest path) rounds.
    A hot node's neighbours are reduced to their minimum before the shuffle and meet one row in the join. Partitions
    follow the number of links, so rounds over few links take few tasks.
    """
    pairs = links.select("a", "b").filter("a <> b")
    both = pin(pairs.union(pairs.select("b", "a")).distinct())
    rows = both.count()
    both = compact(both, rows)
    state = None
    while True:
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        least = compact(pin(least.select("a", F.least("a", "least").alias("least"))), rows)
        # Each link becomes a link from its far end to the smallest node known to its near end.
        turned = both.join(least, "a").select(F.col("b").alias("x"), F.col("least").alias("y"))
        own = least.select(F.col("a").alias("x"), F.col("least").alias("y"))
        new = compact(turned.union(own), 2 * rows).filter("x <> y").distinct()
        check = new.agg(F.count("x"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if tuple(check) == state:
            return least.select(F.col("a").alias("node"), F.col("least").alias("component"))
        state = tuple(check)
        rows = 2 * check[0]
        both = new.select(F.col("x").alias("a"), F.col("y").alias("b")).union(new.select("y", "x"))
        both = compact(pin(compact(both, rows).distinct()), rows)
        release(links.sparkSession)
