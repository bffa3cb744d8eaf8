"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.session import durable, narrowed


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for every node in ``edges`` (``a``, ``b``: whole numbers).

    Alternating stars: every node hands the least node of its neighbourhood first to its larger, then to its smaller
    neighbours, until nothing changes. Only minima are aggregated, so a node with many neighbours is not gathered. No round
    adds to the number of edges, so each runs in as many tasks as the first edges need.
    """
    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, seen = now.count(), None
    while True:
        now = narrowed(now, n)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = narrowed(narrowed(large, n).distinct(), n)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = handed.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b")
        now = durable(narrowed(narrowed(stars, n).distinct(), n))
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
