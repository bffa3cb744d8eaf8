"""Exact top-k inner products by a vector-approximation file.

Every integer vector has an approximation: the cell of each component on a uniform grid. A scan of the approximations
bounds each score from both sides; a row whose upper bound is under the k-th best lower bound of a query is never read.
The rest is read in order of the upper bound: first the best few, then only those whose bound reaches the k-th score found.

Vectors that are null, empty, or hold a null or non-finite component, and rows without an id take no part. Of repeated ids
the largest vector counts. Only vectors of one width are compared. Scores must fit in 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.session import durable

SCALE = 64
#: Rows and queries that meet in one task: each task holds a score matrix of slices of these.
ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 8192
_SLICE = 256


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``width``, ``exact``: floor(scale * x) of the usable vectors."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~bad)
    ints = usable.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("exact"))
    return ints.groupBy("vec_id").agg(F.max("exact").alias("exact")).withColumn("width", F.size("exact"))


def with_cells(ints: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``cells``; a cell is a quarter of the root mean square of all components wide, at least 1."""
    spread = ints.select(F.aggregate("exact", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("s"), "width").agg(F.sum("s").alias("s"), F.sum("width").alias("n")).first()
    cell = max(1, round(((spread["s"] or 0.0) / max(1, spread["n"] or 0)) ** 0.5 / 4))
    return ints.withColumn("cells", F.transform("exact", lambda x: F.floor(x.cast("double") / cell).cast("int"))), cell


def _bounds(k: int, cell: int):
    half = (cell - 1) / 2

    def tile(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids = rows["vec_id"].to_numpy()
            middles = np.stack(rows["cells"].to_numpy()).astype(np.float64) * cell + half
            for first in range(0, len(queries), _SLICE):
                part = queries.iloc[first : first + _SLICE]
                asked, own = np.stack(part["exact"].to_numpy()).astype(np.float64), part["vec_id"].to_numpy()
                about = asked @ middles.T
                slack = half * np.abs(asked).sum(1) + 1e-6 * (1 + np.abs(about).max(1))
                about[ids[None, :] == own[:, None]] = -np.inf
                best = -np.partition(-about, min(k, len(ids)) - 1, axis=1)[:, : min(k, len(ids))]
                for i, query in enumerate(own):
                    kept = np.flatnonzero(about[i] >= max(best[i].min() - 2 * slack[i], -1e300))
                    lower = best[i][np.isfinite(best[i])] - slack[i]
                    out.append((query, lower.tolist(), ids[kept].tolist(), (about[i][kept] + slack[i]).tolist()))
        return pd.DataFrame(out, columns=["query_id", "lower", "found", "upper"])

    return tile


def _blocks(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def _candidates(stored: DataFrame, queries: DataFrame, k: int, cell: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``upper`` of all rows whose upper bound reaches the query's k-th best lower bound.

    Queries and rows are dealt to blocks; each pair of blocks is a task that emits one row per query.
    """
    n_rows, n_queries = stored.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // ROWS_PER_BLOCK)), max(1, -(-n_queries // QUERIES_PER_BLOCK))
    left = queries.select("vec_id", "exact", "width", _blocks(F.col("vec_id"), query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))
    right = stored.select("vec_id", "cells", "width", _blocks(F.col("vec_id"), row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    tiles = durable(left.groupBy("width", "qb", "rb").cogroup(right.groupBy("width", "qb", "rb")).applyInPandas(
        _bounds(k, cell), "query_id long, lower array<double>, found array<long>, upper array<double>"))
    best = tiles.select("query_id", F.explode("lower").alias("lower"))
    place = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    certain = best.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("lower")).otherwise(F.lit(float("-inf"))).alias("at_least"))
    pairs = F.filter(F.arrays_zip("found", "upper"), lambda x: x["upper"] >= F.col("at_least"))
    return tiles.join(certain, "query_id").select("query_id", F.explode(pairs).alias("x")).select("query_id", F.col("x.found").alias("vec_id"), F.col("x.upper").alias("upper"))


def _scored(pairs: DataFrame, stored: DataFrame, queries: DataFrame) -> DataFrame:
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("exact").alias("asked"))
    product = F.aggregate(F.zip_with("asked", "exact", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    return pairs.join(stored.select("vec_id", "exact"), "vec_id").join(asked, "query_id").select("query_id", "vec_id", product.alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k best other rows, ties to the smaller id."""
    stored, cell = with_cells(durable(integer_vectors(vectors, scale)))
    queries = stored.filter(is_query)
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    ordered = durable(_candidates(stored, queries, k, cell).withColumn("place", F.row_number().over(by_bound)))
    first = durable(_scored(ordered.filter(F.col("place") <= 2 * k), stored, queries))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = first.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    open_pairs = ordered.filter(F.col("place") > 2 * k).join(reached, "query_id", "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    scored = first.unionByName(_scored(open_pairs.select("query_id", "vec_id"), stored, queries))
    return scored.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
