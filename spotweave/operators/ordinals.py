"""Ordinals, ranks and running totals that never bring a whole group, or the whole table, into one task.

A plain ``Window.partitionBy(key)`` sorts each key inside one task. Here rows are range partitioned over
``(keys, order)``, so a hot key is cut into slices; a running total is taken per slice and the totals of the
earlier slices of the same key are added. At most ``slices`` keys can straddle a boundary, so the table of
carried totals has at most ``2 * slices`` rows, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.session import broadcast_if_small, durable

#: A key with more left rows than this is looked up by broadcast: N rows have at most N / HOT_ROWS such keys.
HOT_ROWS = 1_000_000


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    weight: str | Column | None = None,
    name: str = "before",
    slices: int | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` (default: the row count) over the *earlier* rows of the same key."""
    w = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    return running_totals(df, keys, order, {name: w}, slices)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], weights: dict[str, Column], slices: int | None = None
) -> DataFrame:
    """Add, for every name, the sum of its weight over the *earlier* rows of the same key, all in one pass.

    The order columns must make the rows of a key distinct. The slice number is written durably before it is
    used twice, so a recomputed task cannot place a row in another slice.
    """
    keys = list(keys)
    order_columns = [F.col(c) if isinstance(c, str) else c for c in order]
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = list(enumerate(weights.items()))
    sliced = durable(
        df.select("*", *[w.alias(f"_w{i}") for i, (_, w) in each])
        .repartitionByRange(n, *keys, *order_columns)
        .withColumn("_slice", F.spark_partition_id())
    )
    local = Window.partitionBy("_slice", *keys).orderBy(*order_columns).rowsBetween(Window.unboundedPreceding, -1)
    inside = sliced.select("*", *[F.coalesce(F.sum(f"_w{i}").over(local), F.lit(0)).alias(f"_local{i}") for i, _ in each])

    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(f"_w{i}").alias(f"_sum{i}") for i, _ in each])
    if keys:
        spans = (
            totals.groupBy(*keys)
            .agg(F.min("_slice").alias("_lo"), F.max("_slice").alias("_hi"))
            .where("_lo < _hi")
            .select(*[F.col(k).alias(f"_key_{k}") for k in keys])
        )
        same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        totals = totals.join(F.broadcast(spans), _all(same), "left_semi")
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_slice").alias("_in"),
        *[F.coalesce(F.sum(f"_sum{i}").over(earlier), F.lit(0)).alias(f"_carry{i}") for i, _ in each],
    )
    on = [F.col("_slice") == F.col("_in")] + [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    joined = inside.join(F.broadcast(carried), _all(on), "left")
    return joined.select("*", *[(F.col(f"_local{i}") + F.coalesce(f"_carry{i}", F.lit(0))).alias(name) for i, (name, _) in each]).drop(
        "_slice", "_in", *[f"_key_{k}" for k in keys], *[f"{c}{i}" for c in ("_w", "_local", "_carry") for i, _ in each]
    )


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def ordinal(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """Zero-based dense position in the given order, over the table or within each key."""
    return running_total(df, keys, order, None, name)


def first_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in order, kept distributed (a sorted ``limit`` would end in one task)."""
    return ordinal(df, order, name="_position").where(F.col("_position") < n).drop("_position")


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest order value, by partial ``max_by``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(F.struct(F.col(c)), F.col(order)).getField(c).alias(c) for c in rest])


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join to a table that is unique on ``on`` when one key may hold a large share of the left rows.

    Left keys above ``hot_rows`` rows (at most ``rows / hot_rows`` of them) are counted, flagged (by broadcast only if they
    are few) and spread over 64 salts, with the matching right rows copied to each salt; all other keys shuffle as usual.
    The salt also takes the task a row is read by, so equal rows of a hot key are spread as well.
    """
    on = list(on)
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_size"))
    hot = durable(sizes.where(F.col("_size") > hot_rows).select(*on, F.lit(True).alias("_hot")))
    hot = broadcast_if_small(hot, hot.count())
    spread = left.withColumn("_draw", F.xxhash64(F.spark_partition_id(), *left.columns)).join(hot, on, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod("_draw", F.lit(64)).cast("int")).otherwise(F.lit(0)),
    ).drop("_hot", "_draw")
    copies = right.join(hot, on, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))),
    ).drop("_hot")
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """One-based rank with ties sharing their mean rank; a NULL value has a NULL rank.

    Ranks are computed on distinct values with their counts (ties are combined before any shuffle), then looked
    up. A value that fills a third of the rows, such as zero, is one row in the rank table and is salted in the
    lookup.
    """
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_total(values, keys, [value], "_n", "_before").select(
        *keys, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name)
    )
    return lookup(df, ranks, [*keys, value], "left")


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Interpolated median from value counts and running totals (no buffer of all values anywhere)."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, keys, [value], "_n", "_before")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = placed.join(sizes, keys) if keys else placed.withColumn("_total", F.lit(sizes.first()["_total"]))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    end = F.col("_before") + F.col("_n")
    lower = F.max(F.when((F.col("_before") <= low) & (low < end), F.col(value)))
    upper = F.max(F.when((F.col("_before") <= high) & (high < end), F.col(value)))
    return joined.groupBy(*keys).agg(((lower + upper) / 2.0).alias(name))


def seeded_split(df: DataFrame, id_column: str, fraction: float, seed: int, n_rows: int) -> DataFrame:
    """Mark exactly ``max(1, rint(n * fraction))`` rows as validation, chosen by a seeded hash order."""
    validation = max(1, int(round(n_rows * float(fraction))))
    if n_rows - validation <= 0:
        raise ValueError("The training side of the split is empty.")
    keyed = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(id_column)))
    placed = ordinal(keyed, ["_hash", id_column], name="_position")
    return placed.withColumn("is_validation", F.col("_position") < validation).drop("_hash", "_position")
