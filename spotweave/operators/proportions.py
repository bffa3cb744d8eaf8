"""Cell-type proportions per spot, long form ``(spot_id, cell_type, p)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators.counts import shared_genes
from spotweave.operators.ordinals import exact_median
from spotweave.session import BROADCAST_ROWS, broadcast_if_small, durable, one_row


def average_duplicates(proportions: DataFrame) -> DataFrame:
    """Repeated rows of a spot are averaged, missing values skipped."""
    return proportions.groupBy("spot_id", "cell_type").agg(F.avg("p").alias("p"))


def reindexed(proportions: DataFrame, targets: DataFrame, types: DataFrame) -> DataFrame:
    """Every target spot with every type, missing entries 0.

    ``types``: ``(cell_type)``, a vocabulary. The type list is carried as one array per spot, not as a cross join.
    """
    names = [r["cell_type"] for r in types.select("cell_type").distinct().orderBy("cell_type").collect()]
    grid = targets.select("spot_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("cell_type"))
    return grid.join(proportions, ["spot_id", "cell_type"], "left").select(
        "spot_id", "cell_type", F.coalesce("p", F.lit(0.0)).alias("p")
    )


def merge_types(proportions: DataFrame, merge: DataFrame) -> DataFrame:
    """Sum source types into their target; unmapped sources vanish, a source of two targets counts in both.

    ``merge``: ``(target, source)``, one row per pair of the merge map (a vocabulary). A source that is no type
    of the table is an error.
    """
    absent = merge.join(proportions.select(F.col("cell_type").alias("source")).distinct(), "source", "left_anti")
    missing = [(r["target"], r["source"]) for r in absent.select("target", "source").limit(5).collect()]
    if missing:
        raise ValueError(f"Missing source types (target, source): {missing}")
    pairs = merge.select("target", F.col("source").alias("cell_type"))
    n = one_row(pairs.agg(F.count(F.lit(1)).alias("n")))["n"]
    return (
        proportions.join(broadcast_if_small(pairs, n), "cell_type")
        .groupBy("spot_id", "target")
        .agg(F.sum(F.coalesce("p", F.lit(0.0))).alias("p"))
        .withColumnRenamed("target", "cell_type")
        .select("spot_id", "cell_type", "p")
    )


def normalised(proportions: DataFrame, floor: float, clip: bool = True) -> DataFrame:
    """Optionally clip at 0, then divide by ``max(spot total, floor)``; with clipping an all-zero spot stays 0."""
    p = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.0)) if clip else F.coalesce("p", F.lit(0.0))
    clipped = proportions.withColumn("p", p)
    sums = clipped.groupBy("spot_id").agg(F.sum("p").alias("_total"))
    return clipped.join(sums, "spot_id").select(
        "spot_id", "cell_type", (F.col("p") / F.greatest("_total", F.lit(floor))).alias("p")
    )


def merged_proportions(proportions: DataFrame, merge: DataFrame) -> DataFrame:
    return normalised(merge_types(proportions, merge), 1e-12)


def training_targets(proportions: DataFrame, targets: DataFrame, types: DataFrame) -> DataFrame:
    """Averaged, reindexed to the target spots, clipped and normalised."""
    return normalised(reindexed(average_duplicates(proportions), targets, types), 1e-8)


def as_vectors(proportions: DataFrame, types: list[str]) -> DataFrame:
    """``(spot_id, proportions)`` with one element per type, in type order, by conditional sums."""
    parts = [F.coalesce(F.sum(F.when(F.col("cell_type") == t, F.col("p"))), F.lit(0.0)) for t in types]
    return proportions.groupBy("spot_id").agg(F.array(*parts).alias("proportions"))


def mixture_proportions(
    counts: DataFrame,
    profiles: DataFrame,
    types: list[str],
    rounds: int = 50,
    umi_minimum: float = 0.0,
    checkpoint_every: int = 10,
    spot: str = "barcode",
) -> DataFrame:
    """``x_s ~ l_s * sum_k p_sk r_k`` by Poisson-mixture EM, on the genes both sides share.

    ``counts``: ``(barcode, gene, count)``; ``profiles``: ``(cell_type, gene, profile)``. Genes that only one side
    has take no part, neither in the fit nor in the weight of a type. A profile is one short array per gene. Counts are joined to it once and stay partitioned by spot, so a round is one co-partitioned
    join and one aggregate with no new shuffle of the counts; a spot has at most one row per gene. Returns
    ``(spot, umi, p array<double>)``; spots below the minimum or without a usable gene have NULL.
    """
    collapsed = durable(counts.groupBy(spot, "gene").agg(F.sum("count").alias("x")))
    spread = durable(profiles.join(shared_genes(profiles, collapsed), "gene").groupBy("gene").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("cell_type") == t, F.col("profile"))), F.lit(0.0)) for t in types]).alias("r")
    ))
    n_genes = one_row(spread.agg(F.count(F.lit(1)).alias("n")))["n"]
    kept = collapsed.groupBy(spot).agg(F.sum("x").alias("umi"))
    enough = kept.where(F.col("umi") >= umi_minimum).select(spot)
    k = len(types)
    r = [F.get("r", F.lit(i)) for i in range(k)]
    usable = sum(r[1:], r[0]) > 0
    shared = durable(
        collapsed.where("x > 0")
        .join(broadcast_if_small(spread, n_genes, BROADCAST_ROWS), "gene")
        .where(usable)
        .join(enough, spot, "left_semi")
        .repartition(spot)
        .select(spot, "x", "r")
    )
    column_total = one_row(spread.agg(*[F.sum(r[i]).alias(f"r{i}") for i in range(k)]))
    weight = [float(column_total[f"r{i}"] or 0.0) for i in range(k)]
    p = shared.select(spot).distinct().select(
        spot, F.array(*[F.lit(1.0 / k if weight[i] > 0 else 0.0) for i in range(k)]).alias("p")
    )
    for step in range(rounds):
        pk = [F.get("p", F.lit(i)) for i in range(k)]
        terms = [pk[i] * r[i] for i in range(k)]
        mu = sum(terms[1:], terms[0])
        moved = shared.join(p, spot).groupBy(spot).agg(
            *[F.sum(F.when(mu > 0, F.col("x") * terms[i] / mu).otherwise(0.0)).alias(f"m{i}") for i in range(k)]
        )
        raw = [F.col(f"m{i}") / F.lit(weight[i]) if weight[i] > 0 else F.lit(0.0) for i in range(k)]
        whole = sum(raw[1:], raw[0])
        p = moved.select(spot, F.array(*[F.when(whole > 0, v / whole).otherwise(0.0) for v in raw]).alias("p"))
        if (step + 1) % checkpoint_every == 0 and step + 1 < rounds:
            p = durable(p)
    return kept.select(spot, "umi").join(p, spot, "left")


def require_valid(checks: dict) -> None:
    """Raise if :func:`validate` counted anything that must not occur."""
    failed = {name: n for name, n in checks.items() if name.startswith("n_") and n}
    if failed:
        raise ValueError(f"Proportions are not valid: {failed}")


def with_missing_spots(merged: DataFrame, spots: DataFrame, types: DataFrame) -> DataFrame:
    """Adds the spots that have no proportions (``spot_id``), NULL for every type. ``types`` is a vocabulary."""
    names = [r["cell_type"] for r in types.select("cell_type").distinct().orderBy("cell_type").limit(10_000).collect()]
    every = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    rows = spots.select("spot_id", F.explode(every).alias("cell_type"), F.lit(None).cast("double").alias("p"))
    return merged.select("spot_id", "cell_type", "p").unionByName(rows)


def validate(proportions: DataFrame, expected_types: DataFrame, expected_spots: DataFrame) -> DataFrame:
    """One row of checks: same types, same spots, nothing missing or non-finite, and the spread of spot totals."""
    types = proportions.select("cell_type").distinct()
    spots = proportions.select("spot_id").distinct()
    wanted_types, wanted_spots = expected_types.select("cell_type").distinct(), expected_spots.select("spot_id").distinct()
    sums = proportions.groupBy("spot_id").agg(F.sum("p").alias("total"))
    median = exact_median(sums, "total").select(F.col("median").alias("row_sum_median"))
    checks = {
        "n_unexpected_types": types.exceptAll(wanted_types).count(),
        "n_missing_types": wanted_types.exceptAll(types).count(),
        "n_unexpected_spots": spots.exceptAll(wanted_spots).count(),
        "n_missing_spots": wanted_spots.exceptAll(spots).count(),
    }
    bad = proportions.agg(
        F.count_if(F.col("p").isNull() | F.isnan("p") | (F.abs("p") == float("inf"))).alias("n_not_finite"),
    )
    spread = sums.agg(F.min("total").alias("row_sum_min"), F.max("total").alias("row_sum_max"))
    values = {**checks, **one_row(bad), **one_row(spread), **one_row(median)}
    row = proportions.sparkSession.range(1)
    return row.select(*[F.lit(v).alias(name) for name, v in values.items()])
