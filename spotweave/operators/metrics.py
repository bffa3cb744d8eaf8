"""Correlations, rank correlations, composition metrics and the training losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.arrays import doubles, let, shares, total
from spotweave.operators.ordinals import average_rank
from spotweave.session import one_row


def paired_values(predicted: DataFrame, target: DataFrame, pred: str = "expr", truth: str = "expr", key: str = "spot_id") -> DataFrame:
    """``(<key>, gene_pos, x, y)``, one row per spot and gene; NaN and infinities become NULL. ``key`` is unique on both sides."""
    both = predicted.select(key, F.col(pred).alias("_x")).join(target.select(key, F.col(truth).alias("_y")), key)
    pairs = both.select(key, F.posexplode(F.arrays_zip(doubles(F.col("_x")), doubles(F.col("_y")))).alias("gene_pos", "_p"))
    names = [f.name for f in pairs.schema["_p"].dataType.fields]
    return pairs.select(
        key, "gene_pos", _finite(F.col("_p").getField(names[0])).alias("x"), _finite(F.col("_p").getField(names[1])).alias("y")
    )


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def pearson(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", name: str = "pcc") -> DataFrame:
    """Pearson correlation per key; NULL for fewer than two pairs or a constant side. Partial sums per key."""
    usable = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(usable, F.col(x)), F.when(usable, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    value = F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))
    return pairs.groupBy(*keys).agg(F.when(F.count_if(usable) >= 2, value).alias(name))


def spearman(pairs: DataFrame, keys: Sequence[str], name: str = "scc") -> DataFrame:
    """Pearson correlation of average ranks; each side is ranked over its own present values."""
    ranked = average_rank(average_rank(pairs, keys, "x", "_rx"), keys, "y", "_ry")
    return pearson(ranked, keys, "_rx", "_ry", name)


def gene_metrics(pairs: DataFrame) -> DataFrame:
    return pearson(pairs, ["gene_pos"]).join(spearman(pairs, ["gene_pos"]), "gene_pos")


def spot_metrics(pairs: DataFrame, key: str = "spot_id") -> DataFrame:
    return pearson(pairs, [key], name="gene_pcc").join(spearman(pairs, [key], name="gene_scc"), key)


def mean_metrics(by_gene: DataFrame, by_spot: DataFrame) -> DataFrame:
    """Means of the metric columns, NULLs skipped, with the numbers of genes and spots."""
    genes = by_gene.agg(F.avg("pcc").alias("mean_gene_PCC"), F.avg("scc").alias("mean_gene_SCC"), F.count(F.lit(1)).alias("n_genes"))
    spots = by_spot.agg(
        F.avg("gene_pcc").alias("mean_spot_gene_PCC"), F.avg("gene_scc").alias("mean_spot_gene_SCC"),
        F.count(F.lit(1)).alias("n_gene_metric_spots"),
    )
    values = {**one_row(genes), **one_row(spots)}
    return by_gene.sparkSession.range(1).select(*[F.lit(v).alias(name) for name, v in values.items()])


def _shares(vec: Column, least: float) -> Column:
    return let(F.transform(doubles(vec), lambda v: F.greatest(v, F.lit(least))), lambda raised: shares(raised, 1e-8))


def type_metrics(table: DataFrame, predicted: str = "predicted", target: str = "target") -> DataFrame:
    """KL, mean absolute and mean squared difference of two compositions per spot."""
    shaped = table.select("spot_id", _shares(F.col(target), 0.0).alias("_t"), _shares(F.col(predicted), 1e-8).alias("_p"))
    kl = F.zip_with("_t", "_p", lambda t, p: t * (F.log(F.greatest(t, F.lit(1e-8))) - F.log(p)))
    n = F.size("_t")
    return shaped.select(
        "spot_id",
        total(kl).alias("type_kl"),
        (total(F.zip_with("_p", "_t", lambda p, t: F.abs(p - t))) / n).alias("type_l1"),
        (total(F.zip_with("_p", "_t", lambda p, t: (p - t) * (p - t))) / n).alias("type_l2"),
    )


def mean_type_metrics(per_spot: DataFrame) -> DataFrame:
    return per_spot.agg(
        F.avg("type_kl").alias("mean_spot_type_KL"), F.avg("type_l1").alias("mean_spot_type_L1"),
        F.avg("type_l2").alias("mean_spot_type_L2"), F.count(F.lit(1)).alias("n_type_metric_spots"),
    )


def expression_loss(table: DataFrame, predicted: str = "predicted", target: str = "target") -> DataFrame:
    """Huber loss (delta 1) of log1p values over all spots and genes: sum and mean."""
    clean = lambda v: F.log1p(F.greatest(v, F.lit(0.0)))
    gap = F.zip_with(doubles(F.col(predicted)), doubles(F.col(target)), lambda p, t: F.abs(clean(p) - clean(t)))
    huber = F.transform(gap, lambda d: F.when(d <= 1, 0.5 * d * d).otherwise(d - 0.5))
    per_spot = table.select(total(huber).alias("_l"), F.size(huber).alias("_n"))
    return per_spot.agg(F.sum("_l").alias("expr_loss_sum"), (F.sum("_l") / F.sum("_n")).alias("expr_loss_mean"))


def proportion_loss(table: DataFrame, predicted: str = "predicted", target: str = "target") -> DataFrame:
    """KL divergence of predicted from target compositions, divided by the number of rows."""
    t = _shares(F.col(target), 0.0)
    kl = F.zip_with(t, doubles(F.col(predicted)), lambda a, p: F.when(a > 0, a * (F.log(a) - F.log(F.greatest(p, F.lit(1e-8))))).otherwise(0.0))
    return table.agg((F.sum(total(kl)) / F.count(F.lit(1))).alias("deconv_loss"))


def confidence_loss(grids: DataFrame, prob: str = "prob") -> DataFrame:
    """Mean over grids of minus the log of the largest type probability."""
    return grids.agg(F.avg(-F.log(F.greatest(F.array_max(doubles(F.col(prob))), F.lit(1e-8)))).alias("confidence_loss"))


def blended_loss(expr: float, deconv: float, confidence: float, alpha: float, lam: float) -> float:
    """Expression loss plus lambda times the blend of confidence and proportion loss."""
    kind = alpha * confidence + (1.0 - alpha) * deconv if alpha > 0 else deconv
    return expr + lam * kind
