"""Sparse count tables: one row per non-zero ``(barcode, gene, count)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.arrays import dense
from spotweave.operators.ordinals import ordinal, running_total
from spotweave.session import one_row


def expression_only(counts: DataFrame) -> DataFrame:
    """Only the rows whose feature type is gene expression."""
    return counts.where(F.col("feature_type") == "Gene Expression")


def collapse_duplicate_genes(counts: DataFrame) -> DataFrame:
    """Source rows sharing a gene name are summed; the partial sums combine before the shuffle."""
    return counts.groupBy("barcode", "gene").agg(F.sum("count").alias("count"))


def duplicate_gene_report(features: DataFrame) -> DataFrame:
    """Names, distinct names and how many rows a collapse removes. ``features``: one row per source gene row."""
    return features.agg(
        F.count(F.lit(1)).alias("n_gene_rows"),
        F.countDistinct("gene").alias("n_genes"),
        (F.count(F.lit(1)) - F.countDistinct("gene")).alias("n_collapsed"),
    )


def gene_order(features: DataFrame) -> DataFrame:
    """``(ord, gene)``: source order if the names are already unique, else sorted by name.

    ``features``: ``(gene_row, gene)``, one row per source gene row.
    """
    report = one_row(duplicate_gene_report(features))
    if report["n_collapsed"] == 0:
        return ordinal(features.select("gene_row", "gene"), ["gene_row"], name="ord").select("ord", "gene")
    return ordinal(features.select("gene").distinct(), ["gene"], name="ord").select("ord", "gene")


def unique_gene_names(features: DataFrame) -> DataFrame:
    """Repeats of a name get the suffix ``-1``, ``-2``... in source order; a suffix that is itself a source
    name is skipped, so the names stay distinct.

    ``features``: ``(gene_row, gene)``. Only names that repeat are ranked.
    """
    repeated = features.groupBy("gene").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gene")
    ranked = ordinal(features.join(repeated, "gene", "left_semi"), ["gene_row"], keys=["gene"], name="_k")
    stem, digits = (F.regexp_extract("gene", r"^(.*)-([1-9][0-9]*)\z", i) for i in (1, 2))
    taken = (
        features.select("gene").distinct()
        .select(stem.alias("_stem"), digits.alias("_digits"))
        .where("_digits <> ''")
        .select(F.col("_stem").alias("gene"), F.expr("try_cast(_digits AS BIGINT)").alias("_taken"))
        .where("_taken IS NOT NULL")
        .join(repeated, "gene", "left_semi")
    )
    suffixed = ranked.withColumn("_suffix", F.col("_k"))
    if not taken.isEmpty():
        # The k-th free number is k plus the taken numbers with fewer than k free numbers before them.
        gaps = ordinal(taken, ["_taken"], keys=["gene"], name="_j").select(
            "gene",
            (F.col("_taken") - F.col("_j") - 1).alias("_at"),
            F.col("_taken").alias("_tie"),
            F.lit(1).alias("_weight"),
            F.lit(None).cast("long").alias("gene_row"),
        )
        wanted = ranked.select(
            "gene", F.col("_k").alias("_at"), F.lit(-1).cast("long").alias("_tie"), F.lit(0).alias("_weight"),
            F.col("gene_row").cast("long").alias("gene_row"),
        )
        counted = running_total(wanted.unionByName(gaps), ["gene"], ["_at", "_tie"], "_weight", "_used")
        suffixed = counted.where("_weight = 0").select(
            "gene", "gene_row", F.col("_at").alias("_k"), (F.col("_at") + F.col("_used")).alias("_suffix")
        )
    renamed = suffixed.select(
        "gene_row",
        "gene",
        F.when(F.col("_k") == 0, F.col("gene")).otherwise(F.concat_ws("-", "gene", F.col("_suffix"))).alias("unique_name"),
    )
    single = features.join(repeated, "gene", "left_anti").select("gene_row", "gene", F.col("gene").alias("unique_name"))
    return single.unionByName(renamed)


def totals(counts: DataFrame, key: str = "barcode") -> DataFrame:
    """Total count per spot or per cell."""
    return counts.groupBy(key).agg(F.sum("count").alias("umi"))


def enough_counts(counts: DataFrame, minimum: float) -> DataFrame:
    """Spots whose total reaches the minimum."""
    return totals(counts).where(F.col("umi") >= minimum)


def default_umi_minimum(sample: str) -> int:
    return 30 if sample == "BREAST" else 100


def requested_genes(gene_list: DataFrame, available: DataFrame) -> DataFrame:
    """The gene list restricted to available genes, in list order (``ord`` renumbered); none left is an error."""
    kept = gene_list.join(available.select("gene").distinct(), "gene", "left_semi")
    if kept.isEmpty():
        raise ValueError("No requested genes are present.")
    return ordinal(kept.select("ord", "gene"), ["ord", "gene"], name="position").select("position", "gene")


def dense_by_spot(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """``(barcode, expression)`` in gene order, absent genes 0. ``genes``: ``(position, gene)``.

    After the collapse a spot has at most one entry per listed gene, so the vector it is built from is bounded
    by the gene list and never by the number of source rows.
    """
    n_genes = one_row(genes.agg(F.count(F.lit(1)).alias("n")))["n"]
    entries = (
        collapse_duplicate_genes(counts)
        .join(genes.select("gene", F.col("position").cast("int").alias("position")), "gene")
        .groupBy("barcode")
        .agg(F.sort_array(F.collect_list(F.struct("position", F.col("count").cast("double").alias("value")))).alias("_e"))
    )
    spots = counts.select("barcode").distinct()
    nothing = F.array().cast("array<struct<position:int,value:double>>")
    return spots.join(entries, "barcode", "left").select("barcode", dense(F.coalesce("_e", nothing), n_genes).alias("expression"))


def reference_profiles(ref_counts: DataFrame, cells: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Mean share of each gene per cell type, over all cells of the type (an absent gene counts as 0).

    ``ref_counts``: ``(cell_id, gene, count)``; ``cells``: ``(cell_id, cell_type)``. Cells without counts are
    not part of the mean.
    """
    kept = ref_counts.join(cells.select("cell_id", "cell_type"), "cell_id")
    umi = kept.groupBy("cell_id").agg(F.sum("count").alias("umi")).where("umi > 0")
    # The share of a gene in a cell is the sum over its rows, so rows are not summed by cell and gene first.
    shares = (
        kept.join(umi, "cell_id")
        .groupBy("cell_type", "gene")
        .agg(F.sum(F.col("count") / F.col("umi")).alias("share"))
    )
    sizes = cells.join(umi, "cell_id", "left_semi").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_cells"))
    if genes is not None:
        shares = shares.join(genes.select("gene"), "gene", "left_semi")
    return shares.join(sizes, "cell_type").select(
        "cell_type", "gene", (F.col("share") / F.col("n_cells")).alias("profile")
    )


def shared_genes(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(gene)``: the genes that both tables have, once each."""
    return first.select("gene").distinct().join(second.select("gene").distinct(), "gene", "left_semi")


def category_order(cells: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Distinct labels in first-seen order, or the allowed order restricted to those present.

    ``cells``: ``(ord, cell_type)``. The distinct labels are a vocabulary, so the final ordering is tiny.
    """
    first = cells.groupBy("cell_type").agg(F.min("ord").alias("first_ord"))
    if allowed is not None:
        listed = F.array_position(F.array(*[F.lit(a) for a in allowed]), F.col("cell_type"))
        first = first.where(F.col("cell_type").isin(*allowed)).withColumn("first_ord", listed)
    return ordinal(first, ["first_ord", "cell_type"], name="position").select("position", "cell_type")
