"""Writers, and the policy for outputs that already exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators.aggregate import named_columns, prediction_tables
from spotweave.operators.lattice import with_corners

#: What to do with an existing output: fail, replace it, or keep and reuse it.
POLICIES = {"fail": "errorifexists", "replace": "overwrite", "reuse": "ignore"}


def write_table(df: DataFrame, path: str, policy: str = "fail", kind: str = "parquet") -> None:
    if policy not in POLICIES:
        raise ValueError(f"Unknown policy: {policy!r}")
    writer = df.write.mode(POLICIES[policy])
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def patch_table(patches: DataFrame, rules: dict) -> DataFrame:
    """Patch boxes with centre, corners and the two constant flags; the rules travel as column metadata."""
    full = with_corners(patches).withColumn("inside_bbox", F.lit(True)).withColumn("inside_tissue_boundary", F.lit(True))
    return full.withMetadata("patch_index", {k: str(v) for k, v in rules.items()})


def write_grid_embedding(grids: DataFrame, path: str, feature_key: str, block: int = 1152, policy: str = "fail") -> None:
    """Grid embedding clustered by spatial block, so a window or a tile reads few files.

    Blocks are ranges of ``(row block, y0, x0)``: a crowded block is cut at its rows and does not become one file.
    """
    marked = grids.withColumnRenamed("feature", feature_key).withMetadata(feature_key, {"feature_key": feature_key})
    clustered = marked.repartitionByRange(F.floor(F.col("y0") / block), F.floor(F.col("x0") / block), "y0", "x0")
    write_table(clustered.sortWithinPartitions("y0", "x0"), path, policy)


def write_predictions(predictions: DataFrame, path: str, policy: str = "fail") -> None:
    write_table(predictions, path, policy)


def write_prediction_tables(predictions: DataFrame, type_names: list[str], types_path: str, expr_path: str, policy: str = "fail") -> None:
    types, expression = prediction_tables(predictions, type_names)
    write_table(types, types_path, policy, "csv")
    write_table(expression, expr_path, policy)


def polygon_outputs(values: DataFrame, vertices: DataFrame, type_names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Type table, the vertices of the kept polygons, and the expression table of an aggregation."""
    types = named_columns(values.select("cell_id", "predicted_type", "prob"), "prob", type_names)
    kept = vertices.join(values.select("cell_id"), "cell_id", "left_semi")
    expression = values.select("cell_id", "center_x", "center_y", "covered_fraction", "expr")
    return types, kept, expression


def write_matrix_text(counts: DataFrame, genes: DataFrame, spots: DataFrame, path: str, policy: str = "fail") -> None:
    """Coordinate-format text: comment and size line first, then 1-based entries, each part a folder of text files.

    ``genes``: ``(position, gene)``; ``spots``: ``(position, barcode)``; both zero-based.
    """
    g = genes.select("gene", (F.col("position") + 1).alias("_g"))
    s = spots.select("barcode", (F.col("position") + 1).alias("_s"))
    entries = counts.join(g, "gene").join(s, "barcode").select("_g", "_s", "count")
    size = f"{genes.count()} {spots.count()} {entries.count()}"
    spark = counts.sparkSession
    head = spark.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate real general"), (0, 1, size)], "_part int, _line bigint, value string")
    body = entries.select(F.lit(1).alias("_part"), F.lit(0).cast("long").alias("_line"), F.concat_ws(" ", "_g", "_s", "count").alias("value"))
    ordered = head.unionByName(body).repartitionByRange("_part", "_line", "value").sortWithinPartitions("_part", "_line", "value")
    write_table(ordered.select("value"), f"{path}/matrix", policy, "text")
    for table, column, name in ((genes, "gene", "genes"), (spots, "barcode", "spots")):
        in_order = table.repartitionByRange("position").sortWithinPartitions("position")
        write_table(in_order.select(F.col(column).alias("value")), f"{path}/{name}", policy, "text")


def write_summary(spark, summary: dict, path: str, policy: str = "replace") -> None:
    """A run summary as one JSON row."""
    import json

    row = spark.createDataFrame([(json.dumps(summary, default=str),)], "value string")
    write_table(row.coalesce(1), path, policy, "text")
