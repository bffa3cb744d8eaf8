"""Evaluation windows: selections, labels, z-scores and rasters of a full-resolution rectangle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.text import hex_channel, known_label, label_color, label_key
from spotweave.operators.ordinals import last_wins
from spotweave.operators.painting import painted_pixels
from spotweave.session import broadcast_if_small, one_row


def checked_window(window) -> tuple[int, int, int, int]:
    """Four coordinates, rounded half to even, with positive extent."""
    values = list(window)
    if len(values) != 4:
        raise ValueError("A window needs x0, y0, x1, y1.")
    x0, y0, x1, y1 = (int(round(float(v))) for v in values)
    if x1 <= x0 or y1 <= y0:
        raise ValueError(f"A window needs x0 < x1 and y0 < y1, got {(x0, y0, x1, y1)}.")
    return x0, y0, x1, y1


def require_columns(table: DataFrame, *names: str) -> None:
    absent = sorted(set(names) - set(table.columns))
    if absent:
        raise ValueError(f"Missing columns: {absent}")


def rectangles_in_window(table: DataFrame, window) -> DataFrame:
    """Rectangles that overlap the window with positive area."""
    x0, y0, x1, y1 = checked_window(window)
    require_columns(table, "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1")
    return table.where((F.col("bbox_x1") > x0) & (F.col("bbox_x0") < x1) & (F.col("bbox_y1") > y0) & (F.col("bbox_y0") < y1))


def clipped_to_window(table: DataFrame, window) -> DataFrame:
    """Whole-pixel rectangles relative to the window origin, cut to the window; empty ones drop."""
    x0, y0, x1, y1 = checked_window(window)
    cut = table.select(
        "*",
        (F.greatest(F.col("bbox_x0").cast("int"), F.lit(x0)) - x0).alias("lx0"),
        (F.greatest(F.col("bbox_y0").cast("int"), F.lit(y0)) - y0).alias("ly0"),
        (F.least(F.col("bbox_x1").cast("int"), F.lit(x1)) - x0).alias("lx1"),
        (F.least(F.col("bbox_y1").cast("int"), F.lit(y1)) - y0).alias("ly1"),
    )
    return cut.where("lx1 > lx0 AND ly1 > ly0")


def polygons_in_window(vertices: DataFrame, window, window_label: str | None = None) -> DataFrame:
    """Vertices of the rings whose bounds touch the window (inclusive) and that have three vertices or more.

    ``vertices``: ``(cell_id, vertex_ord, vertex_x, vertex_y[, celltype, window_label])``. Adds the coordinates
    relative to the window as ``local_x, local_y``.
    """
    x0, y0, x1, y1 = checked_window(window)
    if window_label is not None and "window_label" in vertices.columns:
        vertices = vertices.where(F.col("window_label").cast("string") == str(window_label))
    kept = ring_bounds(vertices).where(
        (F.col("max_x") >= x0) & (F.col("min_x") <= x1) & (F.col("max_y") >= y0) & (F.col("min_y") <= y1) & (F.col("n_vertices") >= 3)
    )
    return vertices.join(kept.select("cell_id"), "cell_id", "left_semi").select(
        "*", (F.col("vertex_x") - x0).alias("local_x"), (F.col("vertex_y") - y0).alias("local_y")
    )


def ring_bounds(vertices: DataFrame) -> DataFrame:
    """Bounds, vertex count and, where present, the first cell type of every ring."""
    first = [F.min_by("celltype", "vertex_ord").alias("celltype")] if "celltype" in vertices.columns else []
    return vertices.groupBy("cell_id").agg(
        F.min("vertex_x").alias("min_x"), F.max("vertex_x").alias("max_x"),
        F.min("vertex_y").alias("min_y"), F.max("vertex_y").alias("max_y"),
        F.count(F.lit(1)).alias("n_vertices"), *first,
    )


def merged_labels(table: DataFrame, merge: DataFrame | None, label: str = "celltype") -> DataFrame:
    """Labels through the merge map (keys compared by their normal form), unknown ones to ``Others``.

    ``merge``: ``(target, source, target_ord[, source_ord])``, a vocabulary. A target maps to itself; of two
    entries for a key the later wins.
    """
    if merge is None:
        return table.withColumn(label, known_label(F.col(label), "Others"))
    within = F.col("source_ord") if "source_ord" in merge.columns else F.lit(0)
    own = merge.select(label_key(F.col("target")).alias("_key"), F.col("target").alias("_to"), F.struct("target_ord", F.lit(-1).alias("i")).alias("_o"))
    sources = merge.select(label_key(F.col("source")).alias("_key"), F.col("target").alias("_to"), F.struct("target_ord", within.alias("i")).alias("_o"))
    mapping = own.unionByName(sources).groupBy("_key").agg(F.max_by("_to", "_o").alias("_to"))
    n = one_row(mapping.agg(F.count(F.lit(1)).alias("n")))["n"]
    joined = table.withColumn("_key", label_key(F.col(label))).join(broadcast_if_small(mapping, n), "_key", "left")
    merged = joined.withColumn(label, known_label(F.coalesce("_to", label), "Others"))
    return merged.select(*table.columns)


def label_counts(table: DataFrame, label: str) -> DataFrame:
    return table.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def zscores(table: DataFrame, value: str = "value", name: str = "z") -> DataFrame:
    """Standard scores with the population deviation; all 0 if the deviation is below 1e-8 or undefined."""
    seen = one_row(table.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")))
    if seen["std"] is None or not seen["std"] >= 1e-8:
        return table.withColumn(name, F.lit(0.0))
    return table.withColumn(name, (F.col(value) - F.lit(seen["mean"])) / F.lit(seen["std"]))


def measured_values(polygon_ids: DataFrame, measured: DataFrame, gene: str) -> DataFrame:
    """Measured value of one gene for each listed cell; the last entry of a repeated cell wins, unknown cells drop.

    ``measured``: ``(xen_cell_id, gene, ord, log1p_count)``. A gene that is absent is an error.
    """
    chosen = measured.where(F.col("gene") == gene)
    if chosen.isEmpty():
        raise ValueError(f"No measured values of gene {gene!r}.")
    values = last_wins(chosen.select(F.col("xen_cell_id").cast("string").alias("_id"), "ord", F.col("log1p_count").alias("value")), ["_id"], "ord")
    return polygon_ids.join(values.select("_id", "value"), F.col("cell_id").cast("string") == F.col("_id")).drop("_id")


def painted(table: DataFrame, payload: list[str], order: str = "ord") -> DataFrame:
    """``(px, py, *payload)``: pixels of the clipped rectangles; where they overlap, the later row shows.

    The rectangles are painted by tiles (:func:`spotweave.operators.painting.painted_pixels`), which become pixels last.
    """
    return painted_pixels(table, payload, order)


def type_raster(grid_types: DataFrame, window) -> DataFrame:
    """Painted pixels with label and colour; pixels without a grid stay white and are not listed."""
    require_columns(grid_types, "predicted_type")
    labelled = clipped_to_window(rectangles_in_window(grid_types, window), window).withColumn(
        "label", known_label(F.col("predicted_type"), "Unassigned")
    )
    color = label_color(F.col("label"))
    return painted(labelled, ["label"]).select(
        "px", "py", "label", *[hex_channel(color, i).alias(c) for i, c in enumerate(("r", "g", "b"))]
    )


def expression_raster(grid_values: DataFrame, window) -> DataFrame:
    """Painted pixels with the z-score over the window's grids, and the value shown (cut to -2..2)."""
    scored = zscores(rectangles_in_window(grid_values, window))
    pixels = painted(clipped_to_window(scored, window), ["z"])
    return pixels.select("px", "py", "z", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("z"))).alias("shown"))


def gene_column(grid_expr: DataFrame, genes: DataFrame, gene: str) -> DataFrame:
    """The value of one gene of an expression table. ``genes``: ``(ord, gene)``; an absent gene is an error."""
    found = genes.where(F.col("gene") == gene).agg(F.min("ord").alias("o")).first()["o"]
    if found is None:
        raise ValueError(f"The expression table has no gene {gene!r}.")
    return grid_expr.withColumn("value", F.get(F.col("expr"), F.lit(int(found)))).drop("expr")


