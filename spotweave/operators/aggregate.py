"""Grid predictions onto cell polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.arrays import first_max_index, let, log1p_clipped, total
from spotweave.operators.blocks import block_of, block_side, block_sums, vector_columns, width_of
from spotweave.operators.ordinals import exact_median
from spotweave.operators.overlap import crossings, numbered, outline, outline_areas, overlap_cells, ring_edges, ring_geometry
from spotweave.session import durable, one_row


def grid_size(grids: DataFrame) -> int:
    """Rounded median width."""
    median = exact_median(grids.select((F.col("x1") - F.col("x0")).alias("width")), "width")
    return one_row(median.select(F.rint("median").cast("int").alias("size")))["size"]


def ring_validity(vertices: DataFrame, grid: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cell_id, n_vertices, center_x, center_y, area, is_repaired, is_invalid)``, the edges, and the outlines of crossing rings.

    A ring that crosses itself is repaired: it covers whatever it winds around (a geometry library that rebuilds such a ring
    by its orientation may keep only one lobe of a bow tie; here both count). Only rings with fewer than three vertices or
    without an area, up to rounding, are invalid.
    """
    edges = durable(ring_edges(numbered(vertices)))
    repaired = durable(outline(edges, durable(crossings(edges, grid / 4.0)), grid))
    areas = outline_areas(repaired).select("cell_id", F.col("area").alias("_area"))
    geometry = ring_geometry(edges).join(areas, "cell_id", "left").withColumn("is_repaired", F.col("_area").isNotNull())
    geometry = geometry.withColumn("area", F.coalesce("_area", "area"))
    bad = (F.col("n_vertices") < 3) | (F.col("area") <= F.col("flat"))
    return geometry.withColumn("is_invalid", bad).drop("_area", "flat"), edges, repaired


def origin_winners(grids: DataFrame) -> DataFrame:
    """``(x0, y0, ord)``: the last row of every lattice origin. Only the narrow columns are aggregated."""
    return grids.groupBy(F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0")).agg(F.max("ord").alias("ord"))


def polygon_sums(hits: DataFrame, grids: DataFrame, size: int, n_genes: int | None = None, n_types: int | None = None) -> DataFrame:
    """``(cell_id, _expr, _prob, _weight, _n_grids)``: weighted sums of the grids' vectors over the overlaps of each polygon.

    ``hits``: ``(cell_id, x0, y0, ord, weight)``; ``grids``: ``(ord, x0, y0, expr, prob)``, one per origin. Overlaps and grids meet by square
    blocks of the lattice, so a grid's vectors move once, however many polygons lie on it. A polygon in one block is finished
    there; of one that reaches into several only a partial vector per block moves.
    """
    widths = [n_genes or width_of(grids, "expr"), n_types or width_of(grids, "prob")]
    side = block_side(8 * sum(widths)) * size
    block = [block_of(F.col(axis), side).alias(name) for axis, name in (("x0", "bx"), ("y0", "by"))]
    placed = durable(hits.select(*block, "cell_id", "ord", "weight"))
    spread = placed.groupBy("cell_id").agg((F.min(F.struct("bx", "by")) != F.max(F.struct("bx", "by"))).alias("border")).where("border")
    kinds = F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")
    weights = placed.join(spread, "cell_id", "left").select(
        "bx", "by", F.col("cell_id").alias("target"), F.coalesce("border", F.lit(False)).alias("border"), F.col("ord").cast("long").alias("source"), "weight", kinds)
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), *vector_columns(grids, c)) for k, c in enumerate(("expr", "prob"))]))
    rows = grids.select(*block, F.col("ord").cast("long").alias("source"), both.alias("v")).select("bx", "by", "source", "v.*")
    sums = block_sums(weights, rows, widths)
    return sums.select(F.col("target").alias("cell_id"), F.col("sum0").alias("_expr"), F.col("sum1").alias("_prob"), F.col("weight0").alias("_weight"), F.col("n0").alias("_n_grids"))


def polygon_values(
    vertices: DataFrame,
    grids: DataFrame,
    type_names: list[str],
    n_genes: int | None = None,
    grid: int | None = None,
    valid_only: bool = True,
) -> DataFrame:
    """Expression, type and geometry of every kept polygon.

    ``vertices``: ``(cell_id, vertex_ord, vertex_x, vertex_y)``; ``grids``: ``(ord, x0, y0, x1, y1, expr, prob)`` with
    a unique ``ord``. Overlap rows find their grid by equal origins while all rows are narrow; the wide vectors are then summed
    by :func:`polygon_sums`. A ring that crosses itself is repaired (:func:`ring_validity`). A NULL vector is left out of a sum with its
    weight; a polygon on NULL vectors only has NULL values. Invalid and uncovered polygons are dropped, or kept with NULL values
    if ``valid_only`` is off.

    Returns ``(cell_id, n_vertices, area, is_repaired, is_invalid, n_grids, covered_fraction, center_x, center_y, expr, prob,
    predicted_type)``.
    """
    size = grid or grid_size(grids)
    rings, edges, repaired = ring_validity(vertices, size)
    w = F.col("area") / float(size * size)
    winners = origin_winners(grids)
    known = grids.select("ord", F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0"), "expr", "prob")
    if grids.groupBy("x0", "y0").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        known = known.join(winners.select("ord"), "ord", "left_semi")
    hits = overlap_cells(edges, size, repaired).join(winners, ["x0", "y0"]).select("cell_id", "x0", "y0", "ord", w.alias("weight"))
    summed = polygon_sums(hits, known, size, n_genes, len(type_names))
    geometry = rings.join(summed, "cell_id", "left")
    usable = lambda c: F.when(~F.col("is_invalid"), c)
    share = let(total(F.col("_prob")), lambda whole: F.when(whole > 0, F.transform("_prob", lambda p: p / whole)))
    joined = geometry.select(
        "cell_id", "n_vertices", "area", "is_repaired", "is_invalid",
        F.coalesce(usable(F.col("_n_grids")), F.lit(0)).alias("n_grids"),
        F.coalesce(usable(F.col("_weight") * float(size * size) / F.greatest("area", F.lit(1e-8))), F.lit(0.0)).alias("covered_fraction"),
        "center_x", "center_y",
        usable(log1p_clipped(F.col("_expr"))).alias("expr"),
        usable(share).alias("prob"),
    )
    names = F.array(*[F.lit(n) for n in type_names])
    named = joined.withColumn(
        "predicted_type", F.coalesce(F.get(names, first_max_index(F.col("prob"))), F.lit("Unassigned"))
    )
    return named.where("NOT is_invalid AND n_grids > 0") if valid_only else named


def polygon_counters(values: DataFrame, valid_only: bool) -> DataFrame:
    """Counters over *all* polygons (``values`` made with ``valid_only=False``).

    With ``valid_only`` an invalid polygon is counted as invalid only; without it, as invalid and uncovered.
    """
    uncovered = F.col("n_grids") == 0
    zero = uncovered & ~F.col("is_invalid") if valid_only else uncovered
    kept = F.count_if(~F.col("is_invalid") & ~uncovered) if valid_only else F.count(F.lit(1))
    return values.agg(
        F.count(F.lit(1)).alias("n_input_polygons"),
        kept.alias("n_output_cells"),
        F.count_if(zero).alias("n_zero_coverage"),
        F.count_if(F.col("is_invalid")).alias("n_invalid_polygon"),
        F.count_if(F.col("is_repaired")).alias("n_repaired_polygon"),
    )


def named_columns(values: DataFrame, vector: str, names: list[str], prefix: str = "prob_") -> DataFrame:
    """One column per vector element, ``<prefix><name>``, in place of the vector."""
    rest = [c for c in values.columns if c != vector]
    return values.select(*rest, *[F.get(F.col(vector), F.lit(i)).alias(f"{prefix}{n}") for i, n in enumerate(names)])


def prediction_tables(predictions: DataFrame, type_names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Grid type table (with ``prob_<type>`` columns) and grid expression table of a prediction table."""
    names = F.array(*[F.lit(n) for n in type_names])
    base = predictions.select(
        F.concat(F.lit("grid_"), F.col("grid_index").cast("string")).alias("grid_id"),
        F.col("center_x").cast("float").alias("center_x"), F.col("center_y").cast("float").alias("center_y"),
        *[F.col(c).cast("float").alias(f"bbox_{c}") for c in ("x0", "y0", "x1", "y1")],
        F.get(names, first_max_index(F.col("type_prob"))).alias("predicted_type"),
        "type_prob",
        F.col("expr_pred").alias("expr"),
    )
    types = named_columns(base.drop("expr"), "type_prob", type_names)
    return types, base.drop("predicted_type", "type_prob")
