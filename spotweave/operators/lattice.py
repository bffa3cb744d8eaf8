"""Patch lattice, token grids, lattice neighbours and the overlap-blended grid features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.arrays import subtract
from spotweave.functions.vectors import vector_mean, vector_pop_std
from spotweave.operators.blocks import block_of, block_side, block_sums, vector_columns, width_of
from spotweave.operators.ordinals import exact_median, ordinal
from spotweave.session import by_shuffle, one_row

# Patch side, stride, grid side and tokens per side, all in full-resolution pixels.
PATCH, STRIDE, GRID, TOKENS = 288, 72, 18, 16


def spot_extent(positions: DataFrame) -> DataFrame:
    """One row: the box around the given (in-tissue) spots."""
    x, y = F.col("pxl_col_in_fullres").cast("double"), F.col("pxl_row_in_fullres").cast("double")
    return positions.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def inside_box(x: Column, y: Column, box: dict) -> Column:
    """Centre inside the spot box, both ends inclusive."""
    return x.between(box["x_min"], box["x_max"]) & y.between(box["y_min"], box["y_max"])


def patch_lattice(image: DataFrame, patch: int = PATCH, stride: int = STRIDE) -> DataFrame:
    """Every full patch of the image at stride steps. ``image``: one row ``(width, height)``.

    Rows are produced first and spread before the columns, so a large slide is not generated by one task.
    """
    last_x = F.floor((F.col("width") - patch) / stride) * stride
    last_y = F.floor((F.col("height") - patch) / stride) * stride
    fits = image.where((F.col("width") >= patch) & (F.col("height") >= patch))
    rows = fits.select(last_x.alias("_x"), F.explode(F.sequence(F.lit(0).cast("long"), last_y, F.lit(stride).cast("long"))).alias("y0"))
    cells = rows.repartition("y0").select(
        "y0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_x"), F.lit(stride).cast("long"))).alias("x0")
    )
    side = [("x0", F.col("x0")), ("y0", F.col("y0")), ("x1", F.col("x0") + patch), ("y1", F.col("y0") + patch)]
    return cells.select(*[value.cast("int").alias(name) for name, value in side])


def with_centre(boxes: DataFrame, size: int) -> DataFrame:
    """Centre of a box as origin plus half its side."""
    return boxes.withColumn("center_x", F.col("x0") + F.lit(size / 2.0)).withColumn("center_y", F.col("y0") + F.lit(size / 2.0))


def with_corners(patches: DataFrame) -> DataFrame:
    """The four corners, clockwise from the upper left, next to the centre."""
    corner = lambda x, y: F.struct(F.col(x).cast("float").alias("x"), F.col(y).cast("float").alias("y"))
    return patches.withColumn(
        "corners", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    )


def mask_pixel(boxes: DataFrame, scale: float, width: int, height: int, single: bool = False) -> DataFrame:
    """Thumbnail pixel of each centre: rounded half to even, clipped to the image.

    ``single`` multiplies in single precision, as is done for grids; patches use double.
    """
    def pixel(centre: str, size: int) -> Column:
        value = F.col(centre).cast("double") * F.lit(float(scale))
        if single:
            value = (F.col(centre).cast("float") * F.lit(float(scale)).cast("float")).cast("double")
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.rint(value).cast("int")))

    return boxes.withColumn("px", pixel("center_x", width)).withColumn("py", pixel("center_y", height))


def on_tissue(boxes: DataFrame, mask: DataFrame, scale: float, width: int, height: int, single: bool = False) -> DataFrame:
    """Boxes whose centre falls on a mask pixel. ``mask``: ``(px, py)`` of the true pixels only."""
    pixels = by_shuffle(mask.select("px", "py"))
    return mask_pixel(boxes, scale, width, height, single).join(pixels, ["px", "py"], "left_semi").drop("px", "py")


def patch_candidates(image: DataFrame, box: dict, patch: int = PATCH, stride: int = STRIDE) -> DataFrame:
    lattice = with_centre(patch_lattice(image, patch, stride), patch)
    return lattice.where(inside_box(F.col("center_x"), F.col("center_y"), box))


def number_patches(patches: DataFrame) -> DataFrame:
    """Row-major patch index: by ``y0``, then ``x0``."""
    return ordinal(patches, ["y0", "x0"], name="patch_index")


def select_patches(
    image: DataFrame, box: dict, mask: DataFrame, scale: float, width: int, height: int,
    patch: int = PATCH, stride: int = STRIDE, max_patches: int | None = None,
) -> DataFrame:
    """Lattice patches inside the spot box and on tissue, numbered row-major; optionally the first few only."""
    numbered = number_patches(on_tissue(patch_candidates(image, box, patch, stride), mask, scale, width, height))
    return numbered if max_patches is None else numbered.where(F.col("patch_index") < max(1, int(max_patches)))


def token_grids(patches: DataFrame, patch: int = PATCH, grid: int = GRID) -> DataFrame:
    """The 16 x 16 grid cells of every patch with token index and blending weight."""
    n = patch // grid
    if n != TOKENS or n * grid != patch:
        raise ValueError("A patch must be exactly 16 x 16 grid cells.")
    tokens = patches.select("patch_index", "x0", "y0", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("token_linear"))
    gx, gy = F.col("token_linear") % n, F.floor(F.col("token_linear") / n).cast("int")
    return tokens.select(
        "patch_index",
        "token_linear",
        (F.col("x0") + gx * grid).cast("int").alias("x0"),
        (F.col("y0") + gy * grid).cast("int").alias("y0"),
        F.greatest(_half_cosine(gx, n) * _half_cosine(gy, n), F.lit(1e-3)).alias("weight"),
    ).select("patch_index", "token_linear", "x0", "y0", (F.col("x0") + grid).alias("x1"), (F.col("y0") + grid).alias("y1"), "weight")


def _half_cosine(g: Column, n: int) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * F.abs(g - F.lit((n - 1) / 2.0)) / F.lit(n / 2.0)))


def boxed_tokens(tokens: DataFrame, box: dict, grid: int = GRID) -> DataFrame:
    return tokens.where(inside_box(F.col("x0") + F.lit(grid / 2.0), F.col("y0") + F.lit(grid / 2.0), box))


def unique_grids(
    tokens: DataFrame, mask: DataFrame | None, scale: float = 1.0, width: int = 0, height: int = 0, grid: int = GRID
) -> DataFrame:
    """Distinct grid cells on tissue with the number of token views, numbered by ``y0, x0, y1, x1``.

    The views are combined before the shuffle. ``mask=None`` switches the tissue filter off.
    """
    distinct = with_centre(tokens.groupBy("x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("duplicate_count")), grid)
    kept = distinct if mask is None else on_tissue(distinct, mask, scale, width, height, single=True)
    return ordinal(kept, ["y0", "x0", "y1", "x1"], name="grid_index")


def token_to_grid(tokens: DataFrame, grids: DataFrame) -> DataFrame:
    """Attach the grid index to every token view of a retained grid."""
    return by_shuffle(tokens).join(grids.select("x0", "y0", "grid_index"), ["x0", "y0"])


def views_per_patch(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("patch_index").agg(F.count(F.lit(1)).alias("n_views"))


def grids_without_view(grids: DataFrame, tokens: DataFrame) -> DataFrame:
    return grids.join(by_shuffle(tokens), ["x0", "y0"], "left_anti")


def neighbour_pairs(patches: DataFrame, stride: int = STRIDE) -> DataFrame:
    """``(patch_index, neighbour_index)`` over the eight lattice neighbours, an equi-join on the origin."""
    offsets = [(dx, dy) for dy in (-stride, 0, stride) for dx in (-stride, 0, stride) if (dx, dy) != (0, 0)]
    shift = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))
    wanted = patches.select("patch_index", "x0", "y0", shift.alias("s")).select(
        "patch_index", (F.col("x0") + F.col("s.dx")).alias("x0"), (F.col("y0") + F.col("s.dy")).alias("y0")
    )
    return by_shuffle(wanted).join(patches.select(F.col("patch_index").alias("neighbour_index"), "x0", "y0"), ["x0", "y0"]).select(
        "patch_index", "neighbour_index"
    )


def neighbour_stats(patches: DataFrame, tiles: DataFrame, stride: int = STRIDE, width: int | None = None) -> DataFrame:
    """Mean, population deviation and number of the neighbours' tile vectors.

    An isolated patch gets its own vector, zero deviation and count 0. ``tiles``: ``(patch_index, tile)``.
    """
    sent = neighbour_pairs(patches, stride).join(tiles.withColumnRenamed("patch_index", "neighbour_index"), "neighbour_index")
    stats = sent.groupBy("patch_index").agg(
        vector_mean(F.col("tile"), width).alias("_mean"),
        vector_pop_std(F.col("tile"), width).alias("_std"),
        F.count(F.lit(1)).alias("_count"),
    )
    own = tiles.select("patch_index", F.col("tile").cast("array<double>").alias("tile"))
    return patches.select("patch_index").join(own, "patch_index").join(stats, "patch_index", "left").select(
        "patch_index",
        "tile",
        F.coalesce("_mean", "tile").alias("neighbour_mean"),
        F.coalesce("_std", F.transform("tile", lambda v: F.lit(0.0))).alias("neighbour_std"),
        F.coalesce("_count", F.lit(0)).alias("neighbour_count"),
    )


def require_encoded(patches: DataFrame, views: DataFrame, tiles: DataFrame, tokens: DataFrame) -> None:
    """Raise if a patch has no tile vector, or a view no token vector: either would silently leave the means."""
    no_tile = patches.select("patch_index").join(tiles.where("tile IS NOT NULL").select("patch_index"), "patch_index", "left_anti").count()
    known = tokens.where("token IS NOT NULL").select("patch_index", "token_linear")
    no_token = views.select("patch_index", "token_linear").join(by_shuffle(known), ["patch_index", "token_linear"], "left_anti").count()
    if no_tile or no_token:
        raise ValueError(f"{no_tile} patches have no tile vector and {no_token} views no token vector.")


def patch_vectors(stats: DataFrame, mode: str = "mean") -> DataFrame:
    """The per-patch part of a grid feature: tile plus neighbour parts for the mode."""
    delta = subtract(F.col("neighbour_mean"), F.col("tile"))
    parts = {
        "mean": [F.col("tile"), F.col("neighbour_mean")],
        "delta": [F.col("tile"), delta],
        "delta_std": [F.col("tile"), delta, F.col("neighbour_std")],
    }
    if mode not in parts:
        raise ValueError(f"Unknown neighbour mode: {mode!r}")
    return stats.select("patch_index", F.concat(*parts[mode]).alias("patch_vector"))


def view_features(views: DataFrame, token_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every view with its whole vector: token part then patch part (for inspection; blending avoids this)."""
    return (
        views.join(token_vectors, ["patch_index", "token_linear"])
        .join(vectors, "patch_index")
        .select("patch_index", "token_linear", "grid_index", "weight",
                F.concat(F.col("token").cast("array<double>"), "patch_vector").alias("feature"))
    )


def blend(
    patches: DataFrame, views: DataFrame, token_vectors: DataFrame, vectors: DataFrame, token_width: int | None = None, patch_width: int | None = None,
    stride: int = STRIDE, grid: int = GRID,
) -> DataFrame:
    """Weighted mean feature of every grid: ``(grid_index, feature, weight_sum, n_views_averaged)``.

    Patches are dealt to square blocks of the lattice with all their token vectors and their patch vector; in a block the
    weights of the views times these vectors give the sums of its grids. Only grids that patches of other blocks can cover too
    are merged afterwards. The patch part is the same for all 256 views of a patch, and concatenation commutes with the weighted
    mean, so the views are never widened to the full feature. ``patches``: ``(patch_index, x0, y0)``.
    """
    means = token_means(patches, views, token_vectors, vectors, token_width, patch_width, stride, grid)
    return means.select("grid_index", F.concat("token_mean", "patch_mean").alias("feature"), "weight_sum", "n_views_averaged")


def token_means(
    patches: DataFrame, views: DataFrame, token_vectors: DataFrame, vectors: DataFrame | None = None, token_width: int | None = None,
    patch_width: int | None = None, stride: int = STRIDE, grid: int = GRID,
) -> DataFrame:
    """``(grid_index, token_mean[, patch_mean], weight_sum, n_views_averaged)``: the parts of :func:`blend`.

    A NULL vector is left out with its weight; a grid with none that counts is an error. Views without a token row drop.
    """
    widths = [token_width or width_of(token_vectors, "token")] + ([patch_width or width_of(vectors, "patch_vector")] if vectors is not None else [])
    # A patch brings its tokens, and leaves about (patch / stride)^-2 as many grids with all parts.
    side = block_side(256 * 8 * widths[0] + 16 * 8 * sum(widths), 32)
    origins = patches.select("patch_index", "x0", "y0", block_of(F.col("x0"), side * stride).alias("bx"), block_of(F.col("y0"), side * stride).alias("by"))
    numbered = lambda df: df.withColumn("source", F.col("patch_index").cast("long") * 256 + F.col("token_linear"))

    def shared(axis: str, step: Column) -> Column:
        """The patches over a grid start within a patch's side before it: can they lie in two blocks?"""
        place = F.col(axis) + step * grid
        first = F.greatest(F.lit(0), F.ceil((place - (TOKENS - 1) * grid) / stride) * stride)
        return block_of(first, side * stride) != block_of(F.floor(place / stride) * stride, side * stride)

    border = shared("x0", F.col("token_linear") % TOKENS) | shared("y0", F.floor(F.col("token_linear") / TOKENS))
    kinds = [F.struct(F.lit(0).alias("kind"), F.col("source"))]
    rows = numbered(token_vectors).join(origins, "patch_index").select("bx", "by", F.lit(0).alias("kind"), "source", *vector_columns(token_vectors, "token"))
    if vectors is not None:
        kinds.append(F.struct(F.lit(1).alias("kind"), F.col("patch_index").cast("long").alias("source")))
        rows = rows.unionByName(vectors.join(origins, "patch_index").select(
            "bx", "by", F.lit(1).alias("kind"), F.col("patch_index").cast("long").alias("source"), *vector_columns(vectors, "patch_vector")))
    weights = numbered(views.join(origins, "patch_index")).select(
        "bx", "by", F.col("grid_index").alias("target"), border.alias("border"), F.explode(F.array(*kinds)).alias("k"), F.col("weight").cast("double").alias("weight")
    ).select("bx", "by", "target", "border", "k.kind", "k.source", "weight")
    sums = block_sums(weights, rows, widths)
    bad = F.raise_error(F.lit("A grid has no vector that counts.")).cast("array<double>")
    mean = lambda k: F.when(F.col(f"used_weight{k}") > 0, F.transform(f"sum{k}", lambda v: v / F.col(f"used_weight{k}"))).otherwise(bad)
    if vectors is not None:
        sums = sums.where("n1 > 0")
    parts = [mean(k).alias(name) for k, name in enumerate(["token_mean", "patch_mean"][: len(widths)])]
    return sums.select(F.col("target").alias("grid_index"), *parts, F.col("weight0").alias("weight_sum"), F.col("n0").alias("n_views_averaged"))


def with_tissue_flags(grids: DataFrame) -> DataFrame:
    """Constant flag and fraction of retained grids, and the exported id."""
    return (
        grids.withColumn("is_tissue", F.lit(True))
        .withColumn("grid_tissue_fraction", F.lit(1.0).cast("float"))
        .withColumn("grid_id", F.concat(F.lit("grid_"), F.col("grid_index").cast("string")))
    )


def blend_report(features: DataFrame, stats: DataFrame) -> dict:
    """Smallest, median and largest views, weights and neighbour counts, and the isolated patches."""
    views = one_row(features.agg(
        F.sum("n_views_averaged").alias("n_total_token_views_used"),
        F.min("n_views_averaged").alias("n_views_averaged_min"),
        F.max("n_views_averaged").alias("n_views_averaged_max"),
        F.min("weight_sum").alias("weight_sum_min"),
        F.max("weight_sum").alias("weight_sum_max"),
    ))
    weights = one_row(exact_median(features.select("weight_sum"), "weight_sum", name="weight_sum_median"))
    weights |= one_row(exact_median(features.select("n_views_averaged"), "n_views_averaged", name="n_views_averaged_median"))
    near = one_row(stats.agg(
        F.min("neighbour_count").alias("neighbor_count_min"),
        F.max("neighbour_count").alias("neighbor_count_max"),
        F.count_if(F.col("neighbour_count") == 0).alias("isolated_patches"),
    ))
    near |= one_row(exact_median(stats.select("neighbour_count"), "neighbour_count", name="neighbor_count_median"))
    return {**views, **weights, **near}


def patch_pixels(pixels: DataFrame, patches: DataFrame, mean: tuple, std: tuple, patch: int = PATCH, stride: int = STRIDE) -> DataFrame:
    """Normalised channels of every pixel of every patch: ``(v / 255 - mean) / std``.

    Patches begin at multiples of the stride. A patch is dealt to the squares of the stride that it lies on, and meets there the pixels
    of the square, so a pixel moves once, however many patches it lies in. ``pixels``: ``(px, py, r, g, b)`` in full resolution.
    """
    def squares(origin: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(origin) / stride), F.floor((F.col(origin) + patch - 1) / stride)))

    lattice = patches.where((F.col("x0") % stride == 0) & (F.col("y0") % stride == 0)).select("patch_index", "x0", "y0")
    dealt = lattice.withColumn("_sx", squares("x0")).withColumn("_sy", squares("y0"))
    placed = pixels.withColumn("_sx", F.floor(F.col("px") / stride)).withColumn("_sy", F.floor(F.col("py") / stride))
    inside = (F.col("px") < F.col("x0") + patch) & (F.col("py") < F.col("y0") + patch)
    joined = placed.join(by_shuffle(dealt), ["_sx", "_sy"]).where(inside)
    channel = lambda c, i: ((F.col(c) / 255.0 - mean[i]) / std[i]).alias(c)
    return joined.select(
        "patch_index", (F.col("px") - F.col("x0")).alias("dx"), (F.col("py") - F.col("y0")).alias("dy"),
        channel("r", 0), channel("g", 1), channel("b", 2),
    )
