"""Intermediate tables that several queries start from: made once per data folder, written, then read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators import lattice, nearest, raster, spots
from spotweave.plans.fixtures import N_GENES, SPOT_DIAMETER, THUMB_SCALE, TYPE_NAMES, Fixtures
from spotweave.session import by_shuffle, one_row, scratch_path

_WRITTEN: dict[tuple, str] = {}
_SCALARS: dict[tuple, object] = {}


def _key(fx: Fixtures, name: str) -> tuple:
    return (fx.spark.sparkContext.applicationId, fx.folder, name)


def written(fx: Fixtures, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = _key(fx, name)
    if key not in _WRITTEN:
        path = scratch_path(fx.spark, name)
        build().write.parquet(path)
        _WRITTEN[key] = path
    return fx.spark.read.parquet(_WRITTEN[key])


def scalar(fx: Fixtures, name: str, build: Callable[[], object]):
    key = _key(fx, name)
    if key not in _SCALARS:
        _SCALARS[key] = build()
    return _SCALARS[key]


def frame(fx: Fixtures) -> tuple[int, int]:
    return scalar(fx, "frame", lambda: raster.frame_size(fx.thumbnail))


def box(fx: Fixtures) -> dict:
    return scalar(fx, "box", lambda: one_row(lattice.spot_extent(spots.in_tissue(fx.positions))))


def tissue_words(fx: Fixtures) -> DataFrame:
    return raster.pack(raster.tissue_pixels(fx.thumbnail))


def closed_words(fx: Fixtures) -> DataFrame:
    return written(fx, "closed", lambda: raster.open_and_close(tissue_words(fx), *frame(fx)))


def mask_words(fx: Fixtures) -> DataFrame:
    return written(fx, "mask", lambda: raster.fill_holes(closed_words(fx), *frame(fx)))


def mask(fx: Fixtures) -> DataFrame:
    return raster.unpack(mask_words(fx))


def spot_table(fx: Fixtures) -> DataFrame:
    return written(fx, "spots", lambda: spots.spot_table(fx.positions, "BREAST"))


def patches(fx: Fixtures) -> DataFrame:
    return written(fx, "patches", lambda: lattice.select_patches(fx.image_meta, box(fx), mask(fx), THUMB_SCALE, *frame(fx)))


def boxed_tokens(fx: Fixtures) -> DataFrame:
    return lattice.boxed_tokens(lattice.token_grids(patches(fx)), box(fx))


def grids(fx: Fixtures) -> DataFrame:
    return written(fx, "grids", lambda: lattice.unique_grids(boxed_tokens(fx), mask(fx), THUMB_SCALE, *frame(fx)))


def views(fx: Fixtures) -> DataFrame:
    return lattice.token_to_grid(boxed_tokens(fx), grids(fx)).select("patch_index", "token_linear", "grid_index", "weight")


def assigned(fx: Fixtures) -> DataFrame:
    return written(fx, "assigned", lambda: nearest.assign_spots(grids(fx), spot_table(fx), SPOT_DIAMETER))


def bags(fx: Fixtures) -> DataFrame:
    targets = spot_table(fx).join(by_shuffle(fx.positions.select("barcode", F.col("ord").alias("target_ord"))), "barcode")
    placed = assigned(fx).withColumn("is_tissue", F.lit(True))
    return spots.spot_bags(targets, spot_table(fx), placed)


def _pick(fx: Fixtures, keyed: DataFrame, number, name: str) -> DataFrame:
    n = scalar(fx, "n_embeddings", lambda: fx.embeddings.count())
    return by_shuffle(keyed.withColumn("vec_id", number % n)).join(
        fx.embeddings.select("vec_id", F.col("embedding").alias(name)), "vec_id"
    ).drop("vec_id")


def tiles(fx: Fixtures) -> DataFrame:
    return _pick(fx, patches(fx).select("patch_index"), F.col("patch_index"), "tile")


def token_vectors(fx: Fixtures) -> DataFrame:
    keyed = boxed_tokens(fx).select("patch_index", "token_linear")
    return _pick(fx, keyed, F.col("patch_index") * 256 + F.col("token_linear"), "token")


def tile_stats(fx: Fixtures) -> DataFrame:
    return lattice.neighbour_stats(patches(fx), tiles(fx))


def predicted_grids(fx: Fixtures) -> DataFrame:
    """Grids with expression and type vectors."""
    return fx.grid_pred.select(
        "ord", "grid_index", "x0", "y0", "x1", "y1", "user_id",
        F.array(*[f"e{i}" for i in range(N_GENES)]).alias("expr"),
        F.array(*[f"p{i}" for i in range(len(TYPE_NAMES))]).alias("prob"),
    )


def grid_type_table(fx: Fixtures) -> DataFrame:
    from spotweave.operators.aggregate import prediction_tables

    grids_ = predicted_grids(fx).select(
        "ord", "grid_index", "x0", "y0", "x1", "y1", (F.col("x0") + 9.0).alias("center_x"), (F.col("y0") + 9.0).alias("center_y"),
        F.col("prob").alias("type_prob"), F.col("expr").alias("expr_pred"),
    )
    return prediction_tables(grids_, TYPE_NAMES)[0]


def spot_sums(fx: Fixtures) -> DataFrame:
    from spotweave.functions.vectors import vector_mean, vector_sum

    return predicted_grids(fx).groupBy(F.col("user_id").alias("spot_id")).agg(
        vector_sum(F.col("expr"), N_GENES).alias("expr"), vector_mean(F.col("prob"), len(TYPE_NAMES)).alias("prob"),
        F.count(F.lit(1)).alias("n_grids"),
    )


def spot_truth(fx: Fixtures) -> DataFrame:
    amount = lambda key, n, i: F.sum(F.when(F.col(key) % n == i, F.col("l_quantity")).otherwise(0.0))
    return fx.lineitem.groupBy(F.col("l_suppkey").alias("spot_id")).agg(
        F.array(*[amount("l_partkey", N_GENES, i) for i in range(N_GENES)]).alias("expr"),
        F.array(*[amount("l_linenumber", 5, i) / F.sum("l_quantity") for i in range(5)]).alias("proportions"),
    )


def window(fx: Fixtures) -> tuple[int, int, int, int]:
    """A window from the data's own extent: the middle half of the grid's width and height."""
    def middle():
        row = one_row(fx.grid_pred.agg(F.max("x1").alias("w"), F.max("y1").alias("h")))
        return tuple(int(v) for v in (row["w"] // 4, row["h"] // 4, row["w"] - row["w"] // 4, row["h"] - row["h"] // 4))

    return scalar(fx, "window", middle)
