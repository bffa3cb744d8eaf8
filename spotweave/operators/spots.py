"""Spot tables, reference cells, and the joins that line spots up with counts, positions and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.text import BRCA_TYPES, CRC_TYPES, spot_id_for_grid
from spotweave.operators.ordinals import exact_median, first_n, last_wins, ordinal
from spotweave.session import by_shuffle, one_row


def in_tissue(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("in_tissue").cast("int") == 1)


def spot_table(positions: DataFrame, sample: str | None) -> DataFrame:
    """In-tissue spots with dense index, id and single-precision coordinates; no spot at all is an error."""
    kept = in_tissue(positions)
    if kept.isEmpty():
        raise ValueError("No in-tissue spots.")
    return ordinal(kept, ["ord"], name="spot_index").select(
        F.col("spot_index").cast("int").alias("spot_index"),
        "barcode",
        spot_id_for_grid(F.col("barcode"), sample).alias("spot_id"),
        F.col("pxl_col_in_fullres").cast("float").alias("x"),
        F.col("pxl_row_in_fullres").cast("float").alias("y"),
    )


def coordinate_columns(positions: DataFrame) -> DataFrame:
    """``(barcode, x, y)`` from whichever coordinate pair is present; neither is an error."""
    for x, y in (("pxl_col_in_fullres", "pxl_row_in_fullres"), ("image_x", "image_y")):
        if {x, y} <= set(positions.columns):
            return positions.select("barcode", F.col(x).alias("x"), F.col(y).alias("y"))
    raise KeyError("No full-resolution coordinate columns.")


def missing_positions(counts: DataFrame, positions: DataFrame) -> DataFrame:
    """Barcodes of the counts that have no position."""
    return counts.select("barcode").distinct().join(positions, "barcode", "left_anti")


def aligned_positions(counts: DataFrame, positions: DataFrame) -> DataFrame:
    """Coordinates of every counted barcode; a barcode without a position is an error."""
    absent = missing_positions(counts, positions)
    first = absent.limit(1).collect()
    if first:
        raise ValueError(f"{absent.count()} barcodes have no position; first={first[0]['barcode']}")
    return counts.select("barcode").distinct().join(coordinate_columns(positions), "barcode")


def keep_labelled(cells: DataFrame, label: str = "label") -> DataFrame:
    """Drop cells whose label is missing, empty, ``nan`` or ``NA``."""
    return cells.where(F.col(label).isNotNull() & ~F.col(label).isin("", "nan", "NA"))


def keep_types(cells: DataFrame, allowed: list[str] | None, label: str = "label") -> DataFrame:
    return cells if allowed is None else cells.where(F.col(label).isin(*allowed))


def keep_patients(cells: DataFrame, suffix: str | None, patient: str = "patient") -> DataFrame:
    return cells if suffix is None else cells.where(F.col(patient).endswith(suffix))


def keep_consensus(cells: DataFrame, column: str = "consensus_keep") -> DataFrame:
    """Cells with agreeing annotation; all cells if the column is absent."""
    return cells.where(F.col(column)) if column in cells.columns else cells


def allowed_types(name: str | None, sample: str, crc_types: list[str] = CRC_TYPES, brca_types: list[str] = BRCA_TYPES) -> list[str] | None:
    """The types, in order, that a named selection keeps; None keeps all. An unknown name is an error."""
    if name in ("allcrc", "p2crc"):
        return crc_types
    if name in (None, "allscrna"):
        return brca_types if sample == "BREAST" else None
    raise ValueError(f"There is no reference selection called {name!r}.")


def label_counts_with_patient(cells: DataFrame, label: str = "label", patient: str = "patient") -> DataFrame:
    """Cells per label, of the cells that have both a label and a patient."""
    kept = cells.where(F.col(label).isNotNull() & F.col(patient).isNotNull())
    return kept.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def reference_filter(
    cells: DataFrame,
    name: str | None,
    sample: str,
    label: str = "label",
    patient: str = "patient",
    consensus: bool = True,
    crc_types: list[str] = CRC_TYPES,
    brca_types: list[str] = BRCA_TYPES,
) -> DataFrame:
    """The named reference selections; an unknown name is an error."""
    allowed = allowed_types(name, sample, crc_types, brca_types)
    suffix = {"allcrc": "CRC", "p2crc": "P2CRC"}.get(name)
    kept = keep_patients(keep_types(keep_labelled(cells, label), allowed, label), suffix, patient)
    return keep_consensus(kept) if consensus else kept


def decode_categories(codes: DataFrame, categories: DataFrame) -> DataFrame:
    """``(ord, code)`` with ``(code, category)``; code -1 becomes NULL."""
    return codes.join(categories, "code", "left").select("ord", F.when(F.col("code") >= 0, F.col("category")).alias("category"))


def match_metadata(cells: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of each cell by id, the first entry of a repeated id, NULL where absent. ``metadata`` has ``ord``."""
    rest = [c for c in metadata.columns if c not in ("cell_id", "ord")]
    first = metadata.groupBy("cell_id").agg(
        *[F.min_by(F.struct(F.col(c)), F.col("ord")).getField(c).alias(c) for c in rest]
    )
    return cells.select("cell_id").join(first, "cell_id", "left")


def supervised(grids: DataFrame) -> DataFrame:
    """Grids that belong to a spot and lie on tissue."""
    return grids.where((F.col("spot_index") >= 0) & F.col("is_tissue"))


def spot_bags(targets: DataFrame, position_spots: DataFrame, grids: DataFrame, limit_spots: int | None = None) -> DataFrame:
    """Long bag table ``(target_ord, spot_id, spot_index, grid_index)``: one row per supervised grid of a kept spot.

    ``targets``: ``(target_ord, spot_id)``; ``position_spots``: ``(spot_index, spot_id)``, where the last position
    of a repeated id wins. A spot is kept if it has at least one grid. Bags are never collected: a spot that owns
    a third of all grids is simply many rows.
    """
    positions = last_wins(position_spots.select("spot_id", F.col("spot_index").alias("spot_index")), ["spot_id"], "spot_index")
    members = supervised(grids).select("spot_index", "grid_index")
    kept = targets.select("target_ord", "spot_id").join(by_shuffle(positions), "spot_id").join(
        by_shuffle(members.select("spot_index").distinct()), "spot_index", "left_semi"
    )
    if limit_spots is not None:
        kept = first_n(kept, ["target_ord"], int(limit_spots))
    return members.join(by_shuffle(kept), "spot_index").select("target_ord", "spot_id", "spot_index", "grid_index")


def bag_summary(bags: DataFrame) -> DataFrame:
    """Smallest, median and largest number of grids per spot."""
    sizes = bags.groupBy("target_ord").agg(F.count(F.lit(1)).alias("n"))
    median = one_row(exact_median(sizes, "n"))["median"]
    return sizes.agg(
        F.coalesce(F.min("n"), F.lit(0)).alias("spot_grid_count_min"),
        F.lit(float(median or 0.0)).alias("spot_grid_count_median"),
        F.coalesce(F.max("n"), F.lit(0)).alias("spot_grid_count_max"),
        F.count(F.lit(1)).alias("n_supervised_spots"),
    )
