"""Identifier, label and palette expressions."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cell types in display order, their colours, and the marker gene groups.
CELL_TYPE_ORDER = [
    "B Cells", "T Cells", "DCIS", "Endothelial", "Invasive Tumor", "DCs",
    "Macrophages", "Mast Cells", "Myoepi", "Perivascular-Like", "Stromal",
]
CELL_TYPE_COLORS = {
    "B Cells": "#fa786e",
    "T Cells": "#dc8c00",
    "DCIS": "#64b400",
    "Endothelial": "#00be5a",
    "Invasive Tumor": "#00c3a5",
    "DCs": "#b487ff",
    "Macrophages": "#00b9dc",
    "Mast Cells": "#8f7aff",
    "Myoepi": "#00a5ff",
    "Perivascular-Like": "#d07cff",
    "Stromal": "#f069eb",
    "Unassigned": "#bdbdbd",
    "Unlabeled": "#bdbdbd",
    "Others": "#7f7f7f",
}
MARKER_GROUPS = {
    "Lymphoid": ["CD3D", "CD3E", "TRAC"],
    "Myeloid": ["LYZ", "CD68"],
    "vascular_stromal_cells": ["CDH5", "DCN", "COL5A2"],
    "Myoepi": ["KRT5", "KRT17", "KRT14", "TAGLN"],
    "Tumor": ["FASN", "ABCC11", "MKI67", "TOP2A"],
}
# Annotation orders accepted when a named reference filter is applied.
CRC_TYPES = [
    "B cells", "T cells", "Tumor", "Myeloid", "Fibroblast", "Endothelial",
    "Intestinal Epithelial", "Smooth Muscle", "Neuronal",
]
BRCA_TYPES = [
    "B Cells", "CD4+ T Cells", "CD8+ T Cells", "DCIS 1", "DCIS 2", "Endothelial", "Invasive Tumor",
    "IRF7+ DCs", "LAMP3+ DCs", "Macrophages 1", "Macrophages 2", "Mast Cells", "Myoepi ACTA2+",
    "Myoepi KRT15+", "Perivascular-Like", "Prolif Invasive Tumor", "Stromal",
]
BRCA_MERGE = {
    "B Cells": ["B Cells"],
    "T Cells": ["CD4+ T Cells", "CD8+ T Cells"],
    "DCIS": ["DCIS 1", "DCIS 2"],
    "Endothelial": ["Endothelial"],
    "Invasive Tumor": ["Invasive Tumor", "Prolif Invasive Tumor"],
    "DCs": ["IRF7+ DCs", "LAMP3+ DCs"],
    "Macrophages": ["Macrophages 1", "Macrophages 2"],
    "Mast Cells": ["Mast Cells"],
    "Myoepi": ["Myoepi ACTA2+", "Myoepi KRT15+"],
    "Perivascular-Like": ["Perivascular-Like"],
    "Stromal": ["Stromal"],
}


def drop_suffix(value: Column, suffix: str) -> Column:
    return F.regexp_replace(value, re.escape(suffix) + r"\z", "")


def spot_id_for_grid(barcode: Column, sample: str | None) -> Column:
    """Strip ``_<sample>`` once."""
    return drop_suffix(barcode, f"_{sample}") if sample else barcode


def spot_id_for_model(barcode: Column, sample: str | None) -> Column:
    """Strip ``_BREAST`` always, then ``_<sample>``; a doubled suffix therefore loses both."""
    return spot_id_for_grid(drop_suffix(barcode, "_BREAST"), sample)


def label_key(label: Column) -> Column:
    """Underscores to blanks, runs of blanks to one, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(label, "_", " "), r"\s+", " ")))


def known_label(label: Column, otherwise: str) -> Column:
    """The label when the palette knows it, else the given fallback."""
    return F.when(label.isin(*CELL_TYPE_COLORS), label).otherwise(F.lit(otherwise))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs.items())])


def label_color(label: Column) -> Column:
    return F.try_element_at(_literal_map(CELL_TYPE_COLORS), label)


def hex_channel(color: Column, channel: int) -> Column:
    """Red (0), green (1) or blue (2) of a ``#rrggbb`` text."""
    digits = F.regexp_replace(color, "^#+", "")
    return F.conv(F.substring(digits, 1 + 2 * channel, 2), 16, 10).cast("int")


def marker_group(gene: Column) -> Column:
    groups = {gene_name: group for group, genes in MARKER_GROUPS.items() for gene_name in genes}
    return F.coalesce(F.try_element_at(_literal_map(groups), F.upper(gene)), F.lit("Gene"))


def dataset_of(sample: Column, *paths: Column) -> Column:
    """Data set from the sample name, else from the parts of the paths in order, else ``unknown``."""
    s = F.lower(sample)
    result = F.when(s.contains("breast"), F.lit("brca")).when(s.contains("colon") | s.contains("crc"), F.lit("crc"))
    for path in paths:
        parts = F.split(F.lower(path), "/")
        result = result.when(F.array_contains(parts, "brca"), F.lit("brca")).when(
            F.array_contains(parts, "crc") | F.array_contains(parts, "colon"), F.lit("crc")
        )
    return result.otherwise(F.lit("unknown"))


def checked_dataset(name: str) -> str:
    """The supported data set names; anything else is an error."""
    chosen = str(name).lower()
    if chosen not in {"brca", "crc"}:
        raise ValueError(f"The data set must be brca or crc, not {name!r}.")
    return chosen
