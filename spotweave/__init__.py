"""Spatial transcriptomics tables on Spark: mixture proportions, grid features, head fitting, polygon aggregation, windows."""

from spotweave.plans.pipeline import agg, deconv, export_grid_predictions, ge, plotexpr, plottype, train

__all__ = ["agg", "deconv", "export_grid_predictions", "ge", "plotexpr", "plottype", "train"]
