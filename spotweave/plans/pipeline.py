"""The seven entry points: DataFrames in, DataFrames and a summary out. With ``output_dir`` the results are written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.text import BRCA_MERGE, checked_dataset, marker_group, spot_id_for_model
from spotweave.operators import aggregate, counts as count_ops, lattice, metrics, nearest, proportions, raster, spots
from spotweave.operators import windows as win
from spotweave.operators.ordinals import ordinal, seeded_split
from spotweave.operators.training import FitOptions, encode_patches, fit, load_params, predict_bags, predict_grids, save_params, token_rows
from spotweave.session import by_shuffle, durable, one_row, scratch_path
from spotweave.sinks import files as sinks


@dataclass
class Result:
    """Named tables of a step, its summary, and (for training) the fitted parameters."""

    tables: dict[str, DataFrame]
    summary: dict
    extra: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _fingerprint(step: str, given: dict) -> str | None:
    """What a run was asked: the step, its plain arguments, and per input table the schema, the number of rows and a sum over hashes of
    all rows (their order does not count). None if nothing is stored. The tables are read once for it.
    """
    if not given.get("output_dir"):
        return None
    told: dict[str, object] = {"step": step}
    for name, value in sorted(given.items()):
        if name in ("output_dir", "policy", "state_path"):
            continue
        if isinstance(value, DataFrame):
            columns = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in value.schema]
            row = value.select(F.xxhash64(*columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
            told[name] = [value.schema.simpleString(), row["n"], str(row["s"])]
        elif callable(value):
            told[name] = f"{getattr(value, '__module__', '')}.{getattr(value, '__qualname__', type(value).__qualname__)}"
        else:
            told[name] = repr(value)
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def _reused(spark, output_dir: str | None, policy: str, mark: str | None) -> Result | None:
    """What an earlier run has stored, if ``policy`` is ``reuse``, that run was asked the same and got as far as its summary, written last."""
    if policy != "reuse" or not output_dir:
        return None
    try:
        summary = json.loads(spark.read.text(f"{output_dir}/summary").first()["value"])
    except AnalysisException:
        return None
    if summary.get("fingerprint") != mark:
        return None
    return Result({name: spark.read.parquet(f"{output_dir}/{name}") for name in summary["tables"]}, summary)


def _store(result: Result, spark, output_dir: str | None, policy: str, mark: str | None) -> Result:
    """Write all tables and, last, the summary. Under ``reuse`` whatever lies there was made from something else and is replaced."""
    if output_dir:
        result.summary |= {"tables": sorted(result.tables), "fingerprint": mark}
        for name, table in result.tables.items():
            sinks.write_table(table, f"{output_dir}/{name}", "replace" if policy == "reuse" else policy)
        sinks.write_summary(spark, result.summary, f"{output_dir}/summary")
    return result


def deconv(
    *, dataset: str, counts: DataFrame, positions: DataFrame, ref_cells: DataFrame, ref_counts: DataFrame, sample_id: str,
    annotation_column: str = "label", patient_column: str = "patient", type_merge: DataFrame | None = None,
    reference_filter: str | None = None, consensus: bool = True, umi_min: float | None = None, rounds: int = 50,
    run: bool = True, output_dir: str | None = None, policy: str = "fail", **vocabularies,
) -> Result:
    """Cell-type proportions per spot from spot counts and annotated reference cells.

    ``counts``: ``(barcode, gene, count)``; ``positions``: spot positions; ``ref_cells``: ``(cell_id, ord, <annotation>,
    <patient>[, consensus_keep])``; ``ref_counts``: ``(cell_id, gene, count)``. With ``run=False`` only the prepared
    inputs are returned.
    """
    mark = _fingerprint("deconv", locals())
    chosen = checked_dataset(dataset)
    spark = counts.sparkSession
    if (stored := _reused(spark, output_dir, policy, mark)) is not None:
        return stored
    collapsed = count_ops.collapse_duplicate_genes(counts)
    coordinates = spots.aligned_positions(counts, positions)
    kept = spots.reference_filter(ref_cells, reference_filter, sample_id, annotation_column, patient_column, consensus, **vocabularies)
    labelled = kept.select("cell_id", "ord", F.col(annotation_column).cast("string").alias("cell_type"))
    order = count_ops.category_order(labelled, spots.allowed_types(reference_filter, sample_id, **vocabularies))
    types = [r["cell_type"] for r in order.orderBy("position").collect()]
    minimum = count_ops.default_umi_minimum(sample_id) if umi_min is None else umi_min
    summary = {
        "dataset": chosen, "sample_id": sample_id, "reference_filter": reference_filter, "umi_min": minimum,
        "annotation_column": annotation_column, "cell_types": types, "n_cell_types": len(types),
        "n_reference_cells": labelled.count(), "n_source_cells": ref_cells.count(),
    }
    prepared = {"coordinates": coordinates, "reference_cells": labelled, "cell_type_order": order}
    if not run:
        return _store(Result(prepared, summary), spark, output_dir, policy, mark)

    profiles = count_ops.reference_profiles(ref_counts, labelled)
    mixed = durable(proportions.mixture_proportions(collapsed, profiles, types, rounds, minimum))
    names = F.array(*[F.lit(t) for t in types])
    empty = F.array(*[F.lit(None).cast("double") for _ in types])
    long = mixed.select(F.col("barcode").alias("spot_id"), F.posexplode(F.coalesce("p", empty)).alias("_i", "p")).select(
        "spot_id", F.get(names, F.col("_i")).alias("cell_type"), "p"
    )
    summary |= one_row(mixed.agg(
        F.count_if(F.col("umi") < minimum).alias("n_spots_below_minimum"), F.count_if(F.col("p").isNull() & (F.col("umi") >= minimum)).alias("n_spots_without_genes")))
    known = long.where("p IS NOT NULL")
    fitted = mixed.where("p IS NOT NULL").select(F.col("barcode").alias("spot_id"))
    summary["validation"] = one_row(proportions.validate(known, order, fitted))
    proportions.require_valid(summary["validation"])
    tables = {**prepared, "profiles": profiles, "proportions": long}
    merge = type_merge
    if merge is None and sample_id == "BREAST" and set(t for ts in BRCA_MERGE.values() for t in ts) <= set(types):
        rows = [(t, s, i) for i, (t, sources) in enumerate(BRCA_MERGE.items()) for s in sources]
        merge = spark.createDataFrame(rows, "target string, source string, target_ord int")
    if merge is not None:
        absent = mixed.where("p IS NULL").select(F.col("barcode").alias("spot_id"))
        tables["merged_proportions"] = proportions.with_missing_spots(
            proportions.merged_proportions(known, merge), absent, merge.select(F.col("target").alias("cell_type")))
    return _store(Result(tables, summary), spark, output_dir, policy, mark)


def ge(
    *, dataset: str, positions: DataFrame, spot_diameter: float, thumbnail_scale: float, thumbnail: DataFrame, image: DataFrame,
    patch_source: Callable[[DataFrame], DataFrame] | None = None, encoder: Callable | None = None,
    tiles: DataFrame | None = None, tokens: DataFrame | None = None, sample_id: str | None = None,
    patch_size: int = lattice.PATCH, stride: int = lattice.STRIDE, max_patches: int | None = None, metadata_only: bool = False,
    neighbour_mode: str = "mean", filter_tissue: bool = True, output_dir: str | None = None, policy: str = "fail",
) -> Result:
    """Grid features from overlapping patches.

    Patch vectors come from an ``encoder`` applied to ``patch_source(patches)`` (patch rows with their image data), or
    ready made as ``tiles(patch_index, tile)`` and ``tokens(patch_index, token_linear, token)``.
    """
    mark = _fingerprint("ge", locals())
    chosen = checked_dataset(dataset)
    if patch_size % 16:
        raise ValueError("patch_size must be a multiple of 16.")
    sample = sample_id or {"brca": "BREAST", "crc": "COLON_P2"}[chosen]
    spark, grid = positions.sparkSession, patch_size // 16
    if (stored := _reused(spark, output_dir, policy, mark)) is not None:
        return stored
    table = durable(spots.spot_table(positions, sample))
    box = one_row(lattice.spot_extent(spots.in_tissue(positions)))
    pixels, width, height = raster.tissue_mask(thumbnail)
    mask = durable(pixels)
    patches = durable(lattice.select_patches(image, box, mask, thumbnail_scale, width, height, patch_size, stride, max_patches))
    boxed = lattice.boxed_tokens(lattice.token_grids(patches, patch_size, grid), box, grid)
    grids = durable(lattice.unique_grids(boxed, mask if filter_tissue else None, thumbnail_scale, width, height, grid))
    views = lattice.token_to_grid(boxed, grids).select("patch_index", "token_linear", "grid_index", "weight")
    assigned = nearest.assign_spots(grids, table, spot_diameter)
    placed = lattice.with_tissue_flags(grids.join(by_shuffle(assigned), "grid_index")).withColumn("is_supervised_grid", F.col("spot_index") >= 0)
    counted = one_row(placed.agg(
        F.count(F.lit(1)).alias("n_grids"), F.count_if("is_supervised_grid").alias("n_supervised_grids"),
        F.countDistinct(F.when(F.col("is_supervised_grid"), F.col("spot_index"))).alias("n_supervised_spots"),
    ))
    summary = {
        "dataset": chosen, "sample_id": sample, "patch_size": patch_size, "stride": stride, "grid_size": grid,
        "neighbor_feature_mode": neighbour_mode, "filter_tissue": filter_tissue, "fullres_bbox": box,
        "n_positions_in_tissue": table.count(), "n_export_patches": patches.count(), "n_raw_token_grids": views.count(), **counted,
        "n_bbox_patch_candidates": lattice.patch_candidates(image, box, patch_size, stride).count(), "complete": False,
    }
    rules = {"patch_size": patch_size, "stride": stride, "selection_rule": "centre in spot box and on tissue", "fullres_bbox": box}
    tables = {"patches": sinks.patch_table(patches, rules), "grids": placed, "spots": table}
    if metadata_only:
        return _store(Result(tables, summary), spark, output_dir, policy, mark)

    if encoder is not None:
        encoded = durable(encode_patches(patch_source(patches) if patch_source else patches, encoder))
        tiles, tokens = encoded.select("patch_index", "tile"), token_rows(encoded)
    if tiles is None or tokens is None:
        raise ValueError("Give an encoder, or tiles and tokens.")
    lattice.require_encoded(patches, views, tiles, tokens)
    stats = durable(lattice.neighbour_stats(patches, tiles, stride))
    features = durable(lattice.blend(patches, views, tokens, lattice.patch_vectors(stats, neighbour_mode), stride=stride, grid=grid))
    missing = placed.join(features, "grid_index", "left_anti").count()
    if missing:
        raise RuntimeError(f"{missing} grids received no token view.")
    tables["grid_embedding"] = placed.join(features, "grid_index")
    summary.update(lattice.blend_report(features, stats))
    summary.update({"complete": True, "feature_dim": one_row(features.agg(F.max(F.size("feature")).alias("n")))["n"]})
    return _store(Result(tables, summary), spark, output_dir, policy, mark)


def _spot_targets(counts: DataFrame, gene_list: DataFrame | None, sample: str) -> tuple[DataFrame, DataFrame]:
    """Dense target expression per spot, and the genes used. Repeated gene names get suffixes, as in a named matrix."""
    expression = count_ops.expression_only(counts) if "feature_type" in counts.columns else counts
    if "gene_row" in expression.columns:
        features = expression.select("gene_row", "gene").distinct()
        named = durable(count_ops.unique_gene_names(features))
        expression = expression.drop("gene").join(named.select("gene_row", F.col("unique_name").alias("gene")), "gene_row")
        available = named.select(F.col("gene_row").alias("ord"), F.col("unique_name").alias("gene"))
    else:
        available = ordinal(expression.select("gene").distinct(), ["gene"], name="ord")
    genes = durable(count_ops.requested_genes(available if gene_list is None else gene_list, available))
    dense = count_ops.dense_by_spot(expression, genes)
    if "spot_ord" in expression.columns:
        dense = dense.join(expression.groupBy("barcode").agg(F.min("spot_ord").alias("spot_ord")), "barcode")
    numbered = ordinal(dense, ["spot_ord", "barcode"] if "spot_ord" in dense.columns else ["barcode"], name="target_ord").drop("spot_ord")
    return numbered.withColumn("spot_id", spot_id_for_model(F.col("barcode"), sample)), genes


def train(
    *, dataset: str, grid_embedding: DataFrame, position_spots: DataFrame, counts: DataFrame, deconv: DataFrame,
    gene_list: DataFrame | None = None, sample_id: str | None = None, options: FitOptions | None = None,
    limit_spots: int | None = None, no_export: bool = False, output_dir: str | None = None, policy: str = "fail",
) -> Result:
    """Fit the expression and type heads on spot totals, evaluate them, and predict every grid.

    ``grid_embedding``: ``(grid_index, spot_index, is_tissue, feature, ...)``; ``position_spots``: ``(spot_index,
    spot_id)``; ``deconv``: ``(spot_id, cell_type, p[, type_ord])``; ``gene_list``: ``(ord, gene)``. Types are in the order of ``type_ord`` (the
    columns of a table), else of their names; spots in the order of ``spot_ord`` of ``counts`` (the lines of a matrix), else of their
    barcodes. With ``output_dir`` each epoch is stored there, and a run that broke off goes on from its last one.
    """
    mark = _fingerprint("train", locals())
    chosen = checked_dataset(dataset)
    sample = sample_id or {"brca": "BREAST", "crc": "COLON_P2"}[chosen]
    opts = options or FitOptions()
    spark = grid_embedding.sparkSession
    if (stored := _reused(spark, output_dir, policy, mark)) is not None:
        stored.extra.update({"params": load_params(spark, f"{output_dir}/model"), "types": stored.summary["cell_type_names"]})
        return stored
    expression, genes = _spot_targets(counts, gene_list, sample)
    expression = durable(expression)
    place = F.min("type_ord") if "type_ord" in deconv.columns else F.lit(0)
    types = [r["cell_type"] for r in deconv.groupBy("cell_type").agg(place.alias("o")).orderBy("o", "cell_type").collect()]
    shares = deconv.withColumn("spot_id", spot_id_for_model(F.col("spot_id"), sample))
    vectors = proportions.as_vectors(proportions.training_targets(shares, expression.select("spot_id").distinct(), deconv.select("cell_type")), types)
    named = position_spots.select("spot_index", spot_id_for_model(F.col("spot_id"), sample).alias("spot_id"))
    bags = durable(spots.spot_bags(expression.select("target_ord", "spot_id"), named, grid_embedding, limit_spots))
    if bags.isEmpty():
        raise ValueError("No supervised spots with tissue grids.")
    targets = durable(
        expression.join(bags.select("target_ord").distinct(), "target_ord", "left_semi").join(vectors, "spot_id")
        .select("target_ord", "spot_id", "expression", "proportions")
    )
    features = bags.join(grid_embedding.select("grid_index", "feature"), "grid_index").select("target_ord", "spot_id", "feature")
    features = durable(features.repartition("target_ord", F.xxhash64("feature") % 16))
    n_in, n_genes, n_spots = len(features.first()["feature"]), genes.count(), targets.count()
    validation = None
    learn = features
    if not opts.train_all:
        split = durable(seeded_split(targets.select("target_ord"), "target_ord", opts.val_fraction, opts.seed, n_spots))
        held = split.where("is_validation").select("target_ord")
        validation = (features.join(held, "target_ord", "left_semi"), targets)
        learn = features.join(held, "target_ord", "left_anti")
    result = fit(learn, targets, n_in, n_genes, len(types), opts, validation, f"{output_dir}/epochs-{mark[:16]}" if output_dir else None)

    predicted = durable(predict_bags(features, result.params, len(types), n_genes))
    # Two barcodes may share one normalised spot id; targets are told apart by their number.
    pairs = durable(metrics.paired_values(predicted, targets.withColumnRenamed("expression", "expr"), key="target_ord"))
    spot_names = targets.select("target_ord", "spot_id")
    by_gene = durable(metrics.gene_metrics(pairs).join(genes.withColumnRenamed("position", "gene_pos"), "gene_pos"))
    by_spot = durable(metrics.spot_metrics(pairs, "target_ord").join(spot_names, "target_ord"))
    composed = predicted.select("target_ord", "spot_id", F.col("prob").alias("predicted")).join(
        targets.select("target_ord", F.col("proportions").alias("target")), "target_ord")
    by_type = metrics.type_metrics(composed)
    summary = {
        "dataset": chosen, "sample_id": sample, "input_dim": n_in, "projection_dim": opts.projection_dim,
        "n_genes": n_genes, "n_cell_types": len(types), "cell_type_names": types, "n_grids": grid_embedding.count(),
        "n_tissue_grids": grid_embedding.where("is_tissue").count(), **one_row(spots.bag_summary(bags)),
        "expression_target": "raw_counts", "early_stop_monitor": result.monitor, "best_epoch": result.best_epoch,
        "epochs_run": len(result.history), "history": result.history,
        **one_row(metrics.mean_metrics(by_gene, by_spot)), **one_row(metrics.mean_type_metrics(by_type)),
    }
    tables = {
        "gene_metrics": by_gene.select("gene", "pcc", "scc"), "spot_metrics": by_spot, "spot_type_metrics": by_type,
        "spot_type_probabilities": predicted.select("spot_id", "prob"), "genes": genes,
    }
    if not no_export:
        geometry = tuple(c for c in grid_embedding.columns if c != "feature")
        tables["grid_predictions"] = predict_grids(grid_embedding, result.params, geometry)
    if output_dir:
        save_params(spark, result.params, f"{output_dir}/model")
    return _store(Result(tables, summary, {"params": result.params, "types": types}), spark, output_dir, policy, mark)


def export_grid_predictions(predictions: DataFrame, type_names: list[str], output_dir: str | None = None, policy: str = "fail") -> Result:
    """Grid type and grid expression tables of a prediction table."""
    mark = _fingerprint("export_grid_predictions", locals())
    types, expression = aggregate.prediction_tables(predictions, type_names)
    return _store(Result({"grid_type": types, "grid_expr": expression}, {"n_cell_types": len(type_names)}), predictions.sparkSession, output_dir, policy, mark)


def agg(
    *, dataset: str, grid_expr: DataFrame, grid_types: DataFrame, type_names: list[str], polygons: DataFrame, valid_only: bool = True,
    target_name: str = "cellvit", n_genes: int | None = None, output_dir: str | None = None, policy: str = "fail",
) -> Result:
    """Area-weighted grid predictions on cell polygons.

    ``grid_expr``: ``(grid_id, bbox_x0.., expr[, ord])``; ``grid_types``: ``(grid_id, prob)``. Without ``ord`` the number in
    ``grid_<n>`` is the row order that decides between grids of one origin.
    """
    mark = _fingerprint("agg", locals())
    chosen = checked_dataset(dataset)
    if (stored := _reused(polygons.sparkSession, output_dir, policy, mark)) is not None:
        return stored
    number = F.col("ord") if "ord" in grid_expr.columns else F.regexp_extract("grid_id", r"([0-9]+)\z", 1).cast("long")
    boxes = [F.col(f"bbox_{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]
    grids = grid_expr.select("grid_id", number.alias("ord"), *boxes, "expr").join(grid_types.select("grid_id", "prob"), "grid_id").drop("grid_id")
    # Several passes read single columns of this join; written, they do not join all vectors anew.
    path = scratch_path(polygons.sparkSession, "agg_grids")
    grids.write.parquet(path)
    grids = polygons.sparkSession.read.schema(grids.schema).parquet(path)
    size = aggregate.grid_size(grids)
    everything = durable(aggregate.polygon_values(polygons, grids, type_names, n_genes, size, valid_only=False))
    values = everything.where("NOT is_invalid AND n_grids > 0") if valid_only else everything
    types, kept, expression = sinks.polygon_outputs(values, polygons, type_names)
    summary = {
        "dataset": chosen, "target_name": target_name, "grid_size": size, "valid_only": valid_only,
        **one_row(aggregate.polygon_counters(everything, valid_only)),
    }
    return _store(Result({"ct": types, "polygon": kept, "expr": expression}, summary), polygons.sparkSession, output_dir, policy, mark)


def plottype(
    *, dataset: str, grid_types: DataFrame, window, true_types: DataFrame | None = None, type_merge: DataFrame | None = None,
    output_dir: str | None = None, policy: str = "fail",
) -> Result:
    """Tables behind the type views of a window: painted pixels, label counts, and measured polygons with labels."""
    mark = _fingerprint("plottype", locals())
    from spotweave.functions.text import known_label

    chosen, box = checked_dataset(dataset), win.checked_window(window)
    order = "ord" if "ord" in grid_types.columns else None
    table = grid_types if order else grid_types.withColumn("ord", F.regexp_extract("grid_id", r"([0-9]+)\z", 1).cast("long"))
    shown = win.clipped_to_window(win.rectangles_in_window(table, box), box).withColumn("label", known_label(F.col("predicted_type"), "Unassigned"))
    tables = {"grid_type_raster": win.type_raster(table, box), "grid_type_counts": win.label_counts(shown, "label")}
    if true_types is not None:
        win.require_columns(true_types, "celltype")
        inside = win.polygons_in_window(win.merged_labels(true_types, type_merge), box)
        tables["true_type_polygons"] = inside
        tables["true_type_counts"] = win.label_counts(win.ring_bounds(inside), "celltype")
    return _store(Result(tables, {"dataset": chosen, "window": list(box)}), grid_types.sparkSession, output_dir, policy, mark)


def plotexpr(
    *, dataset: str, grid_expr: DataFrame, genes: DataFrame, window, gene: str = "EPCAM", measured: DataFrame | None = None,
    polygons: DataFrame | None = None, output_dir: str | None = None, policy: str = "fail",
) -> Result:
    """Tables behind the expression views of a window: painted z-scores, and measured polygons with z-scores."""
    mark = _fingerprint("plotexpr", locals())
    chosen, box = checked_dataset(dataset), win.checked_window(window)
    if measured is not None and polygons is None:
        raise ValueError("Measured values need the polygons of their cells.")
    table = grid_expr if "ord" in grid_expr.columns else grid_expr.withColumn("ord", F.regexp_extract("grid_id", r"([0-9]+)\z", 1).cast("long"))
    tables = {"grid_expr_raster": win.expression_raster(win.gene_column(table, genes, gene), box)}
    if measured is not None:
        inside = win.polygons_in_window(polygons, box)
        ids = inside.select("cell_id").distinct()
        tables["measured_polygons"] = inside.join(win.zscores(win.measured_values(ids, measured, gene)), "cell_id")
    group = one_row(grid_expr.sparkSession.range(1).select(marker_group(F.lit(gene)).alias("g")))["g"]
    return _store(Result(tables, {"dataset": chosen, "window": list(box), "gene": gene, "marker_group": group}), grid_expr.sparkSession, output_dir, policy, mark)
