"""Queries for sources, sinks, filters, joins and the tabular aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions import arrays, text
from spotweave.operators import aggregate, counts, lattice, metrics, ordinals, proportions, spots
from spotweave.operators import windows as win
from spotweave.plans import derived as d
from spotweave.plans import pipeline
from spotweave.plans.fixtures import N_GENES, SEGMENTS, TYPE_NAMES
from spotweave.plans.registry import query
from spotweave.session import durable, scratch_path
from spotweave.sinks import files as sinks
from spotweave.sources import files as sources


def _written(df, name, kind="parquet", order=None, header=True):
    """Write a table in the given order and return its path."""
    path = scratch_path(df.sparkSession, name)
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if kind == "csv":
        df.write.option("header", header).csv(path)
    else:
        getattr(df.write, kind)(path)
    return path


# ------------------------------------------------------------------ sources

@query("a01_spot_counts", "barcode:s gene:s feature_type:s count:d", "SELECT * FROM {counts}")
def _(fx):
    return sources.read_counts(fx.spark, _written(fx.counts, "counts"))


@query("a02_expression_counts", "barcode:s gene:s count:d", "SELECT * FROM {counts} WHERE feature_type = 'Gene Expression'")
def _(fx):
    return sources.read_counts(fx.spark, _written(fx.counts, "counts"), expression=True)


@query("a03_matrix_text", "barcode:s gene:s count:d", "SELECT barcode, gene, sum(count) AS count FROM {counts} GROUP BY 1, 2")
def _(fx):
    genes = counts.gene_order(fx.features).withColumnRenamed("ord", "position")
    names = fx.positions.select(F.col("ord").alias("position"), "barcode")
    path = scratch_path(fx.spark, "matrix")
    sinks.write_matrix_text(counts.collapse_duplicate_genes(fx.counts), genes, names, path)
    return sources.read_matrix_text(fx.spark, f"{path}/matrix", f"{path}/genes", f"{path}/spots")


_POSITION = "barcode in_tissue array_row array_col pxl_row_in_fullres pxl_col_in_fullres".split()


@query("a04_positions_without_header",
       "ord:i barcode:s in_tissue:i array_row:i array_col:i pxl_row_in_fullres:d pxl_col_in_fullres:d", "SELECT * FROM {positions}")
def _(fx):
    table = fx.positions.repartitionByRange("ord").sortWithinPartitions("ord").select(*_POSITION)
    path = scratch_path(fx.spark, "positions")
    table.write.csv(path)
    return sources.read_positions(fx.spark, path)


@query("a05_spot_table", "spot_index:i barcode:s spot_id:s x:d y:d", "SELECT * FROM {spots}")
def _(fx):
    table = fx.positions.repartitionByRange("ord").sortWithinPartitions("ord").select(*_POSITION)
    path, scale = scratch_path(fx.spark, "positions"), scratch_path(fx.spark, "scale")
    table.write.option("header", True).csv(path)
    fx.image_meta.selectExpr("width / 20.0D AS spot_diameter_fullres", "100.0D / height AS tissue_hires_scalef").write.json(scale)
    return sources.read_spot_table(fx.spark, path, scale, "BREAST")[0]


@query("a06_scale_factors", "spot_diameter_fullres:d tissue_hires_scalef:d",
       "SELECT width / 20.0 AS spot_diameter_fullres, 100.0 / height AS tissue_hires_scalef FROM {image_meta}")
def _(fx):
    path = scratch_path(fx.spark, "scale")
    fx.image_meta.selectExpr("width / 20.0D AS spot_diameter_fullres", "100.0D / height AS tissue_hires_scalef").write.json(path)
    row = sources.read_scale_factors(fx.spark, path)
    return fx.image_meta.select(*[F.lit(v).alias(k) for k, v in row.items()])


@query("a07_reference_cells", "cell_id:s label:s umi:d",
       "SELECT cell_id, label, umi FROM {ref_cells} LEFT JOIN (SELECT cell_id, sum(count) AS umi FROM {ref_counts} GROUP BY 1) USING (cell_id)")
def _(fx):
    cells, n = sources.read_reference(
        fx.spark, _written(fx.ref_cells, "cells"), _written(fx.ref_counts.limit(0), "x"), _written(fx.ref_counts, "layer")
    )
    return cells.join(counts.totals(n, "cell_id"), "cell_id", "left")


@query("a08_compressed_matrix", "row:i col:i value:d",
       "SELECT l_suppkey AS row, l_partkey % 40 AS col, sum(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2")
def _(fx):
    cells = fx.lineitem.groupBy(F.col("l_suppkey").alias("row"), (F.col("l_partkey") % 40).alias("minor")).agg(F.sum("l_quantity").alias("value"))
    placed = ordinals.ordinal(cells, ["row", "minor"], name="pos")
    lines = fx.supplier.select(F.col("s_suppkey").alias("i")).join(
        cells.groupBy(F.col("row").alias("i")).agg(F.count(F.lit(1)).alias("n")), "i", "left"
    ).select("i", F.coalesce("n", F.lit(0)).alias("n"))
    starts = ordinals.running_total(lines, [], ["i"], "n", "start")
    end = starts.agg((F.max("i") + 1).alias("i"), F.sum("n").alias("start"))
    pointers = starts.select("i", "start").unionByName(end)
    return sources.compressed_to_entries(pointers, placed.select("pos", "minor", "value"), "csr_matrix")


@query("a09_names_from_bytes", "name:s n:i", "SELECT p_name AS name, count(*) AS n FROM {part} GROUP BY 1")
def _(fx):
    names = fx.part.select(F.encode("p_name", "utf-8").alias("name"))
    return sources.as_text(names, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("a10_gene_list", "ord:i gene:s", "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, gene FROM {gene_list}")
def _(fx):
    lines = fx.gene_list.select("ord", F.explode(F.array(F.concat(F.lit("  "), "gene", F.lit(" ")), F.lit("   "))).alias("value"))
    path = scratch_path(fx.spark, "genes")
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.text(path)
    return sources.read_gene_list(fx.spark, path)


@query("a11_proportions", "spot_id:s cell_type:s p:d", "SELECT * FROM {deconv}")
def _(fx):
    wide = fx.deconv.groupBy("spot_id").pivot("cell_type", SEGMENTS).agg(F.sum("p"))
    return sources.read_proportions(fx.spark, _written(wide, "deconv", "csv")).where("p IS NOT NULL")


@query("a12_type_merge", "target:s source:s target_ord:i source_ord:i", """
    SELECT target, source, dense_rank() OVER (ORDER BY target_ord) - 1 AS target_ord,
           row_number() OVER (PARTITION BY target ORDER BY source) - 1 AS source_ord FROM {type_merge}""")
def _(fx):
    lists = fx.type_merge.groupBy("target_ord", "target").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    text_ = lists.agg(F.to_json(F.map_from_arrays(F.array(F.lit("merge")), F.array(F.map_from_entries(
        F.transform(F.sort_array(F.collect_list(F.struct("target_ord", "target", "sources"))), lambda s: F.struct(s["target"], s["sources"]))
    )))).alias("value"))
    return sources.read_type_merge(fx.spark, _written(text_, "merge", "text"))


@query("a13_polygons", "cell_id:s vertex_ord:i vertex_x:d vertex_y:d", "SELECT * FROM {polygons}")
def _(fx):
    table = fx.polygons.repartitionByRange("cell_id", "vertex_ord").sortWithinPartitions("cell_id", "vertex_ord")
    path = scratch_path(fx.spark, "polygons")
    table.select(F.col("cell_id").alias("cellvit_cell_id"), "vertex_x", "vertex_y").write.option("header", True).csv(path)
    return sources.read_polygons(fx.spark, path)


@query("a14_evaluation_polygons", "cell_id:s vertex_ord:i vertex_x:d vertex_y:d celltype:s", "SELECT * FROM {true_type}")
def _(fx):
    table = fx.true_type.repartitionByRange("cell_id", "vertex_ord").sortWithinPartitions("cell_id", "vertex_ord")
    path = scratch_path(fx.spark, "true")
    table.select(F.col("cell_id").alias("id"), F.col("vertex_x").alias("vertice_x"), F.col("vertex_y").alias("vertice_y"), "celltype").write.option(
        "header", True).csv(path)
    return sources.read_evaluation_polygons(fx.spark, path)


@query("a15_pruned_columns", "cell_id:s vertex_x:d vertex_y:d window_label:s", "SELECT * FROM {true_type}")
def _(fx):
    table = fx.true_type.withColumn("note", F.lit("unused")).withColumn("area", F.lit(1.0))
    path = scratch_path(fx.spark, "true")
    table.repartitionByRange("cell_id", "vertex_ord").sortWithinPartitions("cell_id", "vertex_ord").drop("vertex_ord").write.option(
        "header", True).csv(path)
    return sources.read_evaluation_polygons(fx.spark, path, sources.EVALUATION_COLUMNS)


@query("a16_measured_gene", "cell_id:s value:d", """
    SELECT xen_cell_id AS cell_id, log1p_count AS value FROM {true_expr} WHERE gene = 'G1'""")
def _(fx):
    ids = fx.true_expr.select(F.col("xen_cell_id").alias("cell_id")).distinct()
    return win.measured_values(ids, fx.true_expr, "G1")


@query("a17_predicted_gene", "grid_index:i x0:i y0:i value:d", "SELECT grid_index, x0, y0, e3 AS value FROM {grid_pred}")
def _(fx):
    genes = fx.part.select((F.col("p_size") % N_GENES).alias("ord")).distinct().select("ord", F.concat(F.lit("G"), "ord").alias("gene"))
    return win.gene_column(d.predicted_grids(fx), genes, "G3")


@query("a18_grid_rows", "grid_index:i x0:i y0:i total:d", f"""
    SELECT grid_index, x0, y0, {' + '.join(f'e{i}' for i in range(N_GENES))} AS total FROM {{grid_pred}}
    WHERE grid_index IN (SELECT event_id FROM {{events}} WHERE event_type = 'click')""")
def _(fx):
    path = scratch_path(fx.spark, "embedding")
    sinks.write_grid_embedding(d.predicted_grids(fx).withColumnRenamed("expr", "feature"), path, "dense")
    rows = fx.events.where("event_type = 'click'").select(F.col("event_id").alias("grid_index"))
    table = sources.read_grid_embedding(fx.spark, path, rows)
    return table.withColumn("total", F.aggregate(sources.feature_column(table), F.lit(0.0), lambda a, v: a + v))


@query("a21_patch_pixels", "patch_index:i dx:i dy:i r:d g:d b:d", """
    SELECT p.n AS patch_index, px - x0 AS dx, py - y0 AS dy,
           (r / 255.0 - 0.485) / 0.229 AS r, (g / 255.0 - 0.456) / 0.224 AS g, (b / 255.0 - 0.406) / 0.225 AS b
    FROM {thumbnail} JOIN (
        SELECT row_number() OVER (ORDER BY ly.v, lx.v) - 1 AS n, lx.v AS x0, ly.v AS y0
        FROM {frame}, unnest(range(0, w - 32 + 1, 16)) AS lx(v), unnest(range(0, h - 32 + 1, 16)) AS ly(v)) AS p
      ON px BETWEEN x0 AND x0 + 31 AND py BETWEEN y0 AND y0 + 31""")
def _(fx):
    image = fx.thumbnail.agg((F.max("px") + 1).alias("width"), (F.max("py") + 1).alias("height"))
    boxes = lattice.number_patches(lattice.patch_lattice(image, 32, 16))
    # Channel means and deviations of the usual image normalisation.
    return lattice.patch_pixels(fx.thumbnail, boxes, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 32, 16)


_TOP = """CASE WHEN p0 = greatest(p0, p1, p2, p3, p4) THEN 'DCIS' WHEN p1 = greatest(p1, p2, p3, p4) THEN 'Stromal'
          WHEN p2 = greatest(p2, p3, p4) THEN 'T Cells' WHEN p3 = greatest(p3, p4) THEN 'Myoepi' ELSE 'Mystery' END"""


@query("a22_grid_type_table", "grid_id:s bbox_x0:d predicted_type:s p0:d p1:d p2:d p3:d p4:d",
       f"SELECT 'grid_' || grid_index AS grid_id, x0 AS bbox_x0, {_TOP} AS predicted_type, p0, p1, p2, p3, p4 FROM {{grid_pred}}")
def _(fx):
    table, names = sources.read_grid_types(fx.spark, _written(d.grid_type_table(fx), "types", "csv"))
    assert names == TYPE_NAMES
    return aggregate.named_columns(table, "prob", [str(i) for i in range(5)], "p")


# ------------------------------------------------------------------ sinks

@query("b01_patch_table", "patch_index:i center_x:d center_y:d cx2:d cy2:d inside_bbox:b", """
    SELECT patch_index, center_x, center_y, x1 AS cx2, y1 AS cy2, true AS inside_bbox FROM {patches}""")
def _(fx):
    path = scratch_path(fx.spark, "patches")
    sinks.write_table(sinks.patch_table(d.patches(fx), {"patch_size": 288, "stride": 72}), path)
    return fx.spark.read.parquet(path).select("*", F.col("corners")[2]["x"].alias("cx2"), F.col("corners")[2]["y"].alias("cy2"))


_F8 = " ".join(f"f{i}:d" for i in range(N_GENES))
_E8 = " ".join(f"e{i}:d" for i in range(N_GENES))
_E8_SQL = ", ".join(f"e{i}" for i in range(N_GENES))


@query("b02_grid_embedding", f"grid_index:i x0:i y0:i {_F8}", "SELECT grid_index, x0, y0, " + ", ".join(f"e{i} AS f{i}" for i in range(N_GENES)) + " FROM {grid_pred}")
def _(fx):
    path = scratch_path(fx.spark, "embedding")
    sinks.write_grid_embedding(d.predicted_grids(fx).withColumnRenamed("expr", "feature"), path, "dense")
    table = sources.read_grid_embedding(fx.spark, path)
    return table.select("*", *[F.col("dense")[i].alias(f"f{i}") for i in range(N_GENES)])


@query("b03_grid_predictions", f"grid_index:i type_top1:i {_E8}", f"""
    SELECT grid_index, CASE {_TOP} WHEN 'DCIS' THEN 0 WHEN 'Stromal' THEN 1 WHEN 'T Cells' THEN 2 WHEN 'Myoepi' THEN 3 ELSE 4 END AS type_top1, {_E8_SQL}
    FROM {{grid_pred}}""")
def _(fx):
    from spotweave.functions.arrays import first_max_index

    path = scratch_path(fx.spark, "predictions")
    sinks.write_predictions(d.predicted_grids(fx).withColumn("type_top1", first_max_index(F.col("prob")).cast("short")), path)
    return fx.spark.read.parquet(path).select("*", *[F.col("expr")[i].alias(f"e{i}") for i in range(N_GENES)])


@query("b04_prediction_tables", "grid_id:s center_x:d center_y:d bbox_x1:d predicted_type:s prob_dcis:d", f"""
    SELECT 'grid_' || grid_index AS grid_id, x0 + 9 AS center_x, y0 + 9 AS center_y, x1 AS bbox_x1, {_TOP} AS predicted_type, p0 AS prob_dcis
    FROM {{grid_pred}}""")
def _(fx):
    return d.grid_type_table(fx).withColumnRenamed("prob_DCIS", "prob_dcis")


@query("b05_polygon_outputs", "cell_id:i n_vertices:i predicted_type:s covered_fraction:d", """
    SELECT cell_id, n_vertices, predicted_type, covered_fraction FROM {polygon_kept}""")
def _(fx):
    values = aggregate.polygon_values(fx.polygons, d.predicted_grids(fx), TYPE_NAMES, N_GENES, 18)
    types, kept, expression = sinks.polygon_outputs(values, fx.polygons, TYPE_NAMES)
    paths = [_written(t, n) for t, n in ((types, "ct"), (kept, "polygon"), (expression, "expr"))]
    types, kept, expression = (fx.spark.read.parquet(p) for p in paths)
    sizes = kept.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_vertices"))
    return types.join(sizes, "cell_id").join(expression, "cell_id")


_PCC = """CASE WHEN count(*) >= 2 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END"""


@query("b06_metric_table", "gene_pos:i pcc:d", f"SELECT gene_pos, {_PCC} AS pcc FROM {{pairs}} GROUP BY 1")
def _(fx):
    table = metrics.pearson(metrics.paired_values(d.spot_sums(fx), d.spot_truth(fx)), ["gene_pos"])
    return fx.spark.read.option("header", True).csv(_written(table, "metrics", "csv"))


@query("b07_text_labels", "cell_id:s cell_type:s", "SELECT cell_id, cell_type FROM {labelled}")
def _(fx):
    kept = spots.keep_labelled(fx.ref_cells).select("cell_id", F.col("label").alias("cell_type"))
    return fx.spark.read.option("header", True).csv(_written(kept, "labels", "csv"))


@query("b08_summary_row", "n_input_polygons:i n_output_cells:i n_zero_coverage:i n_invalid_polygon:i n_repaired_polygon:i", """
    SELECT count(*) FILTER (WHERE is_repaired) AS n_repaired_polygon, count(*) AS n_input_polygons, count(*) FILTER (WHERE NOT is_invalid AND n_grids > 0) AS n_output_cells,
           count(*) FILTER (WHERE NOT is_invalid AND n_grids = 0) AS n_zero_coverage, count(*) FILTER (WHERE is_invalid) AS n_invalid_polygon
    FROM {polygon_all}""")
def _(fx):
    values = aggregate.polygon_values(fx.polygons, d.predicted_grids(fx), TYPE_NAMES, N_GENES, 18, valid_only=False)
    counters = aggregate.polygon_counters(values, valid_only=True)
    return fx.spark.read.json(_written(counters, "summary", "json"))


# ------------------------------------------------------------------ projections and filters

_IDS = "SELECT barcode || CASE ord % 3 WHEN 1 THEN '_BREAST' WHEN 2 THEN '_S1' ELSE '' END AS raw FROM {positions}"


def _raw_ids(fx):
    return fx.positions.select(
        F.concat("barcode", F.when(F.col("ord") % 3 == 1, "_BREAST").when(F.col("ord") % 3 == 2, "_S1").otherwise("")).alias("raw")
    )


@query("p01_model_spot_id", "raw:s spot_id:s", f"""
    SELECT raw, regexp_replace(regexp_replace(raw, '_BREAST$', ''), '_BREAST$', '') AS spot_id FROM ({_IDS})""")
def _(fx):
    return _raw_ids(fx).withColumn("spot_id", text.spot_id_for_model(F.col("raw"), "BREAST"))


@query("p02_grid_spot_id", "raw:s spot_id:s", f"SELECT raw, regexp_replace(raw, '_S1$', '') AS spot_id FROM ({_IDS})")
def _(fx):
    return _raw_ids(fx).withColumn("spot_id", text.spot_id_for_grid(F.col("raw"), "S1"))


@query("p03_in_tissue", "barcode:s", "SELECT barcode FROM {positions} WHERE in_tissue = 1")
def _(fx):
    return spots.in_tissue(fx.positions)


@query("p04_labelled_cells", "cell_id:s label:s", "SELECT cell_id, cell_type AS label FROM {labelled}")
def _(fx):
    return spots.keep_labelled(fx.ref_cells)


@query("p05_allowed_types", "cell_id:s label:s", "SELECT cell_id, label FROM {ref_cells} WHERE label IN ('BUILDING', 'FURNITURE')")
def _(fx):
    return spots.keep_types(fx.ref_cells, ["BUILDING", "FURNITURE"])


@query("p06_patient_suffix", "cell_id:s patient:s", "SELECT cell_id, patient FROM {ref_cells} WHERE patient LIKE '%CRC'")
def _(fx):
    return spots.keep_patients(fx.ref_cells, "CRC")


@query("p07_consensus", "cell_id:s", "SELECT cell_id FROM {ref_cells} WHERE consensus_keep")
def _(fx):
    return spots.keep_consensus(fx.ref_cells)


@query("p08_reference_filter", "cell_id:s label:s patient:s", """
    SELECT cell_id, label, patient FROM {ref_cells} JOIN {labelled} USING (cell_id)
    WHERE label IN ('BUILDING', 'MACHINERY') AND patient LIKE '%P2CRC' AND consensus_keep""")
def _(fx):
    return spots.reference_filter(fx.ref_cells, "p2crc", "COLON_P2", crc_types=["BUILDING", "MACHINERY"])


@query("p09_requested_genes", "position:i gene:s", """
    SELECT row_number() OVER (ORDER BY ord, gene) - 1 AS position, gene FROM {gene_list} WHERE gene IN (SELECT gene FROM {counts})""")
def _(fx):
    return counts.requested_genes(fx.gene_list, fx.counts)


@query("p10_patch_in_box", "x0:i y0:i center_x:d center_y:d", "SELECT * FROM {candidates}")
def _(fx):
    return lattice.patch_candidates(fx.image_meta, d.box(fx))


@query("p11_token_in_box", "patch_index:i token_linear:i x0:i y0:i", "SELECT * FROM {boxed}")
def _(fx):
    return d.boxed_tokens(fx)


@query("p12_mask_lookup", "x0:i y0:i", "SELECT x0, y0 FROM {on_mask}")
def _(fx):
    return lattice.on_tissue(lattice.patch_candidates(fx.image_meta, d.box(fx)), d.mask(fx), 0.1, *d.frame(fx))


@query("p13_grids_unfiltered", "grid_index:i x0:i y0:i duplicate_count:i", """
    SELECT row_number() OVER (ORDER BY y0, x0) - 1 AS grid_index, * FROM {distinct_grids}""")
def _(fx):
    return lattice.unique_grids(d.boxed_tokens(fx), None)


@query("p14_supervised_grids", "grid_index:i spot_index:i", "SELECT grid_index, spot_index FROM {assigned} WHERE spot_index >= 0")
def _(fx):
    return spots.supervised(d.assigned(fx).withColumn("is_tissue", F.lit(True)))


_W = """(SELECT w, h, w // 4 AS wx0, h // 4 AS wy0, w - w // 4 AS wx1, h - h // 4 AS wy1 FROM (SELECT max(x1) AS w, max(y1) AS h FROM {grid_pred}))"""
_IN = f"(SELECT * FROM {{grid_pred}}, {_W} WHERE x1 > wx0 AND x0 < wx1 AND y1 > wy0 AND y0 < wy1)"
_CLIP = f"""(SELECT *, greatest(x0, wx0) - wx0 AS lx0, greatest(y0, wy0) - wy0 AS ly0, least(x1, wx1) - wx0 AS lx1, least(y1, wy1) - wy0 AS ly1 FROM {_IN})"""


def _boxes(fx):
    return d.predicted_grids(fx).withColumnsRenamed({c: f"bbox_{c}" for c in ("x0", "y0", "x1", "y1")})


@query("p16_rectangle_in_window", "grid_index:i", f"SELECT grid_index FROM {_IN}")
def _(fx):
    return win.rectangles_in_window(_boxes(fx), d.window(fx))


_RING_IN = f"""(SELECT cell_id FROM {{bounds}}, {_W} WHERE max_x >= wx0 AND min_x <= wx1 AND max_y >= wy0 AND min_y <= wy1 AND n_vertices >= 3)"""


@query("p17_polygon_in_window", "cell_id:i vertex_ord:i", f"SELECT cell_id, vertex_ord FROM {{polygons}} WHERE cell_id IN {_RING_IN}")
def _(fx):
    return win.polygons_in_window(fx.polygons, d.window(fx))


@query("p18_window_label", "cell_id:i vertex_ord:i", f"""
    SELECT cell_id, vertex_ord FROM {{true_type}} WHERE cell_id IN {_RING_IN} AND window_label = (SELECT max(p_type) FROM {{part}})""")
def _(fx):
    label = fx.part.agg(F.max("p_type").alias("t")).first()["t"]
    return win.polygons_in_window(fx.true_type, d.window(fx), label)


@query("p19_three_vertices", "cell_id:i n_vertices:i", "SELECT cell_id, n_vertices FROM {bounds} WHERE n_vertices >= 3")
def _(fx):
    from spotweave.operators.overlap import ring_stats

    return ring_stats(fx.polygons).where("n_vertices >= 3")


@query("p20_polygon_validity", "cell_id:i area:d is_repaired:b is_invalid:b", "SELECT * FROM {polygon_all}")
def _(fx):
    return aggregate.ring_validity(fx.polygons, 18)[0]


@query("p21_window_origin", "cell_id:i vertex_ord:i local_x:d local_y:d", f"""
    SELECT cell_id, vertex_ord, vertex_x - wx0 AS local_x, vertex_y - wy0 AS local_y FROM {{polygons}}, {_W} WHERE cell_id IN {_RING_IN}""")
def _(fx):
    return win.polygons_in_window(fx.polygons, d.window(fx))


@query("p22_clipped_rectangles", "grid_index:i lx0:i ly0:i lx1:i ly1:i", f"SELECT grid_index, lx0, ly0, lx1, ly1 FROM {_CLIP} WHERE lx1 > lx0 AND ly1 > ly0")
def _(fx):
    return win.clipped_to_window(win.rectangles_in_window(_boxes(fx), d.window(fx)), d.window(fx))


@query("p23_label_key", "raw:s key:s", """
    SELECT raw, lower(trim(regexp_replace(replace(raw, '_', ' '), '\\s+', ' ', 'g'))) AS key FROM (SELECT ' ' || replace(p_type, ' ', '__') || '_ ' AS raw FROM {part})""")
def _(fx):
    raw = F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("__")), F.lit("_ "))
    return fx.part.select(raw.alias("raw")).withColumn("key", text.label_key(F.col("raw")))


_MERGE_SQL = """(SELECT p_brand AS source, CASE WHEN max(p_partkey) % 2 = 0 THEN 'DCIS' ELSE 'Mystery' END AS target FROM {part} GROUP BY 1 HAVING max(p_partkey) % 3 > 0)"""


@query("p24_merged_labels", "cell_id:i vertex_ord:i celltype:s", f"""
    SELECT cell_id, vertex_ord, CASE WHEN target = 'DCIS' THEN 'DCIS' ELSE 'Others' END AS celltype
    FROM {{true_type}} LEFT JOIN {_MERGE_SQL} ON celltype = source""")
def _(fx):
    top = fx.part.groupBy(F.col("p_brand").alias("source")).agg(F.max("p_partkey").alias("k")).where("k % 3 > 0")
    merge = top.select("source", F.when(F.col("k") % 2 == 0, "DCIS").otherwise("Mystery").alias("target"), F.lit(0).alias("target_ord"))
    return win.merged_labels(fx.true_type, merge)


@query("p25_known_labels", "grid_index:i label:s", f"""
    SELECT grid_index, CASE WHEN t = 'Mystery' THEN 'Unassigned' ELSE t END AS label FROM (SELECT grid_index, {_TOP} AS t FROM {{grid_pred}})""")
def _(fx):
    return d.grid_type_table(fx).select(
        F.regexp_extract("grid_id", "[0-9]+", 0).cast("long").alias("grid_index"), text.known_label(F.col("predicted_type"), "Unassigned").alias("label"))


@query("p26_label_colours", "label:s r:i g:i b:i n:i", f"""
    SELECT t AS label, CASE t WHEN 'DCIS' THEN 100 WHEN 'Stromal' THEN 240 WHEN 'T Cells' THEN 220 WHEN 'Myoepi' THEN 0 END AS r,
           CASE t WHEN 'DCIS' THEN 180 WHEN 'Stromal' THEN 105 WHEN 'T Cells' THEN 140 WHEN 'Myoepi' THEN 165 END AS g,
           CASE t WHEN 'DCIS' THEN 0 WHEN 'Stromal' THEN 235 WHEN 'T Cells' THEN 0 WHEN 'Myoepi' THEN 255 END AS b, count(*) AS n
    FROM (SELECT {_TOP} AS t FROM {{grid_pred}}) WHERE t <> 'Mystery' GROUP BY 1, 2, 3, 4""")
def _(fx):
    color = text.label_color(F.col("label"))
    table = d.grid_type_table(fx).where("predicted_type <> 'Mystery'").select(F.col("predicted_type").alias("label"))
    return table.groupBy("label", *[text.hex_channel(color, i).alias(c) for i, c in enumerate("rgb")]).agg(F.count(F.lit(1)).alias("n"))


@query("p27_marker_groups", "gene:s marker:s", """
    SELECT gene, CASE upper(gene) WHEN 'CD68' THEN 'Myeloid' WHEN 'KRT5' THEN 'Myoepi' WHEN 'KRT14' THEN 'Myoepi' WHEN 'KRT17' THEN 'Myoepi' ELSE 'Gene' END AS marker
    FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'krt' || p_size ELSE 'Cd' || (p_size + 40) END AS gene FROM {part})""")
def _(fx):
    gene = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("krt"), "p_size")).otherwise(F.concat(F.lit("Cd"), F.col("p_size") + 40))
    return fx.part.select(gene.alias("gene")).withColumn("marker", text.marker_group(F.col("gene")))


@query("p30_dataset_name", "sample:s path:s dataset:s", """
    SELECT sample, path, CASE WHEN contains(lower(sample), 'breast') THEN 'brca' WHEN contains(lower(sample), 'colon') OR contains(lower(sample), 'crc') THEN 'crc'
             WHEN list_contains(string_split(lower(path), '/'), 'brca') THEN 'brca'
             WHEN list_contains(string_split(lower(path), '/'), 'crc') OR list_contains(string_split(lower(path), '/'), 'colon') THEN 'crc' ELSE 'unknown' END AS dataset
    FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN barcode_ ELSE p_name END AS sample, '/data/' || CASE p_size % 4 WHEN 0 THEN 'BRCA' WHEN 1 THEN 'colon' WHEN 2 THEN 'crc_x' ELSE 'x' END || '/he.tif' AS path
          FROM (SELECT *, 'S' || p_size || '_BREAST' AS barcode_ FROM {part}))""")
def _(fx):
    sample = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("S"), "p_size", F.lit("_BREAST"))).otherwise(F.col("p_name"))
    part = F.element_at(F.array(F.lit("BRCA"), F.lit("colon"), F.lit("crc_x"), F.lit("x")), F.col("p_size") % 4 + 1)
    table = fx.part.select(sample.alias("sample"), F.concat(F.lit("/data/"), part, F.lit("/he.tif")).alias("path"))
    return table.withColumn("dataset", text.dataset_of(F.col("sample"), F.col("path")))


@query("p31_coordinate_columns", "barcode:s x:d y:d", "SELECT barcode, pxl_col_in_fullres AS x, pxl_row_in_fullres AS y FROM {positions}")
def _(fx):
    renamed = fx.positions.withColumnsRenamed({"pxl_col_in_fullres": "image_x", "pxl_row_in_fullres": "image_y"})
    return spots.coordinate_columns(renamed)


@query("p33_umi_minimum", "barcode:s umi:d", """
    SELECT barcode, sum(count) AS umi FROM {counts} GROUP BY 1 HAVING sum(count) >= (SELECT sum(count) / count(DISTINCT barcode) FROM {counts})""")
def _(fx):
    mean = fx.counts.agg((F.sum("count") / F.countDistinct("barcode")).alias("m")).first()["m"]
    return counts.enough_counts(fx.counts, mean)


@query("p34_null_labels", "label:s n:i", "SELECT label, count(*) AS n FROM {ref_cells} WHERE label IS NOT NULL AND patient IS NOT NULL GROUP BY 1")
def _(fx):
    return spots.label_counts_with_patient(fx.ref_cells)


@query("p35_named_columns", "grid_index:i prob_DCIS:d prob_Stromal:d prob_Myoepi:d", "SELECT grid_index, p0 AS prob_DCIS, p1 AS prob_Stromal, p3 AS prob_Myoepi FROM {grid_pred}")
def _(fx):
    return aggregate.named_columns(d.predicted_grids(fx), "prob", TYPE_NAMES)


@query("p36_tissue_flags", "grid_id:s is_tissue:b grid_tissue_fraction:d", "SELECT 'grid_' || grid_index AS grid_id, true AS is_tissue, 1 AS grid_tissue_fraction FROM {grids}")
def _(fx):
    return lattice.with_tissue_flags(d.grids(fx))


@query("p37_self_delta", "patch_index:i pos:i delta:d", "SELECT patch_index, pos, mean - tile AS delta FROM {near_full}")
def _(fx):
    from spotweave.functions.arrays import subtract

    return d.tile_stats(fx).select("patch_index", F.posexplode(subtract(F.col("neighbour_mean"), F.col("tile"))).alias("pos", "delta"))


# ------------------------------------------------------------------ joins on keys

@query("j01_missing_positions", "barcode:s", "SELECT DISTINCT barcode FROM {counts} WHERE barcode NOT IN (SELECT barcode FROM {positions} WHERE in_tissue = 1)")
def _(fx):
    return spots.missing_positions(fx.counts, spots.in_tissue(fx.positions))


@query("j01_aligned_positions", "barcode:s x:d y:d", """
    SELECT barcode, pxl_col_in_fullres AS x, pxl_row_in_fullres AS y FROM {positions} WHERE barcode IN (SELECT barcode FROM {counts})""")
def _(fx):
    return spots.aligned_positions(fx.counts, fx.positions)


_TYPES = "(SELECT DISTINCT cell_type FROM {deconv})"


@query("j02_reindexed_proportions", "spot_id:s cell_type:s p:d", f"""
    SELECT raw AS spot_id, t.cell_type, coalesce(p, 0) AS p FROM ({_IDS}) CROSS JOIN {_TYPES} AS t LEFT JOIN {{deconv}} AS d ON d.spot_id = raw AND d.cell_type = t.cell_type""")
def _(fx):
    return proportions.reindexed(fx.deconv, _raw_ids(fx).withColumnRenamed("raw", "spot_id"), fx.deconv.select("cell_type"))


@query("j03_spot_bags", "target_ord:i spot_id:s spot_index:i grid_index:i", "SELECT * FROM {bags}")
def _(fx):
    return d.bags(fx)


@query("j11_expression_with_type", f"grid_id:s predicted_type:s {_E8}", f"SELECT 'grid_' || grid_index AS grid_id, {_TOP} AS predicted_type, {_E8_SQL} FROM {{grid_pred}}")
def _(fx):
    expression = d.predicted_grids(fx).select(F.concat(F.lit("grid_"), "grid_index").alias("grid_id"), *[F.col("expr")[i].alias(f"e{i}") for i in range(N_GENES)])
    return expression.join(d.grid_type_table(fx).select("grid_id", "predicted_type"), "grid_id")


@query("j12_kept_vertices", "cell_id:i vertex_ord:i", "SELECT cell_id, vertex_ord FROM {polygons} WHERE cell_id IN (SELECT cell_id FROM {bounds} WHERE n_vertices >= 3)")
def _(fx):
    from spotweave.operators.overlap import ring_stats

    return fx.polygons.join(ring_stats(fx.polygons).where("n_vertices >= 3").select("cell_id"), "cell_id", "left_semi")


@query("j13_measured_values", "cell_id:i value:d", f"""
    SELECT cell_id, arg_max(log1p_count, ord) AS value FROM {_RING_IN} JOIN (
        SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS ord, ln(1 + p_retailprice % 7) AS log1p_count FROM {{part}} WHERE p_size % 5 = 1) ON CAST(cell_id AS VARCHAR) = id GROUP BY 1""")
def _(fx):
    ids = win.polygons_in_window(fx.polygons, d.window(fx)).select("cell_id").distinct()
    return win.measured_values(ids, fx.true_expr, "G1")


@query("j14_category_decode", "ord:i category:s", """
    SELECT o_orderkey AS ord, c_mktsegment AS category FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey AND o_orderkey % 11 > 0""")
def _(fx):
    codes = fx.orders.select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_custkey")).otherwise(-1).alias("code"))
    return spots.decode_categories(codes, fx.customer.select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("category")))


@query("j15_matched_metadata", "cell_id:s label:s", "SELECT DISTINCT cell_id, label FROM {ref_counts} LEFT JOIN {ref_cells} USING (cell_id)")
def _(fx):
    return spots.match_metadata(fx.ref_counts.select("cell_id").distinct(), fx.ref_cells.select("cell_id", "ord", "label"))


@query("j16_shared_genes", "gene:s", "SELECT DISTINCT gene FROM {counts} WHERE gene IN (SELECT gene FROM {ref_counts})")
def _(fx):
    return counts.shared_genes(fx.counts, fx.ref_counts)


# ------------------------------------------------------------------ aggregates on keys

@query("g01_collapsed_genes", "barcode:s gene:s count:d", "SELECT barcode, gene, sum(count) AS count FROM {counts} GROUP BY 1, 2")
def _(fx):
    return counts.collapse_duplicate_genes(fx.counts)


@query("g01_collapse_report", "n_gene_rows:i n_genes:i n_collapsed:i", "SELECT count(*) AS n_gene_rows, count(DISTINCT gene) AS n_genes, count(*) - count(DISTINCT gene) AS n_collapsed FROM {features}")
def _(fx):
    return counts.duplicate_gene_report(fx.features)


_AVG = """(SELECT regexp_replace(spot_id, '_BREAST$', '') AS spot_id, cell_type, avg(p) AS p FROM {deconv_raw} GROUP BY 1, 2)"""


def _raw_deconv(fx):
    return fx.deconv_raw.withColumn("spot_id", text.spot_id_for_model(F.col("spot_id"), None))


@query("g02_averaged_duplicates", "spot_id:s cell_type:s p:d", f"SELECT * FROM {_AVG}")
def _(fx):
    return proportions.average_duplicates(_raw_deconv(fx))


_MERGED = "(SELECT spot_id, target AS cell_type, sum(coalesce(p, 0)) AS p FROM {deconv_raw} JOIN {type_merge} ON cell_type = source GROUP BY 1, 2)"


@query("g03_merged_types", "spot_id:s cell_type:s p:d", f"SELECT * FROM {_MERGED}")
def _(fx):
    return proportions.merge_types(fx.deconv_raw, fx.type_merge)


_NORM = "SELECT spot_id, cell_type, greatest(p, 0) / greatest(sum(greatest(p, 0)) OVER (PARTITION BY spot_id), {floor}) AS p FROM {source}"


@query("g04_normalised_merge", "spot_id:s cell_type:s p:d", _NORM.replace("{floor}", "1e-12").replace("{source}", _MERGED))
def _(fx):
    return proportions.merged_proportions(fx.deconv_raw, fx.type_merge)


@query("g05_training_targets", "spot_id:s cell_type:s p:d", _NORM.replace("{floor}", "1e-8").replace("{source}", f"""
    (SELECT s.spot_id, t.cell_type, coalesce(p, 0) AS p FROM (SELECT regexp_replace(barcode, '_BREAST$', '') AS spot_id FROM {{positions}}) AS s CROSS JOIN {_TYPES} AS t
     LEFT JOIN {_AVG} AS a ON a.spot_id = s.spot_id AND a.cell_type = t.cell_type)"""))
def _(fx):
    targets = fx.positions.select(text.spot_id_for_model(F.col("barcode"), None).alias("spot_id"))
    return proportions.training_targets(_raw_deconv(fx), targets, fx.deconv_raw.select("cell_type"))


@query("g06_row_normalised", "spot_id:s cell_type:s p:d", "SELECT spot_id, cell_type, p / greatest(sum(p) OVER (PARTITION BY spot_id), 1e-12) AS p FROM {deconv}")
def _(fx):
    return proportions.normalised(fx.deconv, 1e-12, clip=False)


@query("g07_totals", "cell_id:s umi:d", "SELECT cell_id, sum(count) AS umi FROM {ref_counts} GROUP BY 1")
def _(fx):
    return counts.totals(fx.ref_counts, "cell_id")


@query("g08_reference_profiles", "cell_type:s gene:s profile:d", "SELECT * FROM {profiles}")
def _(fx):
    return _profiles(fx)


def _profiles(fx):
    cells = spots.keep_labelled(fx.ref_cells).select("cell_id", F.col("label").alias("cell_type"))
    return counts.reference_profiles(fx.ref_counts, cells)


@query("g38_output_validation",
       "n_unexpected_types:i n_missing_types:i n_unexpected_spots:i n_missing_spots:i n_not_finite:i row_sum_min:d row_sum_median:d row_sum_max:d", """
    SELECT 0 AS n_unexpected_types, 0 AS n_missing_types, (SELECT count(DISTINCT spot_id) FROM {deconv} WHERE spot_id NOT IN (SELECT barcode FROM {positions} WHERE in_tissue = 1)) AS n_unexpected_spots,
           (SELECT count(*) FROM {positions} WHERE in_tissue = 1 AND barcode NOT IN (SELECT spot_id FROM {deconv})) AS n_missing_spots, 0 AS n_not_finite,
           min(t) AS row_sum_min, median(t) AS row_sum_median, max(t) AS row_sum_max FROM (SELECT sum(p) AS t FROM {deconv} GROUP BY spot_id)""")
def _(fx):
    expected = spots.in_tissue(fx.positions).select(F.col("barcode").alias("spot_id"))
    return proportions.validate(fx.deconv, fx.customer.select(F.col("c_mktsegment").alias("cell_type")), expected)


@query("g39_category_order", "position:i cell_type:s", """
    SELECT row_number() OVER (ORDER BY o, label) - 1 AS position, label AS cell_type FROM (SELECT label, min(ord) AS o FROM {ref_cells} WHERE cell_id IN (SELECT cell_id FROM {labelled}) GROUP BY 1)""")
def _(fx):
    return counts.category_order(spots.keep_labelled(fx.ref_cells).select("ord", F.col("label").alias("cell_type")))


@query("g40_dense_expression", "barcode:s pos:i value:d", """
    SELECT s.barcode, g.position AS pos, coalesce(sum(c.count), 0) AS value
    FROM (SELECT DISTINCT barcode FROM {counts}) AS s
    CROSS JOIN (SELECT row_number() OVER (ORDER BY ord, gene) - 1 AS position, gene FROM {gene_list} WHERE gene IN (SELECT gene FROM {counts})) AS g
    LEFT JOIN {counts} AS c ON c.barcode = s.barcode AND c.gene = g.gene GROUP BY 1, 2""")
def _(fx):
    genes = counts.requested_genes(fx.gene_list, fx.counts)
    return counts.dense_by_spot(fx.counts, genes).select("barcode", F.posexplode("expression").alias("pos", "value"))


# ------------------------------------------------------------------ ranks, order, sets

@query("w01_average_rank", "barcode:s gene:s count:d rank:d", """
    SELECT barcode, gene, count, rank() OVER (PARTITION BY gene ORDER BY count) + (count(*) OVER (PARTITION BY gene, count) - 1) / 2.0 AS rank FROM {counts}""")
def _(fx):
    return ordinals.average_rank(fx.counts, ["gene"], "count")


@query("w02_grid_ordinal", "grid_index:i x0:i y0:i", "SELECT row_number() OVER (ORDER BY y0, x0) - 1 AS grid_index, x0, y0 FROM {grid_pred}")
def _(fx):
    return ordinals.ordinal(d.predicted_grids(fx).select("x0", "y0", "x1", "y1"), ["y0", "x0", "y1", "x1"], name="grid_index")


@query("w03_patch_ordinal", "patch_index:i x0:i y0:i", "SELECT row_number() OVER (ORDER BY y0, x0) - 1 AS patch_index, x0, y0 FROM {candidates}")
def _(fx):
    return lattice.number_patches(lattice.patch_candidates(fx.image_meta, d.box(fx)))


@query("w04_renumbered", "grid_index:i x0:i y0:i", "SELECT grid_index, x0, y0 FROM {grids}")
def _(fx):
    return lattice.unique_grids(d.boxed_tokens(fx), d.mask(fx), 0.1, *d.frame(fx))


@query("w06_unique_names", "gene_row:i unique_name:s", """
    SELECT gene_row, gene || CASE WHEN k = 0 THEN '' ELSE '-' || k END AS unique_name
    FROM (SELECT gene_row, gene, row_number() OVER (PARTITION BY gene ORDER BY gene_row) - 1 AS k FROM {features})""")
def _(fx):
    return counts.unique_gene_names(fx.features.select("gene_row", "gene"))


@query("w07_last_wins", "user_id:i event_type:s value:d", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM {events} GROUP BY 1, 2")
def _(fx):
    return ordinals.last_wins(fx.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("w09_first_spots", "ord:i barcode:s", "SELECT ord, barcode FROM {positions} WHERE in_tissue = 1 ORDER BY ord LIMIT 25")
def _(fx):
    return ordinals.first_n(spots.in_tissue(fx.positions), ["ord"], 25)


@query("w11_top_type", "grid_index:i top:i", f"""
    SELECT grid_index, CASE {_TOP} WHEN 'DCIS' THEN 0 WHEN 'Stromal' THEN 1 WHEN 'T Cells' THEN 2 WHEN 'Myoepi' THEN 3 ELSE 4 END AS top FROM {{grid_pred}}""")
def _(fx):
    from spotweave.functions.arrays import first_max_index

    return d.predicted_grids(fx).select("grid_index", first_max_index(F.col("prob")).alias("top"))


@query("w12_seeded_split", "is_validation:b n:i", """
    SELECT k <= greatest(1, round_even(n * 0.1, 0)) AS is_validation, count(*) AS n
    FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS k, count(*) OVER () AS n FROM {supplier}) GROUP BY 1""")
def _(fx):
    # Membership follows a hash; the sizes of the two sides are what is fixed.
    split = ordinals.seeded_split(fx.supplier.select("s_suppkey"), "s_suppkey", 0.1, 0, fx.supplier.count())
    return split.groupBy("is_validation").agg(F.count(F.lit(1)).alias("n"))


@query("o01_distinct_rectangles", "x0:i y0:i x1:i y1:i", "SELECT DISTINCT x0, y0, x0 + 18 AS x1, y0 + 18 AS y1 FROM {tokens}")
def _(fx):
    return lattice.token_grids(d.patches(fx)).select("x0", "y0", "x1", "y1").dropDuplicates()


@query("o02_concatenated_views", "patch_index:i token_linear:i x0:i y0:i weight:d", "SELECT * FROM {tokens}")
def _(fx):
    return lattice.token_grids(d.patches(fx))


@query("o03_gene_sets", "gene:s present:b", """
    SELECT gene, true AS present FROM (SELECT gene FROM {gene_list} INTERSECT SELECT gene FROM {counts})
    UNION ALL SELECT gene, false FROM (SELECT gene FROM {gene_list} EXCEPT SELECT gene FROM {counts})""")
def _(fx):
    wanted, have = fx.gene_list.select("gene"), fx.counts.select("gene")
    return wanted.intersect(have).withColumn("present", F.lit(True)).unionByName(
        wanted.distinct().join(have, "gene", "left_anti").withColumn("present", F.lit(False)))


@query("m01_mixture_proportions", "barcode:s cell_type:s p:d", "SELECT * FROM {mix5}")
def _(fx):
    mixed = proportions.mixture_proportions(fx.counts, _profiles(fx), SEGMENTS, rounds=5)
    return mixed.select("barcode", F.posexplode("p").alias("i", "p")).withColumn(
        "cell_type", F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("i") + 1))


# ------------------------------------------------------------------ deconv, guards, and the scalar forms of the model

@query("api_deconv", "part:s key:s item:s value:d", """
    SELECT 'type' AS part, cell_type AS key, '' AS item, row_number() OVER (ORDER BY cell_type) - 1 AS value FROM (SELECT DISTINCT cell_type FROM {labelled})
    UNION ALL SELECT 'share', barcode, cell_type, p FROM {mix5} WHERE p IS NOT NULL""")
def _(fx):
    # The types are given, in the order of their names.
    out = pipeline.deconv(
        dataset="brca", counts=fx.counts, positions=fx.positions, ref_cells=fx.ref_cells, ref_counts=fx.ref_counts, sample_id="BREAST",
        consensus=False, umi_min=0, rounds=5, brca_types=SEGMENTS)
    shares = out["proportions"].select(F.lit("share").alias("part"), F.col("spot_id").alias("key"), F.col("cell_type").alias("item"), F.col("p").alias("value"))
    return out["cell_type_order"].select(F.lit("type").alias("part"), F.col("cell_type").alias("key"), F.lit("").alias("item"), F.col("position").cast("double").alias("value")).unionByName(shares)


@query("p15_window_guard", "customer:i accepted:b x0:i x1:i", """
    SELECT c_custkey AS customer, round_even(a, 0) < round_even(b, 0) AS accepted, CASE WHEN round_even(a, 0) < round_even(b, 0) THEN round_even(a, 0) END AS x0,
           CASE WHEN round_even(a, 0) < round_even(b, 0) THEN round_even(b, 0) END AS x1
    FROM (SELECT c_custkey, CAST(c_custkey % 7 AS DOUBLE) / 2 AS a, CAST(c_custkey % 11 AS DOUBLE) / 2 AS b FROM {customer})""")
def _(fx):
    # Every pair of ends that the table has is put to the guard.
    ends = fx.customer.select("c_custkey", ((F.col("c_custkey") % 7) / F.lit(2.0)).alias("a"), ((F.col("c_custkey") % 11) / F.lit(2.0)).alias("b"))

    def checked(a, b):
        try:
            return (a, b, True, *win.checked_window((a, 0, b, 1))[::2])
        except ValueError:
            return (a, b, False, None, None)

    told = [checked(r["a"], r["b"]) for r in ends.select("a", "b").distinct().collect()]
    return ends.join(fx.spark.createDataFrame(told, "a double, b double, accepted boolean, x0 int, x1 int"), ["a", "b"]).withColumnRenamed("c_custkey", "customer")


@query("p32_required_columns", "name:s accepted:b", """
    SELECT name, name IN ('s_suppkey', 's_name', 's_nationkey', 's_acctbal') AS accepted FROM (SELECT DISTINCT unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal', 'n_name']) AS name FROM {supplier})""")
def _(fx):
    names = fx.supplier.select(F.explode(F.array(*[F.lit(c) for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal", "n_name")])).alias("name")).distinct()

    def accepted(name):
        try:
            win.require_columns(fx.supplier, name)
            return True
        except ValueError:
            return False

    told = [(r["name"], accepted(r["name"])) for r in names.collect()]
    return fx.spark.createDataFrame(told, "name string, accepted boolean")


@query("a19_feature_column", "grid_index:i pos:i value:d", """
    SELECT vec_id AS grid_index, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS value FROM {embeddings}, unnest(range(1, 65)) AS u(i)""")
def _(fx):
    # The marked column is told from the other arrays after writing and reading.
    grids = fx.embeddings.select(F.col("vec_id").alias("grid_index"), F.col("embedding").alias("feature"), F.array("vec_id", "vec_id").alias("other"), F.lit(0).alias("x0"), F.col("vec_id").alias("y0"))
    path = scratch_path(fx.spark, "grid_embedding")
    sinks.write_grid_embedding(grids, path, "dense_feature")
    table = sources.read_grid_embedding(fx.spark, path)
    return table.select("grid_index", F.posexplode(sources.feature_column(table)).alias("pos", "value"))


@query("s08_scalar_forms", "vec_id:i pos:i softmax:d softplus:d leaky:d sigmoid:d relu:d norm:d", """
    SELECT vec_id, i - 1 AS pos, exp((x[i] - list_max(x)) / 2) / list_sum(list_transform(x, lambda v: exp((v - list_max(x)) / 2))) AS softmax,
           greatest(x[i], 0) + ln(1 + exp(-abs(20 * x[i]))) / 20 AS softplus, CASE WHEN x[i] >= 0 THEN x[i] ELSE 0.01 * x[i] END AS leaky, 1 / (1 + exp(-x[i])) AS sigmoid,
           greatest(x[i], 0) AS relu, (x[i] - list_avg(x)) / sqrt(list_var_pop(x) + 1e-5) AS norm
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM {embeddings}), unnest(range(1, 65)) AS u(i)""")
def _(fx):
    x = F.col("embedding")
    forms = F.arrays_zip(
        arrays.softmax(x, 2.0).alias("softmax"), arrays.softplus(x).alias("softplus"), arrays.leaky_relu(x).alias("leaky"), arrays.sigmoid(x).alias("sigmoid"),
        arrays.relu(x).alias("relu"), arrays.layer_norm(x).alias("norm"))
    return fx.embeddings.select("vec_id", F.posexplode(forms).alias("pos", "v")).select("vec_id", "pos", "v.*")
