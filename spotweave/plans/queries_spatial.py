"""Queries for rasters, lattices, polygons, metrics, windows and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spotweave.functions.arrays import first_max_index
from spotweave.functions.vectors import vector_mean, vector_sum
from spotweave.operators import aggregate, lattice, metrics, nearest, ordinals, overlap, raster, spots, training
from spotweave.operators import windows as win
from spotweave.operators.heads import initial_params
from spotweave.plans import derived as d
from spotweave.plans import pipeline
from spotweave.plans.fixtures import N_GENES, SPOT_DIAMETER, THUMB_SCALE, TYPE_NAMES
from spotweave.plans.model_sql import forward_parts, loss_sql
from spotweave.plans.queries_tables import _CLIP, _IN, _PCC, _RING_IN, _TOP, _boxes
from spotweave.plans.reference_sql import PARTS
from spotweave.plans.registry import query
from spotweave.session import durable, scratch_path

_PIXELS = "px:i py:i"


# ------------------------------------------------------------------ rasters

@query("r01_tissue_pixels", _PIXELS, "SELECT px, py FROM {tissue}")
def _(fx):
    return raster.tissue_pixels(fx.thumbnail)


@query("a20_thumbnail", _PIXELS, "SELECT px, py FROM {tissue}")
def _(fx):
    """The thumbnail as decoded strips of 64 rows; pixels it lacks are white."""
    colour = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in ("b", "g", "r")])
    width = d.frame(fx)[0]
    lines = fx.thumbnail.groupBy("py").agg(F.map_from_entries(F.collect_list(F.struct("px", colour))).alias("at"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.col("at")[x], F.lit("FFFFFF")))
    strips = lines.select("py", F.array_join(filled, "").alias("line")).groupBy(F.floor(F.col("py") / 64).alias("strip")).agg(
        F.sort_array(F.collect_list(F.struct("py", "line"))).alias("l"))
    images = strips.select((F.col("strip") * 64).alias("py0"), F.lit(width).alias("width"), F.size("l").alias("height"), F.lit(3).alias("nChannels"),
                           F.unhex(F.array_join(F.col("l.line"), "")).alias("data"))
    return raster.unpack(raster.image_words(images))


@query("r02_erosion", _PIXELS, "SELECT px, py FROM {eroded1}")
def _(fx):
    return raster.unpack(raster.erode(d.tissue_words(fx)))


@query("r02_dilation", _PIXELS, "SELECT DISTINCT px + dx AS px, py + dy AS py FROM {tissue}, {frame}, range(-1, 2) AS a(dx), range(-1, 2) AS b(dy) WHERE px + dx BETWEEN 0 AND w - 1 AND py + dy BETWEEN 0 AND h - 1")
def _(fx):
    return raster.unpack(raster.dilate(d.tissue_words(fx), *d.frame(fx)))


@query("r03_open_and_close", _PIXELS, "SELECT px, py FROM {closed}")
def _(fx):
    return raster.unpack(raster.open_and_close(d.tissue_words(fx), *d.frame(fx)))


@query("r04_filled_holes", _PIXELS, "SELECT px, py FROM {mask}")
def _(fx):
    return raster.unpack(raster.fill_holes(d.closed_words(fx), *d.frame(fx)))


@query("r05_mask_edge", _PIXELS, """
    SELECT e.px, e.py FROM {mask_edge} AS e, {frame}, {box}, {image_meta}
    WHERE px >= greatest(0, floor(x_min * w / width)) AND px < least(w, ceil(x_max * w / width))
      AND py >= greatest(0, floor(y_min * h / height)) AND py < least(h, ceil(y_max * h / height))""")
def _(fx):
    edge = raster.unpack(raster.mask_edge(d.mask_words(fx)))
    image = d.scalar(fx, "image", lambda: fx.image_meta.first().asDict())
    return raster.clip_to_box(edge, d.box(fx), image, *d.frame(fx))


_BOXES = "x0:i y0:i x1:i y1:i"


@query("r06_patch_lattice", _BOXES, "SELECT x0, y0, x1, y1 FROM {lattice}")
def _(fx):
    return lattice.patch_lattice(fx.image_meta)


@query("r07_selected_patches", "patch_index:i " + _BOXES, "SELECT * FROM {patches}")
def _(fx):
    mask, w, h = raster.tissue_mask(fx.thumbnail)
    return lattice.select_patches(fx.image_meta, d.box(fx), mask, 0.1, w, h)


@query("r08_corners", "patch_index:i corner:i x:d y:d", """
    SELECT patch_index, k AS corner, CASE WHEN k IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN k < 2 THEN y0 ELSE y1 END AS y FROM {patches}, range(4) AS c(k)""")
def _(fx):
    return lattice.with_corners(d.patches(fx)).select("patch_index", F.posexplode("corners").alias("corner", "c")).select("*", "c.*")


@query("r09_token_grids", "patch_index:i token_linear:i " + _BOXES, "SELECT *, x0 + 18 AS x1, y0 + 18 AS y1 FROM {tokens}")
def _(fx):
    return lattice.token_grids(d.patches(fx))


@query("r10_blend_weights", "token_linear:i weight:d n:i", "SELECT token_linear, weight, count(*) AS n FROM {tokens} GROUP BY 1, 2")
def _(fx):
    return lattice.token_grids(d.patches(fx)).groupBy("token_linear", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("r11_unique_grids", "grid_index:i x0:i y0:i duplicate_count:i", "SELECT * FROM {grids}")
def _(fx):
    return lattice.unique_grids(d.boxed_tokens(fx), d.mask(fx), 0.1, *d.frame(fx))


@query("r12_grid_centres", "grid_index:i center_x:d center_y:d", "SELECT grid_index, x0 + 9 AS center_x, y0 + 9 AS center_y FROM {grid_pred}")
def _(fx):
    return lattice.with_centre(d.predicted_grids(fx), 18)


_PAINT = f"""(SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY ord DESC) AS k FROM (
    SELECT c.*, gx.v AS px, gy.v AS py FROM {_CLIP} AS c, unnest(range(lx0, lx1)) AS gx(v), unnest(range(ly0, ly1)) AS gy(v)))"""


@query("r13_type_raster", "px:i py:i label:s r:i b:i", f"""
    SELECT px, py, label, CASE label WHEN 'DCIS' THEN 100 WHEN 'Stromal' THEN 240 WHEN 'T Cells' THEN 220 WHEN 'Myoepi' THEN 0 ELSE 189 END AS r,
           CASE label WHEN 'DCIS' THEN 0 WHEN 'Stromal' THEN 235 WHEN 'T Cells' THEN 0 WHEN 'Myoepi' THEN 255 ELSE 189 END AS b
    FROM (SELECT px, py, CASE WHEN {_TOP} = 'Mystery' THEN 'Unassigned' ELSE {_TOP} END AS label FROM {_PAINT} WHERE k = 1)""")
def _(fx):
    table = _boxes(fx).withColumn("predicted_type", F.get(F.array(*[F.lit(n) for n in TYPE_NAMES]), first_max_index(F.col("prob"))))
    return win.type_raster(table, d.window(fx))


_Z = f"(SELECT avg(e2) AS m, stddev_pop(e2) AS s FROM {_IN})"


@query("r14_expression_raster", "px:i py:i z:d shown:d", f"""
    SELECT px, py, (e2 - m) / s AS z, greatest(-2, least(2, (e2 - m) / s)) AS shown FROM {_PAINT}, {_Z} WHERE k = 1""")
def _(fx):
    return win.expression_raster(_boxes(fx).withColumn("value", F.col("expr")[2]), d.window(fx))


@query("r15_preview_boxes", "patch_index:i " + _BOXES, """
    SELECT patch_index, round_even(x0 * s, 0) AS x0, round_even(y0 * s, 0) AS y0, round_even(x1 * s, 0) AS x1, round_even(y1 * s, 0) AS y1
    FROM {patches}, (SELECT least(CAST(700 AS DOUBLE) / greatest(width, height), 1) AS s FROM {image_meta})""")
def _(fx):
    image = d.scalar(fx, "image", lambda: fx.image_meta.first().asDict())
    return raster.preview_boxes(d.patches(fx), image["width"], image["height"], max_side=700)


# ------------------------------------------------------------------ spatial joins

@query("j04_nearest_spot", "grid_index:i nearest_spot_index:i nearest_spot_distance:d",
       "SELECT grid_index, nearest AS nearest_spot_index, distance AS nearest_spot_distance FROM {assigned}")
def _(fx):
    return nearest.nearest_spot(d.grids(fx), d.spot_table(fx))


@query("j05_radius_join", "grid_index:i spot_index:i", "SELECT grid_index, spot_index FROM {assigned}")
def _(fx):
    return nearest.spots_within(d.grids(fx), d.spot_table(fx), SPOT_DIAMETER / 2)


@query("j06_lattice_neighbours", "patch_index:i neighbour_index:i", "SELECT * FROM {neighbours}")
def _(fx):
    return lattice.neighbour_pairs(d.patches(fx))


@query("j07_token_to_grid", "patch_index:i token_linear:i grid_index:i", "SELECT patch_index, token_linear, grid_index FROM {views}")
def _(fx):
    return lattice.token_to_grid(d.boxed_tokens(fx), d.grids(fx))


_CHECKSUM = "sum(CAST(round({v} * 1e6) AS BIGINT) * (pos + 1))"


@query("j08_view_features", "patch_index:i token_linear:i tokens:i tiles:i means:i", f"""
    SELECT patch_index, token_linear, tokens, tiles, means FROM
      (SELECT patch_index, token_linear, {_CHECKSUM.format(v='v')} AS tokens FROM {{token_vec}} GROUP BY 1, 2) JOIN
      (SELECT patch_index, {_CHECKSUM.format(v='tile')} AS tiles, {_CHECKSUM.format(v='mean')} AS means FROM {{near_full}} GROUP BY 1) USING (patch_index)""")
def _(fx):
    # Whole vectors, each as one number that every element enters with its place.
    features = lattice.view_features(d.views(fx), d.token_vectors(fx), lattice.patch_vectors(d.tile_stats(fx)))
    marks = lambda start: F.aggregate(F.transform(F.slice("feature", start, 64), lambda v, i: F.round(v * 1e6).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return features.select("patch_index", "token_linear", marks(1).alias("tokens"), marks(65).alias("tiles"), marks(129).alias("means"))


@query("j09_candidate_grids", "cell_id:i grid_id:i x0:i y0:i", "SELECT cell_id, grid_index AS grid_id, x0, y0 FROM {cand} JOIN {grid_pred} USING (x0, y0)")
def _(fx):
    grids = d.predicted_grids(fx).withColumnRenamed("grid_index", "grid_id")
    return overlap.candidate_grids(overlap.ring_stats(fx.polygons), grids, 18)


@query("j10_overlap_area", "cell_id:i grid_id:i area:d weight:d", """
    SELECT o.cell_id, grid_index AS grid_id, area, area / 324.0 AS weight FROM {overlap} AS o JOIN {grid_pred} USING (x0, y0)""")
def _(fx):
    grids = d.predicted_grids(fx).withColumnRenamed("grid_index", "grid_id")
    return overlap.grid_weights(overlap.ring_edges(fx.polygons), grids, 18)


# ------------------------------------------------------------------ lattice aggregates

@query("g09_spot_extent", "x_min:d x_max:d y_min:d y_max:d", "SELECT * FROM {box}")
def _(fx):
    return lattice.spot_extent(spots.in_tissue(fx.positions))


@query("g10_neighbour_stats", "patch_index:i pos:i mean:d std:d n:i", "SELECT patch_index, pos, mean, std, n FROM {near_full}")
def _(fx):
    return d.tile_stats(fx).select(
        "patch_index", F.col("neighbour_count").alias("n"), F.posexplode(F.arrays_zip("neighbour_mean", "neighbour_std")).alias("pos", "v")
    ).select("patch_index", "n", "pos", F.col("v.neighbour_mean").alias("mean"), F.col("v.neighbour_std").alias("std"))


@query("g11_weighted_token_mean", "grid_index:i pos:i value:d", "SELECT grid_index, pos, sum(weight * v) / sum(weight) AS value FROM {token_vec} GROUP BY 1, 2")
def _(fx):
    return lattice.token_means(d.patches(fx), d.views(fx), d.token_vectors(fx)).select("grid_index", F.posexplode("token_mean").alias("pos", "value"))


@query("g11_weight_sums", "grid_index:i weight_sum:d n_views:i", "SELECT grid_index, sum(weight) AS weight_sum, count(*) AS n_views FROM {views} GROUP BY 1")
def _(fx):
    return lattice.token_means(d.patches(fx), d.views(fx), d.token_vectors(fx)).withColumnRenamed("n_views_averaged", "n_views")


@query("g12_duplicates", "grid_index:i n:i", "SELECT grid_index, count(*) AS n FROM {views} GROUP BY 1")
def _(fx):
    return d.grids(fx).select("grid_index", F.col("duplicate_count").alias("n"))


@query("g13_views_per_patch", "patch_index:i n_views:i", "SELECT patch_index, count(*) AS n_views FROM {views} GROUP BY 1")
def _(fx):
    return lattice.views_per_patch(d.views(fx))


@query("g14_grids_without_view", "n_grids:i n_without:i", "SELECT (SELECT count(*) FROM {grids}) AS n_grids, (SELECT count(*) FROM {grids} WHERE grid_index NOT IN (SELECT grid_index FROM {views})) AS n_without")
def _(fx):
    without = lattice.grids_without_view(d.grids(fx), d.boxed_tokens(fx)).select(F.lit(1).alias("w"))
    both = d.grids(fx).select(F.lit(0).alias("w")).unionByName(without)
    return both.agg(F.count_if(F.col("w") == 0).alias("n_grids"), F.count_if(F.col("w") == 1).alias("n_without"))


@query("m03_blended_features", "grid_index:i pos:i value:d", """
    SELECT grid_index, pos, sum(weight * v) / sum(weight) AS value FROM {token_vec} GROUP BY 1, 2
    UNION ALL SELECT grid_index, 64 + pos, sum(weight * tile) / sum(weight) FROM {views} JOIN {near_full} USING (patch_index) GROUP BY 1, 2
    UNION ALL SELECT grid_index, 128 + pos, sum(weight * (mean - tile)) / sum(weight) FROM {views} JOIN {near_full} USING (patch_index) GROUP BY 1, 2
    UNION ALL SELECT grid_index, 192 + pos, sum(weight * std) / sum(weight) FROM {views} JOIN {near_full} USING (patch_index) GROUP BY 1, 2""")
def _(fx):
    features = lattice.blend(d.patches(fx), d.views(fx), d.token_vectors(fx), lattice.patch_vectors(d.tile_stats(fx), "delta_std"))
    return features.select("grid_index", F.posexplode("feature").alias("pos", "value"))


@query("g33_blend_report",
       "n_total_token_views_used:i n_views_averaged_min:i n_views_averaged_median:d weight_sum_median:d weight_sum_max:d neighbor_count_median:d isolated_patches:i", """
    SELECT (SELECT count(*) FROM {views}) AS n_total_token_views_used, min(n) AS n_views_averaged_min, median(n) AS n_views_averaged_median,
           median(s) AS weight_sum_median, max(s) AS weight_sum_max, (SELECT median(n) FROM {near_full} WHERE pos = 0) AS neighbor_count_median,
           (SELECT count(*) FROM {near_full} WHERE pos = 0 AND n = 0) AS isolated_patches
    FROM (SELECT count(*) AS n, sum(weight) AS s FROM {views} GROUP BY grid_index)""")
def _(fx):
    # Sums differ in the last bits between orders of addition; the medians are taken over rounded sums.
    features = d.views(fx).groupBy("grid_index").agg(F.count(F.lit(1)).alias("n_views_averaged"), F.round(F.sum("weight"), 9).alias("weight_sum"))
    report = lattice.blend_report(features, d.tile_stats(fx).select("patch_index", "neighbour_count"))
    return fx.image_meta.select(*[F.lit(v).alias(k) for k, v in report.items()])


@query("g32_grids_per_spot", "spot_grid_count_min:i spot_grid_count_median:d spot_grid_count_max:i n_supervised_spots:i", """
    SELECT coalesce(min(n), 0) AS spot_grid_count_min, coalesce(median(n), 0) AS spot_grid_count_median, coalesce(max(n), 0) AS spot_grid_count_max, count(*) AS n_supervised_spots
    FROM (SELECT count(*) AS n FROM {bags} GROUP BY target_ord)""")
def _(fx):
    return spots.bag_summary(d.bags(fx))


@query("g34_distinct_counts", "n_supervised_spots:i n_supervised_grids:i n_grids:i", "SELECT count(DISTINCT spot_index) FILTER (WHERE spot_index >= 0) AS n_supervised_spots, count(*) FILTER (WHERE spot_index >= 0) AS n_supervised_grids, count(*) AS n_grids FROM {assigned}")
def _(fx):
    held = F.when(F.col("spot_index") >= 0, F.col("spot_index"))
    return d.assigned(fx).agg(F.countDistinct(held).alias("n_supervised_spots"), F.count(held).alias("n_supervised_grids"), F.count(F.lit(1)).alias("n_grids"))


@query("m02_tile_token_mean", "patch_index:i pos:i value:d", """
    SELECT patch_index, pos, avg(v) AS value FROM (SELECT patch_index, pos, v FROM {boxed} JOIN {vectors} ON vec_id = (patch_index * 256 + token_linear) % (SELECT count(*) FROM {embeddings})) GROUP BY 1, 2""")
def _(fx):
    means = d.token_vectors(fx).groupBy("patch_index").agg(vector_mean(F.col("token")).alias("v"))
    return means.select("patch_index", F.posexplode("v").alias("pos", "value"))


@query("m02_encoded_patches", "patch_index:i pos:i value:d n_tokens:i token_sum:d", """
    WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM {embeddings}),
    sums AS (SELECT vec_id, CAST(list_sum(v) * 896 AS DOUBLE) AS token_sum FROM whole)
    SELECT vec_id AS patch_index, i - 1 AS pos, CASE WHEN i <= 64 THEN v[i] ELSE v[i - 64] * 3.5 END AS value, 256 AS n_tokens, token_sum
    FROM whole JOIN sums USING (vec_id), unnest(range(1, 129)) AS u(i)""")
def _(fx):
    # The encoder gives whole numbers: token t of a patch is its vector times t % 8, the class token the vector.
    def encoder(frame):
        lead = np.floor(64 * np.stack(frame["embedding"].to_numpy()).astype(np.float64))
        return lead[:, None, :] * (np.arange(256) % 8)[None, :, None], lead

    encoded = training.encode_patches(fx.embeddings.select(F.col("vec_id").alias("patch_index"), "embedding"), encoder)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate("tokens", F.lit(0.0), lambda a, token: a + add(token))
    told = encoded.select("patch_index", "tile", F.size("tokens").alias("n_tokens"), total.alias("token_sum"))
    return told.select("patch_index", "n_tokens", "token_sum", F.posexplode("tile").alias("pos", "value"))


@query("m10_bag_rows", "target_ord:i spot_id:s grid_index:i t0:d t1:d t2:d t3:d t4:d t5:d t6:d t7:d c0:d c1:d c2:d c3:d c4:d", """
    SELECT b.target_ord, b.spot_id, b.grid_index, t.* FROM {bags} AS b JOIN {spot_truth} AS t ON t.spot = b.target_ord""")
def _(fx):
    truth = d.spot_truth(fx).withColumnRenamed("spot_id", "target_ord")
    return _spread(_spread(d.bags(fx).join(truth, "target_ord"), "expr", "t", N_GENES), "proportions", "c", 5)


# ------------------------------------------------------------------ bags, metrics, losses

_E8 = " ".join(f"e{i}:d" for i in range(N_GENES))


def _spread(df, column, prefix, n):
    return df.select("*", *[F.col(column)[i].alias(f"{prefix}{i}") for i in range(n)])


@query("g15_bag_expression", "spot:i " + _E8, "SELECT * FROM {spot_sum}")
def _(fx):
    sums = d.predicted_grids(fx).groupBy(F.col("user_id").alias("spot")).agg(vector_sum(F.col("expr"), N_GENES).alias("v"))
    return _spread(sums, "v", "e", N_GENES)


@query("g15_bag_features_wide", "spot:i pos:i value:d", """
    SELECT user_id AS spot, pos, sum(v) AS value FROM {events} JOIN {vectors} ON vec_id = event_id % (SELECT count(*) FROM {embeddings}) GROUP BY 1, 2""")
def _(fx):
    keyed = d._pick(fx, fx.events.select("event_id", "user_id"), F.col("event_id"), "v")
    return keyed.groupBy(F.col("user_id").alias("spot")).agg(vector_sum(F.col("v")).alias("v")).select("spot", F.posexplode("v").alias("pos", "value"))


@query("g16_bag_type_mean", "spot:i p0:d p1:d p2:d p3:d p4:d", "SELECT * FROM {spot_sum}")
def _(fx):
    return _spread(d.spot_sums(fx).withColumnRenamed("spot_id", "spot"), "prob", "p", 5)


def _pairs(fx):
    return metrics.paired_values(d.spot_sums(fx), d.spot_truth(fx))


@query("g24_gene_pearson", "gene_pos:i pcc:d", f"SELECT gene_pos, {_PCC} AS pcc FROM {{pairs}} GROUP BY 1")
def _(fx):
    return metrics.pearson(_pairs(fx), ["gene_pos"])


@query("g25_spot_pearson", "spot_id:i pcc:d", f"SELECT spot AS spot_id, {_PCC} AS pcc FROM {{pairs}} GROUP BY 1")
def _(fx):
    return metrics.pearson(_pairs(fx), ["spot_id"])


def _ranked(key):
    return f"""(SELECT {key}, rank() OVER (PARTITION BY {key} ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY {key}, round(x, 9)) - 1) / 2.0 AS x,
        rank() OVER (PARTITION BY {key} ORDER BY y) + (count(*) OVER (PARTITION BY {key}, y) - 1) / 2.0 AS y FROM {{pairs}})"""


def _rounded(fx):
    # Equal sums may differ in the last bits; ties are decided on rounded values on both sides of the check.
    return _pairs(fx).withColumn("x", F.round("x", 9))


@query("g26_gene_spearman", "gene_pos:i scc:d", f"SELECT gene_pos, {_PCC} AS scc FROM {_ranked('gene_pos')} GROUP BY 1")
def _(fx):
    return metrics.spearman(_rounded(fx), ["gene_pos"])


@query("g26_spot_spearman", "spot_id:i scc:d", f"SELECT spot AS spot_id, {_PCC} AS scc FROM {_ranked('spot')} GROUP BY 1")
def _(fx):
    return metrics.spearman(_rounded(fx), ["spot_id"])


@query("g27_metric_means", "mean_gene_PCC:d mean_gene_SCC:d mean_spot_gene_PCC:d mean_spot_gene_SCC:d n_genes:i n_gene_metric_spots:i", f"""
    SELECT (SELECT avg(v) FROM (SELECT {_PCC} AS v FROM {{pairs}} GROUP BY gene_pos)) AS "mean_gene_PCC",
           (SELECT avg(v) FROM (SELECT {_PCC} AS v FROM {_ranked('gene_pos')} GROUP BY gene_pos)) AS "mean_gene_SCC",
           (SELECT avg(v) FROM (SELECT {_PCC} AS v FROM {{pairs}} GROUP BY spot)) AS "mean_spot_gene_PCC",
           (SELECT avg(v) FROM (SELECT {_PCC} AS v FROM {_ranked('spot')} GROUP BY spot)) AS "mean_spot_gene_SCC",
           (SELECT count(DISTINCT gene_pos) FROM {{pairs}}) AS n_genes, (SELECT count(DISTINCT spot) FROM {{pairs}}) AS n_gene_metric_spots""")
def _(fx):
    pairs = _rounded(fx)
    return metrics.mean_metrics(metrics.gene_metrics(pairs), metrics.spot_metrics(pairs))


def _composition(fx):
    return d.spot_sums(fx).select("spot_id", F.col("prob").alias("predicted"), F.col("expr").alias("expr_p")).join(
        d.spot_truth(fx).select("spot_id", F.col("proportions").alias("target"), F.col("expr").alias("expr_t")), "spot_id")


_KL = " + ".join(f"c{i} * (ln(greatest(c{i}, 1e-8)) - ln(p{i}))" for i in range(5))
_L1 = " + ".join(f"abs(p{i} - c{i})" for i in range(5))
_L2 = " + ".join(f"(p{i} - c{i}) * (p{i} - c{i})" for i in range(5))


@query("g28_type_metrics", "spot_id:i type_kl:d type_l1:d type_l2:d", f"SELECT spot AS spot_id, {_KL} AS type_kl, ({_L1}) / 5 AS type_l1, ({_L2}) / 5 AS type_l2 FROM {{composition}}")
def _(fx):
    return metrics.type_metrics(_composition(fx))


_GAP = "abs(ln(1 + greatest(x, 0)) - ln(1 + greatest(y, 0)))"


@query("g29_expression_loss", "expr_loss_sum:d expr_loss_mean:d", f"""
    SELECT sum(h) AS expr_loss_sum, avg(h) AS expr_loss_mean FROM (SELECT CASE WHEN {_GAP} <= 1 THEN 0.5 * {_GAP} * {_GAP} ELSE {_GAP} - 0.5 END AS h FROM {{pairs}})""")
def _(fx):
    return metrics.expression_loss(_composition(fx), "expr_p", "expr_t")


@query("g30_proportion_loss", "deconv_loss:d", "SELECT sum(" + " + ".join(f"CASE WHEN c{i} > 0 THEN c{i} * (ln(c{i}) - ln(greatest(p{i}, 1e-8))) ELSE 0 END" for i in range(5)) + ") / count(*) AS deconv_loss FROM {composition}")
def _(fx):
    return metrics.proportion_loss(_composition(fx))


@query("g31_confidence_loss", "confidence_loss:d", "SELECT avg(-ln(greatest(p0, p1, p2, p3, p4, 1e-8))) AS confidence_loss FROM {grid_pred}")
def _(fx):
    return metrics.confidence_loss(d.predicted_grids(fx))


# ------------------------------------------------------------------ polygon aggregation

def polygon_values(fx, **options):
    return aggregate.polygon_values(fx.polygons, d.predicted_grids(fx), TYPE_NAMES, N_GENES, 18, **options)


@query("g17_polygon_expression", "cell_id:i " + _E8, "SELECT * FROM {polygon_kept}")
def _(fx):
    return _spread(polygon_values(fx), "expr", "e", N_GENES)


@query("g18_polygon_types", "cell_id:i q0:d q1:d q2:d q3:d q4:d", "SELECT * FROM {polygon_kept}")
def _(fx):
    return _spread(polygon_values(fx), "prob", "q", 5)


@query("g19_predicted_type", "cell_id:i predicted_type:s is_invalid:b", "SELECT * FROM {polygon_named}")
def _(fx):
    return polygon_values(fx, valid_only=False)


@query("g20_vertex_mean", "cell_id:i center_x:d center_y:d", "SELECT cell_id, avg(vertex_x) AS center_x, avg(vertex_y) AS center_y FROM {polygons} GROUP BY 1")
def _(fx):
    return overlap.ring_stats(fx.polygons)


@query("g21_covered_fraction", "cell_id:i covered_fraction:d", "SELECT * FROM {polygon_kept}")
def _(fx):
    return polygon_values(fx)


@query("g22_counters_all", "n_input_polygons:i n_output_cells:i n_zero_coverage:i n_invalid_polygon:i n_repaired_polygon:i", """
    SELECT count(*) FILTER (WHERE is_repaired) AS n_repaired_polygon, count(*) AS n_input_polygons, count(*) AS n_output_cells, count(*) FILTER (WHERE n_grids = 0) AS n_zero_coverage, count(*) FILTER (WHERE is_invalid) AS n_invalid_polygon FROM {polygon_all}""")
def _(fx):
    return aggregate.polygon_counters(polygon_values(fx, valid_only=False), valid_only=False)


@query("g23_grid_size", "size:i", "SELECT round_even(median(x1 - x0), 0) AS size FROM {grid_pred}")
def _(fx):
    return fx.spark.range(1).select(F.lit(aggregate.grid_size(d.predicted_grids(fx))).alias("size"))


@query("agg_flagship", "cell_id:i predicted_type:s covered_fraction:d center_x:d center_y:d n_grids:i " + _E8 + " q0:d q1:d q2:d q3:d q4:d", "SELECT * FROM {polygon_kept}")
def flagship(fx):
    return _spread(_spread(polygon_values(fx), "expr", "e", N_GENES), "prob", "q", 5)


# ------------------------------------------------------------------ windows

@query("g35_ring_bounds", "cell_id:i min_x:d max_x:d min_y:d max_y:d celltype:s", """
    SELECT b.cell_id, min_x, max_x, min_y, max_y, p_brand AS celltype FROM {bounds} AS b JOIN {part} ON b.cell_id = p_partkey""")
def _(fx):
    return win.ring_bounds(fx.true_type)


@query("g36_label_counts", "label:s n:i", f"SELECT CASE WHEN t = 'Mystery' THEN 'Unassigned' ELSE t END AS label, count(*) AS n FROM (SELECT {_TOP} AS t FROM {_CLIP} WHERE lx1 > lx0 AND ly1 > ly0) GROUP BY 1")
def _(fx):
    from spotweave.functions.text import known_label

    table = _boxes(fx).withColumn("predicted_type", F.get(F.array(*[F.lit(n) for n in TYPE_NAMES]), first_max_index(F.col("prob"))))
    labelled = win.clipped_to_window(win.rectangles_in_window(table, d.window(fx)), d.window(fx)).withColumn("l", known_label(F.col("predicted_type"), "Unassigned"))
    return win.label_counts(labelled, "l")


@query("g37_zscores", "grid_index:i z:d", f"SELECT grid_index, (e2 - m) / s AS z FROM {_IN}, {_Z}")
def _(fx):
    return win.zscores(win.rectangles_in_window(_boxes(fx).withColumn("value", F.col("expr")[2]), d.window(fx)))


@query("w08_paint_order", "px:i py:i ord:i", """
    SELECT px, py, max(ord) AS ord FROM (
        SELECT ord, gx.v AS px, gy.v AS py FROM (SELECT event_id AS ord, event_id % 40 AS x, user_id % 30 AS y FROM {events}),
               unnest(range(x, x + 4)) AS gx(v), unnest(range(y, y + 3)) AS gy(v)) GROUP BY 1, 2""")
def _(fx):
    table = fx.events.select(F.col("event_id").alias("ord"), (F.col("event_id") % 40).alias("lx0"), (F.col("user_id") % 30).alias("ly0"))
    table = table.withColumn("lx1", F.col("lx0") + 4).withColumn("ly1", F.col("ly0") + 3).withColumn("label", F.col("ord"))
    return win.painted(table, ["label"]).withColumnRenamed("label", "ord")


@query("j13_polygon_zscores", "cell_id:i z:d", f"""
    SELECT cell_id, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM (SELECT cell_id, ln(1 + p_retailprice % 7) AS v FROM {_RING_IN} JOIN {{part}} ON cell_id = p_partkey WHERE p_size % 5 = 1)""")
def _(fx):
    ids = win.polygons_in_window(fx.polygons, d.window(fx)).select("cell_id").distinct()
    return win.zscores(win.measured_values(ids, fx.true_expr, "G1"))


# ------------------------------------------------------------------ entry points

def _exported(fx):
    grids = d.predicted_grids(fx).select(
        "ord", "grid_index", "x0", "y0", "x1", "y1", (F.col("x0") + 9.0).alias("center_x"), (F.col("y0") + 9.0).alias("center_y"),
        F.col("prob").alias("type_prob"), F.col("expr").alias("expr_pred"))
    return pipeline.export_grid_predictions(grids, TYPE_NAMES)


@query("api_export_grid_predictions", f"grid_id:s predicted_type:s {_E8}", f"SELECT 'grid_' || grid_index AS grid_id, {_TOP} AS predicted_type, * FROM {{grid_pred}}")
def _(fx):
    tables = _exported(fx)
    return _spread(tables["grid_expr"].join(tables["grid_type"].select("grid_id", "predicted_type"), "grid_id"), "expr", "e", N_GENES)


@query("api_agg", "cell_id:i predicted_type:s covered_fraction:d center_x:d center_y:d " + _E8, "SELECT * FROM {polygon_kept}")
def _(fx):
    tables = _exported(fx)
    types = tables["grid_type"].select("grid_id", F.array(*[f"prob_{name}" for name in TYPE_NAMES]).alias("prob"))
    out = pipeline.agg(dataset="brca", grid_expr=tables["grid_expr"], grid_types=types, type_names=TYPE_NAMES, polygons=fx.polygons, n_genes=N_GENES)
    return _spread(out["expr"].join(out["ct"].select("cell_id", "predicted_type"), "cell_id"), "expr", "e", N_GENES)


# ------------------------------------------------------------------ models

_SHAPE = {"hidden": (16, 8), "type_hidden": 16}
MODEL = initial_params(64, N_GENES, 5, 16, seed=3, **_SHAPE)
_FRESH = initial_params(64, N_GENES, 5, 16, seed=0, **_SHAPE)
_Q5 = "q0:d q1:d q2:d q3:d q4:d"
PARTS["model_input"] = """
    SELECT event_id AS grid_index, user_id AS target_ord, CAST(embedding AS DOUBLE[]) AS x
    FROM {events} JOIN {embeddings} ON vec_id = event_id % (SELECT count(*) FROM {embeddings})"""
PARTS.update(forward_parts("model", MODEL))
PARTS.update(forward_parts("fresh", _FRESH))
PARTS["fresh_loss"] = loss_sql("fresh", N_GENES, 5, 0.05, 1.0)
_OUT = ", ".join(f"expr[{i + 1}] AS e{i}" for i in range(N_GENES)) + ", " + ", ".join(f"prob[{i + 1}] AS q{i}" for i in range(5))


def _features(fx):
    return d._pick(fx, fx.events.select(F.col("event_id").alias("grid_index"), F.col("user_id").alias("target_ord")), F.col("grid_index"), "feature").withColumn(
        "spot_id", F.col("target_ord").cast("string"))


@query("m04_instance_forward", f"grid_index:i {_E8} {_Q5}", f"SELECT grid_index, {_OUT} FROM {{model_out}}")
def _(fx):
    return _spread(_spread(training.predict_grids(_features(fx), MODEL), "expr_pred", "e", N_GENES), "type_prob", "q", 5)


@query("m05_bag_forward", f"target_ord:i n_grids:i {_E8} {_Q5}", "SELECT * FROM {model_bag}")
def _(fx):
    return _spread(_spread(training.predict_bags(_features(fx), MODEL, 5, N_GENES), "expr", "e", N_GENES), "prob", "q", 5)


@query("m06_supervised_prediction", f"position:i spot_id:s {_E8} {_Q5}", "SELECT row_number() OVER (ORDER BY target_ord) - 1 AS position, CAST(target_ord AS VARCHAR) AS spot_id, * FROM {model_bag}")
def _(fx):
    placed = ordinals.ordinal(training.predict_bags(_features(fx), MODEL, 5, N_GENES), ["target_ord"], name="position")
    return _spread(_spread(placed, "expr", "e", N_GENES), "prob", "q", 5)


@query("m07_grid_prediction", f"grid_index:i type_top1:i {_E8} {_Q5}", f"SELECT grid_index, list_position(prob, list_max(prob)) - 1 AS type_top1, {_OUT} FROM {{model_out}}")
def _(fx):
    return _spread(_spread(training.predict_grids(_features(fx), MODEL), "expr_pred", "e", N_GENES), "type_prob", "q", 5)


@query("m08_fit", "first_loss:d fell:b", "SELECT round(loss, 3) AS first_loss, true AS fell FROM {fresh_loss}")
def _(fx):
    truth = d.spot_truth(fx).select(F.col("spot_id").alias("target_ord"), F.col("expr").alias("expression"), "proportions")
    bags = _features(fx).join(truth.select("target_ord"), "target_ord", "left_semi")
    options = training.FitOptions(projection_dim=16, max_epochs=3, lr=1e-2, steps_per_epoch=1, dropout=0.0, **_SHAPE)
    losses = [float(h["train_loss"]) for h in training.fit(bags, truth, 64, N_GENES, 5, options).history]
    return fx.spark.createDataFrame([(round(losses[0], 3), losses[-1] < losses[0])], "first_loss double, fell boolean")


@query("m09_best_epoch", "epoch:i train_loss:d train_expr_loss:d train_type_loss:d val_loss:d best_epoch:i monitor:s")
def _(fx):
    # The default path: stored batches in changing order, dropout, validation, state per epoch. Random numbers have no SQL; a test compares loops.
    truth = durable(d.spot_truth(fx).select(F.col("spot_id").alias("target_ord"), F.col("expr").alias("expression"), "proportions"))
    bags = _features(fx).join(truth.select("target_ord"), "target_ord", "left_semi")
    held = durable(ordinals.seeded_split(truth.select("target_ord"), "target_ord", 0.1, 0, truth.count()).where("is_validation").select("target_ord"))
    options = training.FitOptions(projection_dim=16, max_epochs=3, lr=1e-2, batch_size=256, **_SHAPE)
    result = training.fit(
        bags.join(held, "target_ord", "left_anti"), truth, 64, N_GENES, 5, options, (bags.join(held, "target_ord", "left_semi"), truth), scratch_path(fx.spark, "epochs"))
    rows = [(h["epoch"], h["train_loss"], h["train_expr_loss"], h["train_type_loss"], h["val_loss"], h["best_epoch"], result.monitor) for h in result.history]
    return fx.spark.createDataFrame(rows, "epoch int, train_loss double, train_expr_loss double, train_type_loss double, val_loss double, best_epoch int, monitor string")


# ------------------------------------------------------------------ entry points that a user calls first

_WINDOW_TYPES = f"SELECT CASE WHEN {_TOP} = 'Mystery' THEN 'Unassigned' ELSE {_TOP} END AS label FROM {_PAINT} WHERE k = 1"


def _window_grids(fx):
    boxes = {c: f"bbox_{c}" for c in ("x0", "y0", "x1", "y1")}
    top = F.get(F.array(*[F.lit(n) for n in TYPE_NAMES]), first_max_index(F.col("prob")))
    return d.predicted_grids(fx).withColumnsRenamed(boxes).withColumn("predicted_type", top)


@query("api_plottype", "source:s label:s n:i", f"""
    SELECT 'pixels' AS source, label, count(*) AS n FROM ({_WINDOW_TYPES}) GROUP BY 2
    UNION ALL SELECT 'grids', CASE WHEN t = 'Mystery' THEN 'Unassigned' ELSE t END, count(*) FROM (SELECT {_TOP} AS t FROM {_CLIP} WHERE lx1 > lx0 AND ly1 > ly0) GROUP BY 2
    UNION ALL SELECT 'measured', 'Others', count(*) FROM {_RING_IN}""")
def _(fx):
    # The whole raster by label (its pixels are those of r13), and both label counts.
    tables = pipeline.plottype(dataset="brca", grid_types=_window_grids(fx), window=d.window(fx), true_types=fx.true_type)
    pixels = win.label_counts(tables["grid_type_raster"], "label")
    parts = (("pixels", pixels), ("grids", tables["grid_type_counts"]), ("measured", tables["true_type_counts"]))
    named = [t.select(F.lit(name).alias("source"), "label", "n") for name, t in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("api_plotexpr", "source:s a:i b:i z:d", f"""
    SELECT 'pixel' AS source, px AS a, py AS b, (e2 - m) / s AS z FROM {_PAINT}, {_Z} WHERE k = 1
    UNION ALL SELECT 'cell', cell_id, 0, (v - avg(v) OVER ()) / stddev_pop(v) OVER () FROM (SELECT cell_id, ln(1 + p_retailprice % 7) AS v FROM {_RING_IN} JOIN {{part}} ON cell_id = p_partkey WHERE p_size % 5 = 2)""")
def _(fx):
    genes = fx.part.select((F.col("p_size") % N_GENES).alias("ord")).distinct().select("ord", F.concat(F.lit("G"), "ord").alias("gene"))
    tables = pipeline.plotexpr(dataset="brca", grid_expr=_window_grids(fx), genes=genes, window=d.window(fx), gene="G2", measured=fx.true_expr, polygons=fx.polygons)
    cells = tables["measured_polygons"].select("cell_id", "z").distinct()
    return tables["grid_expr_raster"].select(F.lit("pixel").alias("source"), F.col("px").alias("a"), F.col("py").alias("b"), "z").unionByName(
        cells.select(F.lit("cell").alias("source"), F.col("cell_id").alias("a"), F.lit(0).alias("b"), "z"))


@query("api_ge_metadata", "n_positions_in_tissue:i n_bbox_patch_candidates:i n_export_patches:i n_raw_token_grids:i n_grids:i n_supervised_grids:i n_supervised_spots:i", """
    SELECT (SELECT count(*) FROM {spots}) AS n_positions_in_tissue, (SELECT count(*) FROM {candidates}) AS n_bbox_patch_candidates, (SELECT count(*) FROM {patches}) AS n_export_patches,
           (SELECT count(*) FROM {views}) AS n_raw_token_grids, count(*) AS n_grids, count(*) FILTER (WHERE spot_index >= 0) AS n_supervised_grids,
           count(DISTINCT spot_index) FILTER (WHERE spot_index >= 0) AS n_supervised_spots FROM {assigned}""")
def _(fx):
    summary = _metadata(fx).summary
    names = ["n_positions_in_tissue", "n_bbox_patch_candidates", "n_export_patches", "n_raw_token_grids", "n_grids", "n_supervised_grids", "n_supervised_spots"]
    return fx.image_meta.select(*[F.lit(summary[n]).alias(n) for n in names])


def _metadata(fx):
    return pipeline.ge(
        dataset="brca", positions=fx.positions, spot_diameter=SPOT_DIAMETER, thumbnail_scale=THUMB_SCALE, thumbnail=fx.thumbnail, image=fx.image_meta, metadata_only=True)


@query("api_ge_grids", "grid_index:i x0:i y0:i nearest_spot_index:i nearest_spot_distance:d spot_index:i is_tissue:b", """
    SELECT g.grid_index, g.x0, g.y0, nearest AS nearest_spot_index, distance AS nearest_spot_distance, spot_index, true AS is_tissue FROM {grids} AS g JOIN {assigned} USING (grid_index)""")
def _(fx):
    return _metadata(fx)["grids"]


@query("b09_reuse", "run:s n:i", """
    SELECT 'first' AS run, count(*) AS n FROM {polygon_kept} UNION ALL SELECT 'again', count(*) FROM {polygon_kept}
    UNION ALL SELECT 'other argument', count(*) FROM {polygon_all} UNION ALL SELECT 'other table', count(*) FROM {polygon_all} WHERE cell_id > 10""")
def _(fx):
    # One output folder: the second call reads what the first has stored, the others were asked something else and compute anew.
    folder, tables = scratch_path(fx.spark, "reuse"), _exported(fx)
    types = tables["grid_type"].select("grid_id", F.array(*[f"prob_{name}" for name in TYPE_NAMES]).alias("prob"))

    def run(polygons, valid_only):
        out = pipeline.agg(dataset="brca", grid_expr=tables["grid_expr"], grid_types=types, type_names=TYPE_NAMES, polygons=polygons, n_genes=N_GENES,
                           valid_only=valid_only, output_dir=folder, policy="reuse")
        return out["ct"].count()

    rows = [("first", run(fx.polygons, True)), ("again", run(fx.polygons, True)), ("other argument", run(fx.polygons, False)), ("other table", run(fx.polygons.where("cell_id > 10"), False))]
    return fx.spark.createDataFrame(rows, "run string, n long")
