"""The entry points end to end on tables derived from the test data."""

import os

import pytest
from pyspark.sql import functions as F

import spotweave
from spotweave.operators.training import FitOptions
from spotweave.plans import derived as d
from spotweave.plans.fixtures import N_GENES, SEGMENTS, SPOT_DIAMETER, THUMB_SCALE, TYPE_NAMES, Fixtures

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, FOLDER)


@pytest.fixture(scope="module")
def embedded(fx):
    n = fx.embeddings.count()
    pick = lambda number, name: (lambda df: df.withColumn("vec_id", number % n).join(
        fx.embeddings.select("vec_id", F.slice("embedding", 1, 6).alias(name)), "vec_id").drop("vec_id"))
    patches = d.patches(fx).select("patch_index")
    tokens = patches.withColumn("token_linear", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return spotweave.ge(
        dataset="brca", positions=fx.positions, spot_diameter=SPOT_DIAMETER, thumbnail_scale=THUMB_SCALE, thumbnail=fx.thumbnail,
        image=fx.image_meta, tiles=pick(F.col("patch_index"), "tile")(patches),
        tokens=pick(F.col("patch_index") * 256 + F.col("token_linear"), "token")(tokens), neighbour_mode="delta_std",
    )


def test_deconv(fx):
    merge = fx.type_merge
    result = spotweave.deconv(
        dataset="brca", counts=fx.counts, positions=fx.positions, ref_cells=fx.ref_cells, ref_counts=fx.ref_counts,
        sample_id="BREAST", type_merge=merge, umi_min=0, rounds=3, brca_types=SEGMENTS,
    )
    totals = [r.t for r in result["merged_proportions"].groupBy("spot_id").agg(F.sum("p").alias("t")).collect()]
    assert totals == pytest.approx([1.0] * len(totals)) and len(totals) == 100
    checks = result.summary["validation"]
    assert checks["n_missing_types"] == checks["n_unexpected_types"] == checks["n_missing_spots"] == checks["n_not_finite"] == 0
    assert sorted(result.summary["cell_types"]) == SEGMENTS and result.summary["n_spots_below_minimum"] == 0


def test_ge(embedded):
    s = embedded.summary
    assert s["complete"] and s["feature_dim"] == 6 * 4 and s["n_total_token_views_used"] == s["n_raw_token_grids"]
    grids = embedded["grid_embedding"]
    assert grids.count() == s["n_grids"] and grids.where("size(feature) <> 24 OR feature IS NULL").count() == 0
    assert s["n_supervised_grids"] == grids.where(f"nearest_spot_distance <= {SPOT_DIAMETER / 2}").count() > 0
    with pytest.raises(ValueError):
        spotweave.ge(dataset="brca", positions=None, spot_diameter=1, thumbnail_scale=1, thumbnail=None, image=None, patch_size=100)


def test_train_and_export(fx, embedded, tmp_path):
    options = FitOptions(projection_dim=8, max_epochs=2, lr=0.01, hidden=(8, 8), type_hidden=8, train_all=False, val_fraction=0.2, steps_per_epoch=1)
    genes = fx.gene_list.where("ord < 6")
    result = spotweave.train(
        dataset="brca", grid_embedding=embedded["grid_embedding"], position_spots=embedded["spots"], counts=fx.counts, deconv=fx.deconv,
        gene_list=genes, options=options, limit_spots=12, output_dir=str(tmp_path / "run"),
    )
    assert result.summary["n_supervised_spots"] == 12 and result.summary["n_genes"] == 5 and result.summary["early_stop_monitor"] == "val_loss"
    assert result["gene_metrics"].count() == 5 and result["spot_type_metrics"].count() == 12
    predictions = result["grid_predictions"]
    assert predictions.count() == embedded.summary["n_grids"]
    tables = spotweave.export_grid_predictions(predictions, result.extra["types"])
    assert {f"prob_{t}" for t in SEGMENTS} <= set(tables["grid_type"].columns)
    assert tables["grid_type"].where("predicted_type IS NULL").count() == 0


def _grids(fx):
    boxes = {c: f"bbox_{c}" for c in ("x0", "y0", "x1", "y1")}
    named = d.predicted_grids(fx).withColumnsRenamed(boxes).withColumn("grid_id", F.concat(F.lit("grid_"), "grid_index"))
    top = F.get(F.array(*[F.lit(t) for t in TYPE_NAMES]), (F.array_position("prob", F.array_max("prob")) - 1).cast("int"))
    return named.drop("ord").withColumn("predicted_type", top)


def test_agg(fx):
    grids = _grids(fx)
    off = grids.where("grid_index < 50").withColumn("bbox_x0", F.col("bbox_x0") + 5).withColumn("grid_id", F.concat(F.lit("grid_"), F.col("grid_index") + 900000))
    run = lambda g, valid: spotweave.agg(dataset="brca", grid_expr=g, grid_types=g, type_names=TYPE_NAMES, polygons=fx.polygons, n_genes=N_GENES, valid_only=valid)
    base = run(grids, True)
    shifted = run(grids.unionByName(off), True)  # grids off the lattice never match
    assert base.summary == shifted.summary
    rounded = lambda r: r["expr"].select("cell_id", F.transform("expr", lambda v: F.round(v, 6)).alias("expr"))
    assert rounded(base).exceptAll(rounded(shifted)).count() == 0
    assert base.summary["n_output_cells"] == base["ct"].count() == base["polygon"].select("cell_id").distinct().count()
    assert base["expr"].where("covered_fraction > 1 + 1e-6").count() == 0
    everything = run(grids, False)
    assert everything["ct"].count() == everything.summary["n_input_polygons"]
    assert everything["ct"].where("predicted_type = 'Unassigned'").count() == everything.summary["n_zero_coverage"]


def test_window_tables(fx):
    grids, box = _grids(fx), d.window(fx)
    types = spotweave.plottype(dataset="brca", grid_types=grids, window=box, true_types=fx.true_type)
    painted = types["grid_type_raster"].count()
    assert painted == (box[2] - box[0]) * (box[3] - box[1])
    assert {r.label for r in types["true_type_counts"].collect()} == {"Others"}
    genes = fx.part.select((F.col("p_size") % N_GENES).alias("ord")).distinct().select("ord", F.concat(F.lit("G"), "ord").alias("gene"))
    expr = spotweave.plotexpr(dataset="brca", grid_expr=grids, genes=genes, window=box, gene="G1", measured=fx.true_expr, polygons=fx.polygons)
    assert expr["grid_expr_raster"].count() == painted and expr.summary["marker_group"] == "Gene"
    assert expr["measured_polygons"].select("cell_id").distinct().count() > 0
    with pytest.raises(ValueError):
        spotweave.plotexpr(dataset="brca", grid_expr=grids, genes=genes, window=box, gene="nope")
    with pytest.raises(ValueError):
        spotweave.plottype(dataset="other", grid_types=grids, window=box)


def test_reuse_skips_the_work(spark, tmp_path, monkeypatch):
    from spotweave.operators import aggregate
    from spotweave.plans import pipeline

    boxes = ", ".join(f"bbox_{c} long" for c in ("x0", "y0", "x1", "y1"))
    expr = spark.createDataFrame([("grid_0", 0, 0, 18, 18, [1.0, 2.0]), ("grid_1", 18, 0, 36, 18, [3.0, 4.0])], f"grid_id string, {boxes}, expr array<double>")
    types = spark.createDataFrame([("grid_0", [1.0, 0.0]), ("grid_1", [0.0, 1.0])], "grid_id string, prob array<double>")
    ring = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(2, 2), (20, 2), (20, 9), (2, 9)])], "cell_id long, vertex_ord long, vertex_x double, vertex_y double")
    run = lambda polygons=ring, **other: pipeline.agg(dataset="brca", grid_expr=expr, grid_types=types, type_names=["a", "b"], polygons=polygons, n_genes=2, output_dir=str(tmp_path / "out"), policy="reuse", **other)
    first = run()
    kept = first["expr"].collect()
    plain = aggregate.polygon_values
    monkeypatch.setattr(aggregate, "polygon_values", None)
    again = run(ring.repartition(3))
    assert sorted(again.tables) == sorted(first.tables)
    assert again["expr"].collect() == kept and again.summary["n_output_cells"] == 1
    # Another argument or another table is not what was stored.
    for other in ({"valid_only": False}, {"target_name": "nuclei"}, {"polygons": ring.withColumn("vertex_x", F.col("vertex_x") + 1)}):
        with pytest.raises(TypeError):
            run(**other)
    monkeypatch.setattr(aggregate, "polygon_values", plain)
    moved = run(ring.withColumn("vertex_x", F.col("vertex_x") + 1))
    assert spark.read.parquet(str(tmp_path / "out" / "expr")).collect() == moved["expr"].collect() != kept


def test_agg_joins_the_tables_of_the_grids_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    boxes = [(f"grid_{i}", 18 * i, 0, 18 * i + 18, 18, [1.0 * i, 2.0]) for i in range(4)]
    expr = spark.createDataFrame(boxes, "grid_id string, bbox_x0 int, bbox_y0 int, bbox_x1 int, bbox_y1 int, expr array<double>")
    types = spark.createDataFrame([(f"grid_{i}", [0.25, 0.75]) for i in range(4)], "grid_id string, prob array<double>")
    ring = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (30, 1), (30, 17), (1, 17)])], "cell_id long, vertex_ord long, vertex_x double, vertex_y double")
    out = spotweave.agg(dataset="brca", grid_expr=expr.mapInArrow(counted, expr.schema), grid_types=types, type_names=["a", "b"], polygons=ring, n_genes=2)
    assert [r.predicted_type for r in out["ct"].collect()] == ["b"] and made.value == 4


def test_grids_meet_their_spots_by_shuffle(spark):
    """Grids and their nearest spots grow with the slide: neither is broadcast from the driver, however small Spark takes it to be."""
    positions = spark.createDataFrame(
        [(i, f"S{i}", 1, 0, i, 150.0 + 300 * (i // 2), 150.0 + 300 * (i % 2)) for i in range(4)],
        "ord long, barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double")
    pixels = spark.range(3600).select((F.col("id") % 60).cast("int").alias("px"), F.floor(F.col("id") / 60).cast("int").alias("py"))
    thumbnail = pixels.select("px", "py", F.lit(200).alias("r"), F.lit(120).alias("g"), F.lit(160).alias("b"))
    image = spark.createDataFrame([(600, 600)], "width long, height long")
    result = spotweave.ge(
        dataset="brca", positions=positions, spot_diameter=60.0, thumbnail_scale=0.1, thumbnail=thumbnail, image=image, metadata_only=True)
    grids = result["grids"]
    rows = grids.select("grid_index", "center_x", "center_y", "nearest_spot_index", "nearest_spot_distance", "spot_index")
    told = rows.collect()
    assert len(told) == result.summary["n_grids"] > 0 and len({r.grid_index for r in told}) == len(told)
    for r in told:
        near = min((((r.center_x - 150 - 300 * (i % 2)) ** 2 + (r.center_y - 150 - 300 * (i // 2)) ** 2) ** 0.5, i) for i in range(4))
        assert (r.nearest_spot_distance, r.nearest_spot_index) == (pytest.approx(near[0]), near[1])
        assert r.spot_index == (near[1] if near[0] <= 30 else -1)
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "grid_index" in plan and "BroadcastHashJoin" not in plan
