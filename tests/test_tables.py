import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import arrays, text
from spotweave.operators import counts, metrics, proportions, raster, spots
from spotweave.operators import windows as win
from spotweave.sinks import files as sinks
from spotweave.sources import files as sources


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_spot_ids(spark):
    both = lambda f, v: _one(spark, f(F.lit(v), "BREAST"))
    assert both(text.spot_id_for_model, "a_BREAST_BREAST") == "a" and both(text.spot_id_for_grid, "a_BREAST_BREAST") == "a_BREAST"
    assert _one(spark, text.spot_id_for_grid(F.lit("a.S"), "x")) == "a.S"


def test_array_functions(spark):
    v = F.array(F.lit(-1.0), F.lit(0.0), F.lit(3.0))
    x = np.array([-1.0, 0.0, 3.0])
    e = np.exp(x / 2)
    assert np.allclose(_one(spark, arrays.softmax(v, 2.0)), e / e.sum())
    assert np.allclose(_one(spark, arrays.softplus(v)), np.log1p(np.exp(20 * x)) / 20)
    assert np.allclose(_one(spark, arrays.leaky_relu(v)), [-0.01, 0, 3])
    assert np.allclose(_one(spark, arrays.relu(v)), [0, 0, 3])
    assert np.allclose(_one(spark, arrays.sigmoid(v)), 1 / (1 + np.exp(-x)))
    assert np.allclose(_one(spark, arrays.layer_norm(v)), (x - x.mean()) / np.sqrt(x.var() + 1e-5))
    assert _one(spark, arrays.normalised(F.array(F.lit(0.0), F.lit(-2.0)), 1e-12)) == [0.0, 0.0]
    assert _one(spark, arrays.first_max_index(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)))) == 1


def test_labels_and_merge(spark):
    table = spark.createDataFrame([("CD4+_t  cells",), ("DCIS",), ("odd",), ("b",)], "celltype string")
    merge = spark.createDataFrame([("T Cells", "CD4+ T Cells", 0), ("DCIS", "b", 1), ("Stromal", "b", 2)], "target string, source string, target_ord int")
    assert [r.celltype for r in win.merged_labels(table, merge).collect()] == ["T Cells", "DCIS", "Others", "Stromal"]
    assert _one(spark, text.label_key(F.lit("  A__b \t C "))) == "a b c"
    assert _one(spark, text.hex_channel(F.lit("#fa786e"), 1)) == 0x78
    with pytest.raises(ValueError):
        win.checked_window((0, 0, 0, 5))
    assert win.checked_window((0.5, 1.5, 10.2, 9)) == (0, 2, 10, 9)


def test_proportion_rules(spark):
    p = spark.createDataFrame([("s", "a", 1.0), ("s", "b", -3.0), ("s", "c", 2.0), ("t", "a", 0.0), ("t", "b", 0.0), ("t", "c", None)], "spot_id string, cell_type string, p double")
    merge = spark.createDataFrame([("X", "a", 0), ("X", "b", 0), ("Y", "c", 1), ("Z", "c", 2)], "target string, source string, target_ord int")
    got = {(r.spot_id, r.cell_type): r.p for r in proportions.merged_proportions(p, merge).collect()}
    # X is clipped after merging (1 - 3 < 0); an all-zero spot stays zero; c counts in both its targets
    assert got == {("s", "X"): 0.0, ("s", "Y"): 0.5, ("s", "Z"): 0.5, ("t", "X"): 0.0, ("t", "Y"): 0.0, ("t", "Z"): 0.0}
    with pytest.raises(ValueError):
        proportions.merge_types(p, spark.createDataFrame([("X", "nope", 0)], merge.schema))


def test_mixture_recovers_proportions(spark):
    rng = np.random.default_rng(0)
    r = rng.dirichlet(np.ones(30), 3)
    truth = np.array([[0.7, 0.2, 0.1], [0.0, 0.5, 0.5]])
    x = truth @ r * 1e5
    counts_ = spark.createDataFrame([(f"s{s}", f"g{g}", float(x[s, g])) for s in range(2) for g in range(30)] + [("low", "g0", 1.0)], "barcode string, gene string, count double")
    profiles = spark.createDataFrame([(t, f"g{g}", float(r[i, g])) for i, t in enumerate("abc") for g in range(30)], "cell_type string, gene string, profile double")
    got = {v.barcode: v.p for v in proportions.mixture_proportions(counts_, profiles, list("abc"), rounds=60, umi_minimum=10, checkpoint_every=10).collect()}
    assert np.allclose([got["s0"], got["s1"]], truth, atol=0.02) and got["low"] is None


def test_correlation_guards(spark):
    pairs = spark.createDataFrame([("const", 1.0, 5.0), ("const", 1.0, 6.0), ("one", 1.0, 2.0), ("gap", 1.0, 3.0), ("gap", None, 1.0), ("gap", 2.0, 1.0), ("gap", 2.0, 1.0)], "k string, x double, y double")
    assert {r.k: r.pcc for r in metrics.pearson(pairs, ["k"]).collect()} == {"const": None, "one": None, "gap": pytest.approx(-1.0)}
    assert {r.k: r.scc for r in metrics.spearman(pairs, ["k"]).collect()}["gap"] is not None


def test_zscores_of_a_constant_are_zero(spark):
    assert {r.z for r in win.zscores(spark.createDataFrame([(2.0,), (2.0,)], "value double")).collect()} == {0.0}


def test_reference_filter_names(spark):
    cells = spark.createDataFrame([("1", "T cells", "P2CRC", True), ("2", "T cells", "P1CRC", True), ("3", "odd", "P2CRC", True), ("4", "NA", "P2CRC", True), ("5", "T cells", "P2CRC", False)],
                                  "cell_id string, label string, patient string, consensus_keep boolean")
    ids = lambda *a: sorted(r.cell_id for r in spots.reference_filter(cells, *a).collect())
    assert ids("p2crc", "COLON_P2") == ["1"] and ids("allcrc", "COLON_P2") == ["1", "2"] and ids(None, "COLON_P2") == ["1", "2", "3"]
    assert spots.keep_consensus(cells.drop("consensus_keep")).count() == 5
    with pytest.raises(ValueError):
        spots.reference_filter(cells, "other", "BREAST")


def test_empty_gene_selection_is_an_error(spark):
    genes = spark.createDataFrame([(0, "x")], "ord int, gene string")
    with pytest.raises(ValueError):
        counts.requested_genes(genes, spark.createDataFrame([("y",)], "gene string"))


def test_feature_column_and_policies(spark, tmp_path):
    table = spark.sql("SELECT 1 AS grid_index, array(1.0D) AS dense, array(1, 2) AS center_xy, 0 AS x0, 0 AS y0")
    assert sources.feature_column(table) == "dense"
    with pytest.raises(KeyError):
        sources.feature_column(table.withColumn("other", F.array(F.lit(1))))
    path = str(tmp_path / "t")
    sinks.write_table(table, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_table(table, path, "fail")
    sinks.write_table(table.withColumn("x0", F.lit(9)), path, "reuse")
    assert spark.read.parquet(path).first()["x0"] == 0
    sinks.write_table(table.withColumn("x0", F.lit(9)), path, "replace")
    assert spark.read.parquet(path).first()["x0"] == 9
    with pytest.raises(ValueError):
        sources.compressed_to_entries(table, table, "dense")
    with pytest.raises(ValueError):
        sources.probability_columns(["grid_id", "center_x"])


def test_json_and_header_readers(spark, tmp_path):
    for name, payload in (("a", {"merge": {"T": ["x", "y"], "A": ["z"]}}), ("b", {"T": ["x", "y"], "A": ["z"]})):
        (tmp_path / name).write_text(json.dumps(payload, indent=2))
        got = sorted((r.target_ord, r.target, r.source_ord, r.source) for r in sources.read_type_merge(spark, str(tmp_path / name)).collect())
        assert got == [(0, "T", 0, "x"), (0, "T", 1, "y"), (1, "A", 0, "z")]
    (tmp_path / "bad").write_text('["T"]')
    with pytest.raises(ValueError):
        sources.read_type_merge(spark, str(tmp_path / "bad"))
    (tmp_path / "p.csv").write_text("barcode,in_tissue,image_x,image_y\nb,1,3,4\na,0,1,2\n")
    table = sources.read_positions(spark, str(tmp_path / "p.csv"))
    assert [(r.ord, r.barcode) for r in table.orderBy("ord").collect()] == [(0, "b"), (1, "a")]
    assert [tuple(r) for r in spots.coordinate_columns(table).orderBy("barcode").collect()] == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    (tmp_path / "genes").write_text(" g1 \n\n g0\n")
    assert [(r.ord, r.gene) for r in sources.read_gene_list(spark, str(tmp_path / "genes")).orderBy("ord").collect()] == [(0, "g1"), (1, "g0")]
    (tmp_path / "none").write_text("\n \n")
    assert sources.read_gene_list(spark, str(tmp_path / "none")) is None


def test_lines_are_numbered_without_a_sort(spark, tmp_path):
    """Several files, cut into several splits each: numbers follow files and lines, and the plan sorts no lines."""
    lines = [f"gene {i} " + "x" * (i % 37) for i in range(3000)]
    (tmp_path / "genes").mkdir()
    for part in range(3):
        (tmp_path / "genes" / f"part-{part}").write_text("\n".join(lines[part * 1000 : part * 1000 + 1000] + ["", "  "]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        read = sources.read_lines(spark, str(tmp_path / "genes"))
        assert spark.read.text(str(tmp_path / "genes")).rdd.getNumPartitions() > 9
        assert [r["value"] for r in sorted(read.collect(), key=lambda r: r["ord"])] == [x.strip() for x in lines]
        assert sorted(r["ord"] for r in read.collect()) == list(range(3000))
        assert "rangepartitioning" not in read._jdf.queryExecution().executedPlan().toString().lower()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def png(image):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width, channels = image.shape
    lines = b"".join(b"\0" + image[y].tobytes() for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_image_bands_to_words(spark, tmp_path, channels):
    """Bands of one, of some and of all rows give the words that the pixels give, by a plain loop and by the pixel reader."""
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (9, 150, channels), dtype=np.uint8)
    image[4] = 255
    image[5, :70] = 0
    (tmp_path / "t.png").write_bytes(png(image))
    images = sources.read_images(spark, str(tmp_path / "t.png"))
    want = {}
    for y in range(9):
        for x in range(150):
            r, g, b = (int(image[y, x, min(k, channels - 1)]) for k in range(3))
            high, low = max(r, g, b), min(r, g, b)
            if high and (high - low) / high > 0.05 and (r + g + b) / 3 < 245 and high - low > 10:
                want[y, x // 64] = want.get((y, x // 64), 0) | 1 << x % 64
    pixelwise = raster.pack(raster.tissue_pixels(sources.read_thumbnail(spark, str(tmp_path / "t.png")))).collect()
    assert {(r.py, r.word): r.bits % 2**64 for r in pixelwise} == want
    for size in (1, 150 * channels * 4, 1 << 20):
        rows = raster.image_words(images, size).collect()
        assert len(rows) == len(want) and {(r.py, r.word): r.bits % 2**64 for r in rows} == want
    shifted = raster.image_words(images.selectExpr("*", "100 AS py0")).collect()
    assert {(r.py - 100, r.word) for r in shifted} == set(want)
    assert raster.image_words(images.limit(0)).count() == 0
    assert raster.image_words(images.selectExpr("-1 AS height", "-1 AS width", "-1 AS nChannels", "data")).count() == 0


def test_thumbnail_reader(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    (tmp_path / "t.png").write_bytes(png(image))
    rows = sources.read_thumbnail(spark, str(tmp_path / "t.png")).collect()
    got = np.zeros_like(image)
    for r in rows:
        got[r.py, r.px] = (r.r, r.g, r.b)
    assert len(rows) == 35 and (got == image).all()


def test_unmeasured_gene_changes_no_mixture(spark):
    from spotweave.operators.proportions import mixture_proportions

    counts = spark.createDataFrame([("s0", "g1", 8.0), ("s0", "g2", 2.0), ("s1", "g2", 5.0), ("s1", "g9", 4.0), ("s2", "g9", 3.0)], "barcode string, gene string, count double")
    profiles = [("a", "g1", 0.7), ("a", "g2", 0.3), ("b", "g1", 0.1), ("b", "g2", 0.9)]
    run = lambda rows: {r["barcode"]: r["p"] for r in mixture_proportions(counts, spark.createDataFrame(rows, "cell_type string, gene string, profile double"), ["a", "b"]).collect()}
    plain, more = run(profiles), run(profiles + [("a", "unmeasured", 0.9)])
    assert plain == more
    assert plain["s0"][0] > 0.9 and plain["s1"][1] > 0.9 and plain["s2"] is None


def test_missing_spots_stay_missing_and_bad_output_raises(spark):
    import pytest

    from spotweave.operators import proportions

    merged = spark.createDataFrame([("s0", "t", 1.0)], "spot_id string, cell_type string, p double")
    spots = spark.createDataFrame([("s1",)], "spot_id string")
    types = spark.createDataFrame([("t",), ("u",)], "cell_type string")
    rows = {(r["spot_id"], r["cell_type"]): r["p"] for r in proportions.with_missing_spots(merged, spots, types).collect()}
    assert rows == {("s0", "t"): 1.0, ("s1", "t"): None, ("s1", "u"): None}
    proportions.require_valid({"n_missing_types": 0, "row_sum_min": 1.0})
    with pytest.raises(ValueError):
        proportions.require_valid({"n_missing_types": 1})


def test_profiles_without_a_row_per_cell_and_gene(spark):
    """Rows of a gene in a cell are summed with all others of its type, and never first by cell and gene."""
    from spotweave.operators import counts

    rows = [("a", "G1", 1.0), ("a", "G1", 2.0), ("a", "G2", 1.0), ("b", "G1", 5.0), ("c", "G2", None), ("d", "G2", 4.0), (None, "G1", 1.0)]
    cells = [("a", "T"), ("b", "T"), ("c", "T"), ("d", "U")]
    found = counts.reference_profiles(spark.createDataFrame(rows, "cell_id string, gene string, count double"), spark.createDataFrame(cells, "cell_id string, cell_type string"))
    aggregates = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in line]
    assert not [line for line in aggregates if "cell_id" in line and "gene" in line]
    assert sorted(tuple(r) for r in found.collect()) == [("T", "G1", 0.875), ("T", "G2", 0.125), ("U", "G2", 1.0)]
