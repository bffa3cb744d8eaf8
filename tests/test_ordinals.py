import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotweave.operators import counts, ordinals


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows, and one value half of them."""
    rng = np.random.default_rng(1)
    n = 3000
    frame = pd.DataFrame({
        "id": np.arange(n), "k": np.where(rng.random(n) < 0.66, "hot", rng.integers(0, 20, n).astype(str)),
        "v": np.where(rng.random(n) < 0.5, 0.0, rng.integers(0, 50, n) / 4.0),
    })
    return frame, spark.createDataFrame(frame).repartition(6)


def test_running_total_matches_cumsum(skewed):
    frame, df = skewed
    got = ordinals.running_total(df, ["k"], ["v", "id"], "v", "before", slices=7).toPandas().sort_values("id")
    want = frame.sort_values(["k", "v", "id"])
    want = (want.groupby("k").v.cumsum() - want.v).sort_index()
    assert np.allclose(got.before.to_numpy(), want.to_numpy())


def test_ordinal_is_dense(skewed):
    frame, df = skewed
    got = ordinals.ordinal(df, ["v", "id"]).toPandas().sort_values(["v", "id"])
    assert got.ordinal.tolist() == list(range(len(frame)))


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_average_rank_with_hot_values(skewed, monkeypatch, hot_rows):
    frame, df = skewed
    monkeypatch.setattr(ordinals.lookup, "__defaults__", ("left", hot_rows))
    got = ordinals.average_rank(df, ["k"], "v").toPandas().sort_values("id")
    assert np.allclose(got["rank"].to_numpy(), frame.groupby("k").v.rank().to_numpy())
    assert len(got) == len(frame)


def test_null_values_have_no_rank(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id int, v double")
    assert {r.id: r["rank"] for r in ordinals.average_rank(df, [], "v").collect()} == {1: 2.0, 2: None, 3: 1.0}


def test_exact_median(skewed):
    frame, df = skewed
    got = ordinals.exact_median(df, "v", ["k"]).toPandas().set_index("k")["median"].sort_index()
    assert np.allclose(got.to_numpy(), frame.groupby("k").v.median().sort_index().to_numpy())


def test_seeded_split_has_exact_size(spark):
    df = spark.range(37).withColumnRenamed("id", "s")
    got = ordinals.seeded_split(df, "s", 0.1, 5, 37)
    assert got.where("is_validation").count() == 4
    assert got.where("is_validation").exceptAll(ordinals.seeded_split(df, "s", 0.1, 5, 37).where("is_validation")).count() == 0
    with pytest.raises(ValueError):
        ordinals.seeded_split(df, "s", 1.0, 0, 1)


def test_unique_names_skip_taken_suffixes(spark):
    names = ["A", "A", "A-1", "B", "A", "A-3", "A", "B"]
    df = spark.createDataFrame(list(enumerate(names)), "gene_row long, gene string")
    got = {r.gene_row: r.unique_name for r in counts.unique_gene_names(df).collect()}
    assert [got[i] for i in range(8)] == ["A", "A-2", "A-1", "B", "A-4", "A-3", "A-5", "B-1"]


def test_last_wins_ignores_row_order(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 9, None), ("b", 1, 1.0)], "k string, o int, v double")
    for rows in (df, df.orderBy(F.desc("o"))):
        assert {r.k: r.v for r in ordinals.last_wins(rows, ["k"], "o").collect()} == {"a": None, "b": 1.0}


def test_vector_aggregates_follow_one_rule_at_all_widths(spark):
    import pytest
    from pyspark.sql import functions as F

    from spotweave.functions.vectors import vector_mean, vector_pop_std, vector_sum

    for size, width in ((3, 3), (31, 31), (33, 33), (31, None), (33, None)):
        rows = [(1, [3.0] * size, 1.0), (1, [4.0] * size, 3.0), (1, None, 5.0), (2, [1.0] * size, 2.0)]
        frame = spark.createDataFrame(rows, "k int, v array<double>, w double")
        out = frame.groupBy("k").agg(vector_sum(F.col("v"), width, F.col("w")).alias("s"), vector_mean(F.col("v"), width, F.col("w")).alias("m"), vector_pop_std(F.col("v"), width).alias("d"))
        got = {r["k"]: r for r in out.collect()}
        assert got[1]["s"] == pytest.approx([15.0] * size) and got[1]["m"] == pytest.approx([3.75] * size) and got[1]["d"] == pytest.approx([0.5] * size)
        assert got[2]["m"] == pytest.approx([1.0] * size)
        for bad in ((3, [1.0] * (size - 1) + [None], 1.0), (3, [1.0] * size, -1.0)):
            with pytest.raises(Exception):
                spark.createDataFrame([*rows, bad], frame.schema).groupBy("k").agg(vector_sum(F.col("v"), width, F.col("w"))).collect()


def test_equal_rows_of_a_hot_key_are_looked_up(spark):
    from pyspark.sql import functions as F

    from spotweave.operators.ordinals import lookup

    left = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    right = left.distinct().withColumn("v", F.col("k") * 2)
    out = lookup(left, right, ["k"], hot_rows=100)
    assert out.count() == 4000 and out.where("v <> 2 * k OR v IS NULL").isEmpty()
