import numpy as np
from pyspark.sql import functions as F

from spotweave.llm import forest

SCHEMA = "vec_id long, embedding array<float>, rank long, score string, width int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "s", 2) for i, v in rows], SCHEMA)


def brute(rows, k):
    best = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, np.float32).astype(float).tolist()
        best[i] = max(best.get(i, v), v)
    out = {}
    for q, a in best.items():
        if q % 20 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in best.items() if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(frame, k, **options):
    out = {}
    for r in sorted(forest.nearest(frame, F.col("vec_id") % 20 == 0, k, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


def test_exact_on_few_rows_with_odd_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 4) / 2).tolist()) for i in range(200)]
    rows += [(1000 + i, [1.5, 1.0, 0.5, 1.0]) for i in range(60)]  # copies, more than a query asks for, queries among them
    rows += [(2000, None), (2001, []), (2020, [0.0] * 4), (2040, [1.0, None, 1.0, 1.0]), (2060, [float("nan")] * 4), (2080, [float("inf"), 0, 0, 0]), (None, [1.0] * 4)]
    rows += [(40, [9.0, 0.0, 0.0, 0.0]), (41, rows[41][1]), (3000, [1.0, 2.0]), (3001, [2.0, 2.0]), (3020, [-1.0, 0.0]), (4000, [1.0] * 7)]
    want, got = brute(rows, 5), found(table(spark, rows).repartition(5), 5, target=1.1)
    assert {q: v for q, v in want.items() if v} == {q: [(i, round(s, 9)) for i, s in v] for q, v in got.items()}
    assert 4000 not in got and len(got[3000]) == 2


def test_empty(spark):
    assert forest.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert forest.nearest(table(spark, [(7, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert forest.nearest(table(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def clustered(rng, groups, each, noise):
    centres = rng.standard_normal((groups, 24))
    return [(g * each + i, (c + noise * rng.standard_normal(24)).tolist()) for g, c in enumerate(centres) for i in range(each)]


def test_recall_with_many_slices(spark, monkeypatch):
    """Groups of near vectors, one of them large; slices so small that prefixes stretch over them, and few queries per task."""
    monkeypatch.setattr(forest, "ENTRIES_PER_SLICE", 3000)
    monkeypatch.setattr(forest, "QUERIES_PER_TASK", 16)
    seen = {}
    plain = forest._candidates

    def watched(classes, arrays, queries, over, k):
        seen["levels"] = [r["level"] for r in queries.select("class_id", "level").distinct().collect()]
        return plain(classes, arrays, queries, over, k)

    monkeypatch.setattr(forest, "_candidates", watched)
    rng = np.random.default_rng(5)
    rows = clustered(rng, 60, 40, 0.3) + [(10_000 + i, v) for i, v in clustered(rng, 1, 800, 0.05)]
    want, got = brute(rows, 10), found(table(spark, rows), 10)
    recall = np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 10 for q in want])
    assert recall >= 0.9
    assert len(set(seen["levels"])) > 1 and min(seen["levels"]) > 0  # dense places descend further


def test_prefix_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(forest, "ENTRIES_PER_SLICE", 400)
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in clustered(rng, 6, 40, 0.2)]
    frame = forest.usable_vectors(table(spark, rows)).withColumn("is_query", F.col("vec_id") % 20 == 0)
    classes = forest.classes_of(frame, 3).join(frame.select("vector", "is_query"), "vector")
    largest = {24: max(float(np.linalg.norm(np.array(v, np.float32))) for _, v in rows)}
    arrays = forest.sliced(forest.entries(classes, largest))
    queries, over = forest.described(arrays)
    made = arrays.toPandas()
    assert made["slice"].nunique() > 5 and over.count() > 10
    text = {t: [bytes(s).hex() for s in part.loc[~part.is_query, "string"]] for t, part in made.groupby("tree")}
    told = queries.collect()
    assert len(told) == 12 * forest.TREES
    for r in told:
        own = bytes(r["string"]).hex()
        assert r["counts"] == [sum(s[:n] == own[:n] for s in text[r["tree"]]) for n in range(forest.SYMBOLS + 1)]


def test_strings_do_not_depend_on_the_batch():
    vectors = np.random.default_rng(1).standard_normal((700, 24))
    planes, largest = forest.projections(24), float(np.linalg.norm(vectors, axis=1).max())
    whole = forest.strings(vectors, largest, planes, False)
    assert np.array_equal(whole[::-1], forest.strings(vectors[::-1], largest, planes, False))
    assert np.array_equal(whole[13:14], forest.strings(vectors[13:14], largest, planes, False))
