import zlib

import numpy as np
from pyspark.sql import functions as F

from spotweave.llm import langid, toxicity

SYLLABLES = {"aa": ["the", "ing", "er", "th", "on", "re"], "bb": ["sch", "ung", "ein", "ver", "ö", "keit"], "cc": ["ción", "que", "os", "ñ", "ar", "mente"]}
SCHEMA = "doc_id long, text string, lang string, row string, score string"


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(words))


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        rows.append((i, prose(rng, lang, int(rng.integers(5, 40))), lang if i % 7 else None, "r", "s"))
    return rows


def test_languages(spark):
    rng = np.random.default_rng(1)
    rows = corpus(rng, 240)
    odd = [(1000, None, "aa", "r", "s"), (1001, "", "bb", "r", "s"), (1002, "123 --- 456", "cc", "r", "s"), (1003, "ciónque", None, "r", "s"), (None, rows[0][1], "aa", "r", "s"), (1, rows[1][1], "bb", "r", "s"), (1004, "que " * 60000, None, "r", "s")]
    frame = spark.createDataFrame(rows + odd, SCHEMA)
    model = langid.learn(frame.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), F.col("doc_id"), per_language=20)
    assert sorted(model) == ["aa", "bb", "cc"]
    got = {r["row"]["doc_id"]: r for r in langid.identify(frame, model).collect()}
    assert len(got) == len({r[0] for r in rows + odd})
    held = [row for row in rows if zlib.crc32(str(row[0]).encode()) % 4 == 2]
    truth = lambda i: list(SYLLABLES)[i % 3]
    assert sum(got[row[0]]["lang_pred"] == truth(row[0]) for row in held) >= 0.98 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "cc" and got[1004]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_tasks_without_texts(spark, tmp_path):
    """More tasks than rows, and a file with fewer row groups than splits: tasks without a row hand on nothing."""
    rows = [(i, prose(np.random.default_rng(i), lang, 12), lang, "r", "s") for i, lang in enumerate(SYLLABLES)]
    spread = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert sorted(langid.learn(spread, F.col("doc_id"))) == ["aa", "bb", "cc"]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        stored = spark.read.parquet(f"{tmp_path}/documents")
        assert stored.rdd.getNumPartitions() > 3
        model = langid.learn(stored, F.col("doc_id"))
        assert sorted(r["lang_pred"] for r in langid.identify(stored, model).collect()) == ["aa", "bb", "cc"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_predictions_against_loops(spark):
    """Prototypes, cosines and predictions by plain sums over trigrams; of equal cosines the first name wins."""
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, list(SYLLABLES)[i % 3], 8), list(SYLLABLES)[i % 3], "r", "s") for i in range(24)] + [(24, "aha", "zz", "r", "s"), (25, "aha", "yy", "r", "s")]
    letters = langid._letters()

    def vector(text):
        total = np.zeros(langid.DIMENSIONS)
        codes, counts, _ = langid.trigrams([text])
        for code, n in zip(codes.tolist(), counts.tolist()):
            a, b, c = code // 4096**2, code // 4096 % 4096, code % 4096
            total += n * (letters[0][a].astype(float) * letters[1][b] * letters[2][c])
        return total / np.linalg.norm(total)

    sums = {}
    for _, text, lang, _, _ in rows:
        sums[lang] = sums.get(lang, 0) + vector(text)
    near = lambda text: {lang: float(vector(text) @ s / np.linalg.norm(s)) for lang, s in sums.items()}
    frame = spark.createDataFrame(rows, SCHEMA)
    for r in langid.identify(frame, langid.learn(frame, F.col("doc_id"))).collect():
        cosines = near(r["row"]["text"])
        assert r["lang_pred"] == min(cosines, key=lambda lang: (-round(cosines[lang], 9), lang))
        assert abs(r["score"] - max(cosines.values())) < 1e-5


def test_texts_in_no_learned_language_are_not_recognised(spark):
    """Long texts of other letters or of random ones are not recognised; short ones and all of the learned languages are."""
    rng = np.random.default_rng(6)
    rows = corpus(rng, 120)
    random = lambda letters, n: "".join(rng.choice(list(letters), n))
    cyrillic, noise = "абвгдежзиклмнопрстуфхцчшщыэюя ", "qxzjkvwyfpb0 "
    odd = [(900, random(cyrillic, 4000), None), (901, random(noise, 4000), None), (902, random(cyrillic, 40), None), (903, "??", None), (904, None, None), (905, "the " + random("  xq", 20), None)]
    frame = spark.createDataFrame([(d, t, lang, "r", "s") for d, t, lang, *_ in rows + odd], SCHEMA)
    found = langid.identify(frame, langid.learn(frame, F.col("doc_id")))
    got = {r["doc_id"]: (r["ok"], r["n_letters"]) for r in found.select("row.doc_id", langid.recognised().alias("ok"), "n_letters").collect()}
    assert all(got[row[0]][0] for row in rows)
    assert [got[i][0] for i in range(900, 906)] == [False, False, True, False, False, True]
    assert all(got[d][1] == sum(c.isalpha() for c in (t or "").lower()) for d, t, *_ in rows + odd)


def test_no_languages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.learn(empty, F.col("doc_id")) == {}
    frame = spark.createDataFrame([(1, "the", None, "r", "s")], SCHEMA)
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(frame, {}).collect()] == [("und", 0.0)]


def test_bundles_against_loops():
    rng = np.random.default_rng(4)
    letters = langid._letters()
    text = prose(rng, "bb", 9) + ", Über!"
    codes, counts, _ = langid.trigrams([text])
    plain: dict[str, int] = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        word = f" {word} "
        for k in range(1, len(word) - 1):
            plain[word[k - 1 : k + 2]] = plain.get(word[k - 1 : k + 2], 0) + 1
    slot = lambda c: 0 if c == " " else 1 + ord(c) % 4095
    total = sum(n * letters[0][slot(g[0])].astype(int) * letters[1][slot(g[1])] * letters[2][slot(g[2])] for g, n in plain.items())
    assert np.array_equal(langid.Bundler().bundle(codes, counts), total)


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(7)
    bad = ["gromble", "vaxort", "zzukin", "plimor"]
    rows = []
    for i in range(900):
        words = prose(rng, "aa", int(rng.integers(30, 90))).split()
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        rows.append((i, " ".join(words), toxic, "s"))
    labelled = spark.createDataFrame(rows[:600] + [(5000, None, 1, "s"), (None, "x", 0, "s"), (5001, "y", None, "s"), (0, *rows[0][1:])], "doc_id long, text string, toxic int, score string")
    model = toxicity.learn(labelled, F.col("doc_id"))
    texts = spark.createDataFrame([(r[0], r[1], "clash", 1) for r in rows[600:]] + [(9000, None, "c", 1), (9001, "", "c", 1), (9002, "?!", "c", 1), (9003, rows[1][1] * 400, "c", 1)], "doc_id long, text string, score string, row int")
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(texts, model).collect()}
    assert len(got) == 304 and all(0 <= s <= 1 for s in got.values())
    right = sum((got[r[0]] >= toxicity.CUT) == bool(r[2]) for r in rows[600:])
    assert right >= 0.95 * 300
    assert all(got[i] < toxicity.CUT for i in (9000, 9001, 9002))


def test_toxicity_without_labels(spark):
    labelled = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, toxic int")
    model = toxicity.learn(labelled, F.col("doc_id"))
    assert model is None
    assert [r["score"] for r in toxicity.score(labelled, model).collect()] == [0.0]
    assert toxicity.score(labelled.limit(0), model).count() == 0
