import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from spotweave.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long"


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def expected(rows, items):
    """Ids and texts before packing, by plain loops. Row order does not matter."""
    rows = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    pages = {}
    for _, text, _, source in rows:
        pages.setdefault(source, []).append({x.strip(" \t\r") for x in text.split("\n")} - {""})
    cut = []
    for doc, text, _, source in rows:
        own = pages[source]
        held = lambda x: sum(x in page for page in own)  # noqa: B023, E731
        kept = [x for x in text.split("\n") if not (x.strip(" \t\r") and held(x.strip(" \t\r")) >= 5 and held(x.strip(" \t\r")) > 0.1 * len(own))]
        cut.append((doc, "\n".join(kept) if any(x.strip(" \t\r") for x in kept) else text))
    sets, root = [shingles(t) for _, t in cut], list(range(len(cut)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(cut)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, text) in enumerate(cut):
        key = find(i) if sets[i] else ("empty", doc)
        if key not in least or doc < least[key][0]:
            least[key] = (doc, text)
    kept = {}
    for doc, text in least.values():
        if not any(shingles(item) and shingles(item) <= shingles(text) for _, item in items):
            kept[doc] = text
    return kept


def test_pipeline_against_loops(spark, tmp_path):
    rng = np.random.default_rng(11)
    vocabulary = {"en": [f"the{k}ing" for k in range(300)], "de": [f"sch{k}ung" for k in range(300)]}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    items = [(k, prose("en", 20)) for k in range(5)] + [(5, None)]
    rows = []
    for doc in range(160):
        lang, source = ("en", "de")[doc % 2], f"s{doc % 3}"
        lines = [prose(lang, int(rng.integers(5, 40))) for _ in range(int(rng.integers(1, 4)))]
        if doc % 3 == 0 and doc % 2 == 0:
            lines.insert(0, "Home | About | Contact this site")
        if doc % 17 == 0:
            lines.append(items[doc % 5][1].title() + "!")
        rows.append((doc, "\n".join(lines), lang, source))
    for doc in range(160, 200):  # exact and near copies
        text = rows[doc - 150][1]
        rows.append((doc, text if doc % 2 else text + " more", rows[doc - 150][2], f"s{doc % 3}"))
    rows += [(300, None, "en", "s0"), (301, "", "en", "s0"), (302, "12 34 !!", None, "s1"), (303, "Home | About | Contact this site", "en", "s0"), (304, "ein wort", None, None), (305, prose("en", 9000), "en", "s2"), (7, *rows[7][1:])]
    frame = spark.createDataFrame([(d, t, lang, s, len(t or ""), "r", 1) for d, t, lang, s in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns, name
    want = expected(rows, items)
    got = {r["doc_id"]: r for r in docs.collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["row"] == "r" for r in got.values())
    assert 40 < len(want) < 195
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = pieces.groupby("doc_id")["length"].sum().to_dict()
    assert lengths == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 4096


def test_names_of_queries_and_stages():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
