import re
from collections import Counter

import numpy as np
import pytest

from spotweave.llm import decontam, jaccard
from spotweave.llm.components import components

SCHEMA = "doc_id long, text string, h string, node string, lang string"


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def corpus(seed, groups=14):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [str(x) for x in rng.choice(words, int(rng.integers(3, 160)))]
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = str(rng.choice(words))
            rows.append((doc, " ".join(own) if rng.random() < 0.8 else " ".join(own).upper()))
            doc += 1
    return rows + [(doc + k, text) for k, text in enumerate([None, None, "", "", "?!", "one two", "One, two.", "one"])] + [rows[0], rows[0], (None, rows[5][1])]


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    links = Counter()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((repr(doc), links[i], repr(least.get(find(i)))) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("tiny", [False, True])
def test_links_and_classes_against_brute_force(spark, monkeypatch, tiny):
    if tiny:  # every run and group is tiled, every text fetched by shuffle
        for name, value in (("RUN_TEXTS", 2), ("GROUP_TEXTS", 3), ("BROADCAST_TEXTS", 0)):
            monkeypatch.setattr(jaccard, name, value)
    rows = corpus(3 + tiny, 6 if tiny else 14)
    frame = spark.createDataFrame([(*row, "h", "n", "l") for row in rows], SCHEMA)
    got = jaccard.near_duplicates(frame).collect()
    assert sorted((repr(r["doc_id"]), r["n_links"], repr(r["class_id"])) for r in got) == brute(rows)
    kept = jaccard.one_per_class(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(repr, ids)) == sorted(c for c in {(c, None if shingles(t) else k) for (_, _, c), (k, t) in zip(sorted(brute(rows)), sorted(((repr(d), t) for d, t in rows), key=lambda x: x[0]), strict=True)} for c in [c[0]])


def test_nothing_to_compare(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_duplicates(frame).count() == 0
    assert jaccard.one_per_class(frame).count() == 0
    lone = spark.createDataFrame([(1, "a b c d e f", "h", "n", "l"), (2, None, "h", "n", "l")], SCHEMA)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(lone).collect()) == [(1, 1, 0), (2, 2, 0)]


def test_depth_follows_recall():
    assert jaccard.matched_depth(recall=0.5) == jaccard.DEPTH
    depth = jaccard.matched_depth()
    assert 1 - (1 - 0.8**depth) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** jaccard.TREES


def forest_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").selectExpr("key", "text", "key AS h", "cast(length(text) AS long) AS n_chars")
    signed = jaccard.signatures(rows).selectExpr("row.h AS node", "posexplode(arrays_zip(floors, tails)) AS (tree, own)", "bytes")
    entries = signed.selectExpr("cast(tree AS long) AS tree", "own.floors AS floor", "own.tails AS tail", "node").cache()
    return entries, jaccard.signatures(rows).selectExpr("row.h AS node", "bytes")


def sparse_and_dense(seed=8):
    """Texts 0 to 39: near copies of one text; 40 to 79: pairs of similarity 0.8 to 0.85."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(3000)]
    base = [str(x) for x in rng.choice(words, 300)]
    dense = [" ".join(base[:k] + ["new"] + base[k:]) for k in range(5, 205, 5)]
    sparse = []
    for _ in range(20):
        own = [str(x) for x in rng.choice(words, 200)]
        edited = list(own)
        for at in (20, 70, 120, 170):
            edited[at] = "other"
        sparse += [" ".join(own), " ".join(edited)]
    return dense + sparse


def test_prefixes_are_shortened_only_where_texts_are_not_connected(spark):
    entries, marks = forest_of(spark, sparse_and_dense())
    roots = {r["node"]: r["root"] for r in jaccard.connected(entries, marks).collect()}
    assert {roots[k] for k in range(40)} == {0}
    assert [roots.get(40 + k, 40 + k) for k in range(40)] == [40 + k // 2 * 2 for k in range(40)]
    # Whole strings connect all near copies: no shorter prefix is searched for them, though hundreds of their nodes grow.
    deepest = jaccard.unsettled(entries, None, jaccard.DEPTH)
    assert deepest.filter("node < 40").select("node").distinct().count() == 40
    whole = spark.createDataFrame([(k, 0) for k in range(40)], "node long, root long")
    shorter = {depth: {r["node"] for r in jaccard.unsettled(entries, whole, depth).select("node").distinct().collect()} for depth in range(jaccard.matched_depth(), jaccard.DEPTH)}
    assert not any(node < 40 for nodes in shorter.values() for node in nodes)
    # Pairs at the threshold do not all meet at whole strings, but they do at the shortest prefix.
    met = {r["node"] for r in deepest.select("node").distinct().collect()} - set(range(40))
    assert shorter[jaccard.matched_depth()] and met | set().union(*shorter.values()) == set(range(40, 80))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_forest_connects_what_its_shortest_prefixes_would(spark, monkeypatch, chunk):
    """Against a loop over all pairs that share a shortest prefix and whose estimate is high enough."""
    monkeypatch.setattr(jaccard, "RUN_TEXTS", chunk)
    texts = sparse_and_dense(9)[20:] + [text for _, text in corpus(12) if shingles(text)]
    entries, marks = forest_of(spark, texts)
    own = {r["node"]: np.frombuffer(r["bytes"], np.uint8) for r in marks.collect()}
    nodes: dict = {}
    for r in entries.collect():
        nodes.setdefault((r["tree"], r["floor"]), []).append(r["node"])
    edges = [(a, b) for group in nodes.values() for a in group for b in group if a < b and (own[a] == own[b]).mean() >= jaccard.THRESHOLD - jaccard.MARGIN]
    want = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {r["node"]: r["root"] for r in jaccard.connected(entries, marks).collect()} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 199)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def spoiled(rng, items, words, n):
    texts = []
    for _ in range(n):
        w = str(rng.choice([t for _, t in items if t and len(t.split()) > 1])).split()
        for _ in range(int(rng.integers(0, 3))):
            at, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 4))
            if kind == 0:
                w[at] = "changed"
            elif kind == 1:
                w.insert(at, "more")
            elif kind == 2 and len(w) > 1:
                del w[at]
            else:
                w = w[int(rng.integers(0, min(4, len(w)))) :] or w
        pads = [" ".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(2)]
        texts.append(f"{pads[0]}\n{' '.join(w).title()}, {pads[1]}")
    return texts


def exact(texts, index):
    """Every placement of every item that shares a shingle with a text, a few places around."""
    where: dict[int, list] = {}
    for item, sequence in enumerate(index.shingles):
        for place, value in enumerate(sequence.tolist()):
            where.setdefault(value, []).append((item, place))
    for text in texts:
        own, _ = decontam.shingles_of(decontam.words_of([text or ""]))
        best = {}
        for at, value in enumerate(own.tolist()):
            for item, place in where.get(value, ()):
                wanted = index.shingles[item]
                for start in range(at - place - 4, at - place + 5):
                    start = min(max(start, 0), max(0, len(own) - len(wanted)))
                    value = decontam.similarity(own[start : start + len(wanted)], wanted, index.weights)
                    if value >= 0.8:
                        best[index.ids[item]] = max(best.get(index.ids[item], 0), value)
        yield best


def test_benchmark_items_against_all_placements(spark):
    rng = np.random.default_rng(9)
    words = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(words, int(n)))) for k, n in enumerate(rng.integers(1, 120, 60))] + [(60, None), (61, ""), (62, "?!")]
    items += [(63, items[40][1]), (64, "a a a a a a a a a a a a")]
    texts = spoiled(rng, items, words, 600) + [None, "", "v1", " ".join(rng.choice(words, 3000)), "b " * 10 + "a " * 12]
    index = decontam.index_of(items)
    truth = list(exact(texts, index))
    found = [{x["item_id"]: x["similarity"] for x in own} for own in decontam.matches(texts, index)]
    assert all(set(f) <= set(t) for f, t in zip(found, truth, strict=True))
    hit, all_true = sum(len(f) for f in found), sum(len(t) for t in truth)
    assert all_true > 300 and hit >= 0.98 * all_true
    frame = spark.createDataFrame([(k, text, "h", "n", "l") for k, text in enumerate(texts)] + [(None, items[30][1], "h", "n", "l")], SCHEMA)
    bench = spark.createDataFrame([(*item, "x") for item in items], "item_id long, text string, found string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench).collect()}
    assert got - {(None, 30)} == {(k, item) for k, own in enumerate(found) for item in own} and (None, 30) in got
    clean = decontam.without_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [k for k, own in enumerate(found) if not own]


def test_many_scans_and_no_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS_PER_SCAN", 2)
    frame = spark.createDataFrame([(1, "a b c d e f g h i j k l", "h", "n", "l"), (2, "zz", "h", "n", "l")], SCHEMA)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c d e f g h i j k l", "nn mm oo", "pp", "qq rr", None])], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["n_words"]) for r in decontam.contaminated(frame, bench).collect()] == [(1, 0, 0, 12)]
    assert [r["doc_id"] for r in decontam.without_contaminated(frame, bench).collect()] == [2]
    assert decontam.contaminated(frame, bench.limit(0)).count() == 0
    assert decontam.without_contaminated(frame.limit(0), bench).count() == 0


def test_hamming_lookup_is_complete():
    rng = np.random.default_rng(1)
    marks = rng.integers(0, 2**63, 300, np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 10)), replace=False)) for _ in range(300)]
    asked = marks ^ np.array(flips, np.uint64)
    table = decontam.Blocks(marks)
    found = set(zip(*(x.tolist() for x in table.within(asked)), strict=True))
    want = {(i, j) for i in range(300) for j in range(300) if int(np.bitwise_count(asked[i] ^ marks[j])) <= decontam.RADIUS}
    assert found == want


def weighed(text, item, items):
    """The best weighted similarity of an item and the windows of its size, by plain loops over tuples of words."""
    bag = lambda t: [tuple(w[k : k + 5]) for w in [re.findall(r"\w+", t.lower())] for k in range(len(w) - 4)]
    holders = Counter(s for own in {tuple(bag(t)) for t in items} for s in set(own))
    own, wanted = bag(text), Counter(bag(item))
    n = sum(wanted.values())
    mean = sum(k / holders[s] for s, k in wanted.items()) / n
    best = 0
    for start in range(max(1, len(own) - n + 1)):
        window = Counter(own[start : start + n])
        weight = {s: 1 / holders[s] if s in holders else mean for s in window | wanted}
        best = max(best, sum(weight[s] * k for s, k in (window & wanted).items()) / sum(weight[s] * k for s, k in (window | wanted).items()))
    return best


def test_repeated_and_templated_items_in_any_number_of_scans(spark, monkeypatch):
    rng = np.random.default_rng(21)
    fresh = lambda n: [f"x{k}" for k in rng.integers(0, 10**6, n)]
    repeated, frame_words = [fresh(50), fresh(80)], fresh(60)
    templated = [[*frame_words[:30], *fresh(20), *frame_words[30:]] for _ in range(6)]
    items = [" ".join(repeated[0])] * 10 + [" ".join(repeated[1]).upper(), " ".join(repeated[1]) + "."] + [" ".join(w) for w in templated]
    edited = lambda w, *places: " ".join([*fresh(20), *("edited" if k in places else x for k, x in enumerate(w)), *fresh(20)])
    texts = [edited(repeated[0], 25), edited(repeated[1], 40)] + [edited(templated[0], place) for place in (12, 40, 70)] + [edited(templated[1], 8), " ".join(fresh(200))]
    want = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if weighed(text, item, items) >= 0.8}
    assert {(0, i) for i in range(10)} | {(1, 10), (1, 11), (2, 12), (5, 13)} <= want
    frame = spark.createDataFrame([(d, text, "h", "n", "l") for d, text in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for limit in (5000, 3):
        monkeypatch.setattr(decontam, "ITEMS_PER_SCAN", limit)
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(frame, bench).collect()}
        assert set(got) == want
        assert all(abs(value - weighed(texts[d], items[i], items)) < 1e-9 for (d, i), value in got.items())


def test_scattered_edits_growing_with_the_item():
    rng = np.random.default_rng(33)
    fresh = lambda n: [f"x{k}" for k in rng.integers(0, 10**6, n)]
    cases = [(n, n // 50, kinds) for n in (100, 200, 300) for kinds in ("r", "rid") for _ in range(60)] + [(1500, 30, kinds) for kinds in ("r", "rid") for _ in range(8)]
    items = [fresh(n) for n, _, _ in cases]
    bodies, texts = [" ".join(w) for w in items], []
    for w, (_, edits, kinds) in zip(items, cases, strict=True):
        w = list(w)
        for place in sorted(rng.choice(len(w), edits, replace=False).tolist(), reverse=True):
            kind = rng.choice(list(kinds))
            w[place : place + (kind != "i")] = [] if kind == "d" else ["edited"]
        texts.append(" ".join([*fresh(int(rng.integers(5, 20))), *w, *fresh(15)]))
    found = list(decontam.matches(texts, decontam.index_of(list(enumerate(bodies)))))
    want = [weighed(text, body, [body]) for text, body in zip(texts, bodies, strict=True)]
    got = [{x["item_id"]: x["similarity"] for x in own} for own in found]
    assert sum(value >= 0.8 for value in want) > 250
    for k, value in enumerate(want):
        assert set(got[k]) == ({k} if value >= 0.8 else set())
        assert value < 0.8 or abs(got[k][k] - value) < 1e-9


def test_long_insertion_before_the_intact_part():
    words = [f"y{k}" for k in range(400)]
    index = decontam.index_of([(1, " ".join(words))])
    text = " ".join([*words[:60], *(f"z{k}" for k in range(12)), *words[60:330], *words[342:], *(f"u{k}" for k in range(30))])
    assert [x["item_id"] for x in next(decontam.matches([text], index))] == [1]


def test_rounds_on_few_edges_run_in_few_tasks(spark, monkeypatch):
    from spotweave.llm import components as module

    made, durable = [], module.durable
    monkeypatch.setattr(module, "durable", lambda df: made.append(durable(df)) or made[-1])
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)]
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}
    assert len(made) > 2 and max(df.rdd.getNumPartitions() for df in made[1:]) <= 8
