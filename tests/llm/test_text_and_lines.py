import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spotweave.llm import linededup
from spotweave.llm.text import distinct_per_text, shingles_of, slabs, words_of

PAGES = "doc_id long, source string, text string, site string, row string, line string, dropped string"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_words_and_shingles_agree_with_regular_expressions(texts):
    found = words_of(texts)
    shingles, offsets = shingles_of(found)
    plain = [words(text) for text in texts]
    assert np.diff(found.offsets).tolist() == [len(w) for w in plain] if texts else True
    expected = [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w) for w in plain]
    seen = {}
    for i, own in enumerate(expected):
        part = shingles[offsets[i] : offsets[i + 1]].tolist()
        assert len(part) == len(own)
        for value, shingle in zip(part, own, strict=True):
            assert seen.setdefault(shingle, value) == value
    assert len(set(seen.values())) == len(seen)


def test_words_over_256_characters_differ():
    a, b = "x" * 300 + "y" + "x" * 300, "x" * 301 + "y" + "x" * 299
    assert len(set(words_of([a, b, a[:-1]]).hashes.tolist())) == 3


def test_slabs_cover_all_texts_and_distinct_counts():
    texts = ["a" * n for n in (5, 0, 30, 1)] + [None]
    assert [text for _, part in slabs(texts, 10) for text in part] == [text or "" for text in texts]
    values, counts, offsets = distinct_per_text(np.array([3, 1, 3, 9], np.uint64), np.array([0, 3, 3, 4]))
    assert (values.tolist(), counts.tolist(), offsets.tolist()) == ([1, 3, 9], [1, 2, 1], [0, 2, 2, 3])


def brute(rows, max_ratio, min_pages, spare):
    pages = {}
    for _, source, text in rows:
        pages.setdefault(source, []).append({line.strip(" \t\r") for line in (text or "").split("\n")} - {""})
    out = []
    for doc, source, text in rows:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        held = lambda line: sum(line in page for page in pages[source])  # noqa: B023, E731
        lines = text.split("\n")
        kept = [x for x in lines if not (x.strip(" \t\r") and held(x.strip(" \t\r")) > max_ratio * len(pages[source]) and held(x.strip(" \t\r")) >= min_pages)]
        if spare and not any(x.strip(" \t\r") for x in kept):
            kept = lines
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for doc in range(120):
        source = [None, "a", "b", "c"][doc % 4]
        lines = [f"own {doc}"] + [f"line {k}" for k in rng.integers(0, 12, 3)] + (["menu \t"] if doc % 3 else [" menu\r"]) * (source != "c") + [""]
        rows.append((doc, source, "\n".join(lines)))
    rows += [(600 + k, "b", "copy one\n\ncopy two") for k in range(20)]
    rows += [(500, "a", None), (501, "a", ""), (502, None, "\n\n"), (3, "c", rows[3][2]), (3, "c", rows[3][2]), (None, "z", "solo")]
    frame = spark.createDataFrame([(*row, "s", "r", "l", "d") for row in rows], PAGES)
    for limit, ratio, floor, spare in ((1 << 20, 0.3, 3, True), (-1, 0.3, 3, True), (1 << 20, 0.1, 2, False)):  # broadcast, and the salted join
        want = brute(rows, ratio, floor, spare)
        monkeypatch.setattr(linededup, "BROADCAST_BYTES", limit)
        out = linededup.drop_boilerplate(frame, max_ratio=ratio, min_pages=floor, spare_whole_pages=spare)
        got = sorted([(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["cleaned"]) for r in out.collect()], key=repr)
        assert got == want
    kept = linededup.without_boilerplate(frame, max_ratio=0.3, min_pages=3)
    assert kept.columns == frame.columns and kept.count() == len(rows)
    assert {r["line"] for r in kept.collect()} == {"l"}


def test_small_sites_and_pages_of_boilerplate(spark):
    """A header on all four pages of a site goes, and so does a page of nothing but header and footer."""
    rows = [(i, "four", f"Header\nown {i}", "s", "r", "l", "d") for i in range(4)] + [(10 + i, "many", "Top\nEnd" + f"\nown {i}" * (i % 2), "s", "r", "l", "d") for i in range(12)]
    got = {r["row"]["doc_id"]: r["cleaned"] for r in linededup.drop_boilerplate(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {**{i: f"own {i}" for i in range(4)}, **{10 + i: f"own {i}" * (i % 2) for i in range(12)}}


def test_no_pages(spark):
    assert linededup.without_boilerplate(spark.createDataFrame([], PAGES)).count() == 0
