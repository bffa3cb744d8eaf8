import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spotweave.llm import packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  \n\n x", "It's a don't 'so \"'s", "a<|endoftext|>b<|endoftext|>", "<|startoftext|> Ünï 1234 ²³ ½ x́", "ΣΑΣ İstanbul ǅ ß ẞ", "tab\tnew\nline\x0b\x85\xa0 x\x1c\x1d", "日本語 a\x00b",
       "ªº µ ¼ a_b-c--d!!?? ...", "x" * 5000, "hello world " * 2000, "​﻿\xad", "don’t — “stop”"]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def test_counts_of_odd_texts(libraries):
    counter = token_counts.counter(BYTES)
    for text in ODD:
        assert counter.count(text) == len(libraries[0].encode(text, add_special_tokens=False).ids), text[:50]


TEXTS = st.text(st.one_of(st.sampled_from("aeinrst th 'sdmver"), st.sampled_from("<|endoftx>"), st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_of_random_texts(libraries, text):
    words = packing.WordIds(WORDS) if "words" not in CACHE else CACHE["words"]
    CACHE["words"] = words
    assert words.ids([text, "x"])[0].tolist() == libraries[1].encode(text, add_special_tokens=False).ids


CACHE: dict = {}


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeinrst th 'sdmver\n"), st.characters(max_codepoint=0x52F, exclude_categories=["Cs", "Cc", "Cn"])), max_size=60))
def test_counts_of_random_texts(libraries, text):
    assert token_counts.counter(BYTES).count(text) == len(libraries[0].encode(text, add_special_tokens=False).ids)


def test_word_ids_start_anew_when_full(libraries, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 20)
    words = packing.WordIds(WORDS)
    for text in ["one two three four five", "six seven eight nine ten", "eleven one twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"]:
        assert words.ids([text])[0].tolist() == libraries[1].encode(text, add_special_tokens=False).ids


def test_count_tokens_frame(spark, libraries):
    rows = [(i, text, "clash") for i, text in enumerate(ODD)] + [(None, None, None), (0, "", "clash")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(frame, BYTES).collect()
    assert len(got) == len(rows)
    for r in got:
        body = r["row"]["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(body.encode()), len(libraries[0].encode(body, add_special_tokens=False).ids))
    assert token_counts.count_tokens(frame.limit(0), BYTES).count() == 0


def test_pieces_and_packing(spark, libraries, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", 200)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma's", "δ"], int(n))) for n in rng.integers(0, 90, 300)] + ["word " * 700, None, "", "same", "same"]
    rows = [(i if i % 50 else 7, text, 0, 0) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece long, length long")
    pieces = packing.token_pieces(frame, WORDS, capacity=64, with_ids=True)
    got = pieces.collect()
    by = {}
    for r in got:
        by.setdefault((r["row"]["doc_id"], r["row"]["text"]), []).append(r)
    assert len(by) == len(set((d, t) for d, t, _, _ in rows))
    for (_, text), own in by.items():
        ids = libraries[1].encode(text or "", add_special_tokens=False).ids + [1]
        cuts = [ids[a : a + 64] for a in range(0, len(ids), 64)]
        assert set(map(tuple, cuts)) == {tuple(r["ids"]) for r in own}
        for r in own:
            assert r["length"] == len(r["ids"]) and r["start"] == 64 * r["piece"]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    narrow = packing.durable(pieces.select("row.doc_id", "piece", "start", "length", "ids_crc32"))
    packed = packing.pack(narrow, 64).toPandas().sort_values(["sequence_id", "offset"])
    assert len(packed) == len(got)
    ends = packed.groupby("sequence_id")["length"].cumsum()
    assert (packed["offset"] == ends - packed["length"]).all() and ends.max() <= 64
    lengths, counts = np.unique(packed["length"], return_counts=True)
    assert packed["sequence_id"].nunique() <= packing.lower_bound(lengths, counts, 64) + 3


def test_bound_never_exceeds_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 101, rng.integers(1, 60)))[::-1]
        bins, offsets, free = packing.best_fit_decreasing(lengths.tolist(), 100)
        assert packing.lower_bound(*np.unique(lengths, return_counts=True), 100) <= len(free)
        used = [0] * len(free)
        for b, o, n in zip(bins, offsets, lengths.tolist(), strict=True):
            assert used[b] == o
            used[b] += n
        assert all(u + f == 100 for u, f in zip(used, free, strict=True))
    assert packing.lower_bound(np.array([51]), np.array([10]), 100) == 10
    assert packing.lower_bound(np.array([34]), np.array([9]), 100) == 5


def test_packing_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, piece int, length long")
    assert packing.pack(frame, 64).count() == 0
