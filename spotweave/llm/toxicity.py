"""Toxicity by compression distance: is a window of text shorter under a dictionary of toxic or of ordinary text?

Two zstandard dictionaries are trained: one on windows of ordinary texts, one on words of toxic texts whose beginnings are
significantly more frequent there (counted by distinct preceding words, so that copies of one text count once). Each window
of a few words is compressed with the ordinary dictionary and with the ordinary one followed by the toxic one; the bytes
saved by the second are the window's gap. Statistics of a text's gaps are calibrated by logistic regression on labelled
texts, with the intercept set so that 0.7 is the cut of best F1.

Words are runs of word characters of the lower-cased text. Null texts are empty; a text without words has one gap of 0.
Without labels of both kinds, or if no word is significant, every score is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.arrow import per_text
from spotweave.session import durable

#: Labelled texts that are sampled per label (by hash of the id), and their greatest length: the bound of the fit.
SAMPLE_PER_LABEL, SAMPLE_CHARS = {0: 6000, 1: 3000}, 20_000
#: Of these, texts whose windows train the ordinary dictionary.
DICTIONARY_TEXTS = 400
ORDINARY_BYTES, TOXIC_BYTES = 8000, 2048
WINDOW_WORDS = 8
CUT = 0.7
#: A beginning of a word (with the blank before it) qualifies from so many toxic contexts, log ratio and G statistic.
LEAST_CONTEXTS, LEAST_RATIO, LEAST_G = 8, 2.0, 30.0
_STEM = 5


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=16, search_log=5, min_match=6, strategy=zstandard.STRATEGY_GREEDY, target_length=64,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=settings)


_words = re.compile(r"\w+").findall


def windows(text: str, size: int = WINDOW_WORDS) -> list[bytes]:
    words = _words(text.lower())
    return [f" {' '.join(words[a : a + size])} ".encode("utf-8", "replace") for a in range(0, len(words), size)]


class Gaps:
    """Statistics of the gaps of a text's windows."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.plain, self.both = _compressor(ordinary).compress, _compressor(ordinary + toxic).compress

    def statistics(self, text: str | None) -> list[float]:
        plain, both = self.plain, self.both
        gaps = np.array([len(plain(x)) - len(both(x)) for x in windows(text or "")] or [0])
        top = np.sort(gaps)[::-1][:4]
        return [float(top[0]), float(top.sum()), float((gaps >= 2).sum()), float((gaps >= 3).mean()), float((gaps >= 3).sum()), float(gaps.mean()), math.log(len(text or "") + 1)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def score(self, statistics: np.ndarray) -> np.ndarray:
        """Statistics beyond those of the sample count as its extremes, so that empty and very long texts are not extrapolated."""
        value = (np.clip(statistics, self.low, self.high) - self.middle) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(value, -50, 50)))


def _sample(labelled: DataFrame, key: Column, text: str, label: str) -> DataFrame:
    rows = labelled.select(key.alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("toxic"))
    usable = rows.filter(F.col("toxic").isin(0, 1) & F.col("key").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    place = Window.partitionBy("toxic").orderBy(F.xxhash64("key"), "key")
    bound = F.when(F.col("toxic") == 1, SAMPLE_PER_LABEL[1]).otherwise(SAMPLE_PER_LABEL[0])
    ids = usable.select("key", "toxic").withColumn("n", F.row_number().over(place)).filter((F.col("n") <= SAMPLE_PER_LABEL[0]) & (F.col("n") <= bound))
    return durable(usable.join(F.broadcast(ids.select("key", "toxic").distinct()), ["key", "toxic"], "left_semi"))


def toxic_beginnings(sample: DataFrame) -> list[str]:
    """Shortest beginnings of words that are significantly more frequent in toxic texts."""
    words = sample.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)).alias("w"))
    pairs = words.select("toxic", F.explode(F.transform("w", lambda x, i: F.struct(F.when(i > 0, F.get("w", i - 1)).otherwise("").alias("before"), x.alias("word")))).alias("p"))
    contexts = pairs.select("toxic", "p.before", "p.word").distinct().groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    contexts = durable(contexts.select("word", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))
    total = contexts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    n, m = total["a"] or 0.0, total["b"] or 0.0
    if not n or not m:
        return []
    spaced = F.concat(F.lit(" "), "word", F.lit(" "))
    starts = F.transform(F.sequence(F.lit(_STEM), F.greatest(F.length(spaced), F.lit(_STEM))), lambda i: F.substring(spaced, F.lit(1), i))
    counted = contexts.select(F.explode(F.array_distinct(starts)).alias("start"), "a", "b").groupBy("start").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") >= LEAST_CONTEXTS)
    a, b, share = F.col("a"), F.col("b"), n / (n + m)
    ratio = F.log((a + 0.5) / n) - F.log((b + 0.5) / m)
    g = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    found = {row["start"] for row in counted.filter((ratio > LEAST_RATIO) & (g >= LEAST_G)).select("start").orderBy("start").collect()}
    return sorted(x for x in found if not any(x[:i] in found for i in range(_STEM, len(x))))


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    design = np.c_[x, np.ones(len(x))]
    ridge = 1e-2 * np.eye(design.shape[1])
    w = np.zeros(design.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (p - y)) + ridge @ w)
        w = w - step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return w


def learn(labelled: DataFrame, key: Column, text: str = "text", label: str = "toxic") -> Model | None:
    """The model of a bounded sample of rows with a text and a label 0 or 1; None if nothing can be learned."""
    totals = {row[label]: row["count"] for row in labelled.groupBy(label).count().collect() if row[label] in (0, 1)}
    sample = _sample(labelled, key, text, label)
    starts = toxic_beginnings(sample) if len(totals) == 2 else []
    if not starts:
        return None
    found, lengths = set(starts), range(_STEM, max(map(len, starts)) + 1)
    samples: list[bytes] = []
    toxic = sample.filter("toxic = 1").select("text", F.xxhash64("key", "text").alias("h")).orderBy("h", "text")
    for row in toxic.toLocalIterator():
        for word in _words(row["text"].lower()):
            word = f" {word} "
            if any(word[:i] in found for i in lengths):
                samples.append(word.encode("utf-8", "replace"))
    ordinary = sample.filter("toxic = 0").select("text", F.xxhash64("key", "text").alias("h")).orderBy("h", "text").limit(DICTIONARY_TEXTS).collect()
    plain = _trained(ORDINARY_BYTES, [x for row in ordinary for x in windows(row["text"])])
    bad = _trained(TOXIC_BYTES, [b"".join(samples[a : a + 8]) for a in range(0, len(samples), 8)])
    rows = [(row["toxic"], row["s"]) for row in _statistics(sample, plain, bad, ["key", "toxic"]).select("row.toxic", "s", "row.key").orderBy("key", "s").collect()]
    y, x = np.array([t for t, _ in rows], float), np.array([s for _, s in rows])
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    weight = weight / weight.mean()
    middle, spread = x.mean(0), x.std(0) + 1e-9
    model = Model(plain, bad, middle, spread, _regression((x - middle) / spread, y, weight), x.min(0), x.max(0))
    score = model.score(x)
    order = np.argsort(-score, kind="stable")
    hit, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hit / (taken + (weight * y).sum())))
    middle_cut = (score[order][best] + score[order][min(best + 1, len(order) - 1)]) / 2
    logit = lambda p: math.log(p / (1 - p))
    model.weights[-1] += logit(CUT) - logit(float(np.clip(middle_cut, 1e-6, 1 - 1e-6)))
    return model


def _statistics(texts: DataFrame, ordinary: bytes, toxic: bytes, keep: Sequence[str]) -> DataFrame:
    def make():
        gaps = Gaps(ordinary, toxic)
        return lambda bodies: ((gaps.statistics(body),) for body in bodies)

    return per_text(texts, "text", [("s", pa.list_(pa.float64()), "array<double>")], make, keep)


def score(texts: DataFrame, model: Model | None, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``, all if None) and ``score``, from the text alone."""

    def make():
        if model is None:
            return lambda bodies: ((0.0,) for _ in bodies)
        gaps = Gaps(model.ordinary, model.toxic)

        def work(bodies: list[str | None]) -> Iterator[tuple[float]]:
            for body in bodies:
                yield (float(model.score(np.array(gaps.statistics(body)))),)

        return work

    return per_text(texts, text, [("score", pa.float64(), "double")], make, keep)
