"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A letter trigram is bound into one vector: the product of its letters'
vectors, each permuted (rolled) by its place. A text is the bundle (sum) of its trigram vectors, a language the bundle of a
bounded sample of labelled texts; the nearest prototype by cosine is the prediction and the cosine its score.

Texts are lower-cased; whatever is not a letter is a word border, and trigrams may start or end at one. Null texts and texts
without a letter are ``und`` with score 0, as is every text if nothing could be learned. Of equal cosines the language that
comes first by name is taken. Repeated rows are each predicted; while learning, every row of a drawn id counts.

Vectors of unrelated trigrams are nearly orthogonal: the cosine of a text in no learned language spreads around 0 by one over
the root of the dimensions. ``recognised`` is false for a text of enough letters whose best cosine lies within that chance.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.arrow import per_text
from spotweave.llm.text import code_points, distinct_per_text, slabs

DIMENSIONS = 1024
#: Labelled texts that are bundled per language, those with the smallest hashes of their ids.
SAMPLE_PER_LANGUAGE = 1000
#: Vectors of trigrams a worker keeps; others are bound again when they come.
KEPT_TRIGRAMS = 40_000
UNKNOWN = "und"
#: Cosines below so many standard deviations of chance are no language, in texts of at least so many letters.
CHANCE_DEVIATIONS, LEAST_LETTERS = 4.0, 50
#: Cosines closer than this are equal: a matrix product may round the sums of equal rows differently.
TIED = 1e-12
_SLOTS = 4096


@functools.cache
def _slots() -> np.ndarray:
    """0 for what is no letter, else the letter's slot. Beyond 4,095 code points letters share slots."""
    return np.array([1 + c % (_SLOTS - 1) if chr(c).isalpha() else 0 for c in range(0x110000)], np.int16)


@functools.cache
def _letters() -> list[np.ndarray]:
    plain = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (_SLOTS, DIMENSIONS))
    plain[0] = 1
    return [np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1), plain]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigram codes of each text, their counts, and the offsets of the texts."""
    lowered = [text.lower() for text in texts]
    slots = _slots()[code_points(" " + " ".join(lowered) + " ")]
    keep = slots > 0
    keep[1:] |= slots[:-1] > 0
    keep[0] = True
    at = np.flatnonzero(keep)
    slots = slots[at].astype(np.int64)
    codes = (slots[:-2] * _SLOTS + slots[1:-1]) * _SLOTS + slots[2:]
    full = slots[1:-1] > 0
    limits = np.cumsum([0] + [len(text) + 1 for text in lowered])
    return distinct_per_text(codes[full], np.searchsorted(at[1:-1][full], limits))


def bound(codes: np.ndarray) -> np.ndarray:
    first, second, third = _letters()
    return (first[codes // _SLOTS**2] * second[codes // _SLOTS % _SLOTS] * third[codes % _SLOTS]).astype(np.float32)


class Bundler:
    """Bundles of texts; vectors of frequent trigrams are kept between texts."""

    def __init__(self) -> None:
        self.places: dict[int, int] = {}
        self.kept = np.empty((1024, DIMENSIONS), np.float32)

    def _rows(self, codes: np.ndarray) -> np.ndarray | None:
        get = self.places.get
        rows = np.array([get(code, -1) for code in codes.tolist()])
        new = np.flatnonzero(rows < 0)
        if len(new):
            if len(self.places) + len(new) > KEPT_TRIGRAMS:
                return None
            while len(self.places) + len(new) > len(self.kept):
                self.kept = np.concatenate([self.kept, np.empty((2048, DIMENSIONS), np.float32)])
            rows[new] = np.arange(len(self.places), len(self.places) + len(new))
            self.kept[rows[new]] = bound(codes[new])
            self.places.update(zip(codes[new].tolist(), rows[new].tolist(), strict=True))
        return rows

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS, np.float64)
        for a in range(0, len(codes), 4096):
            part = codes[a : a + 4096]
            rows = self._rows(part)
            vectors = bound(part) if rows is None else self.kept[rows]
            total += counts[a : a + 4096].astype(np.float32) @ vectors
        return total


def _bundles(texts: list[str | None], bundler: Bundler) -> Iterator[tuple[np.ndarray, int]]:
    """The bundle of each text and its number of trigrams, which is that of its letters."""
    for _, part in slabs(texts):
        codes, counts, offsets = trigrams(part)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield bundler.bundle(codes[a:b], counts[a:b]), int(counts[a:b].sum())


def learn(labelled: DataFrame, key: Column, per_language: int = SAMPLE_PER_LANGUAGE, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A prototype per value of ``lang``, from the rows given that have a text and a language.

    Every sampled text counts alike: its bundle is brought to length 1 first. At most ``per_language`` ids per language are
    read by the bundling, and one vector per task and language is summed. The ids are the least by hash; a count per language
    first tells below which hash they lie, so that no language passes through one task.
    """
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), key.alias("key")).distinct()
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    low = usable.join(counts, "lang").filter(drawn * F.col("n") <= 2.0 * per_language + 100).select("lang", "key")
    place = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = low.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= per_language).select("lang", "key")
    rows = labelled.select(key.alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen), ["lang", "key"], "left_semi")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundler, totals = Bundler(), {}
        for batch in batches:
            for name, (vector, _) in zip(batch["lang"], _bundles(batch["text"].tolist(), bundler), strict=True):
                if vector.any():
                    totals[name] = totals.get(name, 0) + vector / np.linalg.norm(vector)
        if totals:  # a frame without rows has no list type
            yield pd.DataFrame({"lang": list(totals), "vector": [total.tolist() for total in totals.values()]})

    parts = rows.select("lang", "text").mapInPandas(summed, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("vector"))
    return {row["lang"]: np.array(row["vector"]) for row in vectors.orderBy("lang").collect()}


def identify(texts: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``, all if None), ``lang_pred``, ``score`` and ``n_letters``."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[name] / np.linalg.norm(prototypes[name]) for name in names]).reshape(len(names), DIMENSIONS)
    model = texts.sparkSession.sparkContext.broadcast((names, matrix))

    def make():
        bundler = Bundler()
        names, matrix = model.value

        def nearest(bundle: tuple[np.ndarray, int]) -> tuple[str, float, int]:
            vector, letters = bundle
            size = np.linalg.norm(vector)
            if not size or not names:
                return UNKNOWN, 0.0, letters
            near = matrix @ vector / size
            best = near.max()
            return names[int(np.argmax(near >= best - TIED))], float(np.clip(best, 0, 1)), letters

        return lambda bodies: map(nearest, _bundles(bodies, bundler))

    return per_text(texts, text, [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double"), ("n_letters", pa.int64(), "bigint")], make, keep)


def recognised() -> Column:
    """Whether a row of ``identify`` has a language: not ``und``, and short or nearer to a prototype than by chance."""
    chance = CHANCE_DEVIATIONS / DIMENSIONS**0.5
    return (F.col("lang_pred") != UNKNOWN) & ((F.col("n_letters") < LEAST_LETTERS) | (F.col("score") >= chance))
