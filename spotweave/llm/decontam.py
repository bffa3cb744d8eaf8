"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification.

A text is its sequence of word shingles. Windows of a few sizes slide over it in steps of ``STEP`` shingles; an item is
fingerprinted at as many successive places, once with the largest window that fits it and with halves from both ends, so a
copied passage has a window in step with one of them wherever it stands. A fingerprint is split into four blocks, each
looked up with up to one bit changed: every item fingerprint within ``RADIUS`` bits is found. Scattered edits may spoil all
of these, so smaller windows at every place of the item are looked up as they are. Their size follows from the edits that the
threshold allows: by pigeonhole one run between edits holds a window in step with the text's, whatever the item's length.
Each candidate is verified by the weighted Jaccard similarity of the item and the text's windows of the item's size there, as
far around as edits that the threshold allows can move it.
A shingle weighs its occurrences, divided by the number of different items that hold it; items with the same words are one,
and all items count, whatever scan they are in. A shingle that no item holds weighs as much as the item's shingles on average.

Words are runs of word characters of the lower-cased text; with one to four words there is one shingle. Texts and items
without a word, and nulls, match nothing. Of repeated items each is reported. An item counts once per text, at its best place.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.arrow import per_text, slices
from spotweave.llm.text import mixed, shingles_of, slabs, words_of

WIDTH, THRESHOLD = 5, 0.8
STEP = 4
#: Pigeonhole: of 8 differing bits in 4 blocks, no block need have under 2.
RADIUS = 7
#: Window sizes in shingles, each about 1.35 times the last.
SIZES = [4, 8, 12, 16, 20, 28, 36, 48, 64, 88, 120, 160, 216, 292, 396, 536, 724, 976]
#: Items, and characters of items, whose index a scan carries to its tasks (about 8 kB an item); more take more scans.
ITEMS_PER_SCAN, CHARS_PER_SCAN = 5000, 8 << 20
_SHIFT = 4


def _bits(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(mixed(shingles).view(np.uint8).reshape(len(shingles), 8), axis=1)


def _marks(counts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints from the numbers of set bits: a bit is set where most shingles of the window set it."""
    return np.packbits(counts * 2 > size, axis=1).view(np.uint64).ravel()


class Blocks:
    """Fingerprints by the 16-bit values of their blocks and all values one bit away."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        near = np.array([0] + [1 << bit for bit in range(16)], np.uint64)
        self.tables = []
        for block in range(4):
            own = (marks >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            values = (own[:, None] ^ near[None, :]).ravel().astype(np.int64)
            order = np.argsort(values, kind="stable")
            members = np.repeat(np.arange(len(marks)), len(near))[order]
            self.tables.append((np.searchsorted(values[order], np.arange(65537)), members))

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``asked``, fingerprint) at most ``RADIUS`` bits apart, some more than once."""
        places, found = [], []
        for block, (limits, members) in enumerate(self.tables):
            values = ((asked >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            counts = limits[values + 1] - limits[values]
            hit = np.flatnonzero(counts)
            if not len(hit):
                continue
            counts = counts[hit]
            place = np.repeat(hit, counts)
            member = members[np.repeat(limits[values[hit]], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
            near = np.bitwise_count(asked[place] ^ self.marks[member]) <= RADIUS
            places.append(place[near])
            found.append(member[near])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(found)


@dataclass
class Weights:
    """Shingles that items hold, sorted, and their weights."""

    shingles: np.ndarray
    values: np.ndarray

    def of(self, shingles: np.ndarray, other: float = 0.0) -> np.ndarray:
        """The weights of ``shingles``; ``other`` where no item holds one."""
        if not len(self.shingles):
            return np.full(len(shingles), other)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.values[at], other)


def weights_of(sequences: Sequence[np.ndarray]) -> Weights:
    """Weights from all items."""
    different = {sequence.tobytes(): np.unique(sequence) for sequence in sequences}
    shingles, holders = np.unique(np.concatenate([*different.values(), np.empty(0, np.uint64)]), return_counts=True)
    return Weights(shingles, 1 / holders)


@dataclass
class Index:
    """``sizes[w]`` has the blocks, items and places inside the items of all fingerprints of windows of w shingles.

    ``intact[w]`` has the sorted fingerprints of windows that are looked up as they are, their items and places. ``short`` has
    the shingles of items too short for windows, sorted, with their items and places. ``reach`` is how far an item's windows
    are tried around a candidate.
    """

    ids: list[int]
    shingles: list[np.ndarray]
    weights: Weights
    sizes: dict[int, tuple[Blocks, np.ndarray, np.ndarray]]
    intact: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    short: tuple[np.ndarray, np.ndarray, np.ndarray]
    reach: list[int]


def spared(weights: np.ndarray, threshold: float = THRESHOLD, width: int = WIDTH) -> tuple[int, int]:
    """How many shingles an item may lose above the threshold, and the least length of its longest run without a loss.

    Each lost shingle, the lightest first, makes room for one of mean weight. An edit inside the item costs ``width - 1``
    shingles in a row at least.
    """
    n, total = len(weights), weights.sum()
    lost = np.arange(1, n + 1)
    most = int(np.count_nonzero(total - np.cumsum(np.sort(weights)) >= (threshold - 1e-9) * (total + lost * total / n)))
    return most, -(-(n - most) // (most // max(1, width - 1) + 1))


def index_of(items: Sequence[tuple[int, str | None]], width: int = WIDTH, weights: Weights | None = None, threshold: float = THRESHOLD) -> Index:
    """``weights`` are those of all items, where ``items`` are some of them."""
    ids, sequences = [], []
    for item, text in items:
        shingles, _ = shingles_of(words_of([text or ""]), width)
        if len(shingles):
            ids.append(item)
            sequences.append(shingles)
    weights = weights_of(sequences) if weights is None else weights
    entries: dict[int, list[tuple[int, int, int]]] = {}
    runs: dict[int, list[tuple[np.ndarray, int]]] = {}
    reach = []
    short: list[tuple[int, int, int]] = []
    for item, sequence in enumerate(sequences):
        n = len(sequence)
        lost, run = spared(weights.of(sequence), threshold, width)
        reach.append(max(_SHIFT, lost))
        if n < SIZES[0] + STEP - 1:
            short += [(int(shingle), item, place) for place, shingle in enumerate(sequence.tolist())]
            continue
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_bits(sequence), axis=0, dtype=np.int64)])
        whole = max(w for w in SIZES if w <= n - STEP + 1)
        half = max([w for w in SIZES if 2 * w <= n - STEP + 1], default=SIZES[0])
        places = {(whole, p) for p in range(STEP)} | {(half, p) for p in range(STEP)} | {(half, n - half - p) for p in range(STEP)}
        for w, place in sorted(places):
            entries.setdefault(w, []).append((int(_marks(sums[place + w : place + w + 1] - sums[place : place + 1], w)[0]), item, place))
        w = max([w for w in SIZES if w <= run - STEP + 1], default=SIZES[0])
        runs.setdefault(w, []).append((_marks(sums[w:] - sums[:-w], w), item))
    sizes = {w: (Blocks(np.array([m for m, _, _ in found], np.uint64)), np.array([i for _, i, _ in found]), np.array([p for _, _, p in found])) for w, found in entries.items()}
    intact = {}
    for w, found in runs.items():
        marks = np.concatenate([own for own, _ in found])
        order = np.argsort(marks, kind="stable")
        owners = np.concatenate([np.full(len(own), item, np.int32) for own, item in found])
        intact[w] = marks[order], owners[order], np.concatenate([np.arange(len(own), dtype=np.int32) for own, _ in found])[order]
    short.sort()
    arrays = np.array([s for s, _, _ in short], np.uint64), np.array([i for _, i, _ in short], np.int64), np.array([p for _, _, p in short], np.int64)
    return Index(ids, sequences, weights, sizes, intact, arrays, reach)


def similarity(window: np.ndarray, item: np.ndarray, weights: Weights) -> float:
    """Weighted Jaccard similarity of two sequences as bags of shingles."""
    of_item = weights.of(item)
    of_window = weights.of(window, float(of_item.mean()))
    a, b = Counter(window.tolist()), Counter(item.tolist())
    weight = dict(zip(item.tolist(), of_item.tolist(), strict=True))
    both = sum(weight[x] * min(n, a[x]) for x, n in b.items() if x in a)
    return both / (float(of_item.sum()) + float(of_window.sum()) - both)


def similarities(text: np.ndarray, item: np.ndarray, weights: Weights) -> np.ndarray:
    """``similarity`` of the item and each window of its size in ``text``, or all of a shorter text, up to rounding."""
    of_item = weights.of(item)
    total, mean = float(of_item.sum()), float(of_item.mean())
    n = min(len(item), len(text))
    known, first, wanted = np.unique(item, return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(known, text), len(known) - 1)
    codes = np.where(known[at] == text, at, -1).tolist()
    weight, room = of_item[first].tolist(), wanted.tolist()
    both, out = 0.0, []
    for place, code in enumerate(codes):
        if code >= 0:
            if room[code] > 0:
                both += weight[code]
            room[code] -= 1
        if place >= n and (gone := codes[place - n]) >= 0:
            room[gone] += 1
            if room[gone] > 0:
                both -= weight[gone]
        if place >= n - 1:
            out.append(both)
    sums = np.concatenate([[0.0], np.cumsum(weights.of(text, mean))])
    shared = np.array(out)
    return shared / (total + sums[n:] - sums[:-n] - shared)


def _candidates(shingles: np.ndarray, offsets: np.ndarray, index: Index) -> np.ndarray:
    """Rows of (text, item, place of the item's first shingle among all shingles) of all windows found, in order.

    Windows start at every ``STEP``-th shingle of their own text, so what is found does not depend on a text's neighbours.
    """
    out = [np.empty((3, 0), np.int64)]
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    steps = -(-counts // STEP)
    blocks = int(steps.sum())
    if index.sizes and blocks:
        first = np.cumsum(steps) - steps
        bits = np.zeros((blocks * STEP, 64), np.uint8)
        bits[np.arange(len(shingles)) + np.repeat(first * STEP - offsets[:-1], counts)] = _bits(shingles)
        words = bits.view(np.uint64).reshape(blocks, STEP, 8)
        summed = words[:, 0] + words[:, 1]
        for place in range(2, STEP):
            summed += words[:, place]
        sums = np.zeros((blocks + 1, 64), np.uint16)
        np.cumsum(summed.view(np.uint8).reshape(blocks, 64), axis=0, dtype=np.uint16, out=sums[1:])
        text = np.repeat(np.arange(len(counts)), steps)
        local = (np.arange(blocks) - np.repeat(first, steps)) * STEP
        room = np.repeat(counts, steps) - local
        for w in sorted({*index.sizes, *index.intact}):
            starts = np.flatnonzero(room >= w)
            if not len(starts):
                continue
            asked = _marks(sums[starts + w // STEP] - sums[starts], w)
            if w in index.sizes:
                table, items, places = index.sizes[w]
                place, found = table.within(asked)
                at = starts[place]
                out.append(np.stack([text[at], items[found], offsets[text[at]] + local[at] - places[found]]))
            if w in index.intact:
                marks, items, places = index.intact[w]
                first = np.searchsorted(marks, asked)
                hit = np.flatnonzero(marks[np.minimum(first, len(marks) - 1)] == asked)
                first = first[hit]
                many = np.searchsorted(marks, asked[hit], "right") - first
                found = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = starts[np.repeat(hit, many)]
                out.append(np.stack([text[at], items[found], offsets[text[at]] + local[at] - places[found]]))
    known, items, places = index.short
    if len(known):
        first, last = np.searchsorted(known, shingles), np.searchsorted(known, shingles, "right")
        at = np.repeat(np.arange(len(shingles)), last - first)
        found = np.repeat(first, last - first) + np.arange(len(at)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        out.append(np.stack([owner[at], items[found], at - places[found]]))
    rows = np.concatenate(out, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])[: rows.shape[1]]].T


def matches(texts: list[str | None], index: Index, threshold: float = THRESHOLD, width: int = WIDTH) -> Iterator[list[dict]]:
    """The matched items of each text."""
    for _, part in slabs(texts):
        shingles, offsets = shingles_of(words_of(part), width)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        spans: list[list[int]] = []
        for text, item, place in _candidates(shingles, offsets, index).tolist():
            low, latest = int(offsets[text]), max(int(offsets[text]), int(offsets[text + 1]) - len(index.shingles[item]))
            first, last = (min(max(place + shift, low), latest) for shift in (-index.reach[item], index.reach[item]))
            if spans and spans[-1][:2] == [text, item] and first <= spans[-1][3] + 1:
                spans[-1][3] = max(last, spans[-1][3])
            else:
                spans.append([text, item, first, last])
        for text, item, first, last in spans:
            wanted, low, high = index.shingles[item], int(offsets[text]), int(offsets[text + 1])
            values = similarities(shingles[first : min(last + len(wanted), high)], wanted, index.weights)
            for start in (first + np.flatnonzero(values >= max(threshold, values.max()) - 1e-9)).tolist():
                value = similarity(shingles[start : min(start + len(wanted), high)], wanted, index.weights)
                if value >= threshold - 1e-9:
                    best[text, item] = max(best.get((text, item), (0.0, 0)), (value, low - start))
        found: list[list[dict]] = [[] for _ in part]
        for (text, item), (value, place) in sorted(best.items()):
            found[text].append({"item_id": index.ids[item], "similarity": value, "start_word": -place, "n_words": len(index.shingles[item]) + width - 1})
        yield from found


def _all_weights(rows: DataFrame, width: int) -> Weights:
    """Weights from the items of all scans. Counted by tasks; the driver gets two numbers per different shingle."""

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            shingles, offsets = shingles_of(words_of(batch.column(0).to_pylist()), width)
            sequences = [shingles[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            own = [np.unique(sequence) for sequence in sequences]
            names = [hashlib.blake2b(sequence.tobytes(), digest_size=16).digest() for sequence in sequences]
            names = pa.array(names, pa.binary()).take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own])))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([*own, np.empty(0, np.uint64)]).view(np.int64))], ["sequence", "shingle"])

    counted = rows.select("text").mapInArrow(held, "sequence binary, shingle long").distinct().groupBy("shingle").count().toArrow()
    shingles, holders = counted["shingle"].to_numpy().view(np.uint64), counted["count"].to_numpy()
    order = np.argsort(shingles)
    return Weights(shingles[order], 1 / holders[order])


def _indexes(items: DataFrame, item: str, text: str, width: int, threshold: float) -> Iterator[Index]:
    rows = items.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    weights = _all_weights(rows, width)
    size = rows.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    scans = max(1, -(-size["items"] // ITEMS_PER_SCAN), -(-size["chars"] // CHARS_PER_SCAN))
    for scan in range(scans):
        own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(scans)) == scan).orderBy("item", "text")
        yield index_of([(row["item"], row["text"]) for row in own.collect()], width, weights, threshold)


def with_matches(documents: DataFrame, index: Index, text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, keep: Sequence[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``, all if None) and ``found``, the matched items."""
    known = documents.sparkSession.sparkContext.broadcast(index)

    def work(bodies: list[str | None]) -> Iterable[tuple]:
        return ((found,) for found in matches(bodies, known.value, threshold, width))

    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())]))
    return per_text(documents, text, [("found", kind, "array<struct<item_id: bigint, similarity: double, start_word: bigint, n_words: bigint>>")], lambda: work, keep)


def contaminated(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``key``, ``item_id``, ``similarity``, ``start_word``, ``n_words``: one row per document and item found in it."""
    parts = [with_matches(documents, index, "text", threshold, width, [key]) for index in _indexes(items, item, "text", width, threshold)]
    out = None
    for part in parts:
        rows = part.select(F.col("row").getField(key).alias(key), F.explode("found").alias("x")).select(key, "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def without_contaminated(documents: DataFrame, items: DataFrame, item: str = "item_id", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The rows whose text holds no item, with their columns."""
    for index in _indexes(items, item, "text", width, threshold):
        kept = with_matches(documents, index, "text", threshold, width).filter(F.size("found") == 0)
        documents = kept.select(*[F.col("row").getField(name).alias(name) for name in documents.columns])
    return documents
