"""Words, word hashes and shingle hashes of many texts at once, as numpy arrays inside a task.

A word is a run of ``\\w`` characters of the lower-cased text. A text with fewer words than the shingle width (but at least
one) has one shingle made of all its words; a text without a word has none. Null texts count as empty.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SLAB_CHARS = 1 << 19


def slabs(texts: list[str | None], chars: int = SLAB_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with about ``chars`` characters together, each with the position of its first text.

    Only the memory of a step depends on ``chars``; a longer single text is a run of its own.
    """
    first, size, part = 0, 0, []
    for position, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if part and size + len(text) > chars:
            yield first, part
            first, size, part = position, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield first, part


@functools.cache
def _word_characters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for found in re.finditer(r"\w+", everything):
        points = np.frombuffer(found[0].encode("utf-32-le"), np.uint32)
        table[points] = True
    return table


@functools.cache
def _random(name: int, count: int) -> np.ndarray:
    return np.random.default_rng(name).integers(1, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values.astype(np.uint64)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Words:
    """``hashes``, ``starts`` and ``ends`` of all words; those of text ``i`` are ``offsets[i]:offsets[i + 1]``.

    ``starts`` and ``ends`` count characters of the lower-cased texts joined by one character.
    """

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points; runs do not overlap and come in order."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    points = points[np.repeat(starts, lengths) + place]
    weights = _random(1, 256)[place & 255]
    if lengths.max() > 256:
        weights = weights * _random(2, 1 << 16)[(place >> 8) & 0xFFFF]
    terms = mixed(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) if points.max(initial=0) > 0xFFFF else _random(3, 1 << 16)[points]
    return mixed(np.add.reduceat(terms * weights, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def words_of(texts: list[str]) -> Words:
    lowered = [text.lower() for text in texts]
    points = code_points("\n".join(lowered))
    starts, ends = runs_of(_word_characters()[points])
    limits = np.cumsum([len(text) + 1 for text in lowered])
    offsets = np.concatenate([[0], np.searchsorted(starts, limits)])
    return Words(run_hashes(points, starts, ends), starts, ends, offsets)


def shingles_of(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and the offsets of each text's shingles. Repeated shingles stay."""
    counts = np.diff(words.offsets)
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(each)])
    multipliers = _random(4, width)
    hashes = np.concatenate([words.hashes, np.zeros(width, np.uint64)])
    first = np.repeat(words.offsets[:-1], each) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], each)
    short = np.repeat(counts, each) < width
    total = np.zeros(offsets[-1], np.uint64)
    for place in range(width):
        part = hashes[first + place] * multipliers[place]
        if short.any():
            part[short & (place >= np.repeat(counts, each))] = 0
        total += part
    return mixed(total), offsets


def distinct_per_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, their counts, and the new offsets."""
    found = [np.unique(values[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.concatenate([[0], np.cumsum([len(kept) for kept, _ in found], dtype=np.int64)])
    if not found:
        return values[:0], np.empty(0, np.int64), sizes
    return np.concatenate([kept for kept, _ in found]), np.concatenate([counts for _, counts in found]), sizes
