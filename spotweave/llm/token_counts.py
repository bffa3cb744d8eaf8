"""Token counts of byte-pair encodings without making tokens.

The symbols of a pre-token are nodes of a doubly linked list, its adjacent pairs a heap ordered by rank and place. The lowest
pair is popped and merged until the heap is empty; the count is the number of initial symbols less the merges.

The file is a ``tokenizers`` file with a byte-level BPE, without normaliser. Its added tokens, where a text holds their
strings, count as one token each. Null texts are empty and have 0 tokens.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spotweave.llm.arrow import per_text

#: The pre-token pattern of this kind of tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker keeps; others are merged again when they come.
KEPT_COUNTS = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {byte: chr(byte) for byte in plain}
    for place, byte in enumerate(byte for byte in range(256) if byte not in shown):
        shown[byte] = chr(256 + place)
    return [shown[byte] for byte in range(256)]


class MergeCounter(dict):
    """Counts by pre-token, merged on demand."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        if stated.get("normalizer") or stated["model"]["type"] != "BPE" or not stated["pre_tokenizer"].get("use_regex"):
            raise ValueError("A byte-level BPE without normaliser is needed.")
        vocabulary = stated["model"]["vocab"]
        self.start = [vocabulary[symbol] for symbol in byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(stated["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[a], vocabulary[b]] = rank, vocabulary[a + b]
        added = sorted((token["content"] for token in stated["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(PATTERN).findall

    def merged(self, pretoken: str) -> int:
        ids = [self.start[byte] for byte in pretoken.encode("utf-8", "replace")]
        count = len(ids)
        merges = self.merges
        heap = [(found[0], place) for place, pair in enumerate(zip(ids, ids[1:], strict=False)) if (found := merges.get(pair))]
        heapq.heapify(heap)
        after = [*range(1, count), -1]
        before = [*range(-1, count - 1)]
        while heap:
            rank, place = heapq.heappop(heap)
            right = after[place]
            if right < 0 or ids[place] < 0:
                continue
            found = merges.get((ids[place], ids[right]))
            if not found or found[0] != rank:
                continue
            ids[place], ids[right] = found[1], -1
            count -= 1
            after[place] = follows = after[right]
            if follows >= 0:
                before[follows] = place
                if found := merges.get((ids[place], ids[follows])):
                    heapq.heappush(heap, (found[0], place))
            left = before[place]
            if left >= 0 and (found := merges.get((ids[left], ids[place]))):
                heapq.heappush(heap, (found[0], left))
        return count

    def __missing__(self, pretoken: str) -> int:
        count = self.merged(pretoken)
        if len(self) < KEPT_COUNTS:
            self[pretoken] = count
        return count

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            total = len(parts) - 1
        for part in parts:
            total += sum(map(self.__getitem__, self.split(part)))
        return total


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One per worker process, kept between its tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def count_tokens(texts: DataFrame, path: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``, all if None), ``n_bytes`` (of UTF-8) and ``n_tokens``. ``path`` is the same on all machines."""

    def make():
        count = counter(path).count

        def work(bodies: list[str | None]) -> Iterable[tuple[int, int]]:
            for body in bodies:
                body = body or ""
                yield len(body.encode("utf-8", "replace")), count(body)

        return work

    return per_text(texts, text, [("n_bytes", pa.int64(), "bigint"), ("n_tokens", pa.int64(), "bigint")], make, keep)
