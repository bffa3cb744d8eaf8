"""Packing of token pieces into sequences: best-fit decreasing per partition, certified by lower bounds.

Pieces are dealt to partitions and each is packed by best-fit decreasing. Dual-feasible functions bound the room its pieces
need at least, in bins and their fractions; a partition that meets its bound is certified and done. One with a gap, be it a
part of its last bin, gives up the pieces of its loosely filled bins. What was given up is exchanged - dealt anew to fewer partitions - and packed again, until no gap, no gain
or nothing to exchange is left. Every step handles bounded partitions, of narrow rows.

Null texts are empty; an empty text is one piece with the end id alone. Repeated rows are packed like any others.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterable, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.arrow import per_text
from spotweave.llm.text import code_points, run_hashes, slabs
from spotweave.session import durable

CAPACITY = 4096
END_ID = 1
#: Pieces that a partition packs at about.
PIECES_PER_PARTITION = 20_000
#: Partitions of the first round at least, so that small tables are dealt out as well.
LEAST_PARTITIONS = 16
ROUNDS = 6
#: A partition with a gap gives up the bins with at least a LOOSE-th of their room left, and some more of the least filled.
LOOSE = 64
#: Words whose ids a worker keeps; beyond, it starts anew.
KEPT_WORDS = 600_000
_PLAIN = 0x250


def _classes() -> np.ndarray:
    """For simple Latin code points: 0 white space, 1 letter, 2 number, 3 other, 4 left to the library."""
    kinds = np.full(_PLAIN, 3, np.int8)
    for point in range(_PLAIN):
        kind = unicodedata.category(chr(point))
        kinds[point] = 0 if chr(point) in "\t\n\r \xa0" else 1 if kind[0] == "L" else 2 if kind[0] == "N" else 4 if kind[0] == "C" else 3
        if len(chr(point).lower()) != 1 or ord(chr(point).lower()) >= _PLAIN:
            kinds[point] = 4
    kinds[0x27] = 4
    return kinds


class WordIds:
    """Ids of texts as the library gives them for a lower-casing word tokenizer.

    Words of simple Latin text are looked up by hash; the library encodes each once, many in one call, and the suffix that
    ends each word tells them apart. Texts with apostrophes, special strings,
    control characters or other scripts go through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.classes = _classes()
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for word, i in self.library.get_vocab().items() if suffix and word.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.places: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def simple(self, text: str) -> bool:
        if "<|" in text or "'" in text:
            return False
        if text.isascii() and text.isprintable():
            return True
        points = code_points(text)
        return not len(points) or (int(points.max()) < _PLAIN and not (self.classes[points] == 4).any())

    def _learn(self, keys: list[int], words: list[str]) -> None:
        first = len(self.places)
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(lengths) != len(words) or lengths.sum() != len(ids):
            raise ValueError("The tokenizer does not end every word with its suffix.")
        while first + len(keys) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        while self.used + lengths.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + lengths.sum()] = ids
        self.starts[first : first + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(keys)] = lengths
        self.used += int(lengths.sum())
        self.places.update(zip(keys, range(first, first + len(keys)), strict=True))

    def _looked_up(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join(text.lower() for text in texts)
        points = code_points(joined)
        kinds = self.classes[points]
        begins = (kinds != 0) & ((kinds != np.concatenate([[0], kinds[:-1]])) | (kinds == 2))
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero((kinds != 0) & np.concatenate([begins[1:] | (kinds[1:] == 0), [True]])) + 1 if len(kinds) else starts
        hashes, first, inverse = np.unique(run_hashes(points, starts, ends), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        if len(self.places) + len(keys) > KEPT_WORDS:
            self.clear()
        new = [i for i, key in enumerate(keys) if key not in self.places]
        if new:
            self._learn([keys[i] for i in new], [joined[starts[first[i]] : ends[first[i]]] for i in new])
        places = np.array([self.places[key] for key in keys], np.int64)[inverse]
        lengths = self.lengths[places]
        total = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[places] - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)]
        limits = np.searchsorted(starts, np.cumsum([len(text) + 1 for text in texts]))
        total = np.concatenate([[0], total])
        return np.split(ids, total[limits][:-1])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        plain = [i for i, text in enumerate(texts) if self.simple(text)]
        for i, ids in zip(plain, self._looked_up([texts[i] for i in plain]) if plain else [], strict=True):
            found[i] = ids
        for i in sorted(set(range(len(texts))) - set(plain)):
            found[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return found


_WORD_IDS: dict[str, WordIds] = {}


def token_pieces(texts: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", keep: Sequence[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``row``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` of every text's pieces.

    A text is its ids and the end id; only longer ones are cut, into pieces of ``capacity`` ids, the last may be shorter.
    """

    def make():
        if path not in _WORD_IDS:
            _WORD_IDS[path] = WordIds(path)
        words = _WORD_IDS[path]

        def work(bodies: list[str | None]) -> Iterable[tuple]:
            for _, part in slabs(bodies):
                for ids in words.ids(part):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    cuts = [ids[a : a + capacity] for a in range(0, len(ids), capacity)]
                    yield ([{"length": len(x), "ids_crc32": zlib.crc32(x.tobytes()), "ids": x.astype(np.int32) if with_ids else None} for x in cuts],)

        return work

    kind = pa.list_(pa.struct([("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]))
    cut = per_text(texts, text, [("pieces", kind, "array<struct<length: bigint, ids_crc32: bigint, ids: array<int>>>")], make, keep)
    rows = cut.select("row", F.posexplode("pieces").alias("piece", "x"))
    return rows.select("row", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "x.length", "x.ids_crc32", *["x.ids"] * with_ids)


def room_needed(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Fraction:
    """Bins, in fractions, that ``counts[i]`` pieces of ``lengths[i]`` take at least: the best of two families of dual-feasible functions.

    The first rounds every length down to shares of 1/k (exact shares stay), the second takes lengths over capacity - e as
    whole bins and drops those under e. For each, no set of pieces that fits a bin sums to over 1.
    """
    best = Fraction(int((lengths * counts).sum()), capacity)
    for k in range(1, 33):
        exact = (lengths * (k + 1)) % capacity == 0
        shares = np.where(exact, lengths * k, (lengths * (k + 1) // capacity) * capacity)
        best = max(best, Fraction(int((shares * counts).sum()), capacity * k))
    for least in np.unique(lengths[lengths * 2 <= capacity]):
        values = np.where(lengths > capacity - least, capacity, np.where(lengths >= least, lengths, 0))
        best = max(best, Fraction(int((values * counts).sum()), capacity))
    return best


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Whole bins that the pieces need at least."""
    return math.ceil(room_needed(lengths, counts, capacity))


def best_fit_decreasing(lengths: Iterable[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given in falling order), and the free room of each bin.

    Set bits of ``rooms`` are the free rooms that some bin has, so the tightest fit is the lowest bit from the length up.
    """
    by_room: dict[int, list[int]] = {}
    rooms, bins, offsets, free = 0, [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, own = capacity, len(free)
            free.append(capacity)
        bins.append(own)
        offsets.append(capacity - room)
        free[own] = left = room - length
        by_room.setdefault(left, []).append(own)
        rooms |= 1 << left
    return bins, offsets, free


def _packed(capacity: int, turn: int, last: bool):
    def group(key, rows: pd.DataFrame) -> pd.DataFrame:
        order = [name for name in rows.columns if name not in ("length", "partition", "sequence_id", "offset", "given")]
        rows = rows.sort_values(["length", *order], ascending=[False] + [True] * len(order), kind="stable")
        bins, offsets, free = best_fit_decreasing(rows["length"].tolist(), capacity)
        lengths, counts = np.unique(rows["length"].to_numpy(), return_counts=True)
        gap = len(free) - room_needed(lengths, counts, capacity)
        by_room = sorted(range(len(free)), key=lambda b: (-free[b], b))
        loose = sum(room * LOOSE >= capacity for room in free)
        worst = set(by_room[: max(loose, 2 * math.ceil(gap))]) if gap and not last else set()
        base = (turn << 56) + (int(key[0]) << 28)
        return rows.drop(columns="partition").assign(sequence_id=[base + b for b in bins], offset=offsets, given=[b in worst for b in bins])

    return group


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` has ``length`` (1 to ``capacity``) and columns that can be sorted."""
    names = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long").add("given", "boolean")

    def packed(rows: DataFrame, count: int, turn: int) -> DataFrame:
        share = PIECES_PER_PARTITION if turn else PIECES_PER_PARTITION // 4
        partitions = max(1 if turn else LEAST_PARTITIONS, -(-count // share))
        last = turn == ROUNDS - 1 or partitions == 1
        dealt = rows.select(*names, F.pmod(F.xxhash64(F.lit(turn), *[F.col(f"`{n}`") for n in names]), F.lit(partitions)).alias("partition"))
        return durable(dealt.groupBy("partition").applyInPandas(_packed(capacity, turn, last), schema))

    pool = durable(pieces.filter(F.col("length") < capacity))
    whole = pieces.filter(F.col("length") >= capacity)
    alone = whole.select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, count, turn, bins = [alone], pool.count(), 0, None
    while count:
        now = packed(pool, count, turn)
        used = now.select("sequence_id").distinct().count()
        if bins is not None and used >= bins:
            done.append(pool.drop("given"))
            break
        done.append(now.filter(~F.col("given")).drop("given"))
        pool = now.filter("given")
        count, bins = pool.count(), pool.select("sequence_id").distinct().count()
        turn += 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result
