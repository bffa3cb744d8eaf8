"""Near-duplicate join: word-shingle Jaccard similarity by a MinHash LSH forest with exact verification.

Identical texts are one class (by a 64-bit hash of the text). A class has a string of ``DEPTH`` min-hashes in each of ``TREES``
trees; a tree is the sorted array of these strings, its nodes are their prefixes. Matching starts at whole strings and shortens
the prefix by one hash in all trees at once. The texts of a node are compared by estimated similarity, and those found are
connected. A shorter prefix is looked at only where it brings something new: its node has two longer prefixes at least, and its
texts are not all connected yet. So texts amid near copies are settled at long prefixes, others go on down to the shortest
one, whose expected recall of pairs at the threshold reaches ``RECALL`` (5 hashes with the settings here).

Nodes of very many texts are searched chunk by chunk first; only those that are not connected by that are searched in tiles of
all chunk pairs. The groups found are verified with whole shingle sets, large ones in tiles. Tasks give one row per text with
the number of its links, never a row per pair.

Words are runs of word characters of the lower-cased text; a text of one to four words has one shingle with all of them.
Texts without a word, and nulls, are similar to nothing: each is a class of its own without links. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.arrow import per_text, sorted_runs
from spotweave.llm.components import components
from spotweave.llm.text import distinct_per_text, shingles_of, slabs, words_of
from spotweave.session import broadcast_if_small, durable, narrowed

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 8, 0.99999
#: An estimate so far under the threshold (six standard deviations) still counts as a candidate.
MARGIN = 0.2
#: Bits of a min-hash past the shortest prefix that a string keeps.
_BITS = 16
#: Texts of a node, and texts and characters of a group, that are compared in one task; larger ones are tiled.
RUN_TEXTS, GROUP_TEXTS, GROUP_CHARS = 4096, 1024, 4 << 20
#: Candidate texts up to which their ids are broadcast to fetch the texts; beyond, texts are shuffled by id.
BROADCAST_TEXTS = 500_000


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Hashes of the shortest prefix that is matched: the first, shortening from ``depth``, whose expected recall is enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _min_hashes(shingles: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """``count`` min-hashes of each text with shingles; texts without any give zeros."""
    out = np.zeros((len(offsets) - 1, count), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        drawn = np.random.default_rng(5).integers(1, 2**32, (2, count), np.uint32)
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        starts = offsets[:-1][full]
        for i in range(count):
            out[full, i] = np.minimum.reduceat(values * (drawn[0, i] | np.uint32(1)) + drawn[1, i], starts)
    return out


def signatures(texts: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (key, h), ``n_shingles``, per tree a string as ``floors`` (a hash of the shortest prefix) and ``tails`` (the further
    min-hashes, ``_BITS`` each, the first on top), and ``bytes`` (a byte per min-hash of the shortest prefixes)."""
    floor = matched_depth(threshold)

    def work(bodies: list[str | None]) -> Iterator[tuple]:
        mix = np.random.default_rng(6).integers(1, 2**63, floor, np.uint64) * np.uint64(2) + np.uint64(1)
        for _, part in slabs(bodies):
            shingles, _, offsets = distinct_per_text(*shingles_of(words_of(part), width))
            hashes = _min_hashes(shingles, offsets, TREES * DEPTH).reshape(-1, TREES, DEPTH)
            first = hashes[:, :, :floor]
            floors = ((first.astype(np.uint64) + np.uint64(1)) * mix).sum(axis=2, dtype=np.uint64).view(np.int64)
            mixed = hashes * np.uint32(0x9E3779B1)
            tails = np.zeros(floors.shape, np.int64)
            for i in range(floor, DEPTH):
                tails = tails << _BITS | (mixed[:, :, i] >> np.uint32(32 - _BITS)).astype(np.int64)
            small = (mixed[:, :, :floor] >> np.uint32(24)).astype(np.uint8).reshape(len(hashes), -1)
            for count, own_floors, own_tails, own in zip(np.diff(offsets).tolist(), floors.tolist(), tails.tolist(), small, strict=True):
                yield (count, own_floors, own_tails, own.tobytes()) if count else (count, None, None, None)

    longs = (pa.list_(pa.int64()), "array<bigint>")
    fields = [("n_shingles", pa.int64(), "bigint"), ("floors", *longs), ("tails", *longs), ("bytes", pa.binary(), "binary")]
    return per_text(texts, "text", fields, lambda: work, ["key", "h", "n_chars"])


def _tiles(rows: DataFrame, count: str, size: int, across: bool = True) -> DataFrame:
    """Splits groups of over ``size`` into chunks by hash of ``node``; a row goes to every pair of chunks with its own, or (not
    ``across``) only to its own.

    ``i`` and ``j`` name the pair. Pairs of one chunk with itself and of two chunks are different tiles.
    """
    chunks = F.ceil(F.col(count) / size).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(3)), chunks)
    if not across:
        return rows.select("*", own.alias("own"), own.alias("i"), own.alias("j"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: F.struct(F.least(own, c).alias("i"), F.greatest(own, c).alias("j")))
    return rows.withColumn("own", own).withColumn("tile", F.explode(others)).select("*", "tile.i", "tile.j").drop("tile")


def _searched(least: float):
    """Edges from the roots of a node's texts to the least root that they are connected with by estimates of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, (roots, marks) in sorted_runs(batches, 5):
            rest = np.arange(len(roots))
            while len(rest):
                own = roots[rest] == roots[rest[0]]
                queue, rest = rest[own].tolist(), rest[~own]
                joined = {int(roots[queue[0]])}
                while queue and len(rest):
                    near = (marks[rest] == marks[queue.pop()]).mean(axis=1) >= least
                    if near.any():
                        found = np.unique(roots[rest[near]])
                        taken = np.isin(roots[rest], found)
                        joined.update(found.tolist())
                        queue += rest[taken].tolist()
                        rest = rest[~taken]
                if len(joined) > 1:
                    a += list(joined)
                    b += [min(joined)] * len(joined)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``root`` beside ``node``: the least node that it is connected with so far."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    near = broadcast_if_small(roots, roots.count(), BROADCAST_TEXTS)
    return rows.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))


def unsettled(entries: DataFrame, roots: DataFrame | None, depth: int) -> DataFrame:
    """The texts of the trie nodes of ``depth`` that are still to be searched: ``tree, floor, tail`` (the prefix), ``node, root, n``.

    These nodes have two longer prefixes at least (at full depth: two texts), and their texts are not all connected.
    """
    bits = _BITS * (DEPTH - depth)
    child = F.col("node") if depth == DEPTH else F.shiftright("tail", bits - _BITS)
    rooted = _rooted(entries.select("tree", "floor", F.shiftright("tail", bits).alias("tail"), child.alias("child"), "node"), roots)
    keys = ["tree", "floor", "tail"]
    new = (F.min("child") < F.max("child")) & (F.min("root") < F.max("root"))
    nodes = rooted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), new.alias("new")).filter("new").select(*keys, "n")
    return rooted.drop("child").join(nodes, keys)


def connected(entries: DataFrame, marks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node``, ``root`` of all texts that the forest connects. ``entries``: ``tree, floor, tail, node``; ``marks``: ``node, bytes``.

    Prefixes are shortened in all trees at once, and each length starts from what longer ones have connected.
    """
    roots = None
    entries = narrowed(entries, entries.count())
    keys = ["tree", "floor", "tail", "i", "j"]
    for depth in range(DEPTH, matched_depth(threshold) - 1, -1):
        large = True
        for across in (False, True):
            if across and not large:
                continue
            found = unsettled(entries, roots, depth)
            found = durable(found.filter(F.col("n") > RUN_TEXTS) if across else found)
            n = found.count()
            if not n:
                break
            found = narrowed(found, n)
            large = not found.filter(F.col("n") > RUN_TEXTS).isEmpty()
            tiled = _tiles(found.join(marks, "node"), "n", RUN_TEXTS, across).select(*keys, "root", "bytes")
            edges = tiled.repartition(*keys).sortWithinPartitions(*keys, "root").mapInArrow(_searched(threshold - MARGIN), "a bigint, b bigint")
            edges = durable(edges.distinct())
            if not edges.isEmpty():
                roots = durable(_merged(roots, components(edges)))
    return entries.select("node", F.col("node").alias("root")).limit(0) if roots is None else roots


def _merged(roots: DataFrame | None, further: DataFrame) -> DataFrame:
    if roots is None:
        return further
    moved = further.select(F.col("node").alias("root"), F.col("root").alias("new"))
    known = roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return known.unionByName(further.join(roots.select("node"), "node", "left_anti"))


def _shared(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many shingles each two texts share, by products of incidence matrices over those that two texts hold."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    _, column, held = np.unique(shingles, return_inverse=True, return_counts=True)
    kept = held[column] > 1
    column, owner = np.unique(column[kept], return_inverse=True)[1], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((n, n), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, last, 2048):
        a, b = np.searchsorted(column, [first, first + 2048])
        block = np.zeros((n, min(2048, last - first)), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        total += block @ block.T
    return total


def _verified(threshold: float, width: int):
    """Per text of a tile: how many texts and rows it is linked with there, and the least node it is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (nodes, copies, own, texts) in sorted_runs(batches, 3):
            parts = [distinct_per_text(*shingles_of(words_of(part), width)) for _, part in slabs(texts)]
            shingles = np.concatenate([part[0] for part in parts])
            sizes = np.concatenate([np.diff(part[2]) for part in parts])
            shared = _shared(shingles, np.concatenate([[0], np.cumsum(sizes)]))
            linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= own[:, None] != own[None, :]
            root = nodes.copy()
            rest = np.arange(len(nodes))
            while len(rest):
                group, queue, rest = [rest[0]], [rest[0]], rest[1:]
                while queue and len(rest):
                    near = linked[queue.pop(), rest]
                    found, rest = rest[near], rest[~near]
                    group += found.tolist()
                    queue += found.tolist()
                root[group] = nodes[group].min()
            links, rows = linked.sum(axis=1), linked @ copies
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, links, rows, root)], ["node", "links", "rows", "root"])

    return run


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row per document: ``key``, ``h`` (hash of its text), ``text_id`` (least key with the same text), ``class_id``
    (least key connected by links), ``n_links`` (other documents at least ``threshold`` similar) and ``n_texts`` (other texts)."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text")).withColumn("n_chars", F.length("text").cast("long"))
    signed = signatures(hashed, width, threshold).select("row.key", "row.h", "row.n_chars", "n_shingles", "floors", "tails", "bytes")
    signed = durable(signed)
    full = signed.filter("n_shingles > 0")
    classes = durable(full.groupBy("h").agg(
        F.count(F.lit(1)).alias("copies"), F.min("key").alias("text_id"),
        *[F.first(name).alias(name) for name in ("n_chars", "floors", "tails", "bytes")]).withColumnRenamed("h", "node"))

    strings = classes.select("node", F.posexplode(F.arrays_zip("floors", "tails")).alias("tree", "own"))
    strings = strings.select(F.col("tree").cast("long").alias("tree"), "own.floors", "own.tails", "node").toDF("tree", "floor", "tail", "node")
    held = strings.groupBy("tree", "floor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tree", "floor")
    entries = durable(strings.join(held, ["tree", "floor"]))
    groups = connected(entries, classes.select("node", "bytes"), threshold)

    candidates = groups.join(classes.select("node", "copies", "text_id", "n_chars"), "node")
    sizes = candidates.groupBy("root").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n_chars") * GROUP_TEXTS / GROUP_CHARS)).alias("n"))
    sized = durable(_tiles(candidates.join(sizes, "root"), "n", GROUP_TEXTS))
    wanted = candidates.select("node", F.col("text_id").alias("key"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    chosen = _fetched(hashed, wanted)
    tiles = sized.select("node", "root", "copies", "own", "i", "j").join(chosen, "node").select("root", "i", "j", "node", "copies", "own", "text")
    keys = ["root", "i", "j"]
    seen = durable(tiles.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_verified(threshold, width), "node bigint, links bigint, rows bigint, root bigint"))

    links = seen.groupBy("node").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows"))
    split = components(seen.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = classes.select("node", "copies", "text_id").join(links.select("node", "links", "rows"), "node", "left").join(split, "node", "left")
    joined = joined.withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("text_id").alias("class_id"))
    told = joined.join(least, "root").select(
        F.col("node").alias("h"), "text_id", "class_id", (F.col("copies") - 1 + F.coalesce("rows", F.lit(0))).alias("n_links"), F.coalesce("links", F.lit(0)).cast("long").alias("n_texts"))
    empty = signed.filter("n_shingles = 0").select("key", "h", F.col("key").alias("text_id"), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"))
    return full.select("key", "h").join(told, "h").select("key", "h", "text_id", "class_id", "n_links", "n_texts").unionByName(empty).withColumnRenamed("key", key)


def one_per_class(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The rows of ``documents`` with the least key of their class, one of them where rows are repeated."""
    marks = durable(near_duplicates(documents, key, text, threshold, width).select(F.col(key).alias("key"), "h", F.col("class_id").alias("least")))
    kept = marks.filter(F.col("key").eqNullSafe(F.col("least"))).select(F.col("key").alias("kept_key"), F.col("h").alias("kept_h"))
    rows = documents.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("h"))
    asked = durable(kept.distinct())
    n, distinct = kept.count(), asked.count()
    asked = F.broadcast(asked) if distinct <= BROADCAST_TEXTS else asked
    chosen = rows.join(asked, F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("h") == F.col("kept_h")), "left_semi")
    if distinct < n:
        chosen = chosen.dropDuplicates(["key", "h"])
    return chosen.select(*[F.col("row").getField(name).alias(name) for name in documents.columns])


def _fetched(hashed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node``, ``text`` once per wanted class: rows of its least key, repeated rows once."""
    asked = wanted.withColumnRenamed("node", "h")
    rows = hashed.join(asked, ["h", "key"], "left_semi").unionByName(hashed.filter("key IS NULL").join(asked.filter("key IS NULL").select("h"), "h", "left_semi"))
    return rows.groupBy(F.col("h").alias("node")).agg(F.first("text").alias("text"))
