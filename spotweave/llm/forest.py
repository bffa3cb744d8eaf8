"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Every distinct vector gets one long hash string per tree; a tree is the array of all strings in sorted order, range partitioned
into slices. A symbol of a string names the largest of eight random projections and its sign. Vectors are lengthened by one
component to the largest norm, so that the largest inner product is the smallest angle; queries get 0 there.

A query descends to its longest prefix match in each tree and then ascends in all trees at once, a symbol at a time, until the
trees together hold enough rows with its prefix; all of these are candidates, none is left out. How many are enough is
calibrated: for a bounded sample of queries the true neighbours are found by a scan of all rows, and the least number is taken
with which the sample's recall reaches the target. Candidates are scored where their slice of the array is, in double precision.

Identical vectors are one class in the trees and ids again in the result. Vectors that are null, empty, zero or hold a null or
non-finite component, and rows without an id, take no part; of repeated ids the largest vector counts. Only vectors of one width
are compared, each width has its own trees. Equal scores go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.arrow import sorted_runs
from spotweave.session import broadcast_if_small, durable

TREES = 16
#: Symbols of a string, two to a byte.
SYMBOLS = 20
_BLOCK = 8
_ENTRIES = TREES * SYMBOLS * _BLOCK
#: Queries of the calibration sample, those with the smallest hashes of their ids, and the recall their neighbours must reach.
SAMPLE_QUERIES = 256
TARGET_RECALL = 0.95
#: Array entries of a slice, and queries that meet a slice in one task.
ENTRIES_PER_SLICE = 65_536
QUERIES_PER_TASK = 8_192
_SLAB = 1 << 22
_HASHED = 512


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` (doubles) of the rows that take part."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", whole.alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL").filter(~bad)
    return rows.filter(F.exists("vector", lambda x: x != 0)).groupBy("vec_id").agg(F.max("vector").alias("vector"))


def classes_of(rows: DataFrame, kept_ids: int) -> DataFrame:
    """``class_id`` (the least id), ``ids`` (the ``kept_ids`` least), ``vector``, ``width``: one row per distinct vector.

    A group of copies is cut to its least ids in each task before it is shuffled.
    """
    place = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= kept_ids)
    return few.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("width", F.size("vector"))


def projections(width: int) -> np.ndarray:
    """Whole numbers, so that products with whole numbers are exact and a string never depends on the batch it is made in."""
    return np.rint(np.random.default_rng([width, 29]).standard_normal((width + 1, _ENTRIES)) * 1024)


def strings(vectors: np.ndarray, largest: float, planes: np.ndarray, as_query: bool) -> np.ndarray:
    """``[n, TREES, SYMBOLS // 2]`` bytes."""
    out = np.empty((len(vectors), TREES, SYMBOLS // 2), np.uint8)
    for first in range(0, len(vectors), _HASHED):
        part = vectors[first : first + _HASHED]
        if as_query:
            scaled = part / np.abs(part).max(1, keepdims=True)
            scaled /= np.sqrt((scaled * scaled).sum(1, keepdims=True))
            rest = np.zeros(len(part))
        else:
            scaled = part / largest
            rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))
        whole = np.rint(np.concatenate([scaled, rest[:, None]], axis=1) * (1 << 20))
        values = (whole @ planes).reshape(len(part), TREES * SYMBOLS, _BLOCK)
        place = np.abs(values).argmax(2)
        sign = np.take_along_axis(values, place[:, :, None], 2)[:, :, 0] > 0
        symbols = (place * 2 + sign).astype(np.uint8).reshape(len(part), TREES, SYMBOLS)
        out[first : first + _HASHED] = symbols[:, :, 0::2] << 4 | symbols[:, :, 1::2]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _runs_of_width(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with vectors of one width; the first column is the width."""
    widths = batch.column(0).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        yield batch if (widths == width).all() else batch.filter(pa.array(widths == width))


def entries(classes: DataFrame, largest: dict[int, float]) -> DataFrame:
    """``width, tree, string, salt, class_id, is_query``: each class once per tree, and again as a query if it holds one."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in _runs_of_width(batch):
                width = part.column(0)[0].as_py()
                if width not in planes:
                    planes = {width: projections(width)}
                for first in range(0, part.num_rows, _HASHED):
                    slab = part.slice(first, _HASHED)
                    vectors, ids = _matrix(slab.column(3)), slab.column(1).to_numpy(zero_copy_only=False)
                    asked = slab.column(2).to_numpy(zero_copy_only=False)
                    for as_query, rows in ((False, np.arange(len(ids))), (True, np.flatnonzero(asked))):
                        if len(rows):
                            codes = strings(vectors[rows], largest[width], planes[width], as_query).reshape(len(rows) * TREES, -1)
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.full(len(codes), width, np.int32)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(rows))),
                                pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.repeat(ids[rows], TREES)), pa.array(np.full(len(codes), as_query)),
                            ], ["width", "tree", "string", "class_id", "is_query"])

    made = classes.select("width", "class_id", "is_query", "vector").mapInArrow(hashed, "width int, tree int, string binary, class_id long, is_query boolean")
    return made.withColumn("salt", F.xxhash64("class_id"))


def _symbols(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)


def _level_counts(codes: np.ndarray, is_query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a sorted run: per query the rows with its prefix of each length, whether that prefix reaches an end of the run, and the
    rows that share each prefix of the first and of the last entry."""
    symbols = _symbols(codes)
    differs = symbols[1:] != symbols[:-1]
    common = np.where(differs.any(1), differs.argmax(1), SYMBOLS)
    counts = np.empty((int(is_query.sum()), SYMBOLS + 1), np.int64)
    opened = np.empty(counts.shape, bool)
    ends = np.empty((2, SYMBOLS + 1), np.int64)
    for level in range(SYMBOLS + 1):
        group = np.concatenate([[0], np.cumsum(common < level)])
        held = np.bincount(group, weights=~is_query, minlength=group[-1] + 1).astype(np.int64)
        counts[:, level] = held[group[is_query]]
        opened[:, level] = (group[is_query] == 0) | (group[is_query] == group[-1])
        ends[:, level] = held[0], held[-1]
    return counts, opened, ends[0], ends[1]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per query entry its counts (``role`` 0), and two rows per run of a tree in a slice for its ends (``role`` 1)."""
    for (slice_, width, tree), (ids, asked, text) in sorted_runs(batches, 3):
        is_query = asked.astype(bool)
        counts, opened, first, last = _level_counts(text, is_query)
        own = [(0, slice_, width, tree, int(i), bytes(t), c.tolist(), int(o.sum()) - 1)
               for i, t, c, o in zip(ids[is_query], text[is_query], counts, opened, strict=True)]
        whole = bool((text[0] == text[-1]).all())
        shared = _symbols(text[[0, -1]])
        same = SYMBOLS if whole else int((shared[0] != shared[1]).argmax())
        # A prefix that both ends share is described once.
        last[: same + 1] = 0
        own += [(1, slice_, width, tree, 0, bytes(text[0]), first.tolist(), 0), (1, slice_, width, tree, 0, bytes(text[-1]), last.tolist(), same + 1)]
        columns = list(zip(*own, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         ["role", "slice", "width", "tree", "class_id", "string", "counts", "level"])


def _prefix(level: Column) -> Column:
    """The first symbols of ``string``, as hexadecimal digits."""
    return F.substring(F.hex("string"), F.lit(1), level)


def sliced(made: DataFrame) -> DataFrame:
    """The sorted arrays: entries with the number of their slice. Written durably, as it is read more than once.

    Slices are cut by string and salt, so that many equal strings can be split as well.
    """
    n = made.count()
    parts = max(1, -(-n // ENTRIES_PER_SLICE))
    order = ["width", "tree", "string", "salt", "is_query", "class_id"]
    return durable(made.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id()))


def described(arrays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query entries with the rows under each of their prefixes, and the slices over which a prefix stretches.

    Returns ``slice, width, tree, class_id, string, counts`` and ``width, tree, level, prefix, slices`` (of prefixes in more than one
    slice). In a slice only its first and its last prefix can go on elsewhere, so the second table follows the slices.
    """
    found = durable(arrays.select("slice", "width", "tree", "class_id", F.col("is_query").cast("int").alias("asked"), "string").mapInArrow(
        _described, "role int, slice int, width int, tree int, class_id long, string binary, counts array<long>, level int"))
    # Levels below ``level`` of a run's last entry are those of its first.
    ends = found.filter("role = 1").select("slice", "width", "tree", "string", "level", F.posexplode("counts").alias("at", "n")).filter("at >= level")
    over = ends.groupBy("width", "tree", F.col("at").alias("level"), _prefix(F.col("at")).alias("prefix")).agg(
        F.collect_list(F.struct("slice", "n")).alias("slices")).filter(F.size("slices") > 1)
    over = durable(over)
    near = broadcast_if_small(over.select("width", "tree", "level", "prefix", F.aggregate("slices", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")), over.count())
    queries = found.filter("role = 0").select("slice", "width", "tree", "class_id", "string", "counts", F.col("level").alias("open"))
    # Only the prefixes that reach an end of the slice (the shortest ones) can be longer than what the slice has.
    wide = queries.select("class_id", "width", "tree", "string", F.explode(F.sequence(F.lit(0), "open")).alias("level")).filter(F.col("level") >= 0)
    wide = wide.withColumn("prefix", _prefix(F.col("level"))).join(near, ["width", "tree", "level", "prefix"]).groupBy("class_id", "tree").agg(
        F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("whole"))
    full = queries.join(wide, ["class_id", "tree"], "left")
    counts = F.transform("counts", lambda c, i: F.coalesce(F.try_element_at("whole", i), c))
    return durable(full.select("slice", "width", "tree", "class_id", "string", counts.alias("counts"))), over


def _true_neighbours(classes: DataFrame, sample: dict[int, tuple], k: int, largest: dict[int, float]) -> DataFrame:
    """``query``, ``class_id``, ``score``, ``level``: per task the k best classes of each sampled query, by a scan of all, with the
    longest prefix that one of the trees has in common."""
    model = classes.sparkSession.sparkContext.broadcast((sample, largest))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, largest = model.value
        best: dict[int, list] = {}
        made = {width: projections(width) for width in sample}
        asked = {width: _symbols(strings(vectors, largest[width], made[width], True).reshape(len(vectors) * TREES, -1)).reshape(len(vectors), TREES, -1) for width, (_, vectors) in sample.items()}
        for batch in batches:
            for part in _runs_of_width(batch):
                width = part.column(0)[0].as_py()
                if width not in sample:
                    continue
                queries, vectors = sample[width]
                rows, ids = _matrix(part.column(2)), part.column(1).to_numpy(zero_copy_only=False)
                scores = vectors @ rows.T
                scores[queries[:, None] == ids[None, :]] = -np.inf
                top = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
                chosen, place = np.unique(top, return_inverse=True)
                codes = _symbols(strings(rows[chosen], largest[width], made[width], False).reshape(len(chosen) * TREES, -1)).reshape(len(chosen), TREES, -1)
                for q, query in enumerate(queries.tolist()):
                    differs = codes[place.reshape(top.shape)[q]] != asked[width][q][None]
                    level = np.where(differs.any(2), differs.argmax(2), SYMBOLS).max(1)
                    kept = best.get(query, []) + list(zip(scores[q][top[q]].tolist(), ids[top[q]].tolist(), level.tolist(), strict=True))
                    best[query] = sorted((x for x in kept if x[0] > -np.inf), reverse=True)[:k]
        flat = [(query, i, s, level) for query, rows in best.items() for s, i, level in rows]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["query", "class_id", "score", "level"])

    place = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    return classes.select("width", "class_id", "vector").mapInArrow(scan, "query long, class_id long, score double, level int").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def _start(counts: np.ndarray, enough: int) -> int:
    """The longest prefix with enough rows over all trees, else the empty one."""
    held = np.flatnonzero(counts >= enough)
    return int(held[-1]) if len(held) else 0


def calibrate(classes: DataFrame, totals: DataFrame, k: int, largest: dict[int, float], target: float) -> int:
    """The least number of candidates, of k times the powers of two, with which the sample reaches the target recall."""
    drawn = totals.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE_QUERIES).join(classes.select("class_id", "width", "vector"), "class_id").collect()
    sample = {width: (np.array([r["class_id"] for r in drawn if r["width"] == width]), np.array([r["vector"] for r in drawn if r["width"] == width])) for width in {r["width"] for r in drawn}}
    levels: dict[int, list[int]] = {}
    for row in _true_neighbours(classes, sample, k, largest).select("query", "level").collect():
        levels.setdefault(row["query"], []).append(row["level"])
    counts = {r["class_id"]: np.array(r["counts"]) for r in drawn}
    enough = k
    while levels:
        found = [np.mean([level >= _start(counts[q], enough) for level in own]) for q, own in levels.items()]
        if np.mean(found) >= target or all(_start(c, enough) == 0 for c in counts.values()):
            break
        enough *= 2
    return enough


def _best(k: int):
    """The k best rows with the query's prefix, for all queries of a task, by one product per distinct prefix."""
    def search(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values(["tree", "prefix_key"], kind="stable")
            ids = rows["class_id"].to_numpy()
            matrix = np.frombuffer(b"".join(rows["bytes"]), np.float64).reshape(len(rows), -1)
            keys = [f"{t:04d}{s}" for t, s in zip(rows["tree"], rows["prefix_key"], strict=True)]
            keys = np.array(keys, dtype=f"U{4 + SYMBOLS}")
            for (tree, prefix), part in queries.groupby(["tree", "prefix"], sort=True):
                low = np.searchsorted(keys, f"{tree:04d}{prefix}")
                high = np.searchsorted(keys, f"{tree:04d}{prefix}~")
                if low == high:
                    continue
                names = part["class_id"].to_numpy()
                asked = np.frombuffer(b"".join(part["asked"]), np.float64).reshape(len(part), -1)
                step = max(1, _SLAB // (high - low))
                for first in range(0, len(part), step):
                    scores = asked[first : first + step] @ matrix[low:high].T
                    keep = min(k, high - low)
                    least = np.partition(scores, high - low - keep, axis=1)[:, high - low - keep]
                    for name, own, limit in zip(names[first : first + step].tolist(), scores, least, strict=True):
                        top = np.flatnonzero(own >= limit)
                        top = top[np.lexsort((ids[low + top], -own[top]))[:keep]]
                        out.append((name, ids[low + top].tolist(), own[top].tolist()))
        return pd.DataFrame(out, columns=["query", "found", "scores"])

    return search


def _candidates(classes: DataFrame, arrays: DataFrame, queries: DataFrame, over: DataFrame, k: int) -> DataFrame:
    """``query, class_id, score``: the best of all candidates in each slice. ``queries`` has the ``level`` each one ascended to.

    A query goes to the slices its prefix lies in. The queries of a slice are dealt to as many tasks as they need, with a copy of
    the slice each. At level 0 one tree holds all rows.
    """
    wanted = queries.filter("level > 0 OR tree = 0").withColumn("prefix", _prefix(F.col("level")))
    near = broadcast_if_small(over.select("width", "tree", "level", "prefix", F.transform("slices", lambda x: x["slice"]).alias("many")), over.count())
    placed = wanted.join(near, ["width", "tree", "level", "prefix"], "left").select(
        "class_id", "width", "tree", "prefix", F.explode(F.coalesce("many", F.array("slice"))).alias("slice"))
    placed = durable(placed)
    load = placed.groupBy("slice", "width").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).cast("int").alias("tasks"))
    load = broadcast_if_small(load, load.count())
    left = placed.join(load, ["slice", "width"]).withColumn("task", F.pmod(F.xxhash64("class_id"), F.col("tasks")).cast("int")).join(_doubles(classes), "class_id")
    rows = arrays.filter("NOT is_query").select("slice", "width", "tree", F.hex("string").alias("prefix_key"), "class_id")
    rows = rows.join(load, ["slice", "width"]).join(_doubles(classes), "class_id")
    right = rows.select("slice", "width", "tree", "prefix_key", "class_id", "bytes", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    key = ["slice", "width", "task"]
    left = left.select(*key, "tree", "prefix", "class_id", F.col("bytes").alias("asked"))
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        _best(k), "query long, found array<long>, scores array<double>")
    return met.select("query", F.explode(F.arrays_zip("found", "scores")).alias("x")).select("query", F.col("x.found").alias("class_id"), F.col("x.scores").alias("score"))


def _doubles(classes: DataFrame) -> DataFrame:
    """``class_id, bytes``: the vector as the bytes of its doubles."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(column).to_pylist()])
            parts = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], ["class_id", "bytes"])

    return classes.select("class_id", "vector").mapInArrow(packed, "class_id long, bytes binary")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET_RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows found for each query. ``is_query`` is a condition on ``vec_id``."""
    rows = durable(usable_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).withColumn("asked", F.coalesce(is_query, F.lit(False))))
    grouped = classes_of(rows, k + 1)
    asked = rows.filter("asked").select("vector", F.col("vec_id").alias("query_id"))
    classes = durable(grouped.join(asked.select("vector").distinct().withColumn("is_query", F.lit(True)), "vector", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False))))
    longest = F.array_max(F.transform("vector", F.abs))
    norm = longest * F.sqrt(F.aggregate(F.transform("vector", lambda x: x / longest), F.lit(0.0), lambda a, x: a + x * x))
    largest = {r["width"]: r["m"] for r in classes.groupBy("width").agg(F.max(norm).alias("m")).collect()}
    arrays = sliced(entries(classes, largest))
    queries, over = described(arrays)
    added = [F.sum(F.get("counts", F.lit(level))) for level in range(SYMBOLS + 1)]
    totals = durable(queries.groupBy("class_id").agg(F.array(*added).alias("counts")))
    enough = calibrate(classes, totals, k, largest, target)
    level = F.greatest(F.lit(0), F.array_max(F.transform("counts", lambda c, i: F.when(c >= enough, i).otherwise(-1))))
    levels = totals.select("class_id", level.alias("level"))
    met = durable(_candidates(classes, arrays, queries.join(levels, "class_id").drop("counts"), over, k + 1))
    # A class is its own neighbour if it has copies, whatever the trees say.
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    own = classes.filter("is_query").select(F.col("class_id").alias("query"), "class_id", square.alias("score"))
    best = met.unionByName(own).groupBy("query", "class_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    few = best.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k + 1)
    ids = few.join(classes.select("class_id", "ids"), "class_id").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = ids.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1)
    listed = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    named = asked.join(classes.filter("is_query").select("vector", F.col("class_id").alias("query")), "vector").select("query_id", "query").join(listed, "query")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
