"""Weighted sums of wide vectors by blocks of the lattice: a sparse matrix of weights times dense rows, one block per task.

Vectors and weights meet by block, so each vector is shuffled once, however many sums it enters. A target (a grid, a polygon)
whose weights all lie in one block is finished there; the partial sums of the others are merged afterwards, and only those move
again. A block holds a bounded number of bytes; the weights of a crowded block are dealt to several tasks with a copy of its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spotweave.functions.vectors import vector_sum
from spotweave.session import broadcast_if_small, scratch_path

#: Bytes of vectors, and of sums, that one task holds.
BLOCK_BYTES = 64 << 20
_SLAB = 1 << 20


def block_side(bytes_per_place: int, most: int = 64) -> int:
    """The side of a square block whose places hold about ``BLOCK_BYTES``."""
    return max(1, min(most, int((BLOCK_BYTES / max(1, bytes_per_place)) ** 0.5)))


def width_of(rows: DataFrame, vector: str) -> int:
    """The width of the vectors, from the first one; others are checked where they are read."""
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    return first["n"] if first else 0


def block_of(value: Column, size: int) -> Column:
    return F.floor(value / size).cast("int")


def vector_columns(rows: DataFrame, name: str) -> list[Column]:
    """``vector`` and ``single``: a vector in its own precision, so that single precision is not widened before it moves."""
    single = rows.schema[name].dataType.simpleString() == "array<float>"
    value, none = F.col(name), F.lit(None)
    return [(none if single else value).cast("array<double>").alias("vector"), (value if single else none).cast("array<float>").alias("single")]


def _dense(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that are not null as a matrix, and the row of each in it (-1 for null)."""
    held = pc.is_valid(column).to_numpy()
    flat = pc.list_flatten(column)
    if flat.null_count:
        raise ValueError("A vector lacks an element.")
    if set(pc.unique(pc.list_value_length(column.drop_null())).to_pylist()) - {width}:
        raise ValueError(f"Vectors must have {width} elements.")
    return flat.to_numpy().reshape(-1, width), np.where(held, np.cumsum(held) - 1, -1)


def weighted_sums(matrix: np.ndarray, source: np.ndarray, weight: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """Row t of the result: the sum of weight times matrix[source] over the entries of target t, in slabs of bounded size."""
    out = np.zeros((n, matrix.shape[1]))
    if not len(source):
        return out
    # Entries of one target and one source are one entry.
    pair, place = np.unique(target * max(1, len(matrix)) + source, return_inverse=True)
    target, source, weight = pair // max(1, len(matrix)), pair % max(1, len(matrix)), np.bincount(place.ravel(), weights=weight)
    step = max(1, _SLAB // max(1, matrix.shape[1]))
    for first in range(0, len(pair), step):
        own = target[first : first + step]
        part = matrix[source[first : first + step]] * weight[first : first + step, None]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[starts]] += np.add.reduceat(part, starts, axis=0)
    return out


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def _products(widths: list[int], schema: pa.Schema):
    def run(weights: pa.Table, rows: pa.Table) -> pa.Table:
        if not weights.num_rows or not rows.num_rows:
            return schema.empty_table()
        targets = weights.column("target").combine_chunks().dictionary_encode()
        border = np.zeros(len(targets.dictionary), bool)
        code = targets.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        border[code] = weights.column("border").to_numpy()
        kinds, sources, amounts = (weights.column(c).to_numpy() for c in ("kind", "source", "weight"))
        if np.isnan(amounts).any() or (amounts < 0).any():
            raise ValueError("A weight is negative or missing.")
        held = rows.column("kind").to_numpy()
        columns = [targets.dictionary, pa.array(border)]
        for kind, width in enumerate(widths):
            own = rows.filter(pa.array(held == kind))
            column = own.column("single")
            matrix, place = _dense(own.column("vector") if column.null_count == len(column) else column, width)
            names = own.column("source").to_numpy()
            order = np.argsort(names, kind="stable")
            if (np.diff(names[order]) == 0).any():
                raise ValueError("A vector is given twice.")
            asked = np.flatnonzero(kinds == kind)
            at = np.searchsorted(names[order], sources[asked])
            known = at < len(names)
            known[known] = names[order][at[known]] == sources[asked][known]
            asked, at = asked[known], order[at[known]]
            n = len(border)
            full = place[at] >= 0
            sums = weighted_sums(matrix, place[at][full], amounts[asked][full], code[asked][full], n)
            count = lambda mask, weight=None: np.bincount(code[asked][mask], weight, n)  # noqa: B023, E731
            every = np.ones(len(asked), bool)
            columns += [pa.array(count(every).astype(np.int64)), pa.array(count(every, amounts[asked])), pa.array(count(full).astype(np.int64)),
                        pa.array(count(full, amounts[asked][full])), _lists(sums)]
        return pa.Table.from_arrays(columns, names=schema.names)

    return run


def block_sums(weights: DataFrame, rows: DataFrame, widths: list[int]) -> DataFrame:
    """Sums of vectors per target.

    ``weights``: ``(bx, by, target, border, kind, source, weight)``; ``rows``: ``(bx, by, kind, source, vector, single)`` (:func:`vector_columns`)
    with each source of a kind once. ``border`` marks the targets that may have weights in other blocks too. Returns ``target`` and, per kind k,
    ``n{k}`` and ``weight{k}`` over all weights that meet a row, ``used{k}`` and ``used_weight{k}`` over those that meet a vector which is not
    NULL, and ``sum{k}``, NULL if there is none. Targets that meet no row of kind 0 are left out. Partial sums are written once.
    """
    spark = weights.sparkSession
    size = 8 * sum(widths)
    load = weights.groupBy("bx", "by").agg(F.ceil(F.count(F.lit(1)) * F.lit(float(size)) / F.lit(float(len(widths) * 16 * BLOCK_BYTES))).cast("int").alias("tasks"))
    crowded = load.where("tasks > 1")
    crowded = broadcast_if_small(crowded, crowded.count())
    tasks = F.coalesce("tasks", F.lit(1))
    left = weights.join(crowded, ["bx", "by"], "left").withColumn("task", F.pmod(F.xxhash64("target"), tasks).cast("int")).drop("tasks")
    right = rows.join(crowded, ["bx", "by"], "left").withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
    kind = weights.schema["target"].dataType.simpleString()
    fields = [f"target {kind}", "border boolean"]
    for k in range(len(widths)):
        fields += [f"n{k} bigint", f"weight{k} double", f"used{k} bigint", f"used_weight{k} double", f"sum{k} array<double>"]
    empty = spark.createDataFrame([], ", ".join(fields))
    key = ["bx", "by", "task"]
    right = right.withColumnsRenamed({c: f"row_{c}" for c in key})  # both sides may stem from the same table
    partial = left.groupBy(*key).cogroup(right.groupBy(*[f"row_{c}" for c in key])).applyInArrow(_products(widths, to_arrow_schema(empty.schema)), empty.schema)
    path = scratch_path(spark, "block_sums")
    partial.write.parquet(path)
    stored = spark.read.schema(empty.schema).parquet(path)
    counts = [c for k in range(len(widths)) for c in (f"n{k}", f"weight{k}", f"used{k}", f"used_weight{k}")]
    merged = stored.where("border").groupBy("target").agg(
        *[F.sum(c).alias(c) for c in counts], *[vector_sum(F.col(f"sum{k}"), w).alias(f"sum{k}") for k, w in enumerate(widths)])
    whole = stored.where("NOT border").select(*merged.columns).unionByName(merged).where("n0 > 0")
    return whole.select("target", *counts, *[F.when(F.col(f"used{k}") > 0, F.col(f"sum{k}")).alias(f"sum{k}") for k in range(len(widths))])
