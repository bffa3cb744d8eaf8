"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Components are whole numbers, x = floor(scale * c) + SHIFT. The fit counts each distinct vector once. Sums are exact; the scatter is
summed in tasks from rows that are centred first (at the nearest whole number, then by the rest of the mean), so that nothing
cancels. Only this matrix, whose size the width fixes, comes to the driver: V = L L' by Cholesky with diagonal pivots, and the
columns of L are rotated in pairs until they are orthogonal. Their squared norms are the eigenvalues, the columns brought to
length 1 the components.

Vectors that are null, empty, or hold a null or non-finite component take no part; neither do components with |scale * c| of 2^53 or
more (no such whole number is exact). Each width is whitened by itself. Every repeated row and every null id is given back. Directions
without variance have no component, so equal vectors only, one vector and empty tables give no rows. Equal eigenvalues keep the
order of the rotated columns. ``deviation`` is null where it exceeds 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.vectors import vector_sum
from spotweave.session import durable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a task that are turned into doubles at once.
_SLAB = 4096


def whole_vectors(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``row`` (id), ``x``: the rows that take part, as long arrays."""
    scaled = F.transform("embedding", lambda c: c.cast("double") * scale)
    rows = vectors.select(F.col("vec_id"), scaled.alias("scaled")).filter("scaled IS NOT NULL AND size(scaled) > 0")
    rows = rows.filter(~F.exists("scaled", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 53))))
    return rows.select("vec_id", F.transform("scaled", lambda c: F.floor(c).cast("long") + shift).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slabs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[np.ndarray]:
    for batch in batches:
        for first in range(0, batch.num_rows, _SLAB):
            yield _matrix(batch.slice(first, _SLAB).column(column))


def sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of each dimension. Tasks hand on a row per dimension."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        n = 0
        for x in _slabs(batches, "x"):
            # 4,096 numbers of 53 bits can exceed 64 bits: halves are added apart.
            own = [(int(high) << 26) + int(low) for high, low in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0), strict=True)]
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
            n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([str(v) for v in [n, *total]])], ["i", "s"])

    added = fit.select("x").mapInArrow(part, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in added.collect()}
    return found.pop(-1, 0), np.array([found[i] for i in sorted(found)], object)


class Centre:
    """Rows minus S / n: first the whole part of the mean, exactly, then the rest."""

    def __init__(self, n: int, total: np.ndarray) -> None:
        self.whole = np.array([(2 * int(s) + n) // (2 * n) for s in total], np.int64)
        self.rest = np.array([(int(s) - n * int(c)) / n for s, c in zip(total, self.whole, strict=True)], np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def scatter(fit: DataFrame, centre: Centre, n: int, turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred rows, turned by ``turn`` if given. Tasks hand on their sums, a row per line of the matrix."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _slabs(batches, "x"):
            y = centre(x) if turn is None else centre(x) @ turn
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "line"])

    lines = fit.select("x").mapInArrow(part, "i int, line array<double>").groupBy("i").agg(vector_sum(F.col("line")).alias("line")).collect()
    return np.array([r["line"] for r in sorted(lines, key=lambda r: r["i"])]) / n


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L', triangular up to the order of its rows; as many columns as v has rank (up to rounding)."""
    d = len(v)
    factor, rest = np.zeros((d, d)), np.diag(v).astype(np.float64).copy()
    limit = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    taken = np.zeros(d, bool)
    for k in range(d):
        pivot = int(np.where(taken, -np.inf, rest).argmax())
        if not rest[pivot] > limit:
            return factor[:, :k]
        column = v[:, pivot] - factor[:, :k] @ factor[pivot, :k]
        column[taken] = 0.0
        factor[:, k] = column / np.sqrt(rest[pivot])
        factor[pivot, k] = np.sqrt(rest[pivot])
        taken[pivot] = True
        rest = np.where(taken, 0.0, rest - factor[:, k] ** 2)
    return factor


def _rounds(count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of disjoint pairs (a circle is turned about one fixed place)."""
    places = list(range(count + count % 2))
    for _ in range(len(places) - 1):
        left, right = np.array(places[: len(places) // 2]), np.array(places[: len(places) // 2 - 1 : -1])
        real = (left < count) & (right < count)
        yield left[real], right[real]
        places.insert(1, places.pop())


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of factor factor', falling, and their unit eigenvectors as columns: columns are rotated until orthogonal."""
    a = factor.copy()
    if not a.shape[1]:
        return np.zeros(0), a
    for _ in range(sweeps):
        worst = 0.0
        for i, j in _rounds(a.shape[1]):
            p, q, r = (a[:, i] ** 2).sum(0), (a[:, j] ** 2).sum(0), (a[:, i] * a[:, j]).sum(0)
            size = np.sqrt(p * q)
            worst = max(worst, float((np.abs(r) / np.where(size > 0, size, 1.0)).max(initial=0.0)))
            turn = np.abs(r) > 1e-16 * size
            zeta = (q - p) / np.where(turn, 2 * r, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[:, i], a[:, j] = a[:, i] * c - a[:, j] * s, a[:, i] * s + a[:, j] * c
        if worst <= 4 * np.finfo(float).eps:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, a[:, order] / norms[order]


def _whitened(rows: DataFrame, centre: Centre, n: int, total: np.ndarray, turn: np.ndarray, values: np.ndarray, explained: np.ndarray, error: float) -> DataFrame:
    sums_of = np.array([int(s) for s in total], np.float64)
    exact = [int(s) for s in total]

    def deviations(x: np.ndarray) -> list[int | None]:
        about = ((n * x.astype(np.float64) - sums_of) ** 2).sum(1)
        if (about < 4e18).all() and max(map(abs, exact), default=0) < 1 << 62:
            return ((n * x - np.array(exact, np.int64)) ** 2).sum(1).tolist()
        found = [sum((n * v - s) ** 2 for v, s in zip(line, exact, strict=True)) for line in x.tolist()]
        return [v if v < 1 << 63 else None for v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = turn.shape[1]
        for batch in batches:
            for first in range(0, batch.num_rows, _SLAB):
                part = batch.slice(first, _SLAB)
                x = _matrix(part.column("x"))
                white = centre(x) @ turn
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), m)))
                held = deviations(x)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * m, n)),
                    pa.array([v for v in held for _ in range(m)], pa.int64()), pa.array(white.ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.tile(values, len(x))), pa.array(np.full(len(x) * m, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "eigenvalue", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, eigenvalue double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, eigenvalue, identity_error`` per row and component."""
    rows = whole_vectors(vectors, scale, shift)
    fit = durable(rows.select("x").distinct())
    out = rows.limit(0).select("vec_id").selectExpr(
        "vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS eigenvalue", "0D AS identity_error")
    widths = sorted(r["w"] for r in fit.select(F.size("x").alias("w")).distinct().collect())
    for width in widths:
        own = fit.filter(F.size("x") == width)
        n, total = sums(own)
        centre = Centre(n, total)
        covariance = scatter(own, centre, n)
        values, axes = one_sided_jacobi(pivoted_cholesky(covariance))
        values, axes = values[:components], axes[:, :components]
        if not len(values):
            continue
        turn = axes / np.sqrt(values)
        error = float(np.abs(scatter(own, centre, n, turn) - np.eye(len(values))).max())
        explained = values / np.trace(covariance)
        out = out.unionByName(_whitened(rows.filter(F.size("x") == width), centre, n, total, turn, values, explained, error))
    return out
