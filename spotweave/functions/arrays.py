"""Array columns as small vectors: element-wise maths with higher-order functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def total(vec: Column) -> Column:
    return F.aggregate(doubles(vec), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; inside a lambda it would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scaled(vec: Column, factor: Column) -> Column:
    return F.transform(doubles(vec), lambda v: v * factor)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def log1p_clipped(vec: Column) -> Column:
    """``log(1 + max(v, 0))`` per element."""
    return F.transform(doubles(vec), lambda v: F.log1p(F.greatest(v, F.lit(0.0))))


def normalised(vec: Column, floor: float) -> Column:
    """Clip at zero, divide by ``max(sum, floor)``; an all-zero vector stays zero."""
    clipped = F.transform(doubles(vec), lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    return let(clipped, lambda c: shares(c, floor))


def shares(vec: Column, floor: float) -> Column:
    """Each element over ``max(sum, floor)``."""
    return let(F.greatest(total(vec), F.lit(floor)), lambda t: F.transform(vec, lambda v: v / t))


def first_max_index(vec: Column) -> Column:
    """Zero-based position of the first maximum; NULL for an empty or NULL vector."""
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def softmax(vec: Column, temperature: float = 1.0) -> Column:
    t = max(float(temperature), 1e-6)
    x = doubles(vec)
    powers = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp((v - top) / F.lit(t))))
    return let(powers, lambda e: let(total(e), lambda whole: F.transform(e, lambda v: v / whole)))


def relu(vec: Column) -> Column:
    return F.transform(doubles(vec), lambda v: F.greatest(v, F.lit(0.0)))


def leaky_relu(vec: Column, slope: float = 0.01) -> Column:
    return F.transform(doubles(vec), lambda v: F.when(v >= 0, v).otherwise(v * F.lit(slope)))


def sigmoid(vec: Column) -> Column:
    return F.transform(doubles(vec), lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))


def softplus(vec: Column, beta: float = 20.0) -> Column:
    """``log(1 + exp(beta v)) / beta``, written so that a large argument cannot overflow."""
    return F.transform(
        doubles(vec),
        lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v * F.lit(beta)))) / F.lit(beta),
    )


def layer_norm(vec: Column, eps: float = 1e-5) -> Column:
    x = doubles(vec)
    centred = let(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(c)
    return let(centred, lambda c: let(F.sqrt(square(c) + F.lit(eps)), lambda sd: F.transform(c, lambda v: v / sd)))


def dense(entries: Column, size: int) -> Column:
    """Sorted ``array<struct<position, value>>`` as a full vector of the given length, absent positions 0.

    The gaps between neighbouring entries become runs of zeros, so the work is linear in the vector.
    """
    position = F.transform(entries, lambda e: e.getField("position").cast("int"))
    ends = F.concat(position, F.array(F.lit(size)))
    starts = F.concat(F.array(F.lit(-1)), position)
    gaps = F.zip_with(ends, starts, lambda end, start: F.array_repeat(F.lit(0.0), end - start - 1))
    values = F.concat(
        F.transform(entries, lambda e: F.array(e.getField("value").cast("double"))), F.array(F.array().cast("array<double>"))
    )
    return F.flatten(F.zip_with(gaps, values, lambda gap, value: F.concat(gap, value)))
