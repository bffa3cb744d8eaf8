"""Vector aggregates: every one has a partial (map-side) step, so a hot group is combined before it moves."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this width one codegen'd sum per element beats the object aggregate.
NARROW = 32


def _weight(vec: Column, weight: Column | None) -> Column:
    """The weight of a row, 0 where the vector is NULL; a negative weight is an error."""
    given = F.lit(1.0) if weight is None else weight.cast("double")
    checked = given if weight is None else F.when(given < 0, F.raise_error(F.lit("A weight is negative.")).cast("double")).otherwise(given)
    return F.when(vec.isNotNull(), checked).otherwise(F.lit(0.0))


def _element(vec: Column, i: int) -> Column:
    """Element i, NULL if the vector is; a NULL or absent element of a vector is an error."""
    x = F.get(vec, F.lit(i)).cast("double")
    return F.when(vec.isNotNull() & x.isNull(), F.raise_error(F.lit("A vector lacks an element.")).cast("double")).otherwise(x)


def _whole(vec: Column) -> Column:
    """The vector for the object aggregate, which leaves out rows of weight 0 before it looks at their width."""
    return array_to_vector(F.coalesce(vec.cast("array<double>"), F.array(F.lit(0.0))))


def vector_sum(vec: Column, width: int | None = None, weight: Column | None = None) -> Column:
    """Element-wise weighted sum of an array column, as ``array<double>``.

    One rule for all widths: a NULL vector is left out with its weight; NULL elements and negative weights are errors. A group
    of NULL vectors only has NULL elements if the width is known to be narrow, else it is an error.
    """
    w = _weight(vec, weight)
    if width is not None and width <= NARROW:
        return F.array(*[F.sum(_element(vec, i) * w) for i in range(width)])
    return vector_to_array(Summarizer.sum(_whole(vec), w))


def vector_mean(vec: Column, width: int | None = None, weight: Column | None = None) -> Column:
    """Element-wise weighted mean of an array column, as ``array<double>``, by the rule of :func:`vector_sum`."""
    w = _weight(vec, weight)
    if width is not None and width <= NARROW:
        whole = F.sum(w)
        return F.array(*[F.sum(_element(vec, i) * w) / whole for i in range(width)])
    return vector_to_array(Summarizer.mean(_whole(vec), w))


def vector_pop_std(vec: Column, width: int | None = None) -> Column:
    """Element-wise population standard deviation."""
    if width is not None and width <= NARROW:
        return F.array(*[F.stddev_pop(_element(vec, i)) for i in range(width)])
    n = F.count(vec)
    unbiased = vector_to_array(Summarizer.variance(_whole(vec), _weight(vec, None)))
    return F.transform(unbiased, lambda v: F.sqrt(v * (n - 1) / n))
