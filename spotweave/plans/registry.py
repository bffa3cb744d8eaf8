"""Query registry: a Spark function, its result columns, and the SQL that must give the same rows.

Columns are declared once, ``name:kind`` with kind ``i`` (whole number), ``d`` (double, rounded to six places), ``s``
(text) or ``b`` (boolean); both sides are projected to the same names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.plans.fixtures import FIXTURES, Fixtures, compose
from spotweave.plans.reference_sql import PARTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SQL = {"i": "CAST({c} AS BIGINT)", "s": "CAST({c} AS VARCHAR)", "b": "CAST({c} AS BOOLEAN)",
        "d": "CASE WHEN round(CAST({c} AS DOUBLE), 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({c} AS DOUBLE), 6) END"}


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "d":
        r = F.round(c.cast("double"), 6)
        return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(name)
    return c.cast({"i": "bigint", "s": "string", "b": "boolean"}[kind]).alias(name)


def query(name: str, columns: str, oracle: str | None = None):
    spec = [c.split(":") for c in columns.split()]

    def register(build: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Fixtures(spark, folder)).select(*[_spark_column(n, k) for n, k in spec])

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            shaped = ", ".join(f'{_SQL[k].format(c=chr(34) + n + chr(34))} AS "{n}"' for n, k in spec)
            ORACLES[name] = compose(f"SELECT {shaped} FROM (\n{oracle}\n) AS result", {**FIXTURES, **PARTS})
        return build

    return register
