"""Row-wise steps on streaming tables. The work itself is batch; only steps without state are offered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def apply_to_stream(
    spark: SparkSession, source: str, schema: StructType, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Apply a row-wise step (a filter of ``operators``, ``predict_grids``...) to Parquet files as they arrive.

    Every file present is processed once, then the query ends; the checkpoint makes a restart continue.
    """
    arriving = spark.readStream.schema(schema).parquet(source)
    return (
        step(arriving).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
