"""Columns computed from one text column in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


#: Bytes of a slice of a batch that is turned into Python values at once.
SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of bounded size, or single rows where these are larger. Only a worker's memory depends on it."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def per_text(
    rows: DataFrame, text: str, fields: Sequence[tuple[str, pa.DataType, str]], make: Callable[[], Callable[[list[str | None]], Iterable[tuple]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (the columns in ``keep``, all if None) and one column per field (name, Arrow type, Spark type).

    ``make`` runs once per task and gives the function that maps a list of texts to one tuple each. The input columns travel
    inside a struct, so no name can clash; a text that is among them travels there only.
    """
    names = list(rows.columns if keep is None else keep)
    inside = names.index(text) if text in names and rows.schema[text].dataType.simpleString() == "string" else None
    packed = rows.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("row"), *([] if inside is not None else [F.col(f"`{text}`").cast("string").alias("text")]))
    schema = packed.select("row").schema
    for name, _, kind in fields:
        schema = schema.add(name, DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            texts = batch.column(1) if inside is None else batch.column(0).field(inside)
            found = list(work(texts.to_pylist()))
            columns = [pa.array([x[i] for x in found], kind) for i, (_, kind, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *[name for name, _, _ in fields]])

    return packed.mapInArrow(run, schema)


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list]]:
    """Runs of rows with equal values in the first ``keys`` (whole number) columns, also across batches.

    Gives the key and, per further column, an array (numbers; equally long binary values as rows of bytes) or a list.
    """
    pending_key, pending = None, []

    def columns_of(batch: pa.RecordBatch) -> list:
        out = []
        for column in batch.columns[keys:]:
            if pa.types.is_binary(column.type):
                joined = b"".join(column.to_pylist())
                out.append(np.frombuffer(joined, np.uint8).reshape(len(column), -1))
            elif pa.types.is_integer(column.type):
                out.append(column.to_numpy(zero_copy_only=False))
            else:
                out.append(column.to_pylist())
        return out

    def joined(parts: list[list]) -> list:
        if len(parts) == 1:
            return parts[0]
        return [np.concatenate(same) if isinstance(same[0], np.ndarray) else [x for part in same for x in part] for same in zip(*parts, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns[:keys]], axis=1)
        values = columns_of(batch)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            own, part = tuple(key[a].tolist()), [x[a:b] for x in values]
            if own != pending_key and pending:
                yield pending_key, joined(pending)
                pending = []
            pending_key = own
            pending.append(part)
    if pending:
        yield pending_key, joined(pending)
