"""Which rectangle shows where many overlap, as runs of pixels of a row.

Rectangles are cut at the lines of square tiles. Each task first paints the rectangles it has, tile by tile, and hands on the
parts that show; the parts of a tile then meet and are painted again. A task holds one tile and what shows on it, so neither a large
rectangle nor a tile with very many of them is ever gathered. What moves are runs of pixels, equal ones of neighbouring rows as one
rectangle, and not pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

TILE = 256
#: Pixels that are painted at once.
_SLAB = 1 << 20
_BOX = ["tx", "ty", "order", "x0", "y0", "x1", "y1"]


class _Tile:
    """The greatest order seen per pixel, and the row of the payload that has it."""

    def __init__(self, schema: pa.Schema) -> None:
        self.order = np.zeros((TILE, TILE), np.int64)
        self.row = np.full((TILE, TILE), -1, np.int64)
        self.kept = schema.empty_table()

    def paint(self, part: pa.RecordBatch) -> None:
        order, x0, y0, x1, y1 = (part.column(c).to_numpy().astype(np.int64) for c in _BOX[2:])
        base, seen, shown = self.kept.num_rows, self.order.ravel(), self.row.ravel()
        rising = np.argsort(order, kind="stable")
        width, area = (x1 - x0)[rising], ((x1 - x0) * (y1 - y0))[rising]
        ends = np.cumsum(area)
        first = 0
        while first < len(rising):
            # A slab of rectangles becomes pixels at once; of pixels given twice the last assignment, the greatest order, stays.
            before = int(ends[first] - area[first])
            last = max(first + 1, int(np.searchsorted(ends, before + _SLAB, side="right")))
            i = np.repeat(np.arange(first, last), area[first:last])
            y, x = np.divmod(np.arange(before, before + len(i)) - (ends - area)[i], width[i])
            source = rising[i]
            place = (y0[source] + y) * TILE + x0[source] + x
            over = (shown[place] < 0) | (seen[place] <= order[source])
            place, source = place[over], source[over]
            seen[place] = order[source]
            shown[place] = base + source
            first = last
        used = np.flatnonzero(np.bincount(shown + 1, minlength=base + part.num_rows + 1)[1:])
        row = np.full(base + part.num_rows + 1, -1, np.int64)
        row[used] = np.arange(len(used))
        self.kept = pa.concat_tables([self.kept, pa.Table.from_batches([part.select(self.kept.column_names)])]).take(pa.array(used))
        self.row = row[shown].reshape(TILE, TILE)

    def rectangles(self, tx: int, ty: int) -> pa.RecordBatch:
        """What shows: runs of pixels, equal ones of neighbouring rows as one rectangle."""
        starts = np.ones((TILE, TILE), bool)
        starts[:, 1:] = self.row[:, 1:] != self.row[:, :-1]
        flat = np.flatnonzero(starts.ravel())
        ends = np.append(flat[1:], TILE * TILE)
        row = self.row.ravel()[flat]
        flat, ends, row = flat[row >= 0], ends[row >= 0], row[row >= 0]
        y, x = np.divmod(flat, TILE)
        x1 = x + ends - flat
        sort = np.lexsort((y, row, x1, x))
        flat, y, x, x1, row = (v[sort] for v in (flat, y, x, x1, row))
        new = np.ones(len(y) + 1, bool)
        new[1:-1] = (np.diff(y) != 1) | (np.diff(row) != 0) | (np.diff(x) != 0) | (np.diff(x1) != 0)
        cut = np.flatnonzero(new)
        low, high = cut[:-1], cut[1:] - 1
        flat, row = flat[low], row[low]
        n = len(low)
        box = [np.full(n, tx, np.int32), np.full(n, ty, np.int32), self.order.ravel()[flat], x[low].astype(np.int32), y[low].astype(np.int32),
               x1[low].astype(np.int32), (y[high] + 1).astype(np.int32)]
        payload = self.kept.take(pa.array(row)).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in payload.columns]
        return pa.RecordBatch.from_arrays([*map(pa.array, box), *columns], [*_BOX, *self.kept.column_names])


    def pixels(self, tx: int, ty: int) -> pa.RecordBatch:
        """A row per pixel that shows a rectangle, in the image's coordinates."""
        flat = np.flatnonzero(self.row.ravel() >= 0)
        y, x = np.divmod(flat, TILE)
        payload = self.kept.take(pa.array(self.row.ravel()[flat])).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in payload.columns]
        place = [pa.array((v + t * TILE).astype(np.int32)) for v, t in ((x, tx), (y, ty))]
        return pa.RecordBatch.from_arrays([*place, *columns], ["px", "py", *self.kept.column_names])


def _painter(payload: list[str], told: Callable[[_Tile, int, int], pa.RecordBatch] = _Tile.rectangles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("tx", "ty")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                own, part = tuple(keys[a].tolist()), batch.slice(a, b - a)
                if own != now:
                    if tile is not None:
                        yield told(tile, *now)
                    now, tile = own, _Tile(part.select(payload).schema)
                tile.paint(part)
        if tile is not None:
            yield told(tile, *now)

    return run


def _painted_tiles(table: DataFrame, payload: list[str], order: str) -> DataFrame:
    """``(tx, ty, order, x0, y0, x1, y1, p0, p1...)``: what the rectangles of each task show, the rows of a tile together in one task."""
    tiles = lambda low, high: F.sequence(F.floor(F.col(low) / TILE).cast("int"), F.floor((F.col(high) - 1) / TILE).cast("int"))
    inside = lambda c, tile: F.greatest(F.lit(0), F.least(F.lit(TILE), F.col(c) - F.col(tile) * TILE)).cast("int")
    own = {f"p{i}": name for i, name in enumerate(payload)}
    cut = table.where("lx1 > lx0 AND ly1 > ly0").select(
        "lx0", "lx1", "ly0", "ly1", F.col(order).cast("long").alias("order"), *[F.col(name).alias(p) for p, name in own.items()], F.explode(tiles("ly0", "ly1")).alias("ty")
    ).withColumn("tx", F.explode(tiles("lx0", "lx1")))
    boxes = cut.select("tx", "ty", "order", inside("lx0", "tx").alias("x0"), inside("ly0", "ty").alias("y0"), inside("lx1", "tx").alias("x1"), inside("ly1", "ty").alias("y1"), *own)
    first = boxes.sortWithinPartitions("tx", "ty").mapInArrow(_painter(list(own)), boxes.schema)
    return first.repartition("tx", "ty").sortWithinPartitions("tx", "ty")


def painted_runs(table: DataFrame, payload: list[str], order: str = "ord") -> DataFrame:
    """``(py, px0, px1, *payload)``: the runs of pixels px0 <= px < px1 that one row of the table shows.

    ``table``: whole-number rectangles ``lx0 <= px < lx1``, ``ly0 <= py < ly1`` with an order; the greatest shows. Of equal orders either one
    may. Empty rectangles show nowhere.
    """
    tiles = _painted_tiles(table, payload, order)
    own = {f"p{i}": name for i, name in enumerate(payload)}
    last = tiles.mapInArrow(_painter(list(own)), tiles.schema)
    x = lambda c: (F.col("tx") * TILE + F.col(c))
    rows = F.explode(F.sequence(F.col("ty") * TILE + F.col("y0"), F.col("ty") * TILE + F.col("y1") - 1))
    return last.select(rows.alias("py"), x("x0").alias("px0"), x("x1").alias("px1"), *[F.col(p).alias(name) for p, name in own.items()])


def painted_pixels(table: DataFrame, payload: list[str], order: str = "ord") -> DataFrame:
    """``(px, py, *payload)``: every pixel of :func:`painted_runs`, straight from the painted tiles."""
    tiles = _painted_tiles(table, payload, order)
    own = {f"p{i}": name for i, name in enumerate(payload)}
    schema = StructType([StructField("px", IntegerType()), StructField("py", IntegerType()), *[tiles.schema[p] for p in own]])
    return tiles.mapInArrow(_painter(list(own), _Tile.pixels), schema).withColumnsRenamed(own)


def pixels_of(runs: DataFrame) -> DataFrame:
    """A row per pixel of each run; nothing moves."""
    return runs.select(F.explode(F.sequence("px0", F.col("px1") - 1)).alias("px"), *[c for c in runs.columns if c not in ("px0", "px1")])
