"""Nearest spot of every grid, and the radius join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.session import by_shuffle, durable, one_row

_FAN = 4            # cells per axis that a cell splits into
_BROADCAST_LEVELS = 4   # 16**4 = 65,536 cells at most: a bound by construction
_LEAF_SPOTS = 32
_MAX_LEVELS = 12


def nearest_spot(grids: DataFrame, spots: DataFrame) -> DataFrame:
    """``(grid_index, nearest_spot_index, nearest_spot_distance)``, exact; ties take the lowest index.

    ``grids``: ``(grid_index, center_x, center_y)``; ``spots``: ``(spot_index, x, y)``. Spots are put into nested
    square cells. A grid walks down from the root and keeps only the cells that can still hold its nearest spot:
    those no farther than the closest guaranteed distance. A crowded area only gets a deeper level, and a grid
    far from all spots never meets the spots of a crowd, so no step pairs a whole group with a whole group.
    """
    points = spots.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(
        F.min("spot_index").alias("spot_index")
    )
    points = durable(points)  # read once per level
    box = one_row(points.agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")
    ))
    if not box["n"]:
        raise ValueError("There are no spots.")
    side = max(box["x1"] - box["x"], box["y1"] - box["y"], 1.0) * (1 + 1e-9)
    levels = max(1, math.ceil(math.log(max(box["n"], 2)) / math.log(_FAN * _FAN)))
    while levels < _MAX_LEVELS and _crowd(points, box, side, levels) > _LEAF_SPOTS:
        levels += 1

    cx, cy = F.col("center_x").cast("float").cast("double"), F.col("center_y").cast("float").cast("double")
    walk = grids.select("grid_index", cx.alias("gx"), cy.alias("gy")).repartition("grid_index")
    fields = ("cx", "cy", "bx0", "bx1", "by0", "by1")
    for level in range(1, levels + 1):
        cells = _cells(points, box, side, level)
        if level == 1:  # at most sixteen cells, written into the plan
            first = [F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in cells.select(*fields).collect()]
            met = walk.select("grid_index", "gx", "gy", F.explode(F.array(*first)).alias("c")).select("grid_index", "gx", "gy", "c.*")
        else:
            cells = F.broadcast(cells) if level <= _BROADCAST_LEVELS else by_shuffle(cells)
            met = walk.withColumnsRenamed({"cx": "px", "cy": "py"}).join(cells, ["px", "py"])
        reach = Window.partitionBy("grid_index")
        walk = (
            met.select("grid_index", "gx", "gy", "cx", "cy", _box_distance("near").alias("_near"), _box_distance("far").alias("_far"))
            .withColumn("_bound", F.min("_far").over(reach))
            .where(F.col("_near") <= F.col("_bound") * (1 + 1e-12))
            .select("grid_index", "gx", "gy", "cx", "cy")
        )
    leaf = points.select("spot_index", "x", "y", *_cell(F.col("x"), F.col("y"), box, side, levels))
    met = walk.join(by_shuffle(leaf), ["cx", "cy"])
    dx, dy = F.col("gx") - F.col("x"), F.col("gy") - F.col("y")
    # Squared distances order the candidates, so equal distances tie exactly.
    best = met.groupBy("grid_index").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col("spot_index"))).alias("b"))
    return best.select(
        "grid_index",
        F.col("b.spot_index").alias("nearest_spot_index"),
        F.sqrt("b.d2").alias("nearest_spot_distance"),
    )


def _cell(x: Column, y: Column, box: dict, side: float, level: int) -> list[Column]:
    n = _FAN**level
    place = lambda v, low: F.least(F.lit(n - 1).cast("long"), F.floor((v - low) / side * n))
    return [place(x, box["x"]).alias("cx"), place(y, box["y"]).alias("cy")]


def _cells(points: DataFrame, box: dict, side: float, level: int) -> DataFrame:
    """Occupied cells of a level with their parent and the tight box of their spots."""
    tight = points.select("x", "y", *_cell(F.col("x"), F.col("y"), box, side, level)).groupBy("cx", "cy").agg(
        F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1")
    )
    return tight.withColumn("px", F.floor(F.col("cx") / _FAN)).withColumn("py", F.floor(F.col("cy") / _FAN))


def _crowd(points: DataFrame, box: dict, side: float, level: int) -> int:
    return one_row(
        points.select(*_cell(F.col("x"), F.col("y"), box, side, level)).groupBy("cx", "cy").count().agg(F.max("count").alias("m"))
    )["m"]


def _box_distance(kind: str) -> Column:
    """Squared distance to the closest (``near``) or the farthest (``far``) point of a cell's tight box."""
    if kind == "near":
        dx = F.greatest(F.col("bx0") - F.col("gx"), F.col("gx") - F.col("bx1"), F.lit(0.0))
        dy = F.greatest(F.col("by0") - F.col("gy"), F.col("gy") - F.col("by1"), F.lit(0.0))
    else:
        dx = F.greatest(F.abs(F.col("gx") - F.col("bx0")), F.abs(F.col("gx") - F.col("bx1")))
        dy = F.greatest(F.abs(F.col("gy") - F.col("by0")), F.abs(F.col("gy") - F.col("by1")))
    return dx * dx + dy * dy


def assign_spots(grids: DataFrame, spots: DataFrame, diameter: float) -> DataFrame:
    """Nearest spot and distance of every grid, and the spot it belongs to (-1 beyond half a diameter)."""
    return nearest_spot(grids, spots).withColumn(
        "spot_index",
        F.when(F.col("nearest_spot_distance") <= F.lit(diameter / 2.0), F.col("nearest_spot_index")).otherwise(F.lit(-1)),
    )


def spots_within(grids: DataFrame, spots: DataFrame, radius: float) -> DataFrame:
    """The nearest spot within the radius (inclusive), else -1, when the full distance is not needed.

    Buckets have the side of the radius. The spots are copied to the nine buckets around them and meet grids on
    equal buckets. Grids lie on a lattice, so a bucket holds a fixed number of them: the pairs grow with the
    spots, also in a crowded bucket.
    """
    side = float(radius)
    bucket = lambda c: F.floor(F.col(c).cast("double") / side)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = spots.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(
        F.min("spot_index").alias("spot_index")
    ).select("spot_index", "x", "y", around.alias("o")).select(
        "spot_index", "x", "y", (bucket("x") + F.col("o.i")).alias("bx"), (bucket("y") + F.col("o.j")).alias("by")
    )
    placed = grids.select("grid_index", "center_x", "center_y", bucket("center_x").alias("bx"), bucket("center_y").alias("by"))
    dx, dy = F.col("center_x") - F.col("x"), F.col("center_y") - F.col("y")
    best = (
        placed.join(spread, ["bx", "by"])
        .select("grid_index", "spot_index", (dx * dx + dy * dy).alias("d2"))
        .where(F.sqrt("d2") <= side)
        .groupBy("grid_index").agg(F.min(F.struct("d2", "spot_index")).getField("spot_index").alias("spot_index"))
    )
    return grids.select("grid_index").join(best, "grid_index", "left").select(
        "grid_index", F.coalesce("spot_index", F.lit(-1)).alias("spot_index")
    )
