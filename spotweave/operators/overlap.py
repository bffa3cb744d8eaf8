"""Polygons over the grid lattice: edges, areas, validity and the overlap area of polygon and grid cell.

The overlap is computed with column arithmetic only. An edge is cut at the lattice lines it crosses; below an
edge every cell of the column is covered to the full width of the piece, which a running sum over the column
carries down. A ring that crosses itself is first cut at its crossings and reduced to the outline of what it winds
around. Work and rows therefore grow with the lattice cells the edges cross plus the cells in the result,
and never with edges times candidate cells. All shuffles are keyed finer than the polygon, so one huge polygon
is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.operators.ordinals import ordinal
from spotweave.session import durable, one_row

#: Rounding steps of a coordinate that a length may be off; areas below such a length times their extent are no areas.
ROUNDING = 64 * 2.0**-52

_TRAPEZOID = "(bx - ax) * (by + ay) / 2.0"


def ring_edges(vertices: DataFrame) -> DataFrame:
    """``(cell_id, slot, ax, ay, bx, by)``: every edge of every ring, the closing edge included.

    ``vertices``: ``(cell_id, vertex_ord, vertex_x, vertex_y)``; see :func:`numbered`. Each vertex is sent as the end of
    one edge and the start of the next, keyed by ring and position.
    """
    null = F.lit(None).cast("double")
    x, y = F.col("vertex_x").cast("double"), F.col("vertex_y").cast("double")
    half = lambda slot, ax, ay, bx, by: F.struct(
        slot.cast("long").alias("slot"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")
    )
    sent = vertices.select(
        "cell_id",
        F.explode(F.array(half(F.col("vertex_ord"), x, y, null, null), half(F.col("vertex_ord") - 1, null, null, x, y))).alias("h"),
    ).select("cell_id", "h.*")
    met = sent.groupBy("cell_id", "slot").agg(*[F.max(c).alias(c) for c in ("ax", "ay", "bx", "by")])
    inner = met.where("ax IS NOT NULL AND bx IS NOT NULL")
    closing = met.where("ax IS NULL OR bx IS NULL").groupBy("cell_id").agg(
        F.max("slot").alias("slot"), *[F.max(c).alias(c) for c in ("ax", "ay", "bx", "by")]
    )
    return inner.unionByName(closing)


def numbered(vertices: DataFrame) -> DataFrame:
    """Vertices with ``vertex_ord`` = 0, 1, 2... in every ring, in the given order; ties and gaps are numbered anew.

    A vertex without a coordinate is an error. Rings that are numbered already, the usual case, are only counted.
    """
    ord_ = F.col("vertex_ord").cast("decimal(38,0)")
    rings = vertices.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(ord_).alias("low"), F.max(ord_).alias("high"), F.sum(ord_).alias("total"), F.sum(ord_ * ord_).alias("squares"),
        F.count_if(F.col("vertex_ord").isNull() | F.col("vertex_x").isNull() | F.col("vertex_y").isNull()).alias("absent"))
    n = F.col("n").cast("decimal(38,0)")
    plain = (F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("total") * 2 == n * (n - 1)) & (F.col("squares") * 6 == (n - 1) * n * (2 * n - 1))
    told = one_row(rings.agg(F.sum("absent").alias("absent"), F.count_if(~F.coalesce(plain, F.lit(False))).alias("odd")))
    if told["absent"]:
        raise ValueError(f"{told['absent']} polygon vertices lack a position or a coordinate.")
    if not told["odd"]:
        return vertices
    return ordinal(vertices, ["vertex_ord", "vertex_x", "vertex_y"], ["cell_id"], "_position").withColumn("vertex_ord", F.col("_position")).drop("_position")


def ring_stats(vertices: DataFrame) -> DataFrame:
    """Vertex count, bounds and the plain mean of the vertices, per ring."""
    return vertices.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.min("vertex_x").alias("min_x"), F.max("vertex_x").alias("max_x"),
        F.min("vertex_y").alias("min_y"), F.max("vertex_y").alias("max_y"),
        F.avg("vertex_x").alias("center_x"), F.avg("vertex_y").alias("center_y"),
    )


def ring_areas(edges: DataFrame) -> DataFrame:
    """Shoelace area of every ring."""
    return edges.groupBy("cell_id").agg(F.abs(F.sum(F.expr(_TRAPEZOID))).alias("area"))


def ring_geometry(edges: DataFrame) -> DataFrame:
    """Vertex count, vertex mean and area of every ring, in one pass: each vertex starts exactly one edge."""
    return edges.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_vertices"), F.avg("ax").alias("center_x"), F.avg("ay").alias("center_y"),
        F.abs(F.sum(F.expr(_TRAPEZOID))).alias("area"),
        (ROUNDING * F.max(F.greatest(F.abs("ax"), F.abs("ay"))) * (F.max("ax") - F.min("ax") + F.max("ay") - F.min("ay"))).alias("flat"),
    )


def self_crossing(edges: DataFrame, bin_size: float = 4.5, crowd: int = 64, levels: int = 8) -> DataFrame:
    """Rings with two edges that properly cross. (A ring that only touches itself keeps its area.)"""
    return crossings(edges, bin_size, crowd, levels, every=False).select("cell_id").distinct()


def crossings(edges: DataFrame, bin_size: float = 4.5, crowd: int = 64, levels: int = 8, every: bool = True) -> DataFrame:
    """``(cell_id, x)``: where two edges of a ring properly cross.

    All edges of a ring with at most ``crowd`` of them are compared. Those of a larger ring are put into the square bins they pass
    through, and only edges of a ring that share a bin are compared. Bins with more than ``crowd`` edges are split into sixteen first, again and again where needed, so the pairs
    stay proportional to the edges. Only the part of an edge that lies in such a bin is binned again, at most seven smaller bins
    whatever the edge's length. With ``every`` off a ring leaves as soon as one crossing is known.
    """
    bins = ["cell_id", "_col", "_row"]
    up = ["_col_up", "_row_up"]
    ends = ("ax", "ay", "bx", "by")
    todo = edges.where("ax <> bx OR ay <> by").select("cell_id", "slot", *ends)
    large = durable(todo.groupBy("cell_id").count().where(F.col("count") > crowd).select("cell_id"))
    if large.isEmpty():
        return _proper_crossings(todo, bins[:1]).distinct()
    found, size = _proper_crossings(todo.join(large, "cell_id", "left_anti"), bins[:1]), float(bin_size)
    todo = todo.join(large, "cell_id", "left_semi")
    for level in range(levels + 1):
        binned = _crossed_cells(todo, *[F.col(c) for c in ends], F.lit(size), inside=level > 0).drop(*up)
        binned = durable(binned) if level else binned
        counted = binned.groupBy(*bins).count().where(F.col("count") > crowd).select(*bins)
        last = level == levels or counted.isEmpty()
        counted = counted if last else durable(counted)
        ready = binned if last else binned.join(counted, bins, "left_anti")
        found = found.unionByName(_proper_crossings(ready, bins))
        if last:
            break
        crowded = binned.join(counted, bins, "left_semi")
        if not every:
            found = durable(found.groupBy("cell_id").agg(F.min("x").alias("x")))
            crowded = crowded.join(found.select("cell_id"), "cell_id", "left_anti")
        todo = crowded.withColumnsRenamed(dict(zip(bins[1:], up, strict=True)))
        size /= 4
    return found.distinct()


def _proper_crossings(binned: DataFrame, bins: list[str]) -> DataFrame:
    ends = ("ax", "ay", "bx", "by")
    other = binned.select(*bins, F.col("slot").alias("slot2"), *[F.col(c).alias(f"{c}2") for c in ends])
    pairs = binned.select(*bins, "slot", *ends).join(other, bins).where("slot < slot2")

    def side(p: str, q: str, r: str, s: str = "", t: str = "") -> Column:
        px, py, qx, qy = F.col(f"{p}x{s}"), F.col(f"{p}y{s}"), F.col(f"{q}x{s}"), F.col(f"{q}y{s}")
        return F.signum((qx - px) * (F.col(f"{r}y{t}") - py) - (qy - py) * (F.col(f"{r}x{t}") - px))

    apart = (side("a", "b", "a", "", "2") * side("a", "b", "b", "", "2") < 0) & (
        side("a", "b", "a", "2", "") * side("a", "b", "b", "2", "") < 0
    )
    turn = F.expr("(bx - ax) * (by2 - ay2) - (by - ay) * (bx2 - ax2)")
    along = F.expr("(ax2 - ax) * (by2 - ay2) - (ay2 - ay) * (bx2 - ax2)") / turn
    return pairs.where(apart).select("cell_id", (F.col("ax") + along * (F.col("bx") - F.col("ax"))).alias("x"))


def _crossed_cells(edges: DataFrame, ax: Column, ay: Column, bx: Column, by: Column, size: Column, inside: bool = False) -> DataFrame:
    """One row per square cell an edge passes through (``_col``, ``_row``), column by column.

    ``inside``: only those within the cell of four times the size that ``_col_up`` and ``_row_up`` name.
    """
    def cells(rows: DataFrame, low: Column, high: Column, up: str, name: str) -> DataFrame:
        first, last = F.floor(low / size), F.floor(high / size)
        if inside:
            first, last = F.greatest(first, F.col(up) * 4), F.least(last, F.col(up) * 4 + 3)
        # The ends are columns first: they would be computed over and over inside the explode.
        ends = rows.withColumn("_first", first).withColumn("_last", last)
        # A null has no rows: the part of an edge may miss this column of the larger cell.
        return ends.withColumn(name, F.explode(F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last")))).drop("_first", "_last")

    left = F.least(ax, bx)
    right = F.greatest(ax, bx)
    columns = cells(edges, left, right, "_col_up", "_col")
    l = F.greatest(left, F.col("_col") * size)
    r = F.least(right, (F.col("_col") + 1) * size)
    slope = (by - ay) / F.nullif(bx - ax, F.lit(0.0))
    low, high = F.least(ay, by), F.greatest(ay, by)
    at = lambda x: F.greatest(low, F.least(high, F.coalesce(ay + slope * (x - ax), low)))
    y1, y2 = at(l), F.when(ax == bx, high).otherwise(at(r))
    heights = columns.withColumn("_y1", y1).withColumn("_y2", y2)
    return cells(heights, F.least("_y1", "_y2"), F.greatest("_y1", "_y2"), "_row_up", "_row").drop("_y1", "_y2")


def candidate_cells(stats: DataFrame, grid: int) -> DataFrame:
    """Every lattice origin in the bounds of a ring, both ends inclusive (the search space, kept for inspection)."""
    steps = lambda low, high: F.sequence(
        F.floor(F.col(low) / grid) * grid, F.ceil(F.col(high) / grid) * grid, F.lit(grid).cast("long")
    )
    return stats.select("cell_id", F.explode(steps("min_x", "max_x")).alias("x0"), steps("min_y", "max_y").alias("_ys")).select(
        "cell_id", "x0", F.explode("_ys").alias("y0")
    )


def candidate_grids(stats: DataFrame, grids: DataFrame, grid: int) -> DataFrame:
    """Candidates that exist in the grid table (equal origins; grids off the lattice never match)."""
    return candidate_cells(stats, grid).join(
        grids.select("grid_id", F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0")), ["x0", "y0"]
    ).select("cell_id", "grid_id", "x0", "y0")


def _column_pieces(edges: DataFrame, grid: int) -> DataFrame:
    """Every edge, left to right, cut at the lattice columns: ``l``, ``r`` with heights ``yl``, ``yr``; ``s`` is its direction."""
    g = F.lit(float(grid))
    forward = F.col("ax") < F.col("bx")
    oriented = edges.where("ax <> bx").select(
        "cell_id",
        F.when(forward, 1.0).otherwise(-1.0).alias("s"),
        F.when(forward, F.col("ax")).otherwise(F.col("bx")).alias("xa"),
        F.when(forward, F.col("ay")).otherwise(F.col("by")).alias("ya"),
        F.when(forward, F.col("bx")).otherwise(F.col("ax")).alias("xb"),
        F.when(forward, F.col("by")).otherwise(F.col("ay")).alias("yb"),
    )
    columns = oriented.select(
        "*", F.explode(F.sequence(F.floor(F.col("xa") / g), F.ceil(F.col("xb") / g) - 1)).alias("gx")
    ).select(
        "cell_id", "gx", "s", "xa", "ya", "xb", "yb",
        F.greatest("xa", F.col("gx") * g).alias("l"), F.least("xb", (F.col("gx") + 1) * g).alias("r"),
    ).where("r > l")
    return columns.select("cell_id", "gx", "s", "l", "r", _height("l").alias("yl"), _height("r").alias("yr"), "xa", "ya", "xb", "yb")


def _height(x: str) -> Column:
    slope = (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))
    return F.greatest(F.least("ya", "yb"), F.least(F.greatest("ya", "yb"), F.col("ya") + slope * (F.col(x) - F.col("xa"))))


def outline(edges: DataFrame, crossed: DataFrame, grid: int) -> DataFrame:
    """Pieces of the outline of what crossing rings wind around: ``s`` is 1 on top of covered ground and -1 below it.

    Inside a lattice column all pieces are cut where any begins, ends or crosses. Between two cuts they lie above one
    another; going up, their directions sum to the winding number, and only those stay that have ground wound around on one
    side. ``crossed`` is ``(cell_id, x)`` of :func:`crossings`; other rings give nothing.
    """
    pieces = _column_pieces(edges.join(crossed.select("cell_id").distinct(), "cell_id", "left_semi"), grid)
    at = crossed.select("cell_id", F.floor(F.col("x") / float(grid)).alias("gx"), "x")
    ends = pieces.select("cell_id", "gx", F.explode(F.array("l", "r")).alias("x")).unionByName(at)
    cuts = ends.groupBy("cell_id", "gx").agg(F.sort_array(F.collect_set("x")).alias("cuts"))
    inner = F.filter("cuts", lambda x: (x >= F.col("l")) & (x <= F.col("r")))
    parted = pieces.join(cuts, ["cell_id", "gx"]).withColumn("cuts", inner).where("size(cuts) > 1")
    spans = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.get("cuts", i - 1).alias("l"), F.get("cuts", i).alias("r")))
    spanned = parted.withColumn("c", F.explode(spans)).withColumn("l", F.col("c.l")).withColumn("r", F.col("c.r"))
    spanned = spanned.select("cell_id", "gx", "s", "l", "r", _height("l").alias("yl"), _height("r").alias("yr"))
    up = Window.partitionBy("cell_id", "gx", "l").orderBy(F.col("yl") + F.col("yr"), "s")
    below = F.coalesce(F.sum("s").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    wound = spanned.withColumn("_below", below).where((F.col("_below") == 0) != (F.col("_below") + F.col("s") == 0))
    return wound.withColumn("s", F.when(F.col("_below") == 0, -1.0).otherwise(1.0)).drop("_below")


def outline_areas(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("cell_id").agg(F.sum(F.expr("s * (r - l) * (yl + yr) / 2.0")).alias("area"))


def overlap_cells(edges: DataFrame, grid: int, repaired: DataFrame | None = None) -> DataFrame:
    """``(cell_id, x0, y0, area)``: overlap area of every ring with every lattice cell it covers.

    ``repaired``: :func:`outline` of the rings that cross themselves; they are taken from there.
    """
    g = F.lit(float(grid))
    if repaired is None:
        plain = _column_pieces(edges, grid)
    else:
        plain = _column_pieces(edges.join(repaired.select("cell_id").distinct(), "cell_id", "left_anti"), grid)
    shape = ("cell_id", "gx", "s", "l", "r", "yl", "yr")
    pieces = plain.select(*shape)
    if repaired is not None:
        pieces = pieces.unionByName(repaired.select(*shape))
    pieces = pieces.withColumn("gy0", F.floor(F.least("yl", "yr") / g))
    crossed = pieces.withColumn("gy", F.explode(F.sequence(F.col("gy0"), F.floor(F.greatest("yl", "yr") / g))))
    base = F.col("gy") * g
    below = F.col("s") * _area_under(F.col("yl") - base, F.col("yr") - base, F.col("r") - F.col("l"), g)
    events = crossed.groupBy("cell_id", "gx", "gy").agg(
        F.sum(below).alias("part"),
        F.sum(F.when(F.col("gy") == F.col("gy0"), F.col("s") * (F.col("r") - F.col("l")) * g).otherwise(0.0)).alias("full"),
    )
    # One lattice column of one ring: at most as many rows as the slide has lattice rows.
    down = Window.partitionBy("cell_id", "gx").orderBy(F.col("gy").desc())
    above = F.coalesce(F.sum("full").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    scanned = events.select(
        "cell_id", "gx", "gy", "part", above.alias("above"), F.lag("gy").over(down).alias("upper")
    )
    least = ROUNDING * grid * grid * (F.abs("gx") + F.abs("gy") + 2)
    # Rows strictly between two crossed rows are covered to the same width throughout.
    runs = F.when(
        (F.abs("above") > least) & (F.col("upper") > F.col("gy") + 1), F.sequence(F.col("gy") + 1, F.col("upper") - 1)
    ).otherwise(F.array().cast("array<bigint>"))
    own = F.struct(F.col("gy").alias("row"), F.abs(F.col("part") + F.col("above")).alias("area"))
    between = F.transform(runs, lambda row: F.struct(row.alias("row"), F.abs(F.col("above")).alias("area")))
    return (
        scanned.select("cell_id", "gx", least.alias("least"), F.explode(F.concat(F.array(own), between)).alias("c"))
        .where(F.col("c.area") > F.col("least"))
        .select("cell_id", (F.col("gx") * grid).alias("x0"), (F.col("c.row") * grid).alias("y0"), F.col("c.area").alias("area"))
    )


def _area_under(yl: Column, yr: Column, width: Column, g: Column) -> Column:
    """Area between a cell's floor and a straight piece, clamped to the cell (heights relative to the floor).

    The mean height is taken over the part of the piece inside the cell and the part above it, without a difference of
    nearly equal areas, so flat pieces lose no digits.
    """
    low, high = F.least(yl, yr), F.greatest(yl, yr)
    inside = lambda v: F.greatest(F.lit(0.0), F.least(g, v))
    a, b = inside(low), inside(high)
    sloped = ((b - a) * (a + b) / 2.0 + g * F.greatest(F.lit(0.0), high - F.greatest(low, g))) / (high - low)
    return width * F.when(high > low, sloped).otherwise(a)


def grid_weights(edges: DataFrame, grids: DataFrame, grid: int) -> DataFrame:
    """``(cell_id, grid_id, weight)`` with weight = overlap area / grid area, for grids in the table."""
    repaired = durable(outline(edges, durable(crossings(edges, grid / 4.0)), grid))
    located = grids.select("grid_id", F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0"))
    return overlap_cells(edges, grid, repaired).join(located, ["x0", "y0"]).select(
        "cell_id", "grid_id", "area", (F.col("area") / float(grid * grid)).alias("weight")
    )
