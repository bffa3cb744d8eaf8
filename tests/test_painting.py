import numpy as np

from spotweave.operators import painting, windows


def brute(rows):
    shown = {}
    for order, x0, x1, y0, y1, label in sorted(rows):
        for y in range(y0, y1):
            for x in range(x0, x1):
                shown[x, y] = (order, label)
    return shown


def frame(spark, rows):
    return spark.createDataFrame(rows, "ord long, lx0 int, lx1 int, ly0 int, ly1 int, label string").repartition(6)


def test_runs_match_brute_force(spark):
    """Small and large rectangles over several tiles, hidden ones, empty ones, NULL labels."""
    rng = np.random.default_rng(1)
    rows = []
    for order in rng.permutation(400).tolist():
        x, y = rng.integers(0, 600, 2).tolist()
        w, h = (rng.integers(0, 30, 2) if order % 50 else rng.integers(200, 400, 2)).tolist()
        rows.append((order, x, x + w, y, y + h, None if order % 7 == 0 else f"l{order % 5}"))
    table = frame(spark, rows)
    runs = painting.painted_runs(table, ["label", "ord"]).collect()
    got = {}
    for r in runs:
        for x in range(r.px0, r.px1):
            assert (x, r.py) not in got
            got[x, r.py] = (r.ord, r.label)
    assert got == brute(rows)
    assert {(r.px, r.py): (r.ord, r.label) for r in windows.painted(table, ["label", "ord"]).collect()} == got


def test_only_what_shows_moves(spark):
    """A pile of rectangles on one place leaves one task as the runs of what shows, not as pixels or rectangles."""
    rows = [(k, 3, 21, 5, 23, "a") for k in range(3000)] + [(5000 + k, 18 * k, 18 * k + 18, 300, 318, "b") for k in range(20)]
    table = frame(spark, rows).coalesce(2)
    done = painting.painted_runs(table, ["label"])
    assert sum(r.px1 - r.px0 for r in done.collect()) == 18 * 18 * 21
    plan = done._jdf.queryExecution().optimizedPlan()
    assert done.count() <= 18 * 21 + 18 * 2  # lattice cells of one row join at no tile line
    assert plan.toString().count("RepartitionByExpression") == 1


def test_no_rectangles(spark):
    assert windows.painted(frame(spark, [(1, 4, 4, 0, 9, "x")]), ["label"]).count() == 0


def test_equal_runs_move_as_one_rectangle_and_pixels_match_runs(spark):
    """What moves between the two paintings are rectangles, not a row per line of pixels; the pixels are those of the runs."""
    rows = [(i, x, x + 18, y, y + 18, f"l{i}") for i, (x, y) in enumerate((x, y) for y in range(0, 180, 18) for x in range(0, 180, 18))]
    rows += [(500, 30, 300, 40, 45, "over"), (501, 250, 260, 250, 270, None), (502, 5, 5, 0, 9, "empty")]
    table = frame(spark, rows)
    moved = painting._painted_tiles(table, ["label"], "ord")
    assert moved.count() < 2 * len(rows)
    pixels = painting.painted_pixels(table, ["label", "ord"])
    assert dict(pixels.dtypes) == {"px": "int", "py": "int", "label": "string", "ord": "bigint"}
    got = sorted(tuple(r) for r in pixels.select("px", "py", "ord").collect())
    assert got == sorted((x, y, order) for (x, y), (order, _) in brute(rows).items())
    assert got == sorted(tuple(r) for r in painting.pixels_of(painting.painted_runs(table, ["label", "ord"])).select("px", "py", "ord").collect())
