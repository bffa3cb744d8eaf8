import numpy as np
import pandas as pd
import pytest

from spotweave.operators import lattice, nearest, overlap, raster


def _plan(df):
    return df._jdf.queryExecution().toString()


def _clip_area(ring, x0, y0, size):
    """Area of a ring cut to a box, by cutting at the four sides in turn."""
    points = [tuple(p) for p in ring]
    for axis, bound, keep in ((0, x0, 1), (0, x0 + size, -1), (1, y0, 1), (1, y0 + size, -1)):
        out = []
        for a, b in zip(points, points[1:] + points[:1]):
            da, db = keep * (a[axis] - bound), keep * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if (da > 0 > db) or (da < 0 < db):
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        points = out
        if not points:
            return 0.0
    p = np.array(points)
    return abs(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1])) / 2


def _vertices(spark, rings):
    rows = [(c, i, float(x), float(y)) for c, ring in rings.items() for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "cell_id long, vertex_ord long, vertex_x double, vertex_y double").repartition(5)


def _star(rng, n, radius, cx, cy):
    angle = np.sort(rng.random(n)) * 2 * np.pi
    r = radius * (0.4 + 0.6 * rng.random(n))
    return np.stack([cx + r * np.cos(angle), cy + r * np.sin(angle)], axis=1)


def test_overlap_matches_clipping(spark):
    rng = np.random.default_rng(0)
    rings = {i: _star(rng, 5 + i % 9, 5 + 4 * (i % 12), *rng.integers(-40, 200, 2)) for i in range(60)}
    rings[900] = np.array([(0, 0), (36, 0), (36, 36), (0, 36)], float)        # on the lattice lines
    rings[901] = np.array([(0, 0), (0, 36), (36, 36), (36, 0), (0, 0)], float)  # clockwise, first vertex repeated
    got = overlap.overlap_cells(overlap.ring_edges(_vertices(spark, rings)), 18)
    assert "CartesianProduct" not in _plan(got) and "NestedLoop" not in _plan(got)
    found = {(r.cell_id, r.x0, r.y0): r.area for r in got.collect()}
    for cell, ring in rings.items():
        low, high = np.floor(ring.min(0) / 18).astype(int) - 1, np.ceil(ring.max(0) / 18).astype(int) + 1
        for gx in range(low[0], high[0]):
            for gy in range(low[1], high[1]):
                want = _clip_area(ring, gx * 18, gy * 18, 18)
                assert found.get((cell, gx * 18, gy * 18), 0.0) == pytest.approx(want, abs=1e-4), (cell, gx, gy)


def test_one_huge_ring_fills_its_cells(spark):
    angle = np.linspace(0, 2 * np.pi, 4000, endpoint=False)
    ring = np.stack([3000 + 2500 * np.cos(angle), 3000 + 2500 * np.sin(angle)], axis=1)
    edges = overlap.ring_edges(_vertices(spark, {1: ring}))
    cells = overlap.overlap_cells(edges, 18).toPandas()
    area = overlap.ring_areas(edges).first()["area"]
    assert cells.area.sum() == pytest.approx(area, rel=1e-9)
    assert cells.area.max() <= 324 + 1e-6 and not cells.duplicated(["x0", "y0"]).any()
    assert overlap.self_crossing(edges).count() == 0


def test_self_crossing_also_in_crowded_bins(spark):
    tiny = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    circle = np.stack([np.cos(tiny), np.sin(tiny)], axis=1)
    knot = circle.copy()
    knot[[100, 300]] = knot[[300, 100]]
    rings = {1: [(0, 0), (10, 10), (10, 0), (0, 10)], 2: [(0, 0), (10, 0), (10, 10), (0, 10)], 3: circle, 4: knot,
             5: [(0, 0), (4, 0), (8, 0)], 6: [(1, 1)]}
    found = overlap.self_crossing(overlap.ring_edges(_vertices(spark, rings)), crowd=16)
    assert sorted(r.cell_id for r in found.collect()) == [1, 4]


def test_long_edges_are_binned_again_only_inside_crowded_bins(spark, monkeypatch):
    """A fan of 5,000-pixel edges through one bin: below the first level an edge has a few bins, not thousands."""
    rng = np.random.default_rng(5)
    far = [(5000 * (k % 2) + rng.random(), 2500 * (k % 2) + rng.random() * 4) for k in range(120)]
    ring = overlap.ring_edges(_vertices(spark, {1: far, 2: [(0, 0), (9, 0), (9, 9), (0, 9)]}))
    made, plain = [], overlap._crossed_cells

    def counting(*args, inside=False):
        out = plain(*args, inside=inside)
        made.append((inside, out.count(), out.select("cell_id", "slot", *(["_col_up", "_row_up"] if inside else [])).distinct().count()))
        return out

    monkeypatch.setattr(overlap, "_crossed_cells", counting)
    ends = [(r.ax, r.ay, r.bx, r.by) for r in ring.where("cell_id = 1").select("ax", "ay", "bx", "by").collect()]
    turn = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    crossed = 0
    for i, e in enumerate(ends):
        for f in ends[:i]:
            a, b, c, d = e[:2], e[2:], f[:2], f[2:]
            crossed += turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0
    found = overlap.crossings(ring, 18.0, crowd=16, levels=4)
    # Places of one pair may differ in the last bit where two bins hold both edges; no two pairs are as close.
    places = np.sort([r.x for r in found.where("cell_id = 1").collect()])
    assert found.where("cell_id = 2").count() == 0 and (np.diff(places) > 1e-9).sum() + 1 == crossed > 500
    deeper = [(rows, parts) for inside, rows, parts in made if inside]
    assert deeper and all(rows <= 7 * parts for rows, parts in deeper)
    assert [r.cell_id for r in overlap.self_crossing(ring, 18.0, crowd=16, levels=4).collect()] == [1]


def test_ring_geometry_of_degenerate_rings(spark):
    edges = overlap.ring_edges(_vertices(spark, {1: [(1, 2)], 2: [(0, 0), (2, 2)], 3: [(0, 0), (2, 0), (4, 0)], 4: [(0, 0), (2, 0), (2, 2)]}))
    got = {r.cell_id: (r.n_vertices, r.area) for r in overlap.ring_geometry(edges).collect()}
    assert got == {1: (1, 0.0), 2: (2, 0.0), 3: (3, 0.0), 4: (3, 2.0)}


def test_nearest_spot_with_a_crowded_cell_and_ties(spark):
    rng = np.random.default_rng(3)
    spots = np.concatenate([rng.random((60, 2)) * 1000, 500 + rng.random((200, 2)), [[100, 100], [100, 100], [118, 100]]]).astype(np.float32)
    gx, gy = np.meshgrid(np.arange(9, 1000, 72), np.arange(9, 1000, 72))
    grids = np.concatenate([np.stack([gx.ravel(), gy.ravel()], 1), [[109.0, 100.0], [-5000.0, 40.0]]]).astype(np.float64)
    g = spark.createDataFrame(pd.DataFrame({"grid_index": np.arange(len(grids)), "center_x": grids[:, 0], "center_y": grids[:, 1]}))
    s = spark.createDataFrame(pd.DataFrame({"spot_index": np.arange(len(spots)), "x": spots[:, 0], "y": spots[:, 1]}))
    found = nearest.nearest_spot(g, s)
    assert "CartesianProduct" not in _plan(found) and "NestedLoop" not in _plan(found)
    got = found.toPandas().sort_values("grid_index")
    d2 = ((grids[:, None, :].astype(np.float32).astype(float) - spots[None].astype(float)) ** 2).sum(-1)
    assert np.allclose(got.nearest_spot_distance, np.sqrt(d2.min(1)))
    assert got.nearest_spot_index.tolist() == d2.argmin(1).tolist()
    near = nearest.spots_within(g, s, 30.0).toPandas().sort_values("grid_index").spot_index
    assert near.tolist() == np.where(np.sqrt(d2.min(1)) <= 30, d2.argmin(1), -1).tolist()


def _words(spark, mask):
    ys, xs = np.nonzero(mask)
    return raster.pack(spark.createDataFrame(pd.DataFrame({"px": xs.astype("int32"), "py": ys.astype("int32")}), "px int, py int"))


def _image(words, shape):
    out = np.zeros(shape, bool)
    for r in raster.unpack(words).collect():
        out[r.py, r.px] = True
    return out


def _square_all(mask, radius):
    padded = np.pad(mask, radius)
    h, w = mask.shape
    views = [padded[i : i + h, j : j + w] for i in range(2 * radius + 1) for j in range(2 * radius + 1)]
    return np.all(views, axis=0), np.any(views, axis=0)


@pytest.mark.parametrize("width", [64, 131])
def test_morphology_matches_brute_force(spark, width):
    mask = np.random.default_rng(width).random((30, width)) < 0.9
    words = _words(spark, mask)
    for radius in (1, 2):
        assert (_image(raster.erode(words, radius), mask.shape) == _square_all(mask, radius)[0]).all()
    sparse = ~mask
    assert (_image(raster.dilate(_words(spark, sparse), width, 30, 3), mask.shape) == _square_all(sparse, 3)[1]).all()
    step = _square_all(_square_all(_square_all(mask, 1)[0], 1)[1], 1)[1]
    want = _square_all(_square_all(_square_all(step, 1)[1], 1)[0], 1)[0]
    assert (_image(raster.open_and_close(words, width, 30), mask.shape) == want).all()


def test_holes_are_filled_but_a_spiral_corridor_is_not(spark):
    size = 41
    mask = np.zeros((size, 70), bool)
    mask[2:39, 2:39] = True
    x, y, step, length = 2, 3, 0, 34
    for turn in range(12):  # a corridor that winds inwards from the border
        dx, dy = [(1, 0), (0, 1), (-1, 0), (0, -1)][turn % 4]
        for _ in range(max(length - 3 * (turn // 2), 0)):
            mask[y, x] = False
            x, y = x + dx, y + dy
    mask[20, 50:60] = mask[30, 50:60] = True
    mask[20:31, 50] = mask[20:31, 59] = True
    reached, todo = np.zeros_like(mask), [(0, 0)]
    while todo:
        i, j = todo.pop()
        if 0 <= i < size and 0 <= j < 70 and not mask[i, j] and not reached[i, j]:
            reached[i, j] = True
            todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    got = _image(raster.fill_holes(_words(spark, mask), 70, size), mask.shape)
    assert (got == ~reached).all() and got[25, 55]


def test_isolated_patch_keeps_its_own_vector(spark):
    patches = spark.createDataFrame([(0, 0, 0), (1, 72, 0), (2, 720, 720)], "patch_index long, x0 int, y0 int")
    tiles = spark.createDataFrame([(0, [1.0, 3.0]), (1, [5.0, 7.0]), (2, [9.0, 9.0])], "patch_index long, tile array<float>")
    got = {r.patch_index: (r.neighbour_mean, r.neighbour_std, r.neighbour_count) for r in lattice.neighbour_stats(patches, tiles).collect()}
    assert got == {0: ([5.0, 7.0], [0.0, 0.0], 1), 1: ([1.0, 3.0], [0.0, 0.0], 1), 2: ([9.0, 9.0], [0.0, 0.0], 0)}


def test_blending_a_constant_gives_the_constant(spark):
    patches = spark.createDataFrame([(0, 0, 0), (1, 72, 0)], "patch_index long, x0 int, y0 int")
    views = spark.createDataFrame([(0, 0, 7, 0.2), (0, 1, 7, 0.9), (1, 0, 7, 0.4), (1, 1, 8, 0.001)], "patch_index long, token_linear int, grid_index long, weight double")
    tokens = views.selectExpr("patch_index", "token_linear", "array(2.0F, 3.0F) AS token")
    vectors = spark.createDataFrame([(0, [4.0]), (1, [4.0])], "patch_index long, patch_vector array<double>")
    blended = lattice.blend(patches, views, tokens, vectors, 2, 1)
    assert {r.grid_index: [round(v, 12) for v in r.feature] for r in blended.collect()} == {7: [2.0, 3.0, 4.0], 8: [2.0, 3.0, 4.0]}


@pytest.mark.parametrize("width", [3, 1280, 4000])
def test_blending_by_blocks(spark, monkeypatch, width):
    """Patches over several blocks, wide vectors, one of them missing: against plain sums over all views."""
    from spotweave.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4 * (256 * 8 * width + 16 * 8 * (width + 2)))  # two patches a side
    seen, plain = [], blocks.block_sums

    def watched(weights, rows, widths):
        seen.append((weights, rows))
        return plain(weights, rows, widths)

    monkeypatch.setattr(lattice, "block_sums", watched)
    rng = np.random.default_rng(width)
    places = [(x, y) for y in range(2) for x in (0, 1, 2, 5)] if width > 3 else [(x, y) for y in range(6) for x in range(6) if (x, y) != (2, 3)]
    patches = spark.createDataFrame([(i, 72 * x, 72 * y) for i, (x, y) in enumerate(places)], "patch_index long, x0 int, y0 int")
    shown = lattice.token_grids(patches)
    numbers = {xy: n for n, xy in enumerate(sorted({(r.x0, r.y0) for r in shown.collect()}))}
    listed = spark.createDataFrame([(x, y, n) for (x, y), n in numbers.items()], "x0 int, y0 int, grid_index long")
    views = lattice.token_to_grid(shown, listed).select("patch_index", "token_linear", "grid_index", "weight")
    base = rng.standard_normal(width).astype(np.float32).astype(float)
    scale = lambda p, t: np.float32(((p * 256 + t) % 17) / 8.0)
    literal = ", ".join(f"CAST({float(v)!r} AS FLOAT)" for v in base)
    tokens = shown.select("patch_index", "token_linear").selectExpr(
        "patch_index", "token_linear", f"CASE WHEN patch_index = 1 AND token_linear = 40 THEN NULL ELSE transform(array({literal}), v -> CAST(v * ((patch_index * 256 + token_linear) % 17) / 8 AS FLOAT)) END AS token")
    own = {i: rng.standard_normal(2) for i in range(len(places))}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in own.items()], "patch_index long, patch_vector array<double>")
    got = {r.grid_index: r for r in lattice.blend(patches, views, tokens.repartition(3), vectors).collect()}
    sums = {}
    for r in views.collect():
        s = sums.setdefault(r.grid_index, [0.0, 0.0, np.zeros(2), 0.0, 0])
        if (r.patch_index, r.token_linear) != (1, 40):
            s[0] += r.weight * float(scale(r.patch_index, r.token_linear))
            s[1] += r.weight
        s[2] += r.weight * own[r.patch_index]
        s[3] += r.weight
        s[4] += 1
    assert sorted(got) == sorted(sums) == list(range(len(numbers)))
    for g, (scaled, used, patch, weight, n) in sums.items():
        assert np.allclose(got[g].feature, np.concatenate([base * scaled / used, patch / weight]), atol=1e-5)
        assert got[g].n_views_averaged == n and got[g].weight_sum == pytest.approx(weight)
    weights, rows = seen[0]
    assert weights.select("bx", "by").distinct().count() > 1 and 0 < weights.where("border").count() < weights.count()
    assert rows.where("kind = 0").count() == 256 * len(places)  # every token vector is sent once


def test_polygon_vectors_move_once(spark, monkeypatch, tmp_path):
    """Polygons over few and many blocks: sums as by hand; sent are the grids once and a partial vector per border polygon and block."""
    from spotweave.operators import aggregate, blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4 * 4 * 8 * 6)  # blocks of four grids a side
    rng = np.random.default_rng(4)
    grids = [(i, (i % 20) * 18, (i // 20) * 18, rng.standard_normal(4).tolist(), rng.random(2).tolist()) for i in range(400)]
    frame = spark.createDataFrame(grids, "ord long, x0 long, y0 long, expr array<double>, prob array<double>")
    hits = [(c, *grids[g][1:3], g, float(rng.random())) for c in range(300) for g in sorted(set((rng.integers(0, 4, 3) + 20 * rng.integers(0, 4, 3) + 84).tolist()))]
    hits += [(900, *g[1:3], g[0], 0.5) for g in grids] + [(901, 9000, 9000, 7777, 1.0)]
    table = spark.createDataFrame(hits, "cell_id long, x0 long, y0 long, ord long, weight double")
    got = {r.cell_id: r for r in aggregate.polygon_sums(table, frame, 18).collect()}
    assert sorted(got) == sorted({h[0] for h in hits} - {901})
    for c, r in got.items():
        own = [(h[4], grids[h[3]]) for h in hits if h[0] == c]
        assert np.allclose(r._expr, sum(w * np.array(g[3]) for w, g in own)) and np.allclose(r._prob, sum(w * np.array(g[4]) for w, g in own))
        assert r._n_grids == len(own) and r._weight == pytest.approx(sum(w for w, _ in own))
    path = str(tmp_path / "partial")
    monkeypatch.setattr(blocks, "scratch_path", lambda spark, name: path)
    aggregate.polygon_sums(table, frame, 18).count()
    partial = spark.read.parquet(path)
    assert partial.where("target < 900").count() == 300 and partial.where("target = 900").count() == 25 == partial.where("border").count()


def _wound_area(ring, step=0.02):
    """Ground with a winding number other than 0, by counting sample points."""
    ring = np.array(ring, float)
    xs = np.arange(ring[:, 0].min(), ring[:, 0].max(), step) + step / 3
    ys = np.arange(ring[:, 1].min(), ring[:, 1].max(), step) + step / 3
    x, y = np.meshgrid(xs, ys)
    winding = np.zeros(x.shape, int)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        winding += (ay <= y) & (by > y) & (side > 0)
        winding -= (ay > y) & (by <= y) & (side < 0)
    return (winding != 0).sum() * step * step


def test_crossing_rings_cover_what_they_wind_around(spark):
    from spotweave.operators.aggregate import ring_validity

    star = [(20 + 15 * np.cos(a), 20 + 15 * np.sin(a)) for a in np.arange(5) * 4 * np.pi / 5]
    spiral = [(0, 0), (30, 0), (30, 30), (0, 30), (0, 5), (20, 5), (20, 20), (5, 20), (5, -5)]
    rings = {1: [(0, 0), (10, 10), (10, 0), (0, 10)], 2: star, 3: spiral, 4: [(0, 0), (40, 0), (40, 25), (0, 25)], 5: [(1, 1), (2, 2), (3, 3)], 6: [(1, 1), (5, 5)]}
    table, edges, repaired = ring_validity(_vertices(spark, rings), 18)
    got = {r["cell_id"]: r for r in table.collect()}
    assert got[1]["area"] == pytest.approx(50) and got[4]["area"] == pytest.approx(1000)
    for ring in (2, 3):
        assert got[ring]["area"] == pytest.approx(_wound_area(rings[ring]), rel=0.01)
    assert [got[k]["is_repaired"] for k in range(1, 7)] == [True, True, True, False, False, False]
    assert [got[k]["is_invalid"] for k in range(1, 7)] == [False, False, False, False, True, True]
    cells = overlap.overlap_cells(edges, 18, repaired).toPandas().groupby("cell_id")["area"].sum()
    for ring in range(1, 5):
        assert cells[ring] == pytest.approx(got[ring]["area"], rel=1e-9)


def test_vertex_numbers_with_gaps_ties_and_missing_values(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = [(1, 10 * k, x, y) for k, (x, y) in enumerate(ring)] + [(2, k, x, y) for k, (x, y) in enumerate(ring)]
    schema = "cell_id long, vertex_ord long, vertex_x double, vertex_y double"
    edges = overlap.ring_edges(overlap.numbered(spark.createDataFrame(rows, schema)))
    assert {r["cell_id"]: r["area"] for r in overlap.ring_areas(edges).collect()} == {1: 100.0, 2: 100.0}
    with pytest.raises(ValueError):
        overlap.numbered(spark.createDataFrame([*rows, (3, 0, None, 1.0)], schema))


def test_slivers_are_kept_at_any_scale(spark):
    edges = overlap.ring_edges(_vertices(spark, {1: [(17.0, 1.0), (18.00001, 1.0), (18.00001, 2.0), (17.0, 2.0)]}))
    areas = {r["x0"]: r["area"] for r in overlap.overlap_cells(edges, 18).collect()}
    assert areas[18] == pytest.approx(1e-5, rel=1e-6) and areas[0] == pytest.approx(1.0)


def test_exploded_sides_are_never_broadcast(spark, tmp_path):
    """A stored table is small, what is exploded from it is not; Spark's estimate of both is the same."""
    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    patches = stored("patches", [(0, 0, 0), (1, 72, 0)], "patch_index int, x0 int, y0 int")
    grids = stored("grids", [(0, 18, 0), (1, 288, 18)], "grid_index int, x0 int, y0 int")
    words = stored("words", [(y, 0, -1) for y in range(64)], "py int, word int, bits long")
    tokens = lattice.token_grids(patches)
    met, without = lattice.token_to_grid(tokens, grids), lattice.grids_without_view(grids, tokens.unionByName(tokens))
    boxes = lattice.with_centre(grids.select("x0", "y0"), 18)
    inside = lattice.on_tissue(boxes, raster.unpack(words), 0.1, 64, 64)
    for joined in (met, without, inside, lattice.neighbour_pairs(patches)):
        assert "BroadcastHashJoin" not in _plan(joined)
    assert sorted((r.patch_index, r.token_linear, r.grid_index) for r in met.collect()) == [(0, 1, 0), (1, 28, 1)]
    assert without.count() == 0 and inside.count() == 2


def test_pixels_meet_patches_by_squares(spark, tmp_path):
    spark.createDataFrame([(x, y, x, y, 7) for x in range(21) for y in range(23)], "px int, py int, r int, g int, b int").write.parquet(str(tmp_path / "px"))
    origins = [(0, 0, 0), (1, 4, 8), (2, 12, 0), (3, 12, 0), (4, 5, 4)]
    patches = spark.createDataFrame(origins, "patch_index int, x0 int, y0 int")
    got = lattice.patch_pixels(spark.read.parquet(str(tmp_path / "px")), patches, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), 10, 4)
    # A patch off the lattice of the stride has no pixels; the last rows and columns of a patch need not fill a square.
    want = sorted((i, x - x0, y - y0) for i, x0, y0 in origins[:4] for x in range(x0, min(21, x0 + 10)) for y in range(y0, min(23, y0 + 10)))
    assert sorted((r.patch_index, r.dx, r.dy) for r in got.collect()) == want
    assert all(r.r == pytest.approx((r.dx + dict((i, x) for i, x, _ in origins)[r.patch_index]) / 255) for r in got.collect())
    assert "Broadcast" not in _plan(got)


def test_edges_of_small_rings_are_compared_without_bins(spark):
    """Edges of a ring with few of them never become a row per bin; a ring with many is binned; both give every crossing."""
    from spotweave.operators import overlap

    small = [("bow", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (900.0, 900.0), (900.0, 0.0), (0.0, 900.0)])]
    small += [("square", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (900.0, 0.0), (900.0, 900.0), (0.0, 900.0)])]
    zigzag = [("zigzag", i, float(i), float(10 * (i % 2))) for i in range(101)] + [("zigzag", 101, 100.0, 5.25), ("zigzag", 102, 0.0, 5.25)]
    schema = "cell_id string, vertex_ord long, vertex_x double, vertex_y double"
    edges = overlap.ring_edges(spark.createDataFrame(small, schema))
    found = overlap.crossings(edges)
    assert "_row" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("bow", 450.0)]
    both = overlap.crossings(overlap.ring_edges(spark.createDataFrame(small + zigzag, schema)))
    told = {}
    for cell, x in both.collect():
        told.setdefault(cell, []).append(x)
    assert told["bow"] == [450.0] and "square" not in told and len(told["zigzag"]) == 100


def test_sides_that_grow_with_the_slide_are_not_broadcast(spark, tmp_path):
    """Stored tables under Spark's threshold are joined by shuffle all the same: grids, spots, positions and mask words grow."""
    from spotweave.operators import spots

    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    table = stored("spots", [(0, "a"), (1, "b"), (2, "b")], "spot_index int, spot_id string")
    targets = stored("targets", [(7, "a"), (8, "b"), (9, "c")], "target_ord long, spot_id string")
    grids = stored("grids", [(10, 0, True), (11, 2, True), (12, 2, False), (13, -1, True), (14, 1, True)], "grid_index int, spot_index int, is_tissue boolean")
    bags = spots.spot_bags(targets, table, grids)
    words = stored("words", [(1, 0, 5), (2, 0, 7)], "py int, word int, bits long")
    runs = raster.background_runs(words, 4, 4)
    for joined in (bags, runs):
        assert "BroadcastHashJoin" not in _plan(joined)
    assert sorted(tuple(r) for r in bags.collect()) == [(7, "a", 0, 10), (8, "b", 2, 11)]
    assert sorted((r.py, r.first, r.last) for r in runs.collect()) == [(0, 0, 3), (1, 1, 1), (1, 3, 3), (2, 3, 3), (3, 0, 3)]
