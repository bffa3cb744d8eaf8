"""Named SQL steps for the checks, written for DuckDB and independent of the Spark forms.

Pixels stay pixels (no packed words), neighbours are counted, holes are found by a recursive flood fill, overlaps are
summed edge by candidate cell, and the nearest spot is the first of all spots by distance.
"""

from __future__ import annotations

from spotweave.plans.fixtures import SPOT_DIAMETER, THUMB_SCALE

_OFFSETS = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) AS o(dx, dy)"
_ERODE = "SELECT px - dx AS px, py - dy AS py FROM {%s}, " + _OFFSETS + " GROUP BY 1, 2 HAVING count(*) = 9"
_DILATE = (
    "SELECT DISTINCT px + dx AS px, py + dy AS py FROM {%s}, {frame}, " + _OFFSETS
    + " WHERE px + dx BETWEEN 0 AND w - 1 AND py + dy BETWEEN 0 AND h - 1"
)
_PIXEL = "CAST(greatest(0, least({size} - 1, round_even({value}, 0))) AS BIGINT)"

PARTS: dict[str, str] = {
    # --- tissue mask
    "tissue": """
        SELECT px, py FROM {thumbnail}
        WHERE CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b, 1) AS DOUBLE) ELSE 0 END > 0.05
          AND (r + g + b) / 3.0 < 245 AND greatest(r, g, b) - least(r, g, b) > 10""",
    "frame": "SELECT max(px) + 1 AS w, max(py) + 1 AS h FROM {thumbnail}",
    "eroded1": _ERODE % "tissue",
    "opened": _DILATE % "eroded1",
    "dilated1": _DILATE % "opened",
    "dilated2": _DILATE % "dilated1",
    "eroded2": _ERODE % "dilated2",
    "closed": _ERODE % "eroded2",
    "background": "SELECT px, py FROM {thumbnail} EXCEPT SELECT px, py FROM {closed}",
    "reach": """
        SELECT px, py FROM {background}, {frame} WHERE px = 0 OR py = 0 OR px = w - 1 OR py = h - 1
        UNION
        SELECT n.px, n.py FROM {reach} AS c, (VALUES (1,0),(-1,0),(0,1),(0,-1)) AS o(dx, dy), {background} AS n
        WHERE n.px = c.px + dx AND n.py = c.py + dy""",
    "mask": "SELECT px, py FROM {thumbnail} EXCEPT SELECT px, py FROM {reach}",
    "mask_inner": _ERODE % "mask",
    "mask_edge": "SELECT px, py FROM {mask} EXCEPT SELECT px, py FROM {mask_inner}",
    # --- spots, patches, token grids
    "spots": """
        SELECT row_number() OVER (ORDER BY ord) - 1 AS spot_index, barcode,
               CASE WHEN ends_with(barcode, '_BREAST') THEN left(barcode, length(barcode) - 7) ELSE barcode END AS spot_id,
               pxl_col_in_fullres AS x, pxl_row_in_fullres AS y
        FROM {positions} WHERE in_tissue = 1""",
    "box": "SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM {spots}",
    "lattice": """
        SELECT lx.v AS x0, ly.v AS y0, lx.v + 288 AS x1, ly.v + 288 AS y1
        FROM {image_meta}, unnest(range(0, width - 288 + 1, 72)) AS lx(v), unnest(range(0, height - 288 + 1, 72)) AS ly(v)""",
    "candidates": """
        SELECT l.*, x0 + 144.0 AS center_x, y0 + 144.0 AS center_y FROM {lattice} AS l, {box}
        WHERE x0 + 144.0 BETWEEN x_min AND x_max AND y0 + 144.0 BETWEEN y_min AND y_max""",
    "on_mask": f"""
        SELECT c.* FROM {{candidates}} AS c, {{frame}}
        WHERE ({_PIXEL.format(size='w', value=f'CAST(center_x AS DOUBLE) * CAST({THUMB_SCALE} AS DOUBLE)')},
               {_PIXEL.format(size='h', value=f'CAST(center_y AS DOUBLE) * CAST({THUMB_SCALE} AS DOUBLE)')}) IN (SELECT (px, py) FROM {{mask}})""",
    "patches": "SELECT row_number() OVER (ORDER BY y0, x0) - 1 AS patch_index, * FROM {on_mask}",
    "tokens": """
        SELECT patch_index, t AS token_linear, x0 + (t % 16) * 18 AS x0, y0 + (t // 16) * 18 AS y0,
               greatest(0.5 * (1 + cos(pi() * abs(t % 16 - 7.5) / 8)) * (0.5 * (1 + cos(pi() * abs(t // 16 - 7.5) / 8))), 1e-3) AS weight
        FROM {patches}, unnest(range(256)) AS u(t)""",
    "boxed": """
        SELECT t.* FROM {tokens} AS t, {box} WHERE x0 + 9.0 BETWEEN x_min AND x_max AND y0 + 9.0 BETWEEN y_min AND y_max""",
    "distinct_grids": "SELECT x0, y0, count(*) AS duplicate_count FROM {boxed} GROUP BY x0, y0",
    "grids": f"""
        SELECT row_number() OVER (ORDER BY y0, x0) - 1 AS grid_index, x0, y0, duplicate_count, x0 + 9.0 AS center_x, y0 + 9.0 AS center_y
        FROM {{distinct_grids}}, {{frame}}
        WHERE ({_PIXEL.format(size='w', value=f'CAST(x0 + 9 AS FLOAT) * CAST({THUMB_SCALE} AS FLOAT)')},
               {_PIXEL.format(size='h', value=f'CAST(y0 + 9 AS FLOAT) * CAST({THUMB_SCALE} AS FLOAT)')}) IN (SELECT (px, py) FROM {{mask}})""",
    "views": "SELECT b.*, grid_index FROM {boxed} AS b JOIN {grids} USING (x0, y0)",
    "assigned": f"""
        SELECT grid_index, center_x, center_y, spot_index AS nearest, sqrt(d2) AS distance,
               CASE WHEN sqrt(d2) <= {SPOT_DIAMETER / 2} THEN spot_index ELSE -1 END AS spot_index
        FROM (SELECT g.*, s.spot_index, (center_x - x) * (center_x - x) + (center_y - y) * (center_y - y) AS d2,
                     row_number() OVER (PARTITION BY grid_index ORDER BY (center_x - x) * (center_x - x) + (center_y - y) * (center_y - y), s.spot_index) AS k
              FROM {{grids}} AS g, {{spots}} AS s)
        WHERE k = 1""",
    "bags": """
        SELECT p.ord AS target_ord, s.spot_id, a.spot_index, a.grid_index
        FROM {assigned} AS a JOIN {spots} AS s USING (spot_index) JOIN {positions} AS p ON p.barcode = s.barcode WHERE a.spot_index >= 0""",
    # --- vectors
    "vectors": "SELECT vec_id, i - 1 AS pos, CAST(list_extract(embedding, i) AS DOUBLE) AS v FROM {embeddings}, unnest(range(1, 65)) AS u(i)",
    "tile": "SELECT patch_index, pos, v FROM {patches} JOIN {vectors} ON vec_id = patch_index % (SELECT count(*) FROM {embeddings})",
    "neighbours": """
        SELECT a.patch_index, b.patch_index AS neighbour_index FROM {patches} AS a JOIN {patches} AS b
          ON abs(a.x0 - b.x0) IN (0, 72) AND abs(a.y0 - b.y0) IN (0, 72) AND a.patch_index <> b.patch_index""",
    "near": """
        SELECT n.patch_index, pos, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n
        FROM {neighbours} AS n JOIN {tile} AS t ON t.patch_index = n.neighbour_index GROUP BY 1, 2""",
    "near_full": """
        SELECT t.patch_index, t.pos, t.v AS tile, coalesce(mean, t.v) AS mean, coalesce(std, 0) AS std, coalesce(n, 0) AS n
        FROM {tile} AS t LEFT JOIN {near} AS n USING (patch_index, pos)""",
    "token_vec": """
        SELECT patch_index, token_linear, grid_index, weight, pos, v
        FROM {views} JOIN {vectors} ON vec_id = (patch_index * 256 + token_linear) % (SELECT count(*) FROM {embeddings})""",
    # --- polygons
    "edges": """
        SELECT cell_id, vertex_ord AS slot, vertex_x AS ax, vertex_y AS ay,
               coalesce(lead(vertex_x) OVER w, first_value(vertex_x) OVER w) AS bx,
               coalesce(lead(vertex_y) OVER w, first_value(vertex_y) OVER w) AS by_
        FROM {polygons} WINDOW w AS (PARTITION BY cell_id ORDER BY vertex_ord)""",
    "ring_area": """
        SELECT cell_id, abs(sum((bx - ax) * (by_ + ay))) / 2.0 AS area FROM {edges} WHERE cell_id NOT IN (SELECT cell_id FROM {crossed}) GROUP BY cell_id
        UNION ALL SELECT cell_id, sum(s * (r - l) * (yl + yr)) / 2.0 AS area FROM {hull} GROUP BY cell_id""",
    "crossed": """
        SELECT DISTINCT cell_id FROM {crossing_at}""",
    "strips": """
        SELECT cell_id, x AS l, lead(x) OVER (PARTITION BY cell_id ORDER BY x) AS r FROM (
          SELECT cell_id, x FROM {crossing_at} UNION SELECT cell_id, ax FROM {edges} WHERE cell_id IN (SELECT cell_id FROM {crossed})
          UNION SELECT cell_id, CAST(x0 AS DOUBLE) FROM {cand} JOIN {bounds} USING (cell_id) WHERE x0 BETWEEN min_x AND max_x AND cell_id IN (SELECT cell_id FROM {crossed}))""",
    "layers": """
        SELECT cell_id, l, r, s, yl, yr, sum(s) OVER (PARTITION BY cell_id, l ORDER BY yl + yr, s ROWS UNBOUNDED PRECEDING) AS upper FROM (
          SELECT cell_id, l, r, sign(bx - ax) AS s, ay + (by_ - ay) / (bx - ax) * (l - ax) AS yl, ay + (by_ - ay) / (bx - ax) * (r - ax) AS yr
          FROM {strips} JOIN {edges} USING (cell_id) WHERE ax <> bx AND least(ax, bx) <= l AND greatest(ax, bx) >= r)""",
    "hull": "SELECT cell_id, l, r, CASE WHEN upper = 0 THEN 1 ELSE -1 END AS s, yl, yr FROM {layers} WHERE (upper = 0) <> (upper - s = 0)",
    "crossing_at": """
        SELECT a.cell_id, a.ax + ((b.ax - a.ax) * (b.by_ - b.ay) - (b.ay - a.ay) * (b.bx - b.ax))
                 / ((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax)) * (a.bx - a.ax) AS x
        FROM {edges} AS a JOIN {edges} AS b ON a.cell_id = b.cell_id AND a.slot < b.slot
        WHERE sign((a.bx - a.ax) * (b.ay - a.ay) - (a.by_ - a.ay) * (b.ax - a.ax)) * sign((a.bx - a.ax) * (b.by_ - a.ay) - (a.by_ - a.ay) * (b.bx - a.ax)) < 0
          AND sign((b.bx - b.ax) * (a.ay - b.ay) - (b.by_ - b.ay) * (a.ax - b.ax)) * sign((b.bx - b.ax) * (a.by_ - b.ay) - (b.by_ - b.ay) * (a.bx - b.ax)) < 0""",
    "bounds": """
        SELECT cell_id, count(*) AS n_vertices, min(vertex_x) AS min_x, max(vertex_x) AS max_x, min(vertex_y) AS min_y, max(vertex_y) AS max_y,
               avg(vertex_x) AS center_x, avg(vertex_y) AS center_y FROM {polygons} GROUP BY cell_id""",
    "cand": """
        SELECT cell_id, gx.v AS x0, gy.v AS y0 FROM {bounds},
               unnest(range(CAST(floor(min_x / 18) * 18 AS BIGINT), CAST(ceil(max_x / 18) * 18 AS BIGINT) + 18, 18)) AS gx(v),
               unnest(range(CAST(floor(min_y / 18) * 18 AS BIGINT), CAST(ceil(max_y / 18) * 18 AS BIGINT) + 18, 18)) AS gy(v)""",
    "cut": """
        SELECT c.cell_id, c.x0, c.y0, CASE WHEN ax < bx THEN 1 ELSE -1 END AS s,
               least(ax, bx) AS xa, CASE WHEN ax < bx THEN ay ELSE by_ END AS ya,
               (by_ - ay) / (bx - ax) AS m, greatest(least(ax, bx), c.x0) AS l, least(greatest(ax, bx), c.x0 + 18) AS r
        FROM {edges} AS e JOIN {cand} AS c USING (cell_id) WHERE ax <> bx AND cell_id NOT IN (SELECT cell_id FROM {crossed})
        UNION ALL SELECT cell_id, x0, y0, s, l, yl, (yr - yl) / (r - l), l, r FROM {hull} JOIN {cand} USING (cell_id) WHERE l >= x0 AND r <= x0 + 18""",
    "pieces": "SELECT *, ya + m * (l - xa) - y0 AS tl, ya + m * (r - xa) - y0 AS tr FROM {cut} WHERE r > l",
    "overlap": """
        SELECT * FROM (
          SELECT cell_id, x0, y0, abs(sum(s * (r - l) * CASE WHEN tl = tr THEN greatest(0, least(18, tl)) ELSE
              ((greatest(0, least(18, tr)) - greatest(0, least(18, tl))) * (greatest(0, least(18, tr)) + greatest(0, least(18, tl))) / 2
               + 18 * (greatest(0, tr - 18) - greatest(0, tl - 18))) / (tr - tl) END)) AS area
          FROM {pieces} GROUP BY 1, 2, 3) WHERE area > 2e-9""",
    "weights": """
        SELECT o.cell_id, g.grid_index, area, area / 324.0 AS weight FROM {overlap} AS o JOIN {grid_pred} AS g USING (x0, y0)""",
    "polygon_sums": "SELECT w.cell_id, sum(weight) AS weight, count(*) AS n_grids, "
        + ", ".join(f"sum(weight * e{i}) AS e{i}" for i in range(8)) + ", "
        + ", ".join(f"sum(weight * p{i}) AS p{i}" for i in range(5))
        + " FROM {weights} AS w JOIN {grid_pred} AS g USING (grid_index) GROUP BY 1",
    "polygon_all": """
        SELECT b.cell_id, n_vertices, coalesce(area, 0) AS area, center_x, center_y,
               b.cell_id IN (SELECT cell_id FROM {crossed}) AS is_repaired, n_vertices < 3 OR coalesce(area, 0) <= 1e-8 AS is_invalid,
               coalesce(n_grids, 0) AS n_grids, coalesce(weight * 324 / greatest(area, 1e-8), 0) AS covered_fraction, """
        + ", ".join(f"ln(1 + greatest(e{i}, 0)) AS e{i}" for i in range(8)) + ", "
        + ", ".join(f"p{i} / (p0 + p1 + p2 + p3 + p4) AS q{i}" for i in range(5))
        + " FROM {bounds} AS b LEFT JOIN {ring_area} USING (cell_id) LEFT JOIN {polygon_sums} USING (cell_id)",
    "polygon_named": """
        SELECT *, CASE WHEN q0 IS NULL THEN 'Unassigned' WHEN q0 = greatest(q0, q1, q2, q3, q4) THEN 'DCIS' WHEN q1 = greatest(q1, q2, q3, q4) THEN 'Stromal'
                       WHEN q2 = greatest(q2, q3, q4) THEN 'T Cells' WHEN q3 = greatest(q3, q4) THEN 'Myoepi' ELSE 'Mystery' END AS predicted_type
        FROM {polygon_all}""",
    "polygon_kept": "SELECT * FROM {polygon_named} WHERE NOT is_invalid AND n_grids > 0",
    # --- spot tables: predictions of each spot are the sums over the predicted grids of a user
    "bag_grid": "SELECT user_id AS spot, * FROM {grid_pred}",
    "spot_sum": "SELECT spot, count(*) AS n_grids, " + ", ".join(f"sum(e{i}) AS e{i}" for i in range(8)) + ", "
        + ", ".join(f"avg(p{i}) AS p{i}" for i in range(5)) + " FROM {bag_grid} GROUP BY spot",
    "spot_truth": """
        SELECT l_suppkey AS spot, """ + ", ".join(f"sum(CASE WHEN l_partkey % 8 = {i} THEN l_quantity ELSE 0 END) AS t{i}" for i in range(8))
        + ", " + ", ".join(f"sum(CASE WHEN l_linenumber % 5 = {i} THEN l_quantity ELSE 0 END) / sum(l_quantity) AS c{i}" for i in range(5))
        + " FROM {lineitem} GROUP BY l_suppkey",
    "pairs": " UNION ALL ".join(f"SELECT spot, {i} AS gene_pos, e{i} AS x, t{i} AS y FROM {{spot_sum}} JOIN {{spot_truth}} USING (spot)" for i in range(8)),
    "composition": "SELECT spot, p0, p1, p2, p3, p4, c0, c1, c2, c3, c4 FROM {spot_sum} JOIN {spot_truth} USING (spot)",
    # --- mixture
    "labelled": "SELECT cell_id, label AS cell_type FROM {ref_cells} WHERE label IS NOT NULL AND label NOT IN ('', 'nan', 'NA')",
    "ref_kept": "SELECT cell_id, cell_type, gene, sum(count) AS count FROM {ref_counts} JOIN {labelled} USING (cell_id) GROUP BY 1, 2, 3",
    "ref_umi": "SELECT cell_id, cell_type, sum(count) AS umi FROM {ref_kept} GROUP BY 1, 2",
    "profiles": """
        SELECT r.cell_type, gene, sum(count / umi) / max(n) AS profile FROM {ref_kept} AS r JOIN {ref_umi} USING (cell_id)
        JOIN (SELECT cell_type, count(*) AS n FROM {ref_umi} GROUP BY 1) AS s ON s.cell_type = r.cell_type GROUP BY 1, 2""",
    "spot_genes": "SELECT barcode, gene, sum(count) AS x FROM {counts} GROUP BY 1, 2",
    "mix0": """
        SELECT barcode, cell_type, 0.2 AS p FROM (SELECT DISTINCT barcode FROM {spot_genes}), (SELECT DISTINCT cell_type FROM {profiles})""",
}
for _step in range(5):
    PARTS[f"mu{_step + 1}"] = (
        f"SELECT barcode, gene, sum(p * profile) AS mu FROM {{mix{_step}}} JOIN {{profiles}} USING (cell_type) GROUP BY 1, 2"
    )
    PARTS[f"raw{_step + 1}"] = f"""
        SELECT m.barcode, m.cell_type, sum(x * p * profile / mu) / max(col) AS a
        FROM {{mix{_step}}} AS m JOIN {{profiles}} AS r USING (cell_type) JOIN {{spot_genes}} AS s USING (barcode, gene)
        JOIN {{mu{_step + 1}}} USING (barcode, gene)
        JOIN (SELECT cell_type, sum(profile) AS col FROM {{profiles}} WHERE gene IN (SELECT gene FROM {{counts}}) GROUP BY 1) AS t ON t.cell_type = m.cell_type GROUP BY 1, 2"""
    PARTS[f"mix{_step + 1}"] = f"SELECT barcode, cell_type, a / sum(a) OVER (PARTITION BY barcode) AS p FROM {{raw{_step + 1}}}"
