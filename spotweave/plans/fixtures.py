"""Spatial tables derived from the star-schema test tables by SQL that Spark and DuckDB both run.

Every definition reads whole tables, so each derived table grows with them. ``{name}`` stands for a table or another
definition, ``@at(array, i)`` for the i-th element counted from one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from spotweave.session import scratch_path

#: Derived tables that stand for stored inputs: written once per data folder and then read like any other table.
STORED = {"positions", "counts", "ref_cells", "ref_counts", "deconv", "deconv_raw", "thumbnail", "polygons", "grid_pred", "true_type", "true_expr"}
_STORED_PATHS: dict[tuple, str] = {}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPOT_DIAMETER = 60.0
THUMB_SCALE = 0.1
GRID_COLUMNS = 62
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TYPE_NAMES = ["DCIS", "Stromal", "T Cells", "Myoepi", "Mystery"]
N_GENES = 8

_E = ", ".join(f"abs(CAST(@at(embedding, {i + 1}) AS DOUBLE)) AS e{i}" for i in range(N_GENES))
_X = [f"exp(CAST(@at(embedding, {i + 9}) AS DOUBLE))" for i in range(len(TYPE_NAMES))]
_P = ", ".join(f"{x} / ({' + '.join(_X)}) AS p{i}" for i, x in enumerate(_X))

FIXTURES: dict[str, str] = {
    "positions": """
        SELECT s_suppkey AS ord,
               concat('SPOT', CAST(s_suppkey AS VARCHAR(20)), '_BREAST') AS barcode,
               CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS in_tissue,
               CAST(floor(s_suppkey / 10.0) AS INT) AS array_row,
               CAST(s_suppkey % 10 AS INT) AS array_col,
               CAST(CAST(floor(s_suppkey / 10.0) AS BIGINT) * 100 + 150 + (s_suppkey * 11) % 17 AS DOUBLE) AS pxl_row_in_fullres,
               CAST((s_suppkey % 10) * 100 + 150 + (s_suppkey * 7) % 13 AS DOUBLE) AS pxl_col_in_fullres
        FROM {supplier}""",
    "image_meta": """
        SELECT CAST(max(pxl_col_in_fullres) AS BIGINT) + 150 AS width,
               CAST(max(pxl_row_in_fullres) AS BIGINT) + 150 AS height
        FROM {positions}""",
    "counts": """
        SELECT concat('SPOT', CAST(l_suppkey AS VARCHAR(20)), '_BREAST') AS barcode,
               concat('G', CAST(l_partkey % 40 AS VARCHAR(20))) AS gene,
               l_partkey AS gene_row,
               CASE WHEN l_partkey % 40 = 39 THEN 'Antibody Capture' ELSE 'Gene Expression' END AS feature_type,
               l_quantity AS count
        FROM {lineitem}""",
    "features": """
        SELECT p_partkey AS gene_row, concat('G', CAST(p_partkey % 40 AS VARCHAR(20))) AS gene,
               CASE WHEN p_partkey % 40 = 39 THEN 'Antibody Capture' ELSE 'Gene Expression' END AS feature_type
        FROM {part}""",
    "gene_list": """
        SELECT DISTINCT p_size AS ord, concat('G', CAST(p_size AS VARCHAR(20))) AS gene FROM {part}""",
    "ref_cells": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS cell_id, o_orderkey AS ord,
               CASE WHEN o_orderkey % 97 = 0 THEN 'NA' WHEN o_orderkey % 89 = 0 THEN NULL ELSE c_mktsegment END AS label,
               concat('P', CAST(o_custkey % 5 AS VARCHAR(20)), CASE WHEN o_orderstatus = 'F' THEN 'CRC' ELSE 'NAT' END) AS patient,
               o_orderstatus <> 'P' AS consensus_keep
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "ref_counts": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) AS cell_id,
               concat(CASE WHEN l_partkey % 40 < 4 THEN 'R' ELSE 'G' END, CAST(l_partkey % 40 AS VARCHAR(20))) AS gene, l_quantity AS count
        FROM {lineitem}""",
    "type_merge": """
        SELECT target, c_mktsegment AS source, target_ord
        FROM (SELECT DISTINCT c_mktsegment FROM {customer})
        JOIN (VALUES ('Heavy', 'AUTOMOBILE', 0), ('Heavy', 'MACHINERY', 0), ('Home', 'HOUSEHOLD', 1), ('Home', 'FURNITURE', 1),
                     ('Works', 'MACHINERY', 2)) AS t(target, source, target_ord) ON source = c_mktsegment""",
    "deconv": """
        SELECT concat('SPOT', CAST(l_suppkey AS VARCHAR(20)), '_BREAST') AS spot_id, c_mktsegment AS cell_type,
               sum(l_quantity) AS p
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        GROUP BY l_suppkey, c_mktsegment""",
    "deconv_raw": """
        SELECT concat('SPOT', CAST(l_suppkey AS VARCHAR(20)), CASE WHEN l_linenumber % 2 = 0 THEN '_BREAST' ELSE '' END) AS spot_id,
               c_mktsegment AS cell_type,
               sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS p
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        GROUP BY l_suppkey, l_linenumber % 2, c_mktsegment""",
    "thumbnail": """
        SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, CASE WHEN t = 1 THEN 200 ELSE 250 END AS r,
               CASE WHEN t = 1 THEN 120 ELSE 249 END AS g, CASE WHEN t = 1 THEN 160 ELSE 250 END AS b
        FROM (SELECT px, py,
                     CASE WHEN ((px - 50) * (px - 50) + (py % 100 - 50) * (py % 100 - 50) < 2116
                                AND NOT (px BETWEEN 40 AND 45 AND py % 100 BETWEEN 40 AND 45)) <> (user_id % 37 = 0)
                          THEN 1 ELSE 0 END AS t
              FROM (SELECT event_id % 100 AS px, CAST(floor(event_id / 100.0) AS BIGINT) AS py, user_id FROM {events}))""",
    "polygons": """
        SELECT p_partkey AS cell_id, k AS vertex_ord,
               CAST((p_partkey * 37) % 1150 + 20
                    + ux * (3 + p_size % 12) * CASE WHEN p_partkey % 70 = 3 AND k IN (1, 3) THEN -1 ELSE 1 END AS DOUBLE)
                    + sqrt(CAST((p_partkey % 7) * 10 + 2 AS DOUBLE)) / 10 AS vertex_x,
               CAST((p_partkey * 91) % (SELECT CAST(floor(count(*) * 0.29) AS BIGINT) FROM {events}) + uy * (3 + p_size % 12) AS DOUBLE)
                    + sqrt(CAST((p_partkey % 5) * 10 + 3 AS DOUBLE)) / 10 AS vertex_y
        FROM {part} CROSS JOIN (VALUES (0, 2, 0), (1, 1, 1), (2, 0, 2), (3, -1, 1), (4, -2, 0), (5, -1, -1), (6, 0, -2), (7, 1, -1)) AS d(k, ux, uy)
        WHERE k < CASE WHEN p_partkey % 50 = 0 THEN 2 ELSE 3 + p_size % 6 END""",
    "grid_pred": f"""
        SELECT event_id AS ord, event_id AS grid_index,
               (event_id % {GRID_COLUMNS}) * 18 AS x0, CAST(floor(event_id / {GRID_COLUMNS}.0) AS BIGINT) * 18 AS y0,
               (event_id % {GRID_COLUMNS}) * 18 + 18 AS x1, CAST(floor(event_id / {GRID_COLUMNS}.0) AS BIGINT) * 18 + 18 AS y1,
               user_id, {_E}, {_P}
        FROM (SELECT event_id, user_id, event_id % (SELECT count(*) FROM {{embeddings}}) AS pick FROM {{events}}) AS g
        JOIN {{embeddings}} ON vec_id = pick""",
    "true_type": """
        SELECT cell_id, vertex_ord, vertex_x, vertex_y, p_brand AS celltype, p_type AS window_label
        FROM {polygons} JOIN {part} ON cell_id = p_partkey""",
    "true_expr": """
        SELECT CAST(p_partkey AS VARCHAR(20)) AS xen_cell_id, concat('G', CAST(p_size % 5 AS VARCHAR(20))) AS gene, p_partkey AS ord,
               ln(1 + p_retailprice % 7) AS log1p_count
        FROM {part}""",
}

_PLACE = re.compile(r"\{(\w+)\}")
_AT = re.compile(r"@at\(([^(),]+),\s*([^(),]+)\)")


def for_spark(sql: str) -> str:
    return _AT.sub(r"element_at(\1, \2)", sql).replace("VARCHAR(20)", "STRING")


def for_duckdb(sql: str) -> str:
    return _PLACE.sub(r"\1", _AT.sub(r"list_extract(\1, \2)", sql))


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_PLACE.findall(sql)))


def compose(body: str, definitions: dict[str, str]) -> str:
    """A DuckDB statement: the definitions the body needs, in dependency order, then the body."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done or name in BASE_TABLES:
            return
        for other in needs(definitions[name]):
            if other != name:
                add(other)
        done.append(name)

    for name in needs(body):
        add(name)
    parts = [f"{name} AS ({for_duckdb(definitions[name])})" for name in done]
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return head + for_duckdb(body)


class Fixtures:
    """The derived tables over one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE_TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in FIXTURES:
                sql = FIXTURES[name]
                self._made[name] = self._stored(name, sql) if name in STORED else self._derive(sql)
            else:
                raise AttributeError(name)
        return self._made[name]

    def _derive(self, sql: str) -> DataFrame:
        return self.spark.sql(for_spark(sql), **{n: getattr(self, n) for n in needs(sql)})

    def _stored(self, name: str, sql: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED_PATHS:
            path = scratch_path(self.spark, name)
            self._derive(sql).write.parquet(path)
            _STORED_PATHS[key] = path
        return self.spark.read.parquet(_STORED_PATHS[key])
