"""Readers. Tables are Parquet, CSV, JSON or text; every reader returns the columns the operators expect.

Where the row order of a file carries meaning (ring vertices, gene lists, repeated ids), the reader adds an explicit
ordinal made of file, block and position, so nothing later depends on how Spark splits or shuffles the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.operators.counts import expression_only
from spotweave.operators.ordinals import ordinal, running_total
from spotweave.operators.spots import spot_table
from spotweave.session import broadcast_if_small, durable, one_row

POSITION_SCHEMA = T.StructType([
    T.StructField("barcode", T.StringType()),
    T.StructField("in_tissue", T.IntegerType()),
    T.StructField("array_row", T.IntegerType()),
    T.StructField("array_col", T.IntegerType()),
    T.StructField("pxl_row_in_fullres", T.DoubleType()),
    T.StructField("pxl_col_in_fullres", T.DoubleType()),
])


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def _in_file_order(df: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Number the rows as they stand in the file, or within each key. ``df`` still carries ``_metadata``.

    Nothing is sorted to number a file: the rows of each split are counted, the counts are added up in the order of the splits, and a
    row's number is the count before its split plus its place there. Both scans must cut the files alike; if they do not
    (cores came or went between them), the job ends with an error.
    """
    part = ["_file", "_block", "_length"]
    marked = df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_block_length").alias("_length"), F.monotonically_increasing_id().alias("_row"),
    ).drop("_metadata")
    if keys:
        return ordinal(marked, ["_file", "_block", "_row"], keys=list(keys), name=name).drop(*part, "_row")
    splits = marked.groupBy(*part).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = durable(running_total(splits, [], ["_file", "_block"], "_n", "_before").select(*part, "_first", "_before"))
    placed = marked.join(broadcast_if_small(starts, starts.count()), part, "left")
    same = F.shiftright("_row", 33) == F.shiftright("_first", 33)
    number = F.when(same, F.col("_before") + F.col("_row") - F.col("_first")).otherwise(F.raise_error(F.lit("The files were cut in another way.")).cast("long"))
    return placed.withColumn(name, number).drop(*part, "_row", "_first", "_before")


def read_counts(spark: SparkSession, path: str, expression: bool = False) -> DataFrame:
    """``(barcode, gene, ..., count)``, all feature types or gene expression only (filter pushed to the scan)."""
    counts = spark.read.parquet(path)
    return expression_only(counts) if expression else counts


def read_matrix_text(spark: SparkSession, matrix: str, genes: str, spots: str) -> DataFrame:
    """Coordinate-format text (1-based, ``%`` comments, one size line) with its two name lists.

    The size line is the first line that is no comment; it is found by its place in the file.
    """
    shown = spark.read.text(matrix).where(~F.col("value").startswith("%") & (F.trim("value") != "")).select("value", "_metadata")
    lines = _in_file_order(shown, "line").where("line > 0")
    parts = F.split(F.trim("value"), r"\s+")
    entries = lines.select(
        F.get(parts, F.lit(0)).cast("long").alias("gene_no"), F.get(parts, F.lit(1)).cast("long").alias("spot_no"),
        F.get(parts, F.lit(2)).cast("double").alias("count"),
    )
    gene_names = read_lines(spark, genes).select((F.col("ord") + 1).alias("gene_no"), F.col("value").alias("gene"))
    spot_names = read_lines(spark, spots).select((F.col("ord") + 1).alias("spot_no"), F.col("value").alias("barcode"))
    return entries.join(gene_names, "gene_no").join(spot_names, "spot_no").select("barcode", "gene", "count")


#: Entries of one major line that are expanded together.
_RANGE = 65_536


def compressed_to_entries(pointers: DataFrame, entries: DataFrame, encoding: str) -> DataFrame:
    """Compressed sparse arrays to ``(row, col, value)``; an encoding other than CSR or CSC is an error.

    ``pointers``: ``(i, start)`` with one more row than major lines; ``entries``: ``(pos, minor, value)``. The owner of an
    entry is the number of pointers at or before it, minus one; only owners' own ranges are expanded.
    """
    if encoding not in ("csr_matrix", "csc_matrix"):
        raise ValueError(f"A sparse matrix must be csr_matrix or csc_matrix, not {encoding!r}.")
    after = pointers.select((F.col("i") - 1).alias("i"), F.col("start").alias("stop"))
    # A long major line is first cut into ranges, which are dealt out before they are expanded.
    ranges = pointers.join(after, "i").where("stop > start").select(
        F.col("i").alias("major"), F.explode(F.sequence("start", F.col("stop") - 1, F.lit(_RANGE).cast("long"))).alias("first"), "stop"
    ).repartition("major", "first")
    owners = ranges.select("major", F.explode(F.sequence("first", F.least(F.col("first") + _RANGE, F.col("stop")) - 1)).alias("pos"))
    joined = entries.join(owners, "pos")
    row, col = ("major", "minor") if encoding == "csr_matrix" else ("minor", "major")
    return joined.select(F.col(row).alias("row"), F.col(col).alias("col"), "value")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Spot positions with or without a header; without one the six standard columns are assumed. Adds ``ord``."""
    if "barcode" in _csv_header(spark, path):
        header = _csv_header(spark, path)
        known = {f.name: f.dataType for f in POSITION_SCHEMA}
        schema = T.StructType([T.StructField(c, known.get(c, T.DoubleType() if c.startswith("image_") else T.StringType())) for c in header])
        table = spark.read.schema(schema).option("header", True).csv(path)
    else:
        table = spark.read.schema(POSITION_SCHEMA).csv(path)
    return _in_file_order(table, "ord")


def read_scale_factors(spark: SparkSession, path: str) -> dict:
    row = spark.read.option("multiLine", True).json(path).select(
        F.col("spot_diameter_fullres").cast("double"), F.col("tissue_hires_scalef").cast("double")
    )
    return one_row(row)


def read_spot_table(spark: SparkSession, positions: str, scale_factors: str, sample: str | None) -> tuple[DataFrame, float]:
    """In-tissue spots (a header is required) and the spot diameter."""
    if "barcode" not in _csv_header(spark, positions):
        raise KeyError("The spot table needs a header row.")
    return spot_table(read_positions(spark, positions), sample), read_scale_factors(spark, scale_factors)["spot_diameter_fullres"]


def read_reference(spark: SparkSession, cells: str, counts: str, layer_counts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Annotated reference cells and their counts; the counts layer is used when there is one."""
    return spark.read.parquet(cells), spark.read.parquet(layer_counts or counts)


def as_text(names: DataFrame, column: str) -> DataFrame:
    """Names stored as bytes or text, as text."""
    kind = names.schema[column].dataType
    value = F.decode(F.col(column), "utf-8") if isinstance(kind, T.BinaryType) else F.col(column).cast("string")
    return names.withColumn(column, value)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, value)``: trimmed lines in file order, blank ones dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("value"), "_metadata")
    return _in_file_order(lines, "ord")


def read_gene_list(spark: SparkSession, path: str | None) -> DataFrame | None:
    """``(ord, gene)``, or None for no list or an empty one (no restriction)."""
    if path is None:
        return None
    genes = read_lines(spark, path).withColumnRenamed("value", "gene")
    return None if genes.isEmpty() else genes


def read_proportions(spark: SparkSession, path: str) -> DataFrame:
    """Wide proportions (spot id first, one column per type) to ``(spot_id, cell_type, p, type_ord)``."""
    header = _csv_header(spark, path)
    schema = T.StructType([T.StructField(header[0], T.StringType())] + [T.StructField(c, T.DoubleType()) for c in header[1:]])
    wide = spark.read.schema(schema).option("header", True).csv(path)
    long = wide.withColumnRenamed(header[0], "spot_id").unpivot(["spot_id"], header[1:], "cell_type", "p")
    return long.withColumn("type_ord", F.array_position(F.array(*[F.lit(c) for c in header[1:]]), F.col("cell_type")) - 1)


def read_type_merge(spark: SparkSession, path: str) -> DataFrame:
    """Merge map, with or without the outer ``merge`` key, as ``(target, source, target_ord, source_ord)``."""
    text = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.merge"), F.col("value"))
    parsed = text.select(F.from_json(inner, "map<string,array<string>>").alias("m"), F.json_object_keys(inner).alias("k"))
    if parsed.where("m IS NULL OR k IS NULL").limit(1).collect():
        raise ValueError("The type merge must be a JSON object of target to source lists.")
    targets = parsed.select("m", F.posexplode("k").alias("target_ord", "target"))
    return targets.select("target_ord", "target", F.posexplode(F.try_element_at("m", F.col("target"))).alias("source_ord", "source")).select(
        "target", "source", "target_ord", "source_ord"
    )


def _first_present(columns: list[str], names: list[str]) -> str:
    for name in names:
        if name in columns:
            return name
    raise ValueError(f"None of these columns is present: {names}")


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Ring vertices ``(cell_id, vertex_ord, vertex_x, vertex_y)`` in file order within each ring."""
    header = _csv_header(spark, path)
    cell = _first_present(header, ["cell_id", "cellvit_cell_id", "xen_cell_id"])
    table = spark.read.option("header", True).csv(path)
    chosen = table.select(
        F.col(cell).alias("cell_id"), F.col("vertex_x").cast("double").alias("vertex_x"), F.col("vertex_y").cast("double").alias("vertex_y"), "_metadata"
    )
    return _in_file_order(chosen, "vertex_ord", ("cell_id",)).select("cell_id", "vertex_ord", "vertex_x", "vertex_y")


EVALUATION_COLUMNS = ["window_label", "id", "xen_cell_id", "cell_id", "vertice_x", "vertex_x", "vertice_y", "vertex_y", "x", "y", "celltype"]


def read_evaluation_polygons(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """Measured ring vertices; ids and coordinates by their own order of aliases, other columns pruned at the scan."""
    header = [c for c in _csv_header(spark, path) if allowed is None or c in allowed]
    cell = _first_present(header, ["id", "xen_cell_id", "cell_id"])
    x, y = _first_present(header, ["vertice_x", "vertex_x", "x"]), _first_present(header, ["vertice_y", "vertex_y", "y"])
    extra = [c for c in ("celltype", "window_label") if c in header]
    chosen = spark.read.option("header", True).csv(path).select(
        F.col(cell).alias("cell_id"), F.col(x).cast("double").alias("vertex_x"), F.col(y).cast("double").alias("vertex_y"), *extra, "_metadata"
    )
    return _in_file_order(chosen, "vertex_ord", ("cell_id",)).select("cell_id", "vertex_ord", "vertex_x", "vertex_y", *extra)


def read_grid_embedding(spark: SparkSession, path: str, rows: DataFrame | None = None, header_only: bool = False) -> DataFrame:
    """Grid embedding table; optionally only some ``grid_index`` rows, or everything but the feature column."""
    table = spark.read.parquet(path)
    if header_only:
        table = table.drop(feature_column(table))
    return table if rows is None else table.join(rows.select("grid_index"), "grid_index", "left_semi")


def feature_column(table: DataFrame) -> str:
    """The column marked as features in its metadata, else the only array column that is not geometry."""
    marked = [f.name for f in table.schema if (f.metadata or {}).get("feature_key")]
    if marked:
        return marked[0]
    reserved = {"bbox_xyxy", "center_xy", "grid_bbox", "grid_center_xy", "spot_xy"}
    found = [f.name for f in table.schema if isinstance(f.dataType, T.ArrayType) and f.name not in reserved]
    if len(found) != 1:
        raise KeyError(f"Cannot tell the feature column; candidates={found}")
    return found[0]


def read_grid_types(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Grid type table with the probability columns as one vector ``prob``, and the type names in column order."""
    header = _csv_header(spark, path)
    names = probability_columns(header)
    text = {"grid_id", "predicted_type"}
    schema = T.StructType([T.StructField(c, T.StringType() if c in text else T.DoubleType()) for c in header])
    table = spark.read.schema(schema).option("header", True).csv(path)
    rest = [c for c in header if c not in names]
    labels = [n[5:] if n.startswith("prob_") else n for n in names]
    return table.select(*rest, F.array(*[F.col(f"`{n}`") for n in names]).alias("prob")), labels


def probability_columns(columns: list[str]) -> list[str]:
    """Columns named ``prob_...``, else every column that is not geometry or the label; none is an error."""
    chosen = [c for c in columns if c.startswith("prob_")]
    if not chosen:
        reserved = {"grid_id", "center_x", "center_y", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1", "predicted_type"}
        chosen = [c for c in columns if c not in reserved]
    if not chosen:
        raise ValueError("The grid type table has no probability columns.")
    return chosen


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded image files as the image source gives them: ``origin, height, width, nChannels, mode, data``."""
    return spark.read.format("image").load(path).select("image.*")


def read_thumbnail(spark: SparkSession, path: str) -> DataFrame:
    """``(px, py, r, g, b)`` of an image file. The bytes of the decoded image are unpacked with column functions."""
    image = read_images(spark, path)
    at = lambda i: F.ascii(F.decode(F.substring("data", i, 1), "iso-8859-1"))
    rows = image.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("py")).select(
        F.expr("substring(data, py * width * nChannels + 1, width * nChannels)").alias("data"), "width", "nChannels", "py"
    )
    pixels = rows.repartition("py").select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("px"))
    base = F.col("px") * F.col("nChannels")
    channel = lambda offset: F.when(F.col("nChannels") == 1, at(base + 1)).otherwise(at(base + offset))
    # Decoded images hold blue, green, red in this order.
    return pixels.select("px", "py", channel(3).alias("r"), channel(2).alias("g"), channel(1).alias("b"))
