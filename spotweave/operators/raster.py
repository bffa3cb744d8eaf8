"""Tissue mask of a thumbnail: thresholds, morphology, hole filling and the mask edge.

A mask travels as 64-pixel words, one row ``(py, word, bits)`` per word with any true pixel, so a morphological
step is bit arithmetic on a sixty-fourth of the pixels and one shuffle keyed by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.session import by_shuffle, durable, one_row

# Least saturation, greatest mean and least range of a tissue pixel.
MIN_SATURATION, MAX_MEAN, MIN_RANGE = 0.05, 245.0, 10.0
#: Bytes of the bands into which decoded images are cut; a band holds whole rows of pixels, one at least.
BAND_BYTES = 1 << 20


def tissue_pixels(thumbnail: DataFrame) -> DataFrame:
    """``(px, py)`` of the pixels that look like tissue."""
    r, g, b = (F.col(c).cast("double") for c in ("r", "g", "b"))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    saturation = F.when(high > 0, (high - low) / F.greatest(high, F.lit(1.0))).otherwise(0.0)
    return thumbnail.where(
        (saturation > MIN_SATURATION) & ((r + g + b) / 3.0 < MAX_MEAN) & (high - low > MIN_RANGE)
    ).select(F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"))


def image_words(images: DataFrame, band_bytes: int = BAND_BYTES) -> DataFrame:
    """Words of the pixels that look like tissue, straight from decoded images: no pixel becomes a row.

    ``images`` has ``width``, ``height``, ``nChannels`` (1, 3 or 4) and ``data`` (blue, green, red) as the image source gives them, and
    may have ``py0``, the image row a strip begins with (0 if absent). Strips must not overlap. Images are cut into bands that are
    dealt to all tasks. Images without data (unreadable files have height -1) give nothing.
    """
    first = F.col("py0").cast("long") if "py0" in images.columns else F.lit(0).cast("long")
    line = F.col("width").cast("long") * F.col("nChannels")
    sized = images.where("width > 0 AND height > 0 AND nChannels > 0").select(
        first.alias("py0"), "width", "height", "nChannels", "data", F.greatest(F.lit(1), F.floor(F.lit(band_bytes) / line)).cast("int").alias("rows"))
    bands = sized.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("height") - 1), F.col("rows"))).alias("top")).select(
        (F.col("py0") + F.col("top")).alias("py"), "width", "nChannels",
        F.expr("substring(data, top * width * nChannels + 1, least(rows, height - top) * width * nChannels)").alias("data"))

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                top, width, channels, data = (batch.column(k)[i].as_py() for k in range(4))
                pixels = np.frombuffer(data, np.uint8).reshape(-1, width, channels)[:, :, :3].astype(np.int64)
                high, low = pixels.max(axis=2), pixels.min(axis=2)
                total = pixels.sum(axis=2) * (3 // pixels.shape[2])
                tissue = ((high - low) / np.maximum(high, 1) > MIN_SATURATION) & (total / 3.0 < MAX_MEAN) & (high - low > MIN_RANGE)
                tissue = np.pad(tissue, ((0, 0), (0, -width % 64)))
                bits = np.packbits(tissue, axis=1, bitorder="little").view("<i8")
                y, word = np.nonzero(bits)
                yield pa.RecordBatch.from_arrays([pa.array(y + top), pa.array(word.astype(np.int32)), pa.array(bits[y, word])], ["py", "word", "bits"])

    found = bands.repartition("py").mapInArrow(words, "py long, word int, bits long")
    return found.select(F.col("py").cast("int").alias("py"), "word", "bits")


def frame_size(thumbnail: DataFrame) -> tuple[int, int]:
    row = one_row(thumbnail.agg((F.max("px") + 1).alias("w"), (F.max("py") + 1).alias("h")))
    return int(row["w"]), int(row["h"])


def pack(pixels: DataFrame) -> DataFrame:
    """True pixels to words; bits of a word combine before the shuffle."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("px") % 64).cast("int"))
    return pixels.groupBy("py", F.floor(F.col("px") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def unpack(words: DataFrame) -> DataFrame:
    """Words back to ``(px, py)``."""
    k = F.explode(F.sequence(F.lit(0), F.lit(63)))
    return words.select("py", "word", "bits", k.alias("k")).where(
        F.call_function("shiftrightunsigned", F.col("bits"), F.col("k")).bitwiseAND(F.lit(1).cast("long")) == 1
    ).select((F.col("word") * 64 + F.col("k")).alias("px"), "py")


def _left(bits: Column, n: int) -> Column:
    return F.call_function("shiftleft", bits, F.lit(n))


def _right(bits: Column, n: int) -> Column:
    return F.call_function("shiftrightunsigned", bits, F.lit(n))


def _fold(columns: list[Column]) -> Column:
    result = columns[0]
    for column in columns[1:]:
        result = result.bitwiseOR(column)
    return result


def _sent(words: DataFrame, bits: Column, radius: int) -> DataFrame:
    """What each word adds to the words around it: ``(py, word, dw, v)``, horizontally spread before it is sent.

    ``dw`` is 0 for the word's own columns, 1 for the bits that move into the next word, -1 for the one before.
    """
    own = _fold([bits] + [move(bits, n) for n in range(1, radius + 1) for move in (_left, _right)])
    onward = _fold([_right(bits, 64 - n) for n in range(1, radius + 1)])
    backward = _fold([_left(bits, 64 - n) for n in range(1, radius + 1)])
    parts = F.array(*[F.struct(F.lit(dw).alias("dw"), v.alias("v")) for dw, v in ((0, own), (1, onward), (-1, backward))])
    rows = F.sequence(F.col("py") - radius, F.col("py") + radius)
    return (
        words.select("py", "word", F.explode(parts).alias("s"))
        .select(F.explode(rows).alias("py"), (F.col("word") + F.col("s.dw")).alias("word"), F.col("s.dw").alias("dw"), F.col("s.v").alias("v"))
    )


def erode(words: DataFrame, radius: int = 1) -> DataFrame:
    """All pixels of the square true; outside the image counts as false. Radius n is n single steps.

    The false pixels are spread. A word that is missing is all false: a missing row clears the target, a missing
    left or right neighbour clears the columns it would have covered.
    """
    rows = 2 * radius + 1
    count = lambda dw: F.count_if(F.col("dw") == dw)
    low = F.lit((1 << radius) - 1).cast("long")
    met = _sent(words, F.bitwise_not(F.col("bits")), radius).groupBy("py", "word").agg(
        F.bit_or("v").alias("clear"), count(0).alias("here"), count(1).alias("before"), count(-1).alias("after")
    ).where(F.col("here") == rows)
    zero = F.lit(0).cast("long")
    edges = F.when(F.col("before") < rows, low).otherwise(zero).bitwiseOR(
        F.when(F.col("after") < rows, _left(low, 64 - radius)).otherwise(zero)
    )
    return met.select("py", "word", F.bitwise_not(F.col("clear").bitwiseOR(edges)).alias("bits")).where("bits <> 0")


def dilate(words: DataFrame, width: int, height: int, radius: int = 1) -> DataFrame:
    """Any pixel of the square true, within the image. Radius n is n single steps."""
    last = (width - 1) // 64
    tail = width - last * 64
    clip = F.when(F.col("word") == last, F.lit(-1 if tail == 64 else (1 << tail) - 1)).otherwise(F.lit(-1)).cast("long")
    sent = _sent(words, F.col("bits"), radius).where(
        (F.col("v") != 0) & F.col("py").between(0, height - 1) & F.col("word").between(0, last)
    )
    return sent.groupBy("py", "word").agg(F.bit_or("v").alias("v")).select(
        "py", "word", F.col("v").bitwiseAND(clip).alias("bits")
    ).where("bits <> 0")


def open_and_close(words: DataFrame, width: int, height: int, opening: int = 1, closing: int = 2) -> DataFrame:
    """Opening, then closing. Their two dilations are one dilation of the summed radius."""
    return erode(dilate(erode(words, opening), width, height, opening + closing), closing)


def background_runs(words: DataFrame, width: int, height: int) -> DataFrame:
    """Maximal horizontal runs of false pixels: ``(id, py, first, last, outside)``, numbered in row-major order.

    The runs of one image row are paired up inside the row, which the image width bounds.
    """
    spark = words.sparkSession
    last_word = (width - 1) // 64
    rows = spark.range(height).select(F.col("id").cast("int").alias("py"))
    frame = rows.select("py", F.explode(F.sequence(F.lit(0), F.lit(last_word))).alias("word"))
    tail = width - last_word * 64
    clip = -1 if tail == 64 else (1 << tail) - 1
    valid = F.when(F.col("word") == last_word, F.lit(clip)).otherwise(F.lit(-1)).cast("long")
    free = frame.join(by_shuffle(words), ["py", "word"], "left").select(
        "py", "word", F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))).bitwiseAND(valid).alias("free")
    )
    row = Window.partitionBy("py").orderBy("word")
    before = F.coalesce(F.lag("free").over(row), F.lit(0).cast("long"))
    after = F.coalesce(F.lead("free").over(row), F.lit(0).cast("long"))
    f = F.col("free")
    marked = free.select("py", "word", f.alias("free"), before.alias("b"), after.alias("a")).select(
        "py", "word",
        f.bitwiseAND(F.bitwise_not(_left(f, 1).bitwiseOR(_right(F.col("b"), 63)))).alias("starts"),
        f.bitwiseAND(F.bitwise_not(_right(f, 1).bitwiseOR(_left(F.col("a"), 63)))).alias("ends"),
    )
    positions = lambda c, end: unpack(
        marked.select("py", "word", F.col(c).alias("bits"))
    ).select("py", F.col("px").alias("x"), F.lit(end).alias("is_end"))
    events = positions("starts", 0).unionByName(positions("ends", 1))
    along = Window.partitionBy("py").orderBy("x", "is_end")
    return events.select("py", "x", "is_end", F.lead("x").over(along).alias("last")).where("is_end = 0").select(
        (F.col("py").cast("long") * width + F.col("x") + 1).alias("id"), "py", F.col("x").alias("first"), "last",
        ((F.col("x") == 0) | (F.col("last") == width - 1) | (F.col("py") == 0) | (F.col("py") == height - 1)).alias("outside"),
    )


def run_contacts(runs: DataFrame) -> DataFrame:
    """``(id, other)`` for runs of neighbouring rows that share a column, both directions.

    Two overlapping runs share the start of one of them, so each start is looked up once in the rows above and
    below; the pairs are linear in the runs.
    """
    host = runs.select(F.col("py").alias("row"), F.col("first").alias("x"), F.lit(0).alias("kind"), "id", "last")
    probe = runs.select(
        F.explode(F.array(F.col("py") - 1, F.col("py") + 1)).alias("row"), F.col("first").alias("x"), F.lit(1).alias("kind"),
        "id", F.lit(None).cast(runs.schema["last"].dataType).alias("last"),
    )
    along = Window.partitionBy("row").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("kind") == 0, F.struct("id", "last")), ignorenulls=True).over(along)
    met = host.unionByName(probe).withColumn("_h", latest).where("kind = 1 AND _h.last >= x")
    one_way = met.select("id", F.col("_h.id").alias("other"))
    return one_way.select(
        F.explode(F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other")))).alias("e")
    ).select("e.*").distinct()


def outside_runs(runs: DataFrame) -> DataFrame:
    """Ids of the runs that are 4-connected to the image border.

    Runs at the border are one node (label 0). The inner runs take the smallest label of their neighbours, whole
    label classes follow the best of their members, and labels are then chased one step; distances halve, so the
    rounds grow with the logarithm of the depth and not with the depth. State is checkpointed every round.
    """
    contacts = run_contacts(runs)
    border = runs.where("outside").select("id")
    inner = runs.where("NOT outside").select("id")
    if inner.isEmpty():
        return border
    touching = contacts.join(by_shuffle(border.withColumnRenamed("id", "other")), "other", "left_semi").select("id").distinct()
    links = durable(contacts.join(by_shuffle(border), "id", "left_anti").join(by_shuffle(border.withColumnRenamed("id", "other")), "other", "left_anti"))
    labels = durable(
        inner.join(by_shuffle(touching.withColumn("_t", F.lit(True))), "id", "left")
        .select("id", F.when(F.col("_t"), F.lit(0).cast("long")).otherwise(F.col("id")).alias("label"))
    )
    while True:
        near = links.join(by_shuffle(labels.withColumnRenamed("id", "other")), "other").groupBy("id").agg(F.min("label").alias("_near"))
        reached = labels.join(by_shuffle(near), "id", "left").select("id", "label", F.least("label", F.coalesce("_near", "label")).alias("_new"))
        # A label 0 never changes; the other classes move together to their members' best label.
        hooks = reached.where("label > 0").groupBy("label").agg(F.min("_new").alias("_hook")).where("_hook < label")
        # The hooks are unique per label, so a label shared by many runs is a skewed side that AQE splits.
        own = reached.join(by_shuffle(hooks), "label", "left").select(
            "id", "label", F.least("_new", F.coalesce("_hook", "_new")).alias("_new")
        )
        chase = hooks.select(F.col("label").alias("_new"), F.col("_hook").alias("_next"))
        moved = durable(
            own.join(by_shuffle(chase), "_new", "left").select("id", "label", F.least("_new", F.coalesce("_next", "_new")).alias("_new"))
        )
        labels = moved.select("id", F.col("_new").alias("label"))
        if moved.where("_new <> label").isEmpty():
            return border.unionByName(labels.where("label = 0").select("id"))


def fill_holes(words: DataFrame, width: int, height: int) -> DataFrame:
    """Set background that is not 4-connected to the border."""
    runs = durable(background_runs(words, width, height))
    holes = runs.join(by_shuffle(outside_runs(runs)), "id", "left_anti").select(
        "py", F.explode(F.sequence("first", "last")).alias("px")
    )
    return pack(holes).unionByName(words.select("py", "word", "bits")).groupBy("py", "word").agg(F.bit_or("bits").alias("bits"))


def tissue_mask(thumbnail: DataFrame) -> tuple[DataFrame, int, int]:
    """``(px, py)`` of the cleaned tissue mask, with the image width and height."""
    width, height = frame_size(thumbnail)
    cleaned = open_and_close(pack(tissue_pixels(thumbnail)), width, height)
    return unpack(fill_holes(durable(cleaned), width, height)), width, height


def mask_edge(words: DataFrame) -> DataFrame:
    """Mask pixels that an erosion removes."""
    inner = erode(words, 1).withColumnRenamed("bits", "_inner")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_inner", F.lit(0).cast("long"))))
    return words.join(inner, ["py", "word"], "left").select("py", "word", rest.alias("bits")).where("bits <> 0")


def clip_to_box(pixels: DataFrame, box: dict, image: dict, width: int, height: int) -> DataFrame:
    """Pixels inside the spot box scaled to the thumbnail (low side floored, high side ceiled, high exclusive)."""
    sx, sy = width / float(image["width"]), height / float(image["height"])
    low = lambda v, s, n: F.greatest(F.lit(0), F.least(F.lit(n), F.floor(F.lit(float(v) * s))))
    high = lambda v, s, n: F.greatest(F.lit(0), F.least(F.lit(n), F.ceil(F.lit(float(v) * s))))
    return pixels.where(
        (F.col("px") >= low(box["x_min"], sx, width)) & (F.col("px") < high(box["x_max"], sx, width))
        & (F.col("py") >= low(box["y_min"], sy, height)) & (F.col("py") < high(box["y_max"], sy, height))
    )


def preview_boxes(boxes: DataFrame, width: int, height: int, max_side: int = 2600) -> DataFrame:
    """Box corners in preview pixels, rounded half to even."""
    scale = min(float(max_side) / float(max(width, height)), 1.0)
    return boxes.select(
        *[c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")],
        *[F.rint(F.col(c).cast("double") * F.lit(scale)).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")],
    )
