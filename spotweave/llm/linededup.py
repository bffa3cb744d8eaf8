"""Lines that occur on too large a share of one site's pages.

Lines are compared without blanks, tabs and carriage returns at their ends. A site is a value of ``host`` (null is a site of
its own); every row is one page of its site, repeated rows included. A line counts once per page. Empty lines never count
and always stay. Null texts stay null. With ``spare_whole_pages`` a page on which every line would go stays as it is: where copies
of pages are still to be searched for, it is taken for one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line on more than this share of a site's pages is boilerplate ...
MAX_RATIO = 0.1
#: ... if at least so many pages hold it: what a single page says is its own, however few pages the site has.
MIN_PAGES = 2
#: Bytes of boilerplate hashes up to which they are broadcast; beyond, pages meet them by a salted shuffle join.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def site_of(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("null"))


def line_shares(pages: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``site``, ``line`` (hash), ``pages_with_line``, ``pages`` for every line that two pages of a site share.

    Only hashes are shuffled, summed per task first, so a frequent line or a large site is a few rows per task.
    """
    rows = pages.select(site_of(F.col(host)).alias("site"), F.col(text).alias("text"))
    kept = F.filter(F.transform(_lines(F.col("text")), _trimmed), lambda line: line != "")
    lines = rows.select("site", F.explode(F.array_distinct(F.transform(kept, _key))).alias("line"))
    shared = lines.groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages_with_line")).filter("pages_with_line > 1")
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    return shared.join(totals, "site")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per site with the hashes of its boilerplate lines.

    At most (lines per page, averaged over the site) / ``max_ratio`` lines of a site can qualify, so a row is bounded.
    """
    found = line_shares(pages, host, text).filter((F.col("pages_with_line") > max_ratio * F.col("pages")) & (F.col("pages_with_line") >= min_pages))
    return found.groupBy("site").agg(F.collect_list("line").alias("dropped"))


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, spare_whole_pages: bool = False,
) -> DataFrame:
    """``row`` (the page as given), ``n_lines``, ``n_dropped`` and ``cleaned``, the text without boilerplate lines."""
    found = boilerplate(pages, host, text, max_ratio, min_pages)
    size = found.agg(F.sum(F.size("dropped") * 24 + 64).alias("bytes")).first()["bytes"] or 0
    rows = pages.select(F.struct("*").alias("row"), site_of(F.col(host)).alias("site"))
    body = F.col("row").getField(text)
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found), "site", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64(body), F.lit(SALTS)).cast("int")).join(salted, ["site", "salt"], "left")
    stays = lambda line: F.coalesce(~F.array_contains(F.col("dropped"), _key(_trimmed(line))), F.lit(True)) | (_trimmed(line) == "")
    left = joined.select("row", _lines(body).alias("lines"), F.when(F.col("dropped").isNull(), _lines(body)).otherwise(F.filter(_lines(body), stays)).alias("kept"))
    some = F.exists("kept", lambda line: _trimmed(line) != "") if spare_whole_pages else F.lit(True)
    marked = left.select("row", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.when(some, F.col("kept")).otherwise(F.col("lines")).alias("kept"))
    return marked.select("row", F.when(F.col("row").getField(text).isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"),
                         F.when(F.col("row").getField(text).isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).alias("n_dropped"),
                         F.array_join("kept", "\n").alias("cleaned"))


def without_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, spare_whole_pages: bool = False,
) -> DataFrame:
    """The same rows and columns, ``text`` without boilerplate lines."""
    cleaned = drop_boilerplate(pages, host, text, max_ratio, min_pages, spare_whole_pages)
    return cleaned.select(*[(F.col("cleaned") if name == text else F.col("row").getField(name)).alias(name) for name in pages.columns])
