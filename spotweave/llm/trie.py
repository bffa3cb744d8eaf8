"""Prefix trie of conversations by collapse of whole sequences.

Every conversation is rebuilt: first turns of its base conversation, then its own turns after as many. Identical rebuilt
conversations become one weighted sequence with the list of those that end there. A sequence that equals a proper prefix of
another is dropped by an anti-join, what remains are the leaves. Every sequence then hands its weight to its prefixes, which are
summed: nothing but sums and minima are grouped, and no tree is ever gathered.

A prefix is named by its length and two sums over its turns of 60-bit hashes of place, role and text. Sums along a conversation are
running totals over range slices, so a conversation with very many turns is not brought into one task. Sums over subtrees
count each node once: of the sequences through a node the one with the least conversation id stands for it, from some depth on, and
the number of nodes under that depth is known from one minimum per sequence.

Turns are ordered by turn (null first), equal turns by role and text; repeated rows are turns of their own. Null role or text is
empty. Rows with a null conv_id take no part. A conversation without turns after its rebuilding is a member of the root. An empty
table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.operators.ordinals import lookup, ordinal, running_totals
from spotweave.session import durable

#: Conversations are rebuilt from the one whose id is the next lower multiple of FAMILY, with up to SHARED - 1 of its turns.
FAMILY, SHARED = 20, 4
#: A word is a run of anything but blanks, tabs, line ends and the like.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids this close are joined to one piece of an end list: at most so many share a piece.
IDS_PER_PIECE = 4096
NODE = ["depth", "a", "b"]


def _hash(seed: int) -> Column:
    """60 of the bits in ``sha``, as a number that can be summed."""
    return F.conv(F.substring("sha", 1 + 16 * seed, 15), 16, 10).cast("decimal(38,0)")


def own_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1)``, role, text`` in the order of a conversation."""
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal rows may stand in either order; a number of the row keeps them apart.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("at").asc_nulls_first(), "role", "text", "row"]
    return ordinal(rows, order, ["conv_id"], "place").select("conv_id", (F.col("place") + 1).alias("place"), "role", "text")


def rebuilt_turns(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, turns`` for every rebuilt conversation, and its turns as ``conv_id, depth`` (from 1)``, role, text``."""
    lengths = own.groupBy("conv_id").agg(F.max("place").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string")) % SHARED
    known = lengths.select("conv_id", "n", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = durable(known.join(bases, "base", "left").select(
        "conv_id", "head", "base", F.least("head", F.coalesce("base_n", F.lit(0))).alias("taken"), F.greatest(F.col("n") - F.col("head"), F.lit(0)).alias("left")))
    first = own.filter(F.col("place") < SHARED).withColumnRenamed("conv_id", "base")
    heads = plan.filter("taken > 0").select("conv_id", "base", "taken").join(first, "base").filter("place <= taken").select("conv_id", F.col("place").alias("depth"), "role", "text")
    tails = own.join(plan.filter("left > 0").select("conv_id", "head", "taken"), "conv_id").filter("place > head").select(
        "conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "role", "text")
    return plan.select("conv_id", (F.col("taken") + F.col("left")).alias("turns")), heads.unionByName(tails)


def paths(turns: DataFrame) -> DataFrame:
    """Per turn the prefix that ends with it.

    ``conv_id, depth, a, b``, the prefix before it (``before_a, before_b``), the words of its text and ``until``, those of the texts before.
    """
    whole = F.concat_ws("\n", F.col("depth").cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text"))
    made = turns.select("conv_id", "depth", F.sha2(whole, 256).alias("sha"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    hashed = made.select("conv_id", "depth", _hash(0).alias("ha"), _hash(1).alias("hb"), "words")
    placed = running_totals(hashed, ["conv_id"], ["depth"], {"before_a": F.col("ha"), "before_b": F.col("hb"), "until": F.col("words")})
    sums = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("before_a", "before_b")] + [(F.col(f"before_{c}") + F.col(f"h{c}")).cast("decimal(38,0)").alias(c) for c in ("a", "b")]
    return durable(placed.select("conv_id", "depth", *sums, "words", "until"))


def _root(rows: DataFrame) -> DataFrame:
    """The rows with the name of the root."""
    zero = F.lit(0).cast("decimal(38,0)")
    return rows.withColumns({"depth": F.lit(0).cast("long"), "a": zero, "b": zero})


def sequences(steps: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, a, b`` of each conversation's end, and one row per distinct sequence: ``depth, a, b, conv_id`` (the least)``,
    weight, total`` (words of all its texts)."""
    last = steps.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by(F.struct("a", "b", (F.col("until") + F.col("words")).alias("total")), "depth").alias("end"))
    empty = _root(lengths.filter("turns = 0").select("conv_id")).withColumn("total", F.lit(0).cast("long"))
    ends = durable(last.select("conv_id", "depth", "end.a", "end.b", "end.total").unionByName(empty))
    return ends, durable(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total")))


def leaves(collapsed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The sequences that are no proper prefix of another one."""
    proper = prefixes.filter("depth < length").select(*NODE).distinct()
    return collapsed.join(proper, NODE, "left_anti")


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256`` of every node where conversations end.

    The ids of a node are ordered over range slices, joined to pieces of ``IDS_PER_PIECE``, and the pieces of a node are hashed one after
    the other as they come, so that a long list is never held.
    """
    placed = ordinal(ends.select(*NODE, "conv_id"), ["conv_id"], NODE, "place")
    pieces = placed.groupBy(*NODE, F.floor(F.col("place") / IDS_PER_PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    text = [F.col(c).cast("string").alias(c) for c in NODE]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for *own, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*NODE, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, digest.hexdigest())], [*NODE, "ends_sha256"])

    listed = pieces.select(*text, "piece", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    hashed = listed.mapInArrow(digests, "depth string, a string, b string, ends_sha256 string")
    return hashed.select(F.col("depth").cast("long").alias("depth"), *[F.col(c).cast("decimal(38,0)").alias(c) for c in "ab"], "ends_sha256")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_ends``."""
    lengths, rebuilt = rebuilt_turns(own_turns(turns))
    steps = paths(rebuilt)
    ends, collapsed = sequences(steps, lengths)
    held = collapsed.select("conv_id", F.col("depth").alias("length"), "weight", "total")
    below = steps.join(held, "conv_id").select(*NODE, "conv_id", "length", "weight", "total", "until", "before_a", "before_b")
    top = _root(held.withColumn("until", F.lit(0).cast("long"))).withColumns({c: F.lit(None).cast("decimal(38,0)") for c in ("before_a", "before_b")})
    prefixes = durable(below.unionByName(top.select(*below.columns)))

    is_leaf = leaves(collapsed, prefixes).select("conv_id", F.lit(1).cast("long").alias("leaf"))
    # The depth from which on the sequence of conversation m stands for the nodes on its way.
    least = prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("m"), F.max("until").alias("until"))
    since = least.groupBy(F.col("m").alias("conv_id")).agg(F.min("depth").alias("since"), F.min_by("until", "depth").alias("since_until"))
    known = durable(collapsed.select("conv_id").join(is_leaf, "conv_id", "left").join(since, "conv_id", "left"))

    rows = prefixes.join(known, "conv_id")
    stands = F.col("since").isNotNull()
    each = F.col("weight") * (F.col("total") - F.col("until"))
    once = F.when(stands, F.col("total") - F.greatest("until", "since_until")).otherwise(0)
    child = F.when(stands & (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("since")), 1).otherwise(0)
    nodes = durable(rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(child).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(each - once).alias("saved_tokens"), F.coalesce(F.max(F.col("depth") == F.col("since")), F.lit(False)).alias("starts"),
        F.max("before_a").alias("before_a"), F.max("before_b").alias("before_b")))

    # A node whose parent has the same least conversation needs no look at it; the others look it up, children of the root at once.
    root = nodes.filter("depth = 0").select("conv_id").first()
    above = nodes.filter("n_children > 0 AND depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("before_a"), F.col("b").alias("before_b"), F.col("conv_id").alias("parent"))
    first = nodes.filter("starts AND depth > 1").select(*NODE, "before_a", "before_b")
    parents = lookup(first, above, ["depth", "before_a", "before_b"], hot_rows=100_000).select(*NODE, "parent")
    parent = F.when(F.col("depth") == 0, None).when((F.col("depth") == 1) & F.col("starts"), F.lit(root["conv_id"] if root else None)).otherwise(F.coalesce("parent", "conv_id"))
    n_ends = collapsed.select(*NODE, F.col("weight").alias("n_ends"))
    told = nodes.join(parents, NODE, "left").join(end_digests(ends), NODE, "left").join(n_ends, NODE, "left")
    return told.select(
        "conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves",
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"))
