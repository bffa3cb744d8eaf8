"""Documents to packed training sequences: each stage takes the documents its predecessor kept.

Languages are identified and documents in none go; lines that a source repeats on too many pages go; of each group of
near-duplicates the document with the least id stays; documents that hold a benchmark item go; the rest is packed.
Null ids are compared like any value; a document row that is repeated is kept once by the third stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import decontam, jaccard, langid, linededup, packing
from spotweave.session import durable, scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and longer ones in no learned language: no nearer to one than unrelated letters are by chance.

    Languages are learned as in op5, from three of four documents.
    """
    taught = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    found = langid.identify(docs, langid.learn(taught, F.col("doc_id")))
    kept = found.filter(langid.recognised())
    return kept.select(*[F.col("row").getField(name).alias(name) for name in docs.columns])


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines on more than a tenth of their source's documents; ``n_chars`` follows the text.

    Copies are only settled by the next stage, so five documents must share a line, and one of which nothing would be left stays whole.
    """
    cleaned = linededup.without_boilerplate(docs, min_pages=5, spare_whole_pages=True)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(kind))
    return cleaned.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group connected by shingle similarities of at least 0.8."""
    return jaccard.one_per_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage at least 0.8 similar to a benchmark item."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and place there."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return packing.pack(durable(pieces.select("row.doc_id", "piece", "start", "length", "ids_crc32")))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Learned languages, near-duplicate groups and tokens have no form in SQL; tests compare a fixture with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
