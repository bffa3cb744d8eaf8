"""The queries of this subpackage: each applies one operator to a whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import chat, decontam, forest, html, jaccard, langid, linededup, packing, token_counts, toxicity, trie, vafile, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(_remainder(3) != 1).select("doc_id", "toxic")
    model = toxicity.learn(documents.join(labels, "doc_id"), F.col("doc_id"))
    scored = toxicity.score(documents, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@_query
def op3_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(extra)))


ORACLES["op3_chat_examples"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
shown AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) OVER w AS size
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size) FILTER (WHERE role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""


@_query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    narrow = packing.durable(pieces.select("row.doc_id", "piece", "start", "length", "ids_crc32"))
    return packing.pack(narrow)


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    prototypes = langid.learn(documents.filter(_remainder(4) != 2), F.col("doc_id"))
    found = langid.identify(documents.select("doc_id", "text"), prototypes, keep=["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vafile.top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLES["op6_exact_top_k"] = """
WITH usable AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
placed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM placed WHERE rank <= 20
"""


@_query
def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


@_query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "text_id", "class_id", "n_links", "n_texts")


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(documents).select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.col("cleaned").alias("text"))


ORACLES["op10_line_dedup"] = f"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT page, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM pages WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM lines),
shared AS (SELECT source, bare, count(DISTINCT page) AS held FROM keyed WHERE bare <> '' GROUP BY source, bare),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
dropped AS (SELECT s.source, bare FROM shared s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source WHERE held > {linededup.MAX_RATIO} * total AND held >= {linededup.MIN_PAGES}),
found AS (SELECT k.*, d.bare IS NOT NULL AS gone FROM keyed k LEFT JOIN dropped d ON k.source IS NOT DISTINCT FROM d.source AND k.bare = d.bare),
texts AS (SELECT page, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text FROM found GROUP BY page)
SELECT p.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, t.text FROM pages p LEFT JOIN texts t USING (page)
"""


@_query
def op11_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@_query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@_query
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.prefix_trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 of a decimal id, eight shifts per byte, by its defining polynomial (a fixed value).
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""

ORACLES["op13_conversation_prefix_trie"] = f"""
WITH told AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
planned AS (SELECT conv_id, turns, {_CRC32} % 4 AS head FROM told),
rebuilt AS (
  SELECT p.conv_id, list_concat(coalesce(b.turns[1:p.head], []), p.turns[p.head + 1:]) AS turns FROM planned p LEFT JOIN told b ON b.conv_id = p.conv_id - p.conv_id % 20),
steps AS (SELECT conv_id, len(turns) AS whole, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(whole = depth) AS is_leaf,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole = depth), '') AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(turns[depth].text), '[^\x20\x09-\x0D]+')) END AS words
  FROM steps GROUP BY 1, 2),
climbed AS (SELECT unnest(range(depth + 1)) AS up, path, (n_convs - 1) * words AS saved, is_leaf FROM nodes),
subtrees AS (SELECT up AS depth, path[1:up] AS path, sum(saved) AS saved, count(*) FILTER (WHERE is_leaf) AS n_leaves FROM climbed GROUP BY 1, 2),
children AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN subtrees s ON s.depth = n.depth AND s.path = n.path LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
