"""Queries over whole texts: one row per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import byte_bpe, chosen_path, language, packing, toxicity
from weir.llm.common import in_fold, table


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    return byte_bpe.encode_digests(table(spark, folder, "documents"))


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return chosen_path.near_duplicates(table(spark, folder, "documents")).drop("n_links")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 4),
      lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) END AS s FROM d
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a WHERE r.c < e.b
), m AS (
  SELECT v, min(c) AS c FROM r GROUP BY v
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept
FROM s JOIN m ON doc_id = v
"""


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels, allowed=F.col("doc_id").isNotNull() & ~held_out)
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, in the order of a Hilbert curve."""
    return packing.pack(table(spark, folder, "documents"), with_ids=False)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from the rows outside the held-out fold."""
    docs = table(spark, folder, "documents")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = language.fit(docs, allowed=F.col("doc_id").isNotNull() & ~held_out)
    found = language.predict(docs, model, with_spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op9_byte_bpe": op9_byte_bpe,
}
ORACLE_SQL: dict[str, str] = {"op1_near_duplicates": OP1_SQL}
