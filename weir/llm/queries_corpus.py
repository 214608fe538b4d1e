"""Queries over counts of a whole collection: sources, search and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import divergence, quality, ranked_search
from weir.llm.common import in_fold, table


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark a source."""
    return divergence.audit(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (
  SELECT lang, source, id, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term
), a AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN k USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), t AS (
  SELECT lang, source, sum(n) AS total FROM a GROUP BY lang, source
), p AS (
  SELECT a.lang, a.source, a.term, a.n,
    1 + (1000000000::HUGEINT * (a.n + 5)) // (t.total + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (a.lang_n + 5)) // (l.total + 5 * l.v) AS q
  FROM a JOIN t ON t.lang = a.lang AND t.source = a.source JOIN l ON l.lang = a.lang
), s AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
  GROUP BY x.lang, x.source, y.source
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
), z AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM r
)
SELECT * FROM z WHERE part = 'pair' OR rank <= 50
"""


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP12_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), d AS (
  SELECT id, doc_id, w, len(w) AS n FROM w WHERE len(w) > 0
), a AS (
  SELECT count(*) AS total, sum(n) AS terms FROM d
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), o AS (
  SELECT id, unnest(w) AS term FROM d
), p AS (
  SELECT id, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM i) GROUP BY id, term
), k AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM p, a GROUP BY term
), m AS (
  SELECT id, doc_id, CAST(50 + (50::HUGEINT * n * total) // terms AS BIGINT) AS m FROM d, a
), s AS (
  SELECT i.item_id, m.id, any_value(m.doc_id) AS doc_id,
    CAST(sum(k.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m))) AS BIGINT) AS score
  FROM i JOIN k USING (term) JOIN p USING (term) JOIN m ON m.id = p.id GROUP BY i.item_id, m.id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every text, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels, allowed=F.col("doc_id").isNotNull() & ~held_out)
    found = quality.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {
    "op11_source_divergence": op11_source_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_quality": op13_quality,
}
ORACLE_SQL = {"op11_source_divergence": OP11_SQL, "op12_ranked_search": OP12_SQL}
