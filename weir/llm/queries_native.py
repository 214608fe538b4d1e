"""Queries that use DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import line_windows, winnowing
from weir.llm.common import table


def op2_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are."""

    def written(prints: str) -> Column:
        hashes = F.transform(f"{prints}.hashes", lambda h: F.lpad(F.lower(F.hex(h)), 15, "0"))
        one = F.zip_with(hashes, f"{prints}.positions", lambda h, p: F.concat(h, F.lit("@"), p))
        return F.array_join(one, " ")

    found = winnowing.edited_likeness(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        written("prints").alias("fingerprint"), written("edited_prints").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), e AS (
  SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next
  FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text)
), x AS (
  SELECT *, substr(text, 1, n - n // 3) || substr(next, 1, n // 3) AS edited FROM e
), t AS (
  SELECT text AS t FROM d UNION SELECT edited FROM x
), u AS (
  SELECT t, regexp_extract_all(t, '[^ \t\n\x0B\f\r]{1,8}') AS u FROM t
), h AS (
  SELECT t, CASE WHEN len(u) = 0 THEN [] ELSE list_transform(range(greatest(len(u) - 3, 0) + 1),
    lambda i: substr(md5(array_to_string(list_slice(u, i + 1, i + 3), ' ')), 1, 15)
              || lpad(CAST(999999999 - i AS VARCHAR), 9, '0')) END AS h FROM u
), m AS (
  SELECT t, CASE WHEN len(h) = 0 THEN [] ELSE list_transform(range(greatest(len(h) - 6, 0) + 1),
    lambda i: list_min(list_slice(h, i + 1, i + 6))) END AS m FROM h
), p AS (
  SELECT t, list_sort(list_transform(list_distinct(m), lambda x:
    struct_pack(at := 999999999 - CAST(substr(x, 16) AS BIGINT), h := substr(x, 1, 15)))) AS p FROM m
), f AS (
  SELECT t, list_distinct(list_transform(p, lambda x: x.h)) AS hs,
    array_to_string(list_transform(p, lambda x: x.h || '@' || CAST(x.at AS VARCHAR)), ' ') AS f FROM p
)
SELECT x.doc_id, CAST(x.n AS BIGINT) AS n_chars, sha256(x.edited) AS edited_sha256,
  a.f AS fingerprint, b.f AS edited_fingerprint,
  CASE WHEN len(a.hs) + len(b.hs) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.hs, b.hs))::DOUBLE
    / (len(a.hs) + len(b.hs) - len(list_intersect(a.hs, b.hs)))::DOUBLE END AS near_edited,
  CASE WHEN len(a.hs) + len(c.hs) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.hs, c.hs))::DOUBLE
    / (len(a.hs) + len(c.hs) - len(list_intersect(a.hs, c.hs)))::DOUBLE END AS near_next
FROM x JOIN f a ON x.text = a.t JOIN f b ON x.edited = b.t JOIN f c ON x.next = c.t
"""


def op6_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the three-line windows that occurred before."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_windows.remove_repeats(docs)


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), f AS (
  SELECT doc_id, text, list_filter(list_transform(l, lambda x, i: struct_pack(
    t := trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)), i := i - 1)), lambda x: x.t <> '') AS a FROM d
), w AS (
  SELECT doc_id, text, unnest(list_transform(range(greatest(len(a) - 2, 0)), lambda i: struct_pack(
    first := a[i + 1].i, last := a[i + 3].i,
    w := a[i + 1].t || chr(10) || a[i + 2].t || chr(10) || a[i + 3].t)), recursive := true) FROM f
), k AS (
  SELECT w, min(struct_pack(d := coalesce(doc_id, -9223372036854775808), i := first)) AS k FROM w
  GROUP BY w HAVING count(*) > 1
), c AS (
  SELECT doc_id, text, unnest(range(first, last + 1)) AS i FROM w JOIN k USING (w)
  WHERE struct_pack(d := coalesce(doc_id, -9223372036854775808), i := first) > k
), g AS (
  SELECT doc_id, text, list(DISTINCT i) AS gone FROM c GROUP BY doc_id, text
)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(l,
    lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text
FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text
"""

QUERIES = {"op2_winnowing": op2_winnowing, "op6_line_windows": op6_line_windows}
ORACLE_SQL = {"op2_winnowing": OP2_SQL, "op6_line_windows": OP6_SQL}
