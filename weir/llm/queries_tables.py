"""Queries over vectors, pages and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import html_text, revisits, vector_search
from weir.llm.common import table


def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best other vectors for every twentieth vector."""
    rows = table(spark, folder, "embeddings").where(vector_search.usable(F.col("embedding")))
    rows = rows.select("vec_id", vector_search.whole_numbers(F.col("embedding")).alias("vector"))
    return vector_search.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_inner_product(q.e, r.e) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 20 = 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM o WHERE n <= 20
"""

def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, folder, "pages"))


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records made from pages: each page as a response and later revisits of it, and
    the front page of its section, which many pages share, as one more record.

    Some revisits have another tag, only a date, only a digest, or no validator, and some
    come before any response.
    """
    n, url = F.col("page_id"), F.col("url")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    other = F.concat(F.lit('"'), F.substring(digest, 13, 12), F.lit('"'))
    hour, day = 3600, 86400
    front = F.regexp_extract(url, r"^([a-z]+://[^/]+/[a-z]+)", 1)
    front_tag = F.concat(F.lit('W/"'), F.floor(n / 64).cast("string"), F.lit('"'))

    def headers(**values: Column) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k.replace("_", "-")), v)]
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())

    def record(i: int, kind: str, address: Column, at: Column, values: Column, digest: Column):
        return F.struct(
            (n * 4 + i).alias("record_id"), F.lit(kind).alias("kind"), address.alias("url"),
            F.timestamp_seconds(at).alias("captured"), values.alias("headers"),
            digest.alias("digest"),
        )

    at = F.lit(1_600_000_000) + n * hour
    date = at.cast("string")
    size = F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    nothing = F.lit(None).cast("string")
    page = record(
        0, "response", url, at,
        headers(Content_Type=F.lit("text/html"), Content_Length=size, Date=date,
                ETag=F.when(n % 7 != 0, tag), Last_Modified=F.when(n % 3 == 0, date)),
        digest,
    )
    later = F.when(n % 11 == 0, at - day).otherwise(at + day)
    again = record(
        1, "revisit", F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#again")), later,
        headers(Content_Length=F.lit("0"), Date=later.cast("string"), Cache_Control=F.lit("no-cache"),
                ETag=F.when(n % 5 == 0, other).when(n % 7 != 0, F.concat(F.lit("W/"), tag)),
                Last_Modified=F.when(n % 3 == 0, date)),
        F.when(n % 2 == 0, digest),
    )
    first = n % 8 == 0
    section = F.when(first, record(
        2, "response", front, at,
        headers(Content_Type=F.lit("text/html"), Content_Length=F.lit("7"), Date=date, ETag=front_tag),
        digest,
    )).otherwise(record(
        2, "revisit", F.concat(front, F.lit("/?utm_source=feed")), at,
        headers(Content_Length=F.lit("0"), Date=date, ETag=front_tag), nothing,
    ))
    return pages.select(F.explode(F.array(page, again, section)).alias("r")).select("r.*")


def op8_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Every crawl record with the response that it stands for."""
    found = revisits.resolve(captures(table(spark, folder, "pages")))
    lines = F.transform(
        F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit(": "), x["value"])
    )
    return found.select(
        "record_id", "url_key", "kind", "state", "resolved_id", "digest",
        F.array_join(F.array_sort(lines), "; ").alias("headers"),
    )


OP8_SQL = r"""
WITH p AS (
  SELECT page_id AS n, url, md5(coalesce(html, '')) AS digest, 1600000000 + page_id * 3600 AS tm,
         CAST(length(coalesce(html, '')) AS VARCHAR) AS size,
         regexp_extract(url, '^([a-z]+://[^/]+/[a-z]+)', 1) AS front,
         'W/"' || CAST(n // 64 AS VARCHAR) || '"' AS front_tag
  FROM pages
), r AS (
  SELECT n * 4 AS id, 'response' AS kind, url, tm, 'text/html' AS ctype, size AS clength, tm AS date,
         CASE WHEN n % 7 <> 0 THEN '"' || substr(digest, 1, 12) || '"' END AS etag,
         CASE WHEN n % 3 = 0 THEN CAST(tm AS VARCHAR) END AS modified, NULL AS cache, digest FROM p
  UNION ALL
  SELECT n * 4 + 1, 'revisit', regexp_replace(url, '#.*$', '') || '#again',
         CASE WHEN n % 11 = 0 THEN tm - 86400 ELSE tm + 86400 END, NULL, '0',
         CASE WHEN n % 11 = 0 THEN tm - 86400 ELSE tm + 86400 END,
         CASE WHEN n % 5 = 0 THEN '"' || substr(digest, 13, 12) || '"'
              WHEN n % 7 <> 0 THEN 'W/"' || substr(digest, 1, 12) || '"' END,
         CASE WHEN n % 3 = 0 THEN CAST(tm AS VARCHAR) END, 'no-cache',
         CASE WHEN n % 2 = 0 THEN digest END FROM p
  UNION ALL
  SELECT n * 4 + 2, CASE WHEN n % 8 = 0 THEN 'response' ELSE 'revisit' END,
         CASE WHEN n % 8 = 0 THEN front ELSE front || '/?utm_source=feed' END, tm,
         CASE WHEN n % 8 = 0 THEN 'text/html' END, CASE WHEN n % 8 = 0 THEN '7' ELSE '0' END, tm,
         front_tag, NULL, NULL, CASE WHEN n % 8 = 0 THEN digest END FROM p
), b AS (
  SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM r
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[a-z]+://([^/?]+)', 1)),
           '^www\.', ''), ':(80|443)?$', '') AS host,
         regexp_replace(bare, '^[^:]*://[^/?]*', '') AS rest FROM b
), k AS (
  SELECT *, regexp_replace(regexp_replace(rest, '\?.*$', ''), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)(=|$)'))),
           '&') AS asked FROM c
), u AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END END AS key
  FROM k
), w AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN struct_pack(id := id, ctype := ctype,
             clength := clength, date := date, etag := etag, modified := modified, digest := digest) END
           IGNORE NULLS) OVER (PARTITION BY key ORDER BY tm, id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
  FROM u
), s AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN f IS NULL OR key IS NULL THEN 'orphan'
    WHEN f.etag IS NOT NULL AND etag IS NOT NULL THEN
      CASE WHEN regexp_replace(f.etag, '^W/', '') = regexp_replace(etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    WHEN f.modified IS NOT NULL AND modified IS NOT NULL THEN
      CASE WHEN f.modified = modified THEN 'resolved' ELSE 'mismatch' END
    WHEN f.digest IS NOT NULL AND digest IS NOT NULL THEN
      CASE WHEN f.digest = digest THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unchecked' END AS state FROM w
), h AS (
  SELECT *, state = 'resolved' AS done FROM s
)
SELECT id AS record_id, key AS url_key, kind, state,
  CASE WHEN done THEN f.id WHEN state = 'full' THEN id END AS resolved_id,
  CASE WHEN done THEN f.digest ELSE digest END AS digest,
  array_to_string(list_filter([
    'cache-control: ' || cache,
    'content-length: ' || CASE WHEN done THEN f.clength ELSE clength END,
    'content-type: ' || CASE WHEN done THEN f.ctype ELSE ctype END,
    'date: ' || CAST(date AS VARCHAR),
    'etag: ' || CASE WHEN done THEN coalesce(etag, f.etag) ELSE etag END,
    'last-modified: ' || CASE WHEN done THEN coalesce(modified, f.modified) ELSE modified END
  ], lambda x: x IS NOT NULL), '; ') AS headers
FROM h
"""

QUERIES = {
    "op7_exact_topk": op7_exact_topk,
    "op8_warc_revisits": op8_warc_revisits,
    "op10_html_text": op10_html_text,
}
ORACLE_SQL = {"op7_exact_topk": OP7_SQL, "op8_warc_revisits": OP8_SQL}
