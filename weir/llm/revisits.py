"""WARC: resolving "not modified" revisit records to the response they stand for.

A revisit holds no body. It stands for the latest earlier full response of the same canonical
URL, if the validators of the two agree; its own headers then update those of the response as
far as HTTP permits for a 304 answer.

The as-of join is a range sort by (URL, time, id): a frequent URL spreads over many sorted
partitions. Each partition remembers the last full response while its rows pass; the last
response of every partition, one row each, is carried to the rows that start the next ones.

Definite results: rows without a URL or time are ``orphan`` if they are revisits. Records of
the same time are ordered by id, null ids first, and repeated rows follow one another. A
revisit without an earlier response is ``orphan``, one whose validators differ ``mismatch``,
one that shares no validator with the response ``unchecked``; these keep their own headers.
A kind other than ``response`` and ``revisit`` is passed through as ``other``. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import map_rows, saved

# Headers of a 304 answer that replace those of the stored response.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires",
             "last-modified", "set-cookie", "vary", "warning"]
# Query parameters that tell where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)(=|$)"
HEADERS = "map<string, string>"
REF = f"struct<url: string, id: bigint, headers: {HEADERS}, digest: string>"


def canonical_url(url: Column) -> Column:
    """One spelling per resource; null when there is no host.

    Scheme, user, a leading ``www.``, default port, fragment, tracking parameters and a
    trailing slash go; the host is in lower case and the parameters are sorted.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)?$", "")
    rest = F.regexp_replace(bare, r"^[^:]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    asked = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ only in case the last by name stays."""
    pairs = F.array_sort(F.map_entries(headers))
    names = F.transform(pairs, lambda x: F.lower(x["key"]))
    last = F.filter(
        F.transform(pairs, lambda x, i: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value"), i.alias("i"))),
        lambda x: ~F.array_contains(F.slice(names, x["i"] + 2, F.greatest(F.size(names), F.lit(1))), x["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))


def validator_state(old: Column, new: Column, old_digest: Column, new_digest: Column) -> Column:
    """``resolved``, ``mismatch`` or ``unchecked`` by entity tag, else date, else digest."""

    def tag(h: Column) -> Column:
        return F.regexp_replace(h["etag"], r"^W/", "")

    def told(a: Column, b: Column, otherwise: Column) -> Column:
        same = F.when(a == b, F.lit("resolved")).otherwise(F.lit("mismatch"))
        return F.when(a.isNotNull() & b.isNotNull(), same).otherwise(otherwise)

    by_digest = told(old_digest, new_digest, F.lit("unchecked"))
    by_date = told(old["last-modified"], new["last-modified"], by_digest)
    return told(tag(old), tag(new), by_date)


def merged_headers(old: Column, new: Column) -> Column:
    """The response's headers with the permitted ones of the revisit in their place."""
    updates = F.map_filter(new, lambda k, _: k.isin(PERMITTED))
    rest = F.map_filter(old, lambda k, _: ~F.map_contains_key(updates, k))
    return F.map_concat(rest, updates)


def resolve(
    records: DataFrame,
    id_col: str = "record_id",
    url_col: str = "url",
    time_col: str = "captured",
    kind_col: str = "kind",
    headers_col: str = "headers",
    digest_col: str = "digest",
) -> DataFrame:
    """(id, url_key, captured, kind, state, resolved_id, digest, headers) of every record.

    ``resolved_id``, ``digest`` and ``headers`` are those of the response for a resolved
    revisit (headers merged), and the record's own otherwise.
    """
    rows = records.select(
        F.col(id_col).cast("bigint").alias("id"),
        canonical_url(F.col(url_col)).alias("url"),
        F.col(time_col).cast("timestamp").alias("time"),
        F.col(kind_col).cast("string").alias("kind"),
        F.coalesce(lower_keys(F.col(headers_col)), F.create_map().cast(HEADERS)).alias("headers"),
        F.col(digest_col).cast("string").alias("digest"),
    )
    order = ["url", "time", "id", "kind", "digest"]
    columns = ["id", "url", "time", "kind", "headers", "digest"]
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def start():
        slot, last = TaskContext.get().partitionId(), [None]

        def fill(batch):
            out = []
            for row in batch:
                row_id, url, time, kind, headers, digest = row
                out.append((*row, last[0], slot))
                if kind == "response" and url is not None and time is not None:
                    last[0] = {"url": url, "id": row_id, "headers": headers, "digest": digest}
            return out

        return fill

    # The state of a task lives as long as its sorted partition.
    filled = saved(
        map_rows(
            rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns),
            f"id bigint, url string, time timestamp, kind string, headers {HEADERS},"
            f" digest string, before {REF}, slot int",
            start,
        ),
        "revisits",
    )
    full = (F.col("kind") == "response") & F.col("url").isNotNull() & F.col("time").isNotNull()
    own = F.struct("url", "id", "headers", "digest")
    # One row per sorted partition, as many as the session has shuffle partitions.
    ends = filled.groupBy("slot").agg(
        F.max_by(F.when(full, own), F.when(full, F.struct(*order))).alias("end")
    )
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("slot", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    found = filled.join(carried, "slot", "left").withColumn(
        "ref", F.coalesce(F.col("before"), F.col("carried"))
    )
    ref = F.when((F.col("ref.url") == F.col("url")) & F.col("time").isNotNull(), F.col("ref"))
    found = found.withColumn("ref", ref)
    agreed = validator_state(
        F.col("ref.headers"), F.col("headers"), F.col("ref.digest"), F.col("digest")
    )
    state = (
        F.when(F.col("kind") == "response", "full")
        .when(F.coalesce(F.col("kind") != "revisit", F.lit(True)), "other")
        .when(F.col("ref").isNull(), "orphan")
        .otherwise(agreed)
    )
    found = found.withColumn("state", state)
    done = F.col("state") == "resolved"
    return found.select(
        F.col("id").alias(id_col), F.col("url").alias("url_key"), F.col("time").alias(time_col),
        F.col("kind").alias(kind_col), "state",
        F.when(done, F.col("ref.id")).when(F.col("state") == "full", F.col("id")).alias("resolved_id"),
        F.when(done, F.col("ref.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(done, merged_headers(F.col("ref.headers"), F.col("headers")))
        .otherwise(F.col("headers")).alias("headers"),
    )
