"""Not-modified revisit resolution of web captures (operator 5).

A revisit record (status 304) has no body; it stands for the latest earlier
full response of its canonical URL. This is an as-of join: by canonical URL, to
the last response before it in (time, record id). A URL may hold a third of all
records, so the join has two levels. The records of URLs that hold more than one
part in ``buckets`` of all (fewer than ``buckets`` URLs) are cut by time into ranges
of about that size; within (URL, range) a window looks back, and each range's last
response is carried into the later ranges of its URL over a table of one row for
each (URL, range). So a window holds about one part in ``buckets`` of the table at
most, whatever its size; ``buckets`` follows the shuffle partitions unless given.
Only records of one URL and one time are never parted.

The response found must agree with the revisit's validator: the entity tag
(weak comparison) if it has one, else the modification date, else the payload
digest. A resolved revisit gets the response's headers, updated by those that a
304 may change.

Defined cases: a null or relative URL is its own canonical form (null matches
nothing); a null time is never before or after anything; records that tie in
time go by record id, a null id first (it is returned like any other). Repeated
records count one by one, extra columns are ignored, an empty table gives no rows.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Headers that a 304 may update in the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"
_TRACKING = "(^|&)(utm_[a-z]+|ref)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Host in lower case, no scheme, fragment, tracking parameters or final slashes."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, _SCHEME + "([^/?]*)", 1))
    rest = F.regexp_replace(bare, _SCHEME + "[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), _TRACKING, ""), "^&+", "")
    full = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(_SCHEME), full).otherwise(url)


def _bare_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _as_number(records: DataFrame, column: str) -> Column:
    """A number that never falls as ``column`` rises."""
    kind = records.schema[column].dataType.typeName()
    time = F.col(column)
    return (F.unix_date(time) if kind == "date" else time.cast("timestamp") if kind == "timestamp_ntz" else time).cast("double")


def _range_of(time: Column, edges: list[float]) -> Column:
    """How many of the rising ``edges`` are not after ``time``, looked up in two steps."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges)) + 1
    heads = F.size(F.filter(F.lit(np.array(edges[::step])), lambda e: e <= time))
    first = F.greatest((heads - 1) * step, F.lit(0))
    inside = F.size(F.filter(F.slice(F.lit(np.array(edges)), first + 1, F.lit(step)), lambda e: e <= time))
    return F.when(heads == 0, 0).otherwise(first + inside)


def _edges(rows: DataFrame, buckets: int) -> list[float]:
    """Times that cut the records (canonical_url, at) of the largest URLs into ranges of
    a ``buckets``-th of all records; fewer than ``buckets`` of them, none without such URLs."""
    total = rows.count()
    hot = checkpoint(rows.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * buckets > total))
    parts = math.ceil((hot.agg(F.sum("n")).first()[0] or 0) * buckets / max(total, 1))
    if parts < 2:
        return []
    cut = F.percentile_approx("at", [i / parts for i in range(1, parts)], 20 * parts)
    found = rows.join(F.broadcast(hot.select("canonical_url")), "canonical_url").agg(cut.alias("e"))  # < buckets URLs
    return sorted(set(found.first()["e"] or []))


def resolve(records: DataFrame, buckets: int | None = None) -> DataFrame:
    """``records``: record_id, url, time, status, etag, last_modified, digest,
    headers (map). One row per revisit (status 304): record_id, canonical_url,
    response_id, verdict (resolved, mismatch, no_validator, no_response) and
    headers (null unless resolved). Responses are records of status 200."""
    buckets = buckets or 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "time", "status", "etag",
                          "last_modified", "digest", "headers", _as_number(records, "time").alias("at"))
    placed = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    edges = _edges(rows.where(F.col("status").isin(200, 304) & placed).select("canonical_url", "at"), buckets)
    rows = (rows.where(F.col("status").isin(200, 304))
            .withColumn("bucket", F.coalesce(_range_of(F.col("at"), edges), F.lit(0))).drop("at"))
    response = F.when((F.col("status") == 200) & placed, F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    rows = rows.withColumn("response", response)
    nothing = F.when(F.lit(False), F.col("response"))
    nowhere = rows.where(~placed & (F.col("status") == 304))  # beside the windows, however many they are
    rows = rows.where(placed)
    inside = rows.withColumn("near", F.expr(
        "last(response, true) over (partition by canonical_url, bucket order by time, record_id "
        "rows between unbounded preceding and 1 preceding)"))
    ends = (rows.groupBy("canonical_url", "bucket")
            .agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("time", "record_id"))).alias("m")))
    carried = ends.select("canonical_url", "bucket", F.expr(
        "last(m, true) over (partition by canonical_url order by bucket rows between unbounded preceding and 1 preceding)")
        .alias("far"))
    asked = inside.where((F.col("status") == 304)).drop("response")
    found = (asked.join(carried, ["canonical_url", "bucket"], "left")
             .unionByName(nowhere.withColumns({"near": nothing, "far": nothing}).drop("response"))
             .withColumn("hit", F.coalesce("near", "far")))
    hit = F.col("hit")
    same = (F.when(F.col("etag").isNotNull(), F.coalesce(_bare_tag(F.col("etag")) == _bare_tag(hit["etag"]), F.lit(False)))
            .when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == hit["last_modified"], F.lit(False)))
            .when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == hit["digest"], F.lit(False))))
    verdict = (F.when(hit.isNull(), "no_response").when(same.isNull(), "no_validator")
               .when(same, "resolved").otherwise("mismatch"))
    update = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")),
                          lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    kept = F.map_filter(F.coalesce(hit["headers"], F.create_map().cast("map<string,string>")),
                        lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return (found.withColumn("verdict", verdict)
            .select("record_id", "canonical_url", hit["record_id"].alias("response_id"), "verdict",
                    F.when(F.col("verdict") == "resolved", F.map_concat(kept, update)).alias("headers")))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from the pages table: each page as a full response, and
    a later revisit of the same URL whose validator is, by turns of the page's
    digest, its entity tag, a weak one, its date, its digest or none."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    turn = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 4), 16, 10).cast("long")
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", digest.alias("digest"), tag.alias("tag"),
                        F.concat(F.lit("day "), (F.col("page_id") / 8).cast("long").cast("string")).alias("day"),
                        turn.alias("turn"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    full = base.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("time"), F.lit(200).alias("status"),
                       F.col("tag").alias("etag"), F.col("day").alias("last_modified"), "digest",
                       F.create_map(F.lit("content-length"), "size", F.lit("content-type"), F.lit("text/html"),
                                    F.lit("cache-control"), F.lit("max-age=60"), F.lit("etag"), "tag").alias("headers"))
    kind = F.col("turn") % 5
    time = F.col("page_id") * 10 + 5 + 10 * (F.col("turn") % 4000)
    again = base.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", time.alias("time"), F.lit(304).alias("status"),
                        F.when(kind == 0, F.col("tag")).when(kind == 1, F.concat(F.lit("W/"), "tag")).alias("etag"),
                        F.when(kind == 2, F.col("day")).alias("last_modified"), F.when(kind == 3, F.col("digest")).alias("digest"),
                        F.create_map(F.lit("date"), time.cast("string"), F.lit("cache-control"), F.lit("max-age=90"),
                                     F.lit("content-length"), F.lit("0")).alias("headers"))
    return full.unionByName(again)


def flat(headers: Column) -> Column:
    """Headers as ``name=value`` in the order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


SQL = f"""WITH b AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
    'day ' || CAST(page_id // 8 AS VARCHAR) AS day, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4) AS BIGINT) AS turn,
    CAST(length(coalesce(html, '')) AS VARCHAR) AS size, regexp_replace(url, '#.*$', '') AS bare FROM pages),
c AS (SELECT *, lower(regexp_extract(bare, '{_SCHEME}([^/?]*)', 1)) AS host, regexp_replace(bare, '{_SCHEME}[^/?]*', '') AS rest FROM b),
u AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^?]*', 0), '/+$', '') AS path,
    regexp_replace(regexp_replace(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '{_TRACKING}', '', 'g'), '^&+', '') AS query FROM c),
k AS (SELECT *, CASE WHEN regexp_matches(url, '{_SCHEME}') THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END
    ELSE url END AS canonical_url, page_id * 10 + 5 + 10 * (turn % 4000) AS asked FROM u),
a AS (SELECT canonical_url, page_id * 10 AS time, page_id * 2 AS record_id, 200 AS status, tag, day, digest, size, turn, asked FROM k
  UNION ALL SELECT canonical_url, asked, page_id * 2 + 1, 304, tag, day, digest, size, turn, asked FROM k),
w AS (SELECT *, last_value(CASE WHEN status = 200 AND canonical_url IS NOT NULL THEN {{'id': record_id, 'tag': tag, 'day': day, 'digest': digest, 'size': size}} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY time, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM a),
v AS (SELECT *, CASE WHEN hit IS NULL THEN 'no_response' WHEN turn % 5 = 4 THEN 'no_validator'
    WHEN CASE WHEN turn % 5 < 2 THEN tag = hit.tag WHEN turn % 5 = 2 THEN day = hit.day ELSE digest = hit.digest END THEN 'resolved'
    ELSE 'mismatch' END AS verdict FROM w WHERE status = 304)
SELECT record_id, canonical_url, hit.id AS response_id, verdict, CASE WHEN verdict = 'resolved' THEN
  'cache-control=max-age=90;content-length=' || hit.size || ';content-type=text/html;date=' || CAST(asked AS VARCHAR) || ';etag=' || hit.tag END AS headers
FROM v"""
