"""Resolution of not-modified revisit records to the latest earlier full response of the same URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified response must not change in the stored one, in lower case.
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "etag")
#: Parts of the time that records of one URL are dealt out by.
SLICES = 256


def canonical_url(url: Column) -> Column:
    """One spelling for a URL: host in lower case without ``www.`` or ``m.``, no scheme, default port,
    fragment, tracking parameters, index page or final slash."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref|sessionid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    rest = F.regexp_replace(rest, r"/index\.html?$", "/")
    return F.concat(host, F.regexp_replace(rest, r"/$", ""))


def strong(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def latest_before(records: DataFrame, full: Column, payload: Column, span: tuple[int, int] | None = None) -> DataFrame:
    """Add ``found``: the payload of the latest row with ``full`` before each row of the same ``url``.

    Rows come in the order (ts, record_id). One URL may hold any share of the rows: its rows are
    dealt out by slices of time; within a slice a window looks back, and what the slices before it
    ended with, one row per URL and slice, is carried in.
    """
    if span is None:
        span = records.agg(F.min("ts"), F.max("ts")).first()
    low, high = (span[0] or 0), (span[1] or 0)
    width = max(1, (high - low) // SLICES + 1)
    sliced = records.withColumn("__slice", F.floor((F.col("ts") - low) / width))
    inside = Window.partitionBy("url", "__slice").orderBy("ts", "record_id")
    kept = F.when(full, payload)
    near = F.last(kept, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    order = F.struct("ts", "record_id")
    ends = sliced.where(full).groupBy("url", "__slice").agg(F.max_by(payload, order).alias("__end"))
    steps = sliced.select("url", "__slice").distinct().join(ends, ["url", "__slice"], "left")
    back = Window.partitionBy("url").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select(F.col("url").alias("__u"), F.col("__slice").alias("__s"), F.last("__end", ignorenulls=True).over(back).alias("__carried"))
    joined = sliced.withColumn("__near", near).join(carried, (F.col("url") == F.col("__u")) & (F.col("__slice") == F.col("__s")), "left")
    return joined.withColumn("found", F.coalesce("__near", "__carried")).drop("__slice", "__near", "__u", "__s", "__carried")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit record of ``records``: record_id, url (canonical), status, refers_to, headers, digest.

    ``records`` has record_id, url, ts (long), type (``response`` or ``revisit``), http_status, headers
    (map, names in lower case), digest. A full response is a ``response`` of HTTP status 200. status is

    * ``resolved``: the validators agree: the ETag (weak marks ignored) if both have one, else
      Last-Modified if both have one, else the payload digest;
    * ``validator_mismatch``: the first validator that both have differs;
    * ``no_validator``: they have none in common;
    * ``no_earlier_response``: no full response of the URL comes before, by (ts, record_id).

    Where resolved, headers is the stored response's with every field of the revisit's that a
    not-modified response may update (all but KEPT_HEADERS) put in its place, and digest is the stored
    one; otherwise headers are the revisit's own and refers_to is the response looked at, if any.
    Null headers are empty. A null url or ts has no earlier response. Records of equal time follow
    record_id. Repeated rows are resolved each. Empty tables give empty results.
    """
    tidy = records.select("record_id", canonical_url(F.col("url")).alias("url"), "ts", "type", "http_status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest")
    full = F.coalesce((F.col("type") == "response") & (F.col("http_status") == 200), F.lit(False))
    usable = F.col("url").isNotNull() & F.col("ts").isNotNull()
    seen = latest_before(tidy.where(usable), full, F.struct("record_id", "headers", "digest"))
    lost = tidy.where(~usable | usable.isNull())
    asked = seen.where("type = 'revisit'").unionByName(lost.where("type = 'revisit'"), allowMissingColumns=True)

    def both(a: Column, b: Column) -> Column:
        return a.isNotNull() & b.isNotNull()

    mine, theirs = F.col("headers"), F.col("found.headers")
    tag, their_tag = strong(mine["etag"]), strong(theirs["etag"])
    time, their_time = mine["last-modified"], theirs["last-modified"]
    same = (
        F.when(both(tag, their_tag), tag == their_tag)
        .when(both(time, their_time), time == their_time)
        .when(both(F.col("digest"), F.col("found.digest")), F.col("digest") == F.col("found.digest"))
    )
    status = F.when(F.col("found").isNull(), "no_earlier_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    updates = F.map_filter(mine, lambda k, _: ~k.isin(*KEPT_HEADERS))
    stays = F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(updates), k))
    merged = F.when(F.col("status") == "resolved", F.map_concat(stays, updates)).otherwise(mine)
    return asked.withColumn("status", status).select(
        "record_id", "url", "status", F.col("found.record_id").alias("refers_to"), merged.alias("headers"), F.when(F.col("status") == "resolved", F.col("found.digest")).otherwise(F.col("digest")).alias("digest")
    )


def captures(pages: DataFrame) -> DataFrame:
    """Two capture records for each page, as a recrawl would leave them.

    The page itself is a full response (record_id 2 * page_id) at second 10 * page_id; 100,000
    seconds later its URL was asked for again with the validators of the capture, and the server
    said "not modified" (record_id 2 * page_id + 1). Pages of even number have an ETag; the others
    only a Last-Modified time.
    """
    digest = F.sha1(F.encode("html", "UTF-8"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    stamp = F.concat(F.lit("t"), F.col("page_id").cast("string"))
    even = F.col("page_id") % 2 == 0
    validators = F.when(even, F.create_map(F.lit("etag"), tag)).otherwise(F.create_map(F.lit("last-modified"), stamp))
    weak = F.when(even, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))).otherwise(F.create_map(F.lit("last-modified"), stamp))
    length = F.create_map(F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60"))
    later = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), F.concat(F.lit("d"), F.col("page_id").cast("string")))
    record = F.explode(
        F.array(
            F.struct((F.col("page_id") * 2).alias("record_id"), (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("type"), F.lit(200).alias("http_status"), F.map_concat(length, validators).alias("headers"), digest.alias("digest")),
            F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") * 10 + 100_000).alias("ts"), F.lit("revisit").alias("type"), F.lit(304).alias("http_status"), F.map_concat(later, weak).alias("headers"), F.lit(None).cast("string").alias("digest")),
        )
    ).alias("r")
    return pages.select("url", record).select("r.record_id", "url", "r.ts", "r.type", "r.http_status", "r.headers", "r.digest")


#: The same over the pages, for the columns of op2_revisit.
ORACLE = r"""
WITH u AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), h AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref|sessionid)=[^&]*', '\1', 'g') AS rest FROM u
), c AS (
  SELECT page_id, html, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/index\.html?$', '/'), '/$', '') AS url,
         sha1(html) AS digest FROM h
), r AS (
  SELECT a.page_id, a.url, a.digest, b.page_id AS page_b, b.digest AS digest_b, octet_length(encode(b.html)) AS length_b,
         row_number() OVER (PARTITION BY a.page_id ORDER BY b.page_id DESC) AS n
  FROM c a JOIN c b ON a.url = b.url AND b.page_id * 10 <= a.page_id * 10 + 100000
), s AS (
  SELECT *, CASE WHEN page_id % 2 = 0 AND page_b % 2 = 0 THEN CASE WHEN left(digest, 16) = left(digest_b, 16) THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN page_id % 2 = 1 AND page_b % 2 = 1 THEN CASE WHEN page_id = page_b THEN 'resolved' ELSE 'validator_mismatch' END
                 ELSE 'no_validator' END AS status FROM r WHERE n = 1
)
SELECT page_id * 2 + 1 AS record_id, url, status, page_b * 2 AS refers_to,
       CASE WHEN status = 'resolved' THEN digest_b END AS digest,
       CASE WHEN status = 'resolved' THEN CAST(length_b AS VARCHAR) ELSE '0' END AS content_length,
       'max-age=600' AS cache_control,
       CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type,
       CASE WHEN page_id % 2 = 0 THEN CASE WHEN status = 'resolved' THEN '"' || left(digest_b, 16) || '"' ELSE 'W/"' || left(digest, 16) || '"' END END AS etag
FROM s
"""
