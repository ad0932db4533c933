"""WARC revisits: a not-modified record resolves to the latest earlier full response.

Records: record_id, kind (``response`` or ``revisit``), url, ts (seconds), etag,
last_modified, headers (map, lower-case names), digest (of the payload).

1. Urls are made canonical (scheme, case of the host, ``www.`` and ``m.``, fragment, tracking
   parameters, trailing ``/`` and ``.html``).
2. As-of join on small rows only.  Responses shrink to the greatest record per (url, ts).
   Time is cut into ``SLICES`` ranges at quantiles; a window within (url, slice) finds the
   latest earlier response of the same slice, and a second one over at most ``SLICES`` rows a
   url carries the last response of earlier slices.  So a url with a third of all records is
   spread over the slices, and payloads never move.
3. The response's validators must agree with the revisit's: a strong or weak ``ETag`` by weak
   comparison if the revisit has one, else ``Last-Modified``.
4. Headers: the response's, updated by the revisit's, except those that a 304 must not change
   (``KEPT``: they describe the stored payload or one connection).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import table
from cohortlens.llm.urlfilter import LOWER, UPPER

SLICES = 64
# Header fields of a 304 response that do not update a stored response.
KEPT = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
        "proxy-authenticate", "proxy-authorization", "proxy-connection", "set-cookie", "te", "trailer",
        "transfer-encoding", "upgrade"]
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def canonical(url: Column) -> Column:
    """Canonical form of a url; null if it is null or has no ``://``."""
    host = F.regexp_replace(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), r"(\.html|/)$", "")
    query = F.array_join(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"),
                                  lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def latest_earlier(revisits: DataFrame, responses: DataFrame, slices: int = SLICES) -> DataFrame:
    """Revisits (curl, ts, ...) with ``found``: the record of the latest response before ts.

    ``responses``: curl, ts, record (a struct that starts with its id; of several at one
    second the greatest counts).  Strictly earlier: a response of the same second is not.
    Revisits without url or time find nothing.
    """
    cols = [c for c in revisits.columns]
    one = responses.where("curl is not null and ts is not null").groupBy("curl", "ts").agg(F.max("record").alias("record"))
    asked = revisits.where("curl is not null and ts is not null").select("curl", "ts").distinct()
    empty = F.lit(None).cast(responses.schema["record"].dataType)
    points = (one.unionByName(asked.select("curl", "ts", empty.alias("record")))
              .groupBy("curl", "ts").agg(F.max("record").alias("record")))
    cuts = asked.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)] or [0.5], 10_000)).first()[0]
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts or []))]).cast("array<bigint>")
    points = points.withColumn("slice", F.size(F.filter(bounds, lambda b: b <= F.col("ts"))))
    last = points.where("record is not null").groupBy("curl", "slice").agg(
        F.max(F.struct("ts", "record")).alias("last"))
    filled = points.select("curl", "slice").distinct().join(last, ["curl", "slice"], "left")
    earlier = Window.partitionBy("curl").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = filled.select("curl", "slice", F.last("last.record", True).over(earlier).alias("carried"))
    inside = Window.partitionBy("curl", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    known = (points.withColumn("inside", F.last("record", True).over(inside)).join(carried, ["curl", "slice"])
             .select(F.col("curl").alias("__curl"), F.col("ts").alias("__ts"),
                     F.coalesce("inside", "carried").alias("found")).where("found is not null"))
    return (revisits.join(known, (F.col("curl") == F.col("__curl")) & (F.col("ts") == F.col("__ts")), "left")
            .select(*cols, "found"))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, curl, ts, status, response_id, digest, headers.

    status: ``resolved``; ``mismatch`` (the latest earlier response has another validator);
    ``unproved`` (the revisit has no validator); ``orphan`` (no earlier response, no url or
    no time).  Only a resolved revisit has the response's digest and merged headers; the
    payload is the response's (join on response_id).  Null header maps are empty; header
    names that differ in case only must be lower-cased before.  Repeated revisits are each
    resolved.  Other columns are ignored; no rows give none.
    """
    named = records.withColumn("curl", canonical(F.col("url")))
    responses = named.where("kind = 'response'").select("curl", "ts", F.struct(
        "record_id", "etag", "last_modified", "digest", F.array_sort(F.map_entries(F.coalesce(
            "headers", F.create_map().cast("map<string,string>")))).alias("headers")).alias("record"))
    revisits = named.where("kind = 'revisit'").select("record_id", "curl", "ts", "etag", "last_modified", F.coalesce(
        "headers", F.create_map().cast("map<string,string>")).alias("headers"))
    got = latest_earlier(revisits, responses)
    same = F.when(F.col("etag").isNotNull(), F.coalesce(_weak(F.col("etag")) == _weak(F.col("found.etag")), F.lit(False))
                  ).when(F.col("last_modified").isNotNull(),
                         F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False)))
    status = (F.when(F.col("found").isNull(), "orphan").when(same.isNull(), "unproved")
              .when(same, "resolved").otherwise("mismatch"))
    stored = F.map_from_entries("found.headers")
    update = F.map_filter("headers", lambda k, v: ~F.lower(k).isin(KEPT))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(update, k))
    done = got.withColumn("status", status)
    only = F.col("status") == "resolved"
    return done.select("record_id", "curl", "ts", "status",
                       F.when(F.col("status") != "orphan", F.col("found.record_id")).alias("response_id"),
                       F.when(only, F.col("found.digest")).alias("digest"),
                       F.when(only, F.map_concat(kept, update)).alias("headers"))


DAY = 86_400


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl that visited every page three times.

    A first visit before the capture (a revisit with the validators of what it saw), the
    capture itself (a response), and a visit thirty days later (a revisit).  Page ids are
    minutes of the crawl's clock.  Pages that share a canonical url are captures of one
    resource, so a later visit may meet a newer capture.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    at = F.col("page_id") * 60
    visits = F.array(
        F.struct(F.lit("a").alias("visit"), F.lit("revisit").alias("kind"), (at - DAY).alias("ts")),
        F.struct(F.lit("b").alias("visit"), F.lit("response").alias("kind"), at.alias("ts")),
        F.struct(F.lit("c").alias("visit"), F.lit("revisit").alias("kind"), (at + 30 * DAY).alias("ts")))
    rows = pages.select("page_id", "url", tag.alias("etag"), F.md5("html").alias("md5"), F.length("html").alias("size"),
                        F.inline(visits))
    seen = F.col("ts").cast("string")
    response = F.create_map(
        F.lit("content-length"), F.coalesce(F.col("size"), F.lit(0)).cast("string"), F.lit("content-type"), F.lit("text/html"),
        F.lit("date"), seen, F.lit("cache-control"), F.lit("max-age=60"), F.lit("vary"), F.lit("accept"))
    revisit = F.create_map(
        F.lit("content-length"), F.lit("0"), F.lit("date"), seen, F.lit("cache-control"), F.lit("max-age=600"),
        F.lit("set-cookie"), F.concat(F.lit("v="), seen), F.lit("age"), F.lit("7"))
    weak = F.when(F.col("visit") == "c", F.concat(F.lit("W/"), F.col("etag"))).otherwise(F.col("etag"))
    return rows.select(
        F.concat(F.col("page_id").cast("string"), F.lit("-"), F.col("visit")).alias("record_id"), "kind", "url", "ts",
        weak.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.when(F.col("kind") == "response", response).otherwise(revisit).alias("headers"),
        F.when(F.col("kind") == "response", F.col("md5")).alias("digest"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Every revisit of the pages' crawl, headers as sorted ``name: value`` lines."""
    got = resolve(page_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")),
                                     lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return got.withColumn("headers", lines).withColumnRenamed("curl", "canonical_url")


OP3_SQL = rf"""
WITH parts AS (
  SELECT page_id, md5(html) AS md5, coalesce(length(html), 0) AS size, page_id * 60 AS clock, url,
         regexp_replace(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '^(www|m)\.', '') AS host,
         regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '(\.html|/)$', '') AS path,
         array_to_string([p for p in string_split(regexp_extract(url, '\?([^#]*)', 1), '&')
                          if p <> '' AND NOT regexp_matches(p, '{TRACKING}')], '&') AS query
  FROM pages
), named AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
           host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS curl FROM parts
), visits AS (
  SELECT page_id || '-a' AS record_id, curl, clock - {DAY} AS ts, md5 FROM named
  UNION ALL SELECT page_id || '-c', curl , clock + {30 * DAY}, md5 FROM named
), found AS (
  SELECT v.record_id, v.curl, v.ts, v.md5, n.page_id, n.clock, n.size, n.md5 AS old,
         row_number() OVER (PARTITION BY v.record_id, v.curl, v.ts, v.md5
                            ORDER BY n.clock DESC NULLS LAST, n.page_id || '-b' DESC) AS place
  FROM visits v LEFT JOIN named n ON v.curl = n.curl AND n.clock < v.ts
), judged AS (
  SELECT *, CASE WHEN page_id IS NULL THEN 'orphan' WHEN md5 IS NULL THEN 'unproved'
                 WHEN substr(md5, 1, 12) = substr(old, 1, 12) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM found WHERE place = 1
)
SELECT record_id, curl AS canonical_url, CAST(ts AS BIGINT) AS ts, status, page_id || '-b' AS response_id,
       CASE WHEN status = 'resolved' THEN old END AS digest,
       CASE WHEN status = 'resolved' THEN 'age: 7' || chr(10) || 'cache-control: max-age=600' || chr(10)
            || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
            || 'date: ' || ts || chr(10) || 'vary: accept' END AS headers
FROM judged
"""
