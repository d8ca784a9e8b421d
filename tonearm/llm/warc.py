"""Resolution of WARC revisit records.

A revisit record (an answer "not modified") has no body of its own. It is
resolved by an as-of join: the latest earlier full response with the same
canonical URL. The two must agree on the validators that both have (entity
tag, last-modified time, payload digest) and share at least one; then the
revisit takes the body, and the response's headers updated by those of the
revisit that may be merged.

A URL may hold a third of all records, so nothing is gathered per URL: records
are dealt by (URL, time range); each range keeps its last full response, a
running maximum over those ranges of a URL that have records carries it
forward, and a window inside the range does the rest.

Defined cases: null URLs and null times resolve to nothing (``no_response``);
a response at the very time of the revisit counts if its record_id is
smaller; repeated rows resolve alike; a full response resolves to itself; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import parallelism

#: Response headers that a revisit may replace (RFC 9111, 3.2, leaves out those of the stored body).
MERGEABLE = ("age", "cache-control", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that don't name another resource.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.`` dropped, host in lower case, default port, fragment and tracking parameters gone, the rest sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def resolve(spark: SparkSession, records: DataFrame) -> DataFrame:
    """``records``: record_id, url, ts, full (boolean), etag, last_modified, digest, headers map<string,string>.

    Returns record_id, url_key, full, status (full, resolved, validator_mismatch,
    no_validator, no_response), source_id (whose body it has) and headers.
    """
    r = records.select("record_id", canonical_url(F.col("url").cast("string")).alias("url_key"), F.col("ts").cast("long").alias("ts"), F.coalesce("full", F.lit(False)).alias("full"), "etag", "last_modified", "digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    many = parallelism(spark)
    cuts = r.agg(F.percentile_approx("ts", [i / many for i in range(1, many)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    r = r.withColumn("part", F.size(F.filter(bounds, lambda b: b <= F.col("ts"))))
    # no header maps in the as-of part: they are fetched for the found responses only
    mine = F.when(F.col("full") & F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "digest"))
    r = r.withColumn("own", mine)
    # one row for each (URL, range) that occurs: what ranges before it leave to it
    heads = r.where("url_key is not null and ts is not null").groupBy(F.col("url_key").alias("k"), F.col("part").alias("p")).agg(F.max("own").alias("last"))
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select("k", "p", F.max("last").over(before).alias("carry")).where("carry is not null")
    inside = F.max("own").over(Window.partitionBy("url_key", "part").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("near", inside).join(carried, (F.col("url_key") == F.col("k")) & (F.col("part") == F.col("p")), "left")
    r = r.withColumn("src", F.when(F.col("url_key").isNotNull() & F.col("ts").isNotNull() & ~F.col("full"), F.coalesce("near", "carry"))).drop("near", "carry", "k", "p", "own", "part")
    both = [F.col(c).isNotNull() & F.col(f"src.{c}").isNotNull() for c in ("etag", "last_modified", "digest")]
    differ = [b & (F.col(c) != F.col(f"src.{c}")) for b, c in zip(both, ("etag", "last_modified", "digest"), strict=True)]
    status = (
        F.when(F.col("full"), "full").when(F.col("src").isNull(), "no_response").when(~(both[0] | both[1] | both[2]), "no_validator")
        .when(differ[0] | differ[1] | differ[2], "validator_mismatch").otherwise("resolved")
    )
    r = r.withColumn("status", status).withColumn("source_id", F.when(F.col("full"), F.col("record_id")).when(F.col("status") == "resolved", F.col("src.record_id")))
    bodies = r.where("full").groupBy(F.col("record_id").alias("b")).agg(F.first("headers").alias("stored"))
    done, open_ = r.where("status <> 'resolved'"), r.where("status = 'resolved'").join(bodies, F.col("source_id") == F.col("b"))
    allowed = F.map_filter("headers", lambda k, _: F.lower(k).isin(*MERGEABLE))
    rest = F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    cols = ["record_id", "url_key", "full", "status", "source_id"]
    return done.select(*cols, "headers").unionByName(open_.select(*cols, F.map_concat(rest, allowed).alias("headers")))


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records of the ``pages`` table.

    At time 2 * page_id a page is a full response; every 40th is the start
    page of its host instead, and every fifth has no response of its own. At
    time 2 * page_id + 1 comes an answer "not modified": of every third page
    for its own URL, under another tracking parameter, else for the start page
    of its host, whose response may be far back, or missing.

    Tags are hashes of the contents; every other start page is a new version.
    Some answers have a wrong tag, none, or a last-modified time or digest.
    """
    p = F.col("page_id")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1)
    text = lambda x: F.lit(x).cast("string")
    start, own = p % 40 == 7, p % 3 == 0
    home = F.concat(F.lit("http://"), host, F.lit("/"))
    version = lambda new: F.md5(F.concat(F.when(new, "v2 ").otherwise("v1 "), host))
    full = pages.where((p % 5 != 3) | start).select(
        (2 * p).alias("record_id"), F.when(start, home).otherwise(F.col("url")).alias("url"), (2 * p).alias("ts"), F.lit(True).alias("full"),
        F.when(start, version(p % 80 == 7)).otherwise(F.md5(html)).alias("etag"), F.when(start, "day 1").otherwise(F.concat(F.lit("day "), p.cast("string"))).alias("last_modified"),
        F.when((p % 4 == 0) & ~start, F.md5(F.reverse(html))).alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.concat(F.lit("day "), p.cast("string"))).alias("headers"),
    )
    later = F.concat("url", F.when(F.instr("url", "#") > 0, "").when(F.instr("url", "?") > 0, "&utm_medium=again").otherwise("?utm_medium=again"))
    again = pages.select(
        (2 * p + 1).alias("record_id"), F.when(own, later).otherwise(home).alias("url"), (2 * p + 1).alias("ts"), F.lit(False).alias("full"),
        F.when(p % 11 == 0, text(None)).when(p % 7 == 0, "x").when(own, F.md5(html)).otherwise(version(F.lit(False))).alias("etag"),
        F.when(p % 2 == 0, F.when(own, F.concat(F.lit("day "), p.cast("string"))).otherwise("day 1")).alias("last_modified"),
        F.when(own, F.md5(F.reverse(html))).alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("none"), F.lit("date"), F.lit("again")).alias("headers"),
    )
    return full.unionByName(again)


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(spark, page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select("record_id", "url_key", "full", "status", "source_id", F.try_element_at("headers", F.lit("content-type")).alias("content_type"), F.try_element_at("headers", F.lit("date")).alias("date"))


OP4_SQL = r"""
WITH src_pages AS (
  SELECT page_id AS p, url, coalesce(html, '') AS html, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host, page_id % 40 = 7 AS start, page_id % 3 = 0 AS own FROM pages
), recs AS (
  SELECT 2 * p AS record_id, CASE WHEN start THEN 'http://' || host || '/' ELSE url END AS url, 2 * p AS ts, true AS "full",
    CASE WHEN start THEN md5(CASE WHEN p % 80 = 7 THEN 'v2 ' ELSE 'v1 ' END || host) ELSE md5(html) END AS etag, CASE WHEN start THEN 'day 1' ELSE 'day ' || p END AS lm,
    CASE WHEN p % 4 = 0 AND NOT start THEN md5(reverse(html)) END AS dg, 'text/html' AS ct, 'day ' || p AS dt FROM src_pages WHERE p % 5 <> 3 OR start
  UNION ALL
  SELECT 2 * p + 1, CASE WHEN own THEN url || CASE WHEN instr(url, '#') > 0 THEN '' WHEN instr(url, '?') > 0 THEN '&utm_medium=again' ELSE '?utm_medium=again' END ELSE 'http://' || host || '/' END, 2 * p + 1, false,
    CASE WHEN p % 11 = 0 THEN NULL WHEN p % 7 = 0 THEN 'x' WHEN own THEN md5(html) ELSE md5('v1 ' || host) END, CASE WHEN p % 2 = 0 THEN CASE WHEN own THEN 'day ' || p ELSE 'day 1' END END,
    CASE WHEN own THEN md5(reverse(html)) END, 'none', 'again' FROM src_pages
), bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM recs
), keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
    list_sort(list_filter(string_split(regexp_extract(b, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM bare
), k AS (
  SELECT record_id, ts, "full", etag, lm, dg, ct, dt, hp || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM keyed
), a AS (
  SELECT k.*, max(CASE WHEN "full" AND url_key IS NOT NULL THEN record_id END) OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM k
), m AS (
  SELECT a.*, f.ct AS src_ct, a.etag = f.etag AS e1, a.lm = f.lm AS e2, a.dg = f.dg AS e3 FROM a LEFT JOIN k f ON f.record_id = a.src
), s AS (
  SELECT *, CASE WHEN "full" THEN 'full' WHEN src IS NULL THEN 'no_response' WHEN coalesce(e1, e2, e3) IS NULL THEN 'no_validator'
    WHEN NOT coalesce(e1, true) OR NOT coalesce(e2, true) OR NOT coalesce(e3, true) THEN 'validator_mismatch' ELSE 'resolved' END AS status FROM m
)
SELECT record_id, url_key, "full", status, CASE WHEN "full" THEN record_id WHEN status = 'resolved' THEN src END AS source_id,
  CASE WHEN status = 'resolved' THEN src_ct ELSE ct END AS content_type, dt AS date FROM s
"""
