"""Resolution of not-modified revisits in crawl records.

A revisit record says that a server answered 304: what it stands for is the latest earlier full response of the same
canonical URL. That is an as-of join. It runs without gathering a URL's whole history in one task: time is cut at
quantiles into spans, the last full response of each (URL, span) is a partial aggregate, the last one before each span
follows from these few rows, and only the records within a span are put in order. Payloads take no part in it; the
responses that revisits point at are joined by their ids at the end.

A match must be borne out by the validators: an entity tag (compared weakly), else the date of last modification. The
stored response's headers are then updated from those of the 304 that may change it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import heavy_limit, table, written

#: Header fields of a 304 that replace those of the stored response (RFC 9110, section 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

RECORD = ("record_id", "url", "ts", "is_full", "headers", "payload")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a slash at its end, parameters in order
    without ``utm_`` ones; neither scheme nor fragment. Null for null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, "[?].*$", ""), "/+$", "")
    query = F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, "^[^?]*[?]", "")).otherwise("")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(F.lower(p), F.lit("utm_"))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, by its name in lower case; null if there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers, but for those that a permitted header of the 304 replaces, then these."""
    allowed = F.filter(fresh, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"]))), allowed)


def resolve_revisits(records: DataFrame, spans: int = 64) -> DataFrame:
    """``records``: record_id long, url string, ts long, is_full boolean, headers array<struct<name,value>>, payload
    binary or string. Returns these with url_key, status and source_id; a resolved revisit has its source's payload
    and merged headers.

    status: ``full``, ``resolved``, ``no_earlier_response``, ``validator_mismatch`` (the tags differ, or without two
    tags the dates do) or ``no_validator`` (the two share no kind of validator). Records are in order of (ts,
    record_id). Only resolved revisits and full responses have a source_id and, by it, a payload.

    Defined results: a null or missing is_full is a revisit; a record whose url, ts or record_id is null is nobody's
    source, and a revisit without url or ts has no earlier response; null headers are no headers; of several full
    responses with one URL, time and id the source, of validators, headers and payload alike, is that of the greatest
    hash of these; equal rows stay separate; an empty table gives no row; columns other than the six are not read.

    A URL's records are cut into spans of time, and the revisits of a source that many ask for are dealt to several
    tasks; records of one URL and one moment are in one.
    """
    rows = records.select(*RECORD).withColumns({
        "is_full": F.coalesce("is_full", F.lit(False)),
        "url_key": canonical_url(F.col("url")),
        "headers": F.coalesce("headers", F.array().cast(records.schema["headers"].dataType)),
    })
    content = F.xxhash64("headers", "payload", "url")
    full, revisit = rows.where("is_full").withColumn("content", content), rows.where("not is_full").drop("payload", "is_full")
    cuts = rows.where("ts is not null").agg(F.percentile_approx("ts", [i / spans for i in range(1, spans)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    span = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    tag, changed = header(F.col("headers"), "etag"), header(F.col("headers"), "last-modified")
    sources = full.where("url_key is not null and ts is not null and record_id is not null").select(
        "url_key", "ts", "record_id", span.alias("span"), F.struct("ts", "record_id", "content", tag.alias("etag"), changed.alias("changed")).alias("source")
    )
    askers = revisit.withColumns({"span": span, "source": F.lit(None).cast(sources.schema["source"].dataType), "asks": F.lit(True)})
    timed = askers.where("url_key is not null and ts is not null")
    untimed = askers.where("url_key is null or ts is null").drop("asks", "span").withColumnRenamed("source", "found")
    events = sources.unionByName(timed, allowMissingColumns=True)
    earlier_spans = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("url_key", "span").agg(F.max("source").alias("last")).select("url_key", "span", F.max("last").over(earlier_spans).alias("carried"))
    # Of equal (ts, record_id), a response is not earlier than a revisit: revisits come first.
    within = Window.partitionBy("url_key", "span").orderBy("ts", "record_id", F.col("asks").isNull(), "source.content").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        events.withColumn("here", F.last("source", ignorenulls=True).over(within))
        .where("asks")
        .join(carried, ["url_key", "span"], "left")
        .withColumn("found", F.coalesce("here", "carried"))
        .drop("here", "carried", "source", "asks", "span")
        .unionByName(untimed)
    )
    both_tags, both_dates = tag.isNotNull() & F.col("found.etag").isNotNull(), changed.isNotNull() & F.col("found.changed").isNotNull()
    status = (
        F.when(F.col("found").isNull(), "no_earlier_response")
        .when(both_tags, F.when(weak(tag) == weak(F.col("found.etag")), "resolved").otherwise("validator_mismatch"))
        .when(both_dates, F.when(changed == F.col("found.changed"), "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )
    names = ["source_id", "source_ts", "source_content"]
    resolved = F.col("status") == "resolved"
    found = found.withColumn("status", status).withColumns({n: F.when(resolved, F.col(f"found.{c}")) for n, c in zip(names, ("record_id", "ts", "content"))})
    found = written(found.drop("found"), "revisits")
    asked = found.where(resolved).groupBy(*names).agg(F.count("*").alias("asked"))
    # A source that more than ``limit`` revisits ask for, of which there are at most 1,000, is dealt to several tasks.
    limit = heavy_limit(found.count())
    heavy = F.broadcast(asked.where(F.col("asked") > limit).select(*names, F.ceil(F.col("asked") / limit).cast("int").alias("cuts")))
    stored = full.where("record_id is not null and ts is not null").select(
        F.col("record_id").alias("source_id"), F.col("ts").alias("source_ts"), F.col("content").alias("source_content"), F.col("headers").alias("stored"), "payload"
    )
    # One key all the way, so that payloads are shuffled once.
    light = stored.join(asked.where(F.col("asked") <= limit).select(*names), names, "left_semi").dropDuplicates(names)
    out = found.where(resolved).join(heavy.select(*names), names, "left_anti").join(light, names)
    dealt = found.join(heavy, names).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.col("cuts")).cast("int")).drop("cuts")
    copies = stored.join(heavy, names).dropDuplicates(names).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    out = out.unionByName(dealt.join(copies, [*names, "salt"]).drop("salt"))
    # What is not resolved has no key to join by; as nulls it would all be one task's.
    out = out.unionByName(found.where(~resolved), allowMissingColumns=True)
    out = out.withColumn("headers", F.when(F.col("stored").isNotNull(), merged(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")))
    columns = ["record_id", "url", "url_key", "ts", "is_full", "status", "source_id", "headers", "payload"]
    whole = full.withColumns({"status": F.lit("full"), "source_id": F.col("record_id")})
    return whole.select(*columns).unionByName(out.withColumn("is_full", F.lit(False)).select(*columns))


FIRST, LATER = 1_704_067_200, 34_560_000  # the first crawl's start and the time to the second, in seconds


def crawl(pages: DataFrame) -> DataFrame:
    """Two crawls of ``pages``: full responses, then a 304 for each page by another spelling of its URL. Every fifth
    304 has a tag that differs, every seventh has only a date; the rest repeat the tag, every third as a weak one."""
    one = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"'))
    changed = F.concat(F.lit("day "), (page % 28).cast("string"))
    first = pages.select(
        (page * 2).alias("record_id"), "url", (page * 60 + FIRST).alias("ts"), F.lit(True).alias("is_full"),
        F.array(
            one("ETag", tag), one("Last-Modified", changed), one("Content-Type", F.lit("text/html; charset=utf-8")),
            one("Content-Length", F.octet_length(html).cast("string")), one("Cache-Control", F.lit("max-age=60")),
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    sent = F.when(page % 5 == 0, F.lit('"other"')).when(page % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    head = F.when(page % 7 == 0, one("last-modified", changed)).otherwise(one("etag", sent))
    again = pages.select(
        (page * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTPS://WWW."), F.lit("#again")).alias("url"),
        (page * 60 + FIRST + LATER).alias("ts"), F.lit(False).alias("is_full"),
        F.array(head, one("cache-control", F.lit("max-age=600")), one("content-length", F.lit("0")), one("x-cache", F.lit("HIT"))).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls of all pages, the second resolved against the first."""
    found = resolve_revisits(crawl(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"]))
    return found.select(
        "record_id", (F.col("record_id") / 2).cast("long").alias("page_id"), "url_key", "status", "source_id",
        F.array_join(F.array_sort(lines), "\n").alias("headers"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
    )


ORACLE_SQL = """
WITH page AS (
    SELECT page_id, url, html, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id % 28) AS changed FROM pages
), record AS (
    SELECT page_id * 2 AS record_id, page_id, url, page_id * 60 + 1704067200 AS ts, true AS is_full, tag, changed, html AS payload FROM page
    UNION ALL
    SELECT page_id * 2 + 1, page_id, regexp_replace(url, '^https?://', 'HTTPS://WWW.') || '#again', page_id * 60 + 1704067200 + 34560000, false,
        CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"other"' WHEN page_id % 3 = 0 THEN 'W/' || tag ELSE tag END,
        CASE WHEN page_id % 7 = 0 THEN changed END, NULL FROM page
), bare AS (
    SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM record
), part AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
        regexp_replace(u, '^[^/?]*', '') AS rest FROM bare
), pieces AS (
    SELECT *, regexp_replace(regexp_replace(rest, '[?].*$', ''), '/+$', '') AS path,
        list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN regexp_replace(rest, '^[^?]*[?]', '') ELSE '' END, '&'),
            lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) AS params FROM part
), keyed AS (
    SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM pieces
), located AS (
    SELECT *, last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS) OVER (
        PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM keyed
), checked AS (
    SELECT r.record_id, r.page_id, r.url_key, r.tag, r.changed, r.is_full,
        CASE WHEN r.is_full THEN 'full' WHEN s.record_id IS NULL THEN 'no_earlier_response'
            WHEN r.tag IS NOT NULL THEN CASE WHEN regexp_replace(r.tag, '^W/', '') = s.tag THEN 'resolved' ELSE 'validator_mismatch' END
            WHEN r.changed = s.changed THEN 'resolved' ELSE 'validator_mismatch' END AS status,
        CASE WHEN r.is_full THEN r.payload ELSE s.payload END AS body, s.record_id AS earlier, s.tag AS s_tag, s.changed AS s_changed
    FROM located r LEFT JOIN keyed s ON s.is_full AND r.earlier = s.record_id AND NOT r.is_full AND r.url_key IS NOT NULL
), told AS (
    SELECT *, CASE WHEN status IN ('full', 'resolved') THEN body END AS payload,
        CASE WHEN status = 'full' THEN ['etag: ' || tag, 'last-modified: ' || changed, 'content-type: text/html; charset=utf-8',
                'content-length: ' || octet_length(encode(coalesce(body, ''))), 'cache-control: max-age=60']
            WHEN status = 'resolved' THEN ['etag: ' || coalesce(tag, s_tag), 'last-modified: ' || coalesce(changed, s_changed), 'content-type: text/html; charset=utf-8',
                'content-length: ' || octet_length(encode(coalesce(body, ''))), 'cache-control: max-age=600']
            ELSE [CASE WHEN tag IS NULL THEN 'last-modified: ' || changed ELSE 'etag: ' || tag END, 'cache-control: max-age=600', 'content-length: 0', 'x-cache: HIT'] END AS lines
    FROM checked
)
SELECT record_id, page_id, url_key, status, CASE WHEN status = 'full' THEN record_id WHEN status = 'resolved' THEN earlier END AS source_id,
    array_to_string(list_sort(lines), chr(10)) AS headers, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256
FROM told
"""
