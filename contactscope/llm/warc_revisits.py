"""Not-modified revisits of a web archive, resolved to the capture they stand for.

A revisit record holds the headers of a 304 answer and no body. It stands for the latest full response
of the same canonical URL that was captured earlier. The validators must agree: entity tags by weak
comparison, and the modification times where both sides have one. The headers of the revisit replace
those of the response where a 304 may change them; framing, coding and hop-by-hop headers stay.

The as-of join: responses and revisits are range-partitioned by (URL, time), so that a URL with a third
of all captures is many partitions. The last response of each (URL, partition) is carried on to later
partitions by a window over these few rows, and a window within each partition does the rest.

Defined results (``status``): ``resolved``; ``no_response``, without an earlier response, without a URL or
a time; ``no_validator``, where no validator is on both sides; ``mismatch``, where one differs. Only a
resolved revisit refers to a response and has headers. Of responses at one time the largest record_id
counts as the latest, a missing one as the smallest, and of equal ones the largest hash of the headers,
then the largest digest; an id need not be unique. A response at the revisit's own time is not earlier. Repeated rows are resolved
each; header names are compared in lower case, null headers are none; extra columns are passed by. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactscope.llm.common import stored

# Headers that a 304 answer must not change in a stored response.
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-location", "content-range",
    "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade",
]
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, port 80 or 443 and user, path without a closing slash, and the sorted
    query without tracking parameters; scheme and fragment are dropped. Null without a host."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(host, r"^.*@", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    pairs = F.array_join(F.array_sort(pairs), "&")
    return F.when(host != "", F.concat(host, path, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise("")))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ only in case the last one counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(
        low, lambda e, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda later: later["key"] == e["key"])
    )
    return F.map_from_entries(last)


def _tag(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def merged_headers(stored_headers: Column, fresh: Column) -> Column:
    """The headers of the response with those of the 304 answer that it may change."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(KEPT_HEADERS))
    old = F.map_filter(stored_headers, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(old, allowed)


def resolve(records: DataFrame) -> DataFrame:
    """Resolve the revisits among ``records``: record_id, kind (response or revisit), url, ts, headers
    (a map) and payload_digest. One row per revisit: record_id, url_key, ts, status, refers_to,
    headers, payload_digest."""
    headers = _lower_keys(F.col("headers"))
    rows = records.select(
        F.col("record_id").cast("bigint").alias("record_id"),
        (F.col("kind") == "response").alias("full"),
        canonical_url(F.col("url").cast("string")).alias("url_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        headers.alias("headers"),
        F.col("payload_digest").cast("string").alias("payload_digest"),
    )
    rows = rows.where("full is not null").withColumn("x", F.xxhash64(F.map_entries("headers")))
    rows = stored(rows, "warc-records")
    placed = rows.where("url_key is not null and ts is not null").select(
        "url_key", "ts", "full", "record_id", "x", F.struct("ts", "record_id", "x").alias("self")
    )
    order = ["ts", "full", "record_id", "x"]  # at one time a revisit comes before a response
    placed = placed.repartitionByRange("url_key", *order).withColumn("part", F.spark_partition_id())
    placed = stored(placed, "warc-placed")
    response = F.when(F.col("full"), F.col("self"))
    last = F.last(response, ignorenulls=True)
    ends = placed.where("full").groupBy("url_key", "part").agg(F.max("self").alias("last"))
    parts = placed.select("url_key", "part").distinct().join(ends, ["url_key", "part"], "left")
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        "url_key", "part", F.last("last", ignorenulls=True).over(earlier).alias("carried")
    )
    within = Window.partitionBy("url_key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.withColumn("here", last.over(within)).where("not full").join(carried, ["url_key", "part"])
    revisit = ["url_key", "record_id", "x", "ts"]
    met = met.groupBy(*revisit).agg(F.max(F.coalesce("here", "carried")).alias("response"))

    def same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
        found = F.lit(True)
        for a, b in names.items():
            found = found & left[a].eqNullSafe(right[b])
        return found

    revisits = rows.where("not full")
    found = revisits.join(met, same(revisits, met, {c: c for c in revisit}), "left").select(
        *[revisits[c] for c in ("record_id", "url_key", "ts", "headers")],
        F.col("response.ts").alias("response_ts"),
        F.col("response.record_id").alias("response_id"),
        F.col("response.x").alias("response_x"),
    )
    responses = rows.where("full and url_key is not null and ts is not null").groupBy(*revisit).agg(
        F.max_by(F.struct("headers", "payload_digest"), F.struct("payload_digest")).alias("r")
    )
    responses = responses.toDF("of_url", "of_id", "of_x", "of_ts", "r")
    names = {"url_key": "of_url", "response_ts": "of_ts", "response_id": "of_id", "response_x": "of_x"}
    found = found.join(responses, same(found, responses, names), "left")
    own, old = F.col("headers"), F.col("r.headers")
    tags = _tag(own["etag"]), _tag(old["etag"])
    times = F.trim(own["last-modified"]), F.trim(old["last-modified"])
    both = [a.isNotNull() & b.isNotNull() for a, b in (tags, times)]
    differ = (both[0] & (tags[0] != tags[1])) | (both[1] & (times[0] != times[1]))
    status = (
        F.when(F.col("r").isNull(), "no_response")
        .when(~both[0] & ~both[1], "no_validator")
        .when(differ, "mismatch")
        .otherwise("resolved")
    )
    found = found.withColumn("status", status)
    good = F.col("status") == "resolved"
    return found.select(
        "record_id",
        "url_key",
        "ts",
        "status",
        F.when(good, F.col("response_id")).alias("refers_to"),
        F.when(good, merged_headers(old, own)).alias("headers"),
        F.when(good, F.col("r.payload_digest")).alias("payload_digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """An archive's records derived from a table of pages: page p is response 4p, and later checks of
    it that found it unchanged are revisits 4p + 1 to 4p + 3.

    The second check carries a weak form of the tag, that of every fifth page a changed one; the
    third carries only the modification time, that of every seventh page nothing.
    """
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(5_000_000)))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    changed = F.date_format(at - F.expr("interval 1 day"), "yyyy-MM-dd HH:mm:ss")
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")

    def entry(k: int, kind: str, hours: int, headers: dict[str, Column]) -> Column:
        return F.struct(
            (F.col("page_id") * 4 + k).cast("bigint").alias("record_id"),
            F.lit(kind).alias("kind"),
            (at + F.expr(f"interval {hours} hours")).alias("ts"),
            F.map_filter(
                F.create_map(*[x for name, value in headers.items() for x in (F.lit(name), value)]),
                lambda _, v: v.isNotNull(),
            ).alias("headers"),
        )

    weak = F.when(F.col("page_id") % 5 == 0, F.lit('W/"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    full = entry(0, "response", 0, {"Content-Type": F.lit("text/html"), "Content-Length": size, "ETag": tag, "Last-Modified": changed, "Cache-Control": F.lit("max-age=60")})
    one = entry(1, "revisit", 24, {"ETag": tag, "Cache-Control": F.lit("max-age=600"), "Content-Length": F.lit("0"), "Connection": F.lit("close")})
    two = entry(2, "revisit", 72, {"etag": weak, "Age": F.col("page_id").cast("string"), "Transfer-Encoding": F.lit("chunked")})
    three = entry(3, "revisit", -48, {"Last-Modified": F.when(F.col("page_id") % 7 != 0, changed), "Vary": F.lit("Accept")})
    return pages.select(
        F.col("url"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"),
        F.explode(F.array(full, one, two, three)).alias("r"),
    ).select("r.*", "url", F.when(F.col("r.kind") == "response", F.col("digest")).alias("payload_digest"))
