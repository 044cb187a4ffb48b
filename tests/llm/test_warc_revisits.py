import datetime as dt
import re

from contactscope.llm.queries import QUERIES
from contactscope.llm.warc_revisits import KEPT_HEADERS, TRACKING, canonical_url, captures, resolve

SCHEMA = "record_id long, kind string, url string, ts timestamp, headers map<string,string>, payload_digest string, status int, part int"


def key(url):
    if url is None:
        return None
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.strip(" "))
    rest = re.sub(r"#.*$", "", rest)
    host, tail = re.match(r"([^/?]*)(.*)", rest, re.S).groups()
    host = re.sub(r"^www[0-9]*\.", "", re.sub(r":(80|443)$", "", re.sub(r"^.*@", "", host.lower())))
    path, _, query = tail.partition("?")
    pairs = sorted(p for p in query.split("&") if p and not re.match(TRACKING, p))
    return (host + path.rstrip("/") + ("?" + "&".join(pairs) if pairs else "")) if host else None


def brute(rows):
    full = [(key(r[2]), r[3], r[0], r) for r in rows if r[1] == "response"]
    out = []
    for r in rows:
        if r[1] != "revisit":
            continue
        own = {k.lower(): v for k, v in (r[4] or {}).items()}
        k = key(r[2])
        fits = [f for f in full if k is not None and r[3] is not None and f[0] == k and f[1] is not None and f[1] < r[3]]
        status, ref, merged, digest = "no_response", None, None, None
        if fits:
            best = max(fits, key=lambda f: f[1:3])[3]
            old = {a.lower(): v for a, v in (best[4] or {}).items()}
            pairs = [(own.get(h), old.get(h)) for h in ("etag", "last-modified")]
            pairs = [tuple(re.sub("^[Ww]/", "", v.strip(" ")) for v in p) for p in pairs if None not in p]
            status = "no_validator" if not pairs else "mismatch" if any(a != b for a, b in pairs) else "resolved"
            if status == "resolved":
                ref, digest = best[0], best[5]
                merged = old | {a: v for a, v in own.items() if a not in KEPT_HEADERS}
        out.append((r[0], k, r[3], status, ref, merged, digest))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r["record_id"], r["url_key"], r["ts"], r["status"], r["refers_to"], r["headers"], r["payload_digest"]) for r in df.collect()), key=str)


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def test_derived_captures_equal_brute_force(spark, folder):
    records = captures(spark.read.parquet(f"{folder}/pages.parquet"))
    rows = [(r["record_id"], r["kind"], r["url"], r["ts"], r["headers"], r["payload_digest"]) for r in records.collect()]
    want = brute(rows)
    assert plain(resolve(records)) == want
    assert {w[3] for w in want} == {"resolved", "no_response", "no_validator", "mismatch"} - ({"no_validator"} - {w[3] for w in want})
    got = QUERIES["op3_warc_revisits"](spark, folder)
    assert got.count() == len(want) == 3 * spark.read.parquet(f"{folder}/pages.parquet").count()


def test_odd_records(spark):
    u = "http://www.Example.org:80/a/?b=2&utm_source=x&a=1#top"
    rows = [
        (1, "response", u, at(0), {"ETag": '"x"', "Content-Type": "t", "A": "1"}, "d1"),
        (2, "response", "https://example.org/a?a=1&b=2", at(5), {"etag": 'W/"y"'}, "d2"),
        (3, "response", "example.org/a?a=1&b=2", at(5), {"etag": '"z"'}, "d3"),
        (4, "revisit", u, at(1), {"etag": 'W/"x"', "content-type": "no", "b": "2"}, None),
        (5, "revisit", u, at(6), {"ETAG": '"z"'}, None),
        (6, "revisit", u, at(5), {"etag": '"x"'}, None),
        (7, "revisit", u, at(0), {"etag": '"x"'}, None),
        (8, "revisit", u, at(7), None, None),
        (9, "revisit", None, at(7), {"etag": '"x"'}, None),
        (10, "revisit", u, None, {"etag": '"x"'}, None),
        (11, "revisit", "http:///path", at(7), {}, None),
        (12, "revisit", u, at(7), {"etag": '"other"', "last-modified": "m"}, None),
        (4, "revisit", u, at(1), {"etag": 'W/"x"', "content-type": "no", "b": "2"}, None),
        (None, "revisit", u, at(2), {"etag": '"x"'}, None),
        (20, "response", None, at(0), None, None),
        (21, "response", u, None, None, None),
        (22, "other", u, at(0), None, None),
        (23, None, u, at(0), None, None),
        (24, "response", "http://h.example/" + "p" * 100_000, at(0), {"etag": "1"}, "long"),
        (25, "revisit", "http://h.example/" + "p" * 100_000, at(1), {"etag": "1"}, None),
    ]
    got = resolve(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))
    want = [w for w in brute([r for r in rows if r[1] in ("response", "revisit")])]
    want += [w for r in rows if r[1] == "other" for w in brute([(r[0], "revisit", *r[2:])])]
    assert plain(got.where("record_id is null or record_id <> 22")) == sorted((w for w in want if w[0] != 22), key=str)


def test_one_hot_url_crosses_partitions(spark):
    rows = [(k, "response" if k % 50 == 0 else "revisit", "http://hot.example/", at(k), {"etag": str(k // 50)}, f"d{k}") for k in range(2000)]
    records = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(7)
    assert plain(resolve(records)) == brute(rows)


def test_empty_table(spark):
    assert resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_canonical_urls(spark):
    urls = ["HTTPS://user:pw@WWW2.A.example:443/x//?b&a&&gclid=1", "a.example", "a.example/?ref=1", " http://a.example/#f", "", None, "http://", "a.example?q"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(__import__("pyspark").sql.functions.col("u")).alias("k")).collect()
    assert [r["k"] for r in got] == [key(u) for u in urls]


def test_ids_that_are_missing_or_shared_by_urls(spark):
    rows = [
        (1, "response", "a.example", at(0), {"etag": "old"}, "a0"),
        (None, "response", "a.example", at(2), {"etag": "a"}, "a2"),
        (1, "response", "b.example", at(9), {"etag": "b"}, "b9"),
        (7, "revisit", "a.example", at(1), {"etag": "old"}, None),
        (7, "revisit", "a.example", at(3), {"etag": "a"}, None),
        (8, "revisit", "a.example", at(10), {"etag": "a"}, None),
        (8, "revisit", "b.example", at(10), {"etag": "a"}, None),
        (None, "revisit", "b.example", at(11), {"etag": "b"}, None),
        (None, "revisit", "c.example", at(11), {"etag": "b"}, None),
    ]
    assert plain(resolve(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))) == brute(rows)
