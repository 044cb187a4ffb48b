"""The named queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactscope.llm import toxicity as toxic
from contactscope.llm.common import table
from contactscope.llm.digest_index import DigestIndex
from contactscope.llm.embedding_dedup import near_duplicates
from contactscope.llm.impact_search import search
from contactscope.llm.kneser_ney import language_scores
from contactscope.llm.lemp_negatives import hard_negatives as mined_negatives
from contactscope.llm.license_scan import licence_report
from contactscope.llm.mix_sources import Mix
from contactscope.llm.ngram_join import jaccard_classes
from contactscope.llm.pack import pack, pieces
from contactscope.llm.passage_chains import passages
from contactscope.llm.token_files import count_documents, read_blocks, write_flat
from contactscope.llm.warc_revisits import captures, resolve


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles agree to 90 % or more."""
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document decided against a new digest index, which takes all of them as one batch."""
    return DigestIndex(spark).dedup(table(spark, sf_dir, "documents"))


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits derived from all pages, resolved; headers as sorted lines."""
    found = resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    text = F.array_join(F.array_sort(lines), "\n")
    return found.withColumns({"headers": text, "ts": F.col("ts").cast("timestamp_ntz")})


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between all vectors with a cosine of 0.9 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages of 30 words or more that documents share."""
    return passages(table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence signatures of every document."""
    return licence_report(table(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 1,024 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents")))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels that are not held out."""
    return toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, found again in flat files written from them."""
    return count_documents(read_blocks(spark, write_flat(table(spark, sf_dir, "documents"))))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of one and a half times all words takes of every document."""
    return Mix(table(spark, sf_dir, "documents")).taken()


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those that are not held out."""
    return language_scores(table(spark, sf_dir, "documents"))


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives; every 100th row is an anchor."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": ngram_jaccard,
    "op2_exact_dedup": exact_dedup,
    "op3_warc_revisits": warc_revisits,
    "op4_embedding_dedup": embedding_dedup,
    "op5_substring_dedup": substring_dedup,
    "op6_license_scan": license_scan,
    "op7_best_fit_packing": best_fit_packing,
    "op8_toxicity": toxicity,
    "op9_token_counts": token_counts,
    "op10_mix_sources": mix_sources,
    "op11_lm_scores": lm_scores,
    "op12_ranked_search": ranked_search,
    "op13_hard_negatives": hard_negatives,
}

#: Components of the links (x, y): everything that can be reached.
_REACHED = """
        reach AS (
          SELECT x, y FROM links UNION SELECT y, x FROM links
          UNION SELECT r.x, l.y FROM reach r JOIN (SELECT x, y FROM links UNION SELECT y, x FROM links) l
            ON r.y = l.x
        ), low AS (SELECT x, least(x, min(y)) AS component FROM reach GROUP BY x)"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
          FROM documents
        ), s AS (
          SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN []
            WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END)) AS sh
          FROM w
        ), c AS (
          SELECT doc_id, len(sh) AS n, sh, min(doc_id) OVER (PARTITION BY sh) AS class_id,
            count(*) OVER (PARTITION BY sh) AS class_size FROM s
        ), e AS (
          SELECT doc_id, n, unnest(sh) AS g FROM c WHERE doc_id = class_id
        ), links AS (
          SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), {_REACHED}
        SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE class_id END AS class_id,
          CASE WHEN n = 0 THEN 1 ELSE class_size END AS class_size,
          CASE WHEN n = 0 THEN doc_id ELSE coalesce(component, class_id) END AS component_id
        FROM c LEFT JOIN low ON class_id = x
    """,
    "op3_warc_revisits": r"""
        WITH rest AS (
          SELECT page_id, coalesce(html, '') AS html,
            make_timestamp((1700000000 + (page_id * 7919) % 5000000) * 1000000) AS t0,
            regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u
          FROM pages
        ), parts AS (
          SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)),
              '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
            regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
            array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
              lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=.*)?$'))),
              '&') AS query
          FROM rest
        ), r AS (
          SELECT page_id, t0, CASE WHEN host <> '' THEN host || path ||
              CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url_key,
            '"' || substr(md5(html), 1, 16) || '"' AS tag, sha256(html) AS digest, length(html) AS size,
            strftime(t0 - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS changed
          FROM parts
        ), v AS (
          SELECT page_id, url_key, k, t0 + to_hours(CASE k WHEN 1 THEN 24 WHEN 2 THEN 72 ELSE -48 END) AS ts,
            CASE WHEN k = 1 THEN tag WHEN k = 2 AND page_id % 5 = 0 THEN '"changed"' WHEN k = 2 THEN tag END AS tag,
            CASE WHEN k = 3 AND page_id % 7 <> 0 THEN changed END AS changed
          FROM r, (SELECT unnest([1, 2, 3]) AS k)
        ), m AS (
          SELECT v.*, r.page_id AS old_id, r.tag AS old_tag, r.changed AS old_changed, r.size, r.digest
          FROM v LEFT JOIN r ON r.url_key = v.url_key AND r.t0 < v.ts
          QUALIFY row_number() OVER (PARTITION BY v.page_id, k ORDER BY r.t0 DESC NULLS LAST, r.page_id DESC) = 1
        ), s AS (
          SELECT *, CASE WHEN old_id IS NULL THEN 'no_response'
            WHEN tag IS NULL AND changed IS NULL THEN 'no_validator'
            WHEN tag <> old_tag OR changed <> old_changed THEN 'mismatch' ELSE 'resolved' END AS status FROM m
        )
        SELECT page_id * 4 + k AS record_id, url_key, ts, status,
          CASE WHEN status = 'resolved' THEN old_id * 4 END AS refers_to,
          CASE WHEN status = 'resolved' THEN
            CASE WHEN k = 2 THEN 'age: ' || page_id || chr(10) ELSE '' END
            || 'cache-control: max-age=' || CASE k WHEN 1 THEN '600' ELSE '60' END || chr(10)
            || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
            || 'etag: ' || CASE k WHEN 1 THEN tag WHEN 2 THEN 'W/' || tag ELSE old_tag END || chr(10)
            || 'last-modified: ' || CASE WHEN k = 3 THEN changed ELSE old_changed END
            || CASE WHEN k = 3 THEN chr(10) || 'vary: Accept' ELSE '' END END AS headers,
          CASE WHEN status = 'resolved' THEN digest END AS payload_digest
        FROM s
    """,
    "op4_embedding_dedup": f"""
        WITH RECURSIVE v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
            count(*) OVER (PARTITION BY embedding) AS class_size FROM embeddings
        ), links AS (
          SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9::DOUBLE
        ), n AS (
          SELECT x, count(*) AS n FROM (SELECT x FROM links UNION ALL SELECT y FROM links) GROUP BY x
        ), {_REACHED}
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
          vec_id = coalesce(component, vec_id) AS kept, class_size
        FROM v LEFT JOIN n ON vec_id = n.x LEFT JOIN low ON vec_id = low.x
    """,
    "op2_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
          FROM documents
        ), g AS (
          SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size
          FROM d GROUP BY h
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256
        FROM d JOIN g USING (h)
    """,
    "op12_ranked_search": r"""
        WITH words AS (
          SELECT doc_id AS id, TRUE AS of_document, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
          UNION ALL
          SELECT item_id, FALSE, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark
        ), each AS (SELECT id, of_document, len(ws) AS n, unnest(ws) AS term FROM words),
        c AS (SELECT id, of_document, term, n, count(*) AS tf FROM each GROUP BY ALL),
        totals AS (SELECT count(*) AS documents, CAST(sum(len(ws)) AS BIGINT) AS occurrences
          FROM words WHERE of_document AND len(ws) > 0),
        df AS (SELECT term, count(*) AS df FROM c WHERE of_document GROUP BY term),
        s AS (
          SELECT i.id AS item_id, d.id AS doc_id, CAST(sum(i.tf
            * CAST(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) AS BIGINT)
            * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * d.n * documents) // occurrences)))) AS BIGINT) AS score
          FROM c i JOIN c d ON i.term = d.term JOIN df ON i.term = df.term, totals
          WHERE NOT i.of_document AND d.of_document GROUP BY i.id, d.id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
          doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 20
    """,
    "op13_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
            CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
          SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT p.anchor_id, positive_id,
          CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
          other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
          AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5
    """,
}
