import hashlib
import re
import uuid

from contactscope.llm.digest_index import DigestIndex, drop_copies

SCHEMA = "doc_id long, text string, keep_id string, digest int"


def brute(rows):
    groups = {}
    for i, text, *_ in rows:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
        groups.setdefault(key, []).append((-len(text or ""), i is None, i or 0, i))
    out = []
    for key, found in groups.items():
        best = min(found)
        out += [(r[3], best[3], len(found), r == best, key) for r in found]
    return sorted(out, key=str)


def rows():
    data = [(5, "a b c"), (3, "abc"), (4, "a\tb  c"), (2, "a\tb\r\nc"), (9, None), (7, ""), (8, " \n"), (1, "É"), (6, "é")]
    data += [(None, "only"), (None, "o nly"), (20, "on ly"), (21, "x" * 200_000), (22, "x" * 199_999 + " x"), (30, "dup"), (30, "dup")]
    return [(i, t, "clash", 1) for i, t in data]


def test_batch_equals_brute_force(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = DigestIndex(spark, buckets=4).dedup(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())


def test_index_persists_across_batches(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    first = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "o n e"), (4, "new"), (5, "n ew")], "doc_id long, text string")
    assert all(r["kept"] for r in DigestIndex(spark, path, 4).dedup(first).collect())
    index = DigestIndex(spark, path, 4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in index.dedup(second).collect()}
    assert got == {3: (1, False, 1), 4: (5, False, 2), 5: (5, True, 2)}
    smaller = index.compact(f"file://{tmp_path}/{uuid.uuid4().hex}")
    assert sorted(r["keep_id"] for r in smaller.table().collect()) == [1, 2, 5]
    assert smaller.dedup(second).where("kept").count() == 0


def test_anti_join_reads_the_index_in_its_buckets(spark):
    index = DigestIndex(spark, buckets=8)
    index.append(spark.createDataFrame([("aa", 1)], "digest string, keep_id long"))
    new = spark.range(100).selectExpr("cast(id as string) as digest").repartition(3)
    plan = new.hint("merge").join(index.table(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_drop_copies_keeps_one_full_row_of_each_text(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    want = {k for _, k, *_ in brute(rows())}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert kept.count() == len({r[4] for r in brute(rows())})
    assert kept.where("doc_id = 2").first()["text"] == "a\tb\r\nc"


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert DigestIndex(spark).dedup(docs).count() == 0
    assert drop_copies(docs).count() == 0
