import zlib

from contactscope.llm.queries import QUERIES
from contactscope.llm.toxicity import Lexicon, _matcher, drop_toxic, fit, fold, toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(got) == docs.count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert len(held) > 30
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_folding():
    assert fold("You IDIOT!") == " you idiot "
    assert fold("ｉｄｉｏｔ іdіоt 1d10t i​diot") == " idiot idiot idiot ldlot idiot "
    assert fold("tr@sh $cum 2024 a.b") == " trash scum 2024 a b "
    assert fold("") == "  "


def test_exceptions_cancel_matches_inside_them():
    run = _matcher(Lexicon({" trash ": 5.0, " tras": 4.0, " moro": 4.0}, ("trash can",)))
    assert run("the trash can")[0] == 0.0
    assert run("trash can trash")[0] == 5.0
    assert run("moronic people")[0] == 4.0
    assert run("oxymoron") == (0.0, 1)
    assert run(None) == (0.0, 0) == run("")


def tables(spark):
    docs, labels = [], []
    for k in range(600):
        bad = k % 6 == 0
        text = f"plain words number {k} walk along " + ("you idiot " if bad else "you friend ") + "the river " * (k % 30)
        docs.append((k, text, "x", 1.0))
        labels.append((k, 1, int(bad)))
    docs += [(2000, None, "x", 0.0), (2001, "", "x", 0.0), (None, "an idiot", "x", 0.0), (2002, "1d10t", "x", 0.0)]
    docs += [(2003, "clean " * 30_000 + "idiot", "x", 0.0), (7, "repeated id", "x", 0.0), (7, "repeated idiot", "x", 0.0)]
    labels += [(2, None, None), (None, 1, 1), (9999, 1, 1), (3, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    docs, labels = tables(spark)
    got = toxicity(docs, labels)
    assert got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2000][0]["predicted"] == by[2001][0]["predicted"] == 0
    assert by[None][0]["predicted"] == 1 and not by[None][0]["held_out"]
    assert by[2002][0]["predicted"] == 1
    assert sorted(r["predicted"] for r in by[7]) == [0, 0, 1]
    wrong = [k for k in range(600) if k != 7 and by[k][0]["predicted"] != (k % 6 == 0)]
    assert not wrong
    kept = drop_toxic(docs, labels)
    assert kept.schema == docs.schema
    assert kept.count() == got.where("predicted = 0").count()


def test_the_sample_is_bounded_and_held_out_rows_do_not_count(spark):
    docs, labels = tables(spark)
    lexicon = fit(docs, labels, max_terms=3)
    assert 0 < len(lexicon.terms) <= 3
    only_held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    flipped = labels.selectExpr("doc_id", f"case when doc_id in ({','.join(map(str, only_held))}) then 1 - toxic else toxic end as toxic")
    assert fit(docs, flipped).terms == fit(docs, labels).terms


def test_empty_tables(spark):
    docs, labels = tables(spark)
    assert toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert {r["predicted"] for r in toxicity(docs, labels.limit(0)).collect()} == {0}
    assert drop_toxic(docs.limit(0), labels).count() == 0
