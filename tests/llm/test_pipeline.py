import re
from collections import Counter

import corpus_pipeline
from contactscope.llm.toxicity import fit, score


def text_key(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def test_stages_equal_brute_force(spark, folder):
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact", "n-gram", "mixing", "best-fit"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = {r["doc_id"]: r["score"] for r in score(docs, fit(docs, labels)).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}

    one = stages[0](spark, docs, folder).cache()
    assert one.columns == docs.columns
    kept = {i for i in rows if scored[i] < 0.5}
    assert {r["doc_id"] for r in one.collect()} == kept and len(kept) < len(rows)

    two = stages[1](spark, one, folder).cache()
    assert two.columns == docs.columns
    best = {}
    for i in kept:
        best.setdefault(text_key(rows[i]["text"]), []).append((-len(rows[i]["text"] or ""), i))
    kept = {min(v)[1] for v in best.values()}
    assert {r["doc_id"] for r in two.collect()} == kept

    three = stages[2](spark, two, folder).cache()
    assert three.columns == docs.columns
    sets, parent = {i: shingles(rows[i]["text"]) for i in kept}, {i: i for i in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in kept:
        for b in kept:
            both = len(sets[a] & sets[b])
            if a < b and both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    kept = {i for i in kept if root(i) == i}
    assert {r["doc_id"] for r in three.collect()} == kept

    four = stages[3](spark, three, folder).cache()
    assert four.columns == docs.columns
    used = Counter()
    for r in four.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        used[r["doc_id"]] += len(words)
        assert r["n_chars"] == len(r["text"])
        whole = re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]]["text"])
        assert not Counter(words) - Counter(whole)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"] or "")) for i in kept}
    assert all(used[i] <= 2 * sizes[i] for i in used)
    assert abs(sum(used.values()) - 1.5 * sum(sizes.values())) < 0.01 * sum(sizes.values())

    five = stages[4](spark, four, folder)
    assert {r["doc_id"] for r in five.select("doc_id").distinct().collect()} == set(used)


def test_run_survives_an_empty_folder_of_documents(spark, tmp_path, folder):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_packs_whole_table(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    total = got.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert total <= 1024
