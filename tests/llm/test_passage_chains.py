import random

import numpy as np

from contactscope.llm.passage_chains import chains, common_words, matched_words, parts, passages, winnowed
from contactscope.llm.queries import QUERIES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_alignment_equals_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        b = [x if rng.random() > 0.2 else rng.randrange(6) for x in a if rng.random() > 0.1]
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        want = lcs(a, b)
        assert matched_words(x, y, 100, 0) == want
        assert matched_words(x, y, 100, want) == want
        assert matched_words(x, y, 100, want + 1) == 0


def test_best_chain_equals_quadratic_search():
    rng = random.Random(4)
    for _ in range(100):
        anchors = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        x, y = (np.array(v) for v in zip(*anchors, strict=True))
        worth = []
        for i, (a, b) in enumerate(anchors):
            worth.append(8 + max([0.0, *(worth[j] - 0.05 * (a - c + b - d) for j, (c, d) in enumerate(anchors[:i]) if c < a and d < b)]))
        best = chains(x, y, 8, 0.05)[0]
        got = 8 * len(best) - 0.05 * (x[best[-1]] - x[best[0]] + y[best[-1]] - y[best[0]])
        assert abs(got - max(worth)) < 1e-9
        flat = [k for c in chains(x, y, 8, 0.05) for k in c]
        assert sorted(flat) == list(range(len(anchors)))


def test_windows_share_a_seed():
    rng = np.random.default_rng(3)
    for _ in range(50):
        common = rng.integers(0, 1 << 60, 19).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 1 << 60, 30).astype(np.uint64), common, rng.integers(0, 1 << 60, 9).astype(np.uint64)])
        b = np.concatenate([common, rng.integers(0, 1 << 60, 40).astype(np.uint64)])
        assert set(a[winnowed(a, 19)]) & set(b[winnowed(b, 19)])


def planted(spark):
    rng = random.Random(9)

    def text(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    shared, line = text(60), text(12)
    docs = {}
    for k in range(30):
        words = [*text(rng.randint(20, 80)), *line, *text(20)]
        if k % 3 == 0:
            passage = list(shared)
            for _ in range(k // 3 % 4):
                passage[rng.randrange(60)] = "changed"
            if k % 6 == 3:
                del passage[30]
            words += [*passage, *text(10)]
        docs[k] = words
    docs[50] = list(docs[4])
    docs[51] = text(15_000)
    docs[52] = [*docs[51][:7000], "new", *docs[51][7000:]]
    docs[53] = [*text(40), *line, *line, *line, *line]
    return docs, {k for k in range(30) if k % 3 == 0}


def test_planted_passages_are_found_and_others_left_alone(spark):
    docs, with_passage = planted(spark)
    rows = [(k, " ".join(w), "c", 0) for k, w in docs.items()] + [(60, None, "c", 0), (61, "", "c", 0), (62, "a b", "c", 0), (None, " ".join(docs[0]), "c", 0)]
    got = passages(spark.createDataFrame(rows, "doc_id long, text string, chain string, lo int")).collect()
    found = {(r["doc_id"], r["src_id"]) for r in got}
    assert {a for a, _ in found if a < 50} == with_passage - {0}
    assert {b for a, b in found if a < 50} <= with_passage
    assert {p for p in found if p[0] >= 50} == {(50, 4), (52, 51)}
    for r in got:
        a, b = docs[r["doc_id"]][r["lo"] : r["hi"]], docs[r["src_id"]][r["src_lo"] : r["src_hi"]]
        assert r["n_words"] == max(len(a), len(b)) and r["n_words"] >= 30
        assert r["identity"] >= 0.8
        if len(a) < 1000:
            assert r["matched"] == lcs(a, b)
    for k in with_passage - {0}:
        assert len({w for r in got if r["doc_id"] == k for w in range(r["lo"], r["hi"])}) >= 50
    whole = next(r for r in got if r["doc_id"] == 52)
    assert (whole["lo"], whole["hi"], whole["matched"]) == (0, 15_001, 15_000)


def test_query_covers_all_exact_copies(spark, folder):
    docs = {r["doc_id"]: (r["text"] or "").lower().split() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op5_substring_dedup"](spark, folder).collect()
    groups = {}
    for k, words in sorted(docs.items()):
        if len(words) >= 40:
            groups.setdefault(tuple(words), []).append(k)
    touched = {r["doc_id"] for r in got}
    for same in groups.values():
        assert set(same[1:]) <= touched
    for r in got[:200]:
        a, b = docs[r["doc_id"]][r["lo"] : r["hi"]], docs[r["src_id"]][r["src_lo"] : r["src_hi"]]
        assert lcs(a, b) >= r["matched"] >= 0.8 * r["n_words"]


def test_repeated_ids_and_empty_table(spark):
    same = " ".join(f"v{k}" for k in range(50))
    rows = [(1, same), (1, same), (2, same), (2, "other text")]
    got = passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["src_id"], r["matched"]) for r in got] == [(2, 1, 50)]
    assert passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_words_equal_longest_common_subsequence(monkeypatch):
    rng = random.Random(5)
    for limit in (4096, 3):
        monkeypatch.setattr("contactscope.llm.passage_chains.BIT_WORDS", limit)
        for _ in range(200):
            a, b = ([rng.randrange(9) for _ in range(rng.randint(0, 40))] for _ in range(2))
            assert common_words(np.array(a, np.uint32), np.array(b, np.uint32)) == lcs(a, b)


def test_passages_in_order_with_other_words_between(spark):
    rng = random.Random(6)

    def text(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    docs = {}
    for k, gap in enumerate((40, 100, 300) * 3):
        one, two = text(60), text(60)
        for j in range(2):
            docs[2 * k + j] = [*text(30), *one, *text(gap), *two, *text(30)]
    got = passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")).collect()
    for k, w in docs.items():
        if k % 2:
            covered = {i for r in got if (r["doc_id"], r["src_id"]) == (k, k - 1) for i in range(r["lo"], r["hi"])}
            assert covered >= {*range(30, 90), *range(len(w) - 90, len(w) - 30)}


def test_passage_with_long_insertions_on_both_sides():
    rng = np.random.default_rng(7)
    for n, put in ((500, 40), (500, 17), (9000, 600)):
        w = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        new = rng.integers(0, 1 << 32, (2, put), dtype=np.uint32)
        a = np.concatenate([w[: n // 3], new[0], w[n // 3 :]])
        b = np.concatenate([w[: n * 2 // 3], new[1], w[n * 2 // 3 :]])
        at = np.arange(0, n - 8, 10)
        x, y = at + put * (at >= n // 3), at + put * (at >= n * 2 // 3)
        assert parts(a, b, x, y, 8, 30, 0.8) == [(0, n + put, 0, n + put, n)]


def test_frequent_lines_against_brute_force(spark):
    rng = random.Random(8)

    def text(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    lines = [text(n) for n in [20, 22, 25, 28] * 5]
    docs = {k: [*text(20), *line, *text(20)] for k, line in enumerate(lines)}
    for k in range(len(lines), 150):
        docs[k] = [w for _ in range(4) for w in [*text(10), *rng.choice(lines), *rng.choice(lines)]]
    first, shared = {}, set()  # the first place of every 48 words, and the places where they come again
    for k, words in docs.items():
        for i in range(len(words) - 47):
            if first.setdefault(tuple(words[i : i + 48]), k) != k:
                shared |= {(k, j) for j in range(i, i + 48)}
    got = passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string"), k=8, window=19)
    covered = {(r["doc_id"], i) for r in got.collect() for i in range(r["lo"], r["hi"])}
    assert shared and shared <= covered


def test_extension_goes_on_past_the_first_margin(spark):
    rng = random.Random(10)
    text = " ".join(f"u{rng.randrange(10**9)}" for _ in range(3000))
    # One seed a text: all else is extension.
    got = passages(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), window=4000).collect()
    assert [(r["lo"], r["hi"], r["matched"]) for r in got] == [(0, 3000, 3000)]


def test_fuzzy_passages_against_brute_force(spark):
    rng = random.Random(11)

    def text(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    docs, every = {}, {}
    for k in range(120):
        shared = text(60)
        every[2 * k + 1] = (7, 8, 10, 15)[k % 4]
        changed = [w if i % every[2 * k + 1] else f"x{k}" for i, w in enumerate(shared, 1)]
        docs[2 * k], docs[2 * k + 1] = [*text(30), *shared, *text(30)], [*text(30), *changed, *text(30)]
    want = {k for k in every if lcs(docs[k - 1], docs[k]) >= 0.8 * 60}
    assert want == set(every)
    got = passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in got if r["src_id"] == r["doc_id"] - 1}
    assert found >= {k for k in want if every[k] >= 10}
    assert len(found) >= 0.9 * len(want)


def test_seeds_of_one_document_are_not_stored(spark, monkeypatch):
    from contactscope.llm import passage_chains

    names, store = [], passage_chains.stored
    monkeypatch.setattr(passage_chains, "stored", lambda df, name: names.append(name) or store(df, name))
    docs = [(k, " ".join(f"w{k}.{j}" if j < 40 else f"same{j}" for j in range(80))) for k in range(6)]
    got = passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.src_id, r.lo, r.hi) for r in got} == {(k, 0, 40, 80) for k in range(1, 6)}
    assert "passage-shared" in names and "passage-seeds" not in names


def test_shared_seeds_over_any_batches():
    import numpy as np
    import pyarrow as pa

    from contactscope.llm.passage_chains import _shared

    rng = np.random.default_rng(2)
    for _ in range(60):
        rows = sorted(zip(rng.integers(-9, 9, 40).tolist(), rng.integers(0, 3, 40).tolist()))
        cuts = [0, *sorted(rng.integers(0, 41, 12).tolist()), 40]
        kind = pa.schema([("seed", pa.int64()), ("doc_id", pa.int64())])
        parts = [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], pa.int64()) for k in (0, 1)], schema=kind) for p in parts]
        got = [(r["seed"], r["doc_id"]) for b in _shared(batches) for r in b.to_pylist()]
        assert got == [r for r in rows if len({d for s, d in rows if s == r[0]}) > 1]


def test_words_of_repeated_lines_are_fetched_once(spark, monkeypatch):
    """A line that a document repeats is a chain each time; its words are not fetched for each of them."""
    from contactscope.llm import passage_chains

    line = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, line), (2, " ".join([line] * 12)), (3, "a b c d e f")], "doc_id long, text string")
    kept = {}

    def record(df, name, plain=passage_chains.stored):
        table = plain(df, name)
        kept.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(passage_chains, "stored", record)
    found = passages(docs).collect()
    assert {(r.lo, r.hi) for r in found if r.src_id == 1 and r.matched == 40} >= {(0, 40), (40, 80), (440, 480)}
    assert kept["passage-chains"][0] >= 12 and max(kept["passage-words"]) == 2


def test_texts_serve_many_requests(spark, monkeypatch):
    from contactscope.llm import passage_chains

    monkeypatch.setattr(passage_chains, "REQUESTS", 4)
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    kind = "doc_id long, src_id long, unit string, lo long, hi long, src_lo long, src_hi long"
    units = spark.createDataFrame([(1, 2, str(i), 0, 2, 1, 3) for i in range(40)], kind)
    rows = passage_chains._asked(docs, units)
    assert sorted({(r.text, a.unit, a.side) for r in rows.collect() for a in r.asked}) == sorted(
        (t, str(i), s) for i in range(40) for s, t in enumerate(("a b c", "d e f"))
    )
    assert rows.count() <= 20
    words = rows.mapInArrow(passage_chains._sliced(0), passage_chains.WORDS).collect()
    assert len(words) == 80 and {(r.side, r["from"], len(r.words), r.more) for r in words} == {(0, 0, 8, True), (1, 1, 8, False)}


def test_places_extended_together_equal_single_ones():
    from contactscope.llm.passage_chains import _reach, _reach_all

    rng = np.random.default_rng(12)
    for kinds, size in ((3, 300), (40, 3000), (40, 20_000)):
        a = rng.integers(0, kinds, size).astype(np.uint32)
        keep = rng.random(size) > 0.06
        b = np.where(rng.random(size) > 0.06, a, kinds)[keep].astype(np.uint32)
        i = rng.integers(0, len(b), 400)
        j = np.minimum(len(b) - 1, np.where(rng.random(400) < 0.8, np.cumsum(keep)[i] - 1, rng.integers(0, len(b), 400)).clip(0))
        right = _reach_all(a, b, i, j, len(a) - i, len(b) - j, 1)
        left = _reach_all(a, b, i - 1, j - 1, i, j, -1)
        for c in range(400):
            assert tuple(v[c] for v in right) == _reach(a[i[c] :], b[j[c] :])
            assert tuple(v[c] for v in left) == _reach(a[: i[c]][::-1], b[: j[c]][::-1])


def test_single_anchors_are_extended_together(monkeypatch):
    import pyarrow as pa

    from contactscope.llm import passage_chains

    rng = np.random.default_rng(13)
    words = np.tile(rng.integers(0, 1 << 32, 40, dtype=np.uint32), 50)
    other = np.append(words[:40], rng.integers(0, 1 << 32, 40, dtype=np.uint32))
    chain = [{"chain": c, "xs": [40 * c], "ys": [0]} for c in range(50)] + [{"chain": 50, "xs": [1, 9], "ys": [0, 9]}]
    unit = {"unit": "0", "chains": chain, "from": 0, "words": words.tobytes(), "more": False}
    unit |= {"src_from": 0, "src_words": other.tobytes(), "src_more": False}
    calls, plain = [], passage_chains._reach
    monkeypatch.setattr(passage_chains, "_reach", lambda a, b: calls.append(1) or plain(a, b))
    batch = pa.RecordBatch.from_pylist([unit])
    got = [r for b in passage_chains._aligned(4, 30, 0.8)([batch.slice(0, 0), batch]) for r in b.to_pylist()]
    for r in got[:50]:
        at = 40 * r["chain"]
        assert not r["cut"] and r["parts"] == [{"matched": 40, "lo": at, "hi": at + 40, "src_lo": 0, "src_hi": 40}]
    assert [r["chain"] for r in got[:50]] == list(range(50)) and len(calls) <= 20


def test_first_places_take_one_shuffle_of_the_shared_seeds(spark, monkeypatch):
    from contactscope.llm import passage_chains

    plans, store = {}, passage_chains.stored

    def record(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(passage_chains, "stored", record)
    docs = [(k, " ".join(f"w{k}.{j}" if j < 40 else f"same{j}" for j in range(80))) for k in range(6)]
    got = passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.src_id, r.lo, r.hi) for r in got} == {(k, 0, 40, 80) for k in range(1, 6)}
    shuffles = [x for x in plans["passage-anchors"].splitlines() if "Exchange " in x]
    assert len(shuffles) <= 2 and "Join" not in plans["passage-anchors"]


def test_long_alignments_are_bitwise_where_the_table_is_small(monkeypatch):
    import time

    from contactscope.llm import passage_chains

    rng = np.random.default_rng(14)
    a = rng.integers(0, 300, 9000).astype(np.uint32)
    b = np.where(rng.random(9000) > 0.1, a, 300)[rng.random(9000) > 0.1].astype(np.uint32)
    began = time.process_time()
    fast = common_words(a, b)
    middle = time.process_time()
    monkeypatch.setattr(passage_chains, "BIT_WORDS", 3)
    monkeypatch.setattr(passage_chains, "BIT_TABLE", 0)
    assert common_words(a, b) == fast
    assert middle - began < 0.7 * (time.process_time() - middle)
    for _ in range(200):
        x, y = ([int(v) for v in rng.integers(0, 9, rng.integers(0, 40))] for _ in range(2))
        assert common_words(np.array(x, np.uint32), np.array(y, np.uint32)) == lcs(x, y)
