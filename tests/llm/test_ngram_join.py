import re

import pytest

from contactscope.llm import ngram_join
from contactscope.llm.ngram_join import jaccard_classes, keep_one, offers, tile_links
from contactscope.llm.queries import QUERIES


def brute(rows, n, num, den):
    sets, parent = {}, {}
    for k, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        m = min(n, len(w))
        sets[k] = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
        parent[k] = k

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sets:
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                parent[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return sorted(
        ((i, len(sets[x]), low.get(root(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)),
        key=str,
    )


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op1_ngram_jaccard"](spark, folder)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("block_rows", [1024, 5])
@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_edits_chains_and_odd_rows(spark, n, num, den, block_rows):
    import random

    rng = random.Random(n)
    rows, words = [], [f"W{k}" for k in range(40)]
    for g in range(12):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 8, 12, 25, 60, 150]))
        for _ in range(7):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "\t\n"]).join(copy)))
            base = copy if g % 3 == 0 else base
    rows += [(900, None), (901, ""), (902, " \n"), (903, "É É É"), (904, "é é é"), (900, rows[0][1]), (1, rows[0][1])]
    rows += [(None, rows[3][1]), (950, "x y z " * 4000), (951, "x y z " * 4000 + "x")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "clash", "s") for i, t in rows], "doc_id long, text string, cls string, row string")
    got = jaccard_classes(docs, n, num, den, block_rows=block_rows)
    found = sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert found == brute(rows, n, num, den)


@pytest.mark.parametrize("rows", [250_000, 0])
def test_one_large_group_of_near_copies(spark, monkeypatch, rows):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", rows)  # either way of meeting the texts
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[: k % 190], f"new{k}", *base[k % 190 + 1 :]])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_classes(docs, 3, 90, 100, block_rows=64).collect()
    assert {r["component_id"] for r in got} == {0}
    assert [r["doc_id"] for r in keep_one(docs, n=3, num=90, den=100).collect()] == [0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(docs).count() == 0
    assert keep_one(docs).count() == 0


def test_tiles_discard_without_loss():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 60, 80).astype(np.uint64)
    rows = [np.unique(np.append(rng.choice(base, 74, replace=False), rng.integers(1, 1 << 60, 2).astype(np.uint64))) for _ in range(30)]
    links = {(x, y) for x in range(30) for y in range(x) if 10 * len(set(rows[x]) & set(rows[y])) >= 8 * len(set(rows[x]) | set(rows[y]))}
    one = set(tile_links(rows, None, 8, 10, 7))
    two = set(tile_links(rows[:10], rows[10:], 8, 10, 7))
    assert all((max(p), min(p)) in links for p in one | two)
    assert bool(one) == bool(links)


def test_linking_rows_share_an_offer():
    import numpy as np

    rng = np.random.default_rng(8)
    for num, den in ((90, 100), (8, 10), (1, 2)):
        for size in [1, 2, 3, 5, 8, 9, 10, 11, 19, 20, 21, 40, 75, 150, 400]:
            for _ in range(40):
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
                known = np.sort(rng.choice(a, rng.integers(0, len(a) + 1), replace=False))
                ranks = rng.permutation(len(known)) + 1
                least = -(-num * 2 * len(a) // (den + num))
                kept = rng.choice(a, rng.integers(max(1, least - 1), len(a) + 1), replace=False)
                b = np.unique(np.append(kept, rng.integers(0, 1 << 63, rng.integers(0, 3 + size // 3)).astype(np.uint64)))
                both = len(np.intersect1d(a, b))
                if den * both < num * (len(a) + len(b) - both) or np.array_equal(a, b):
                    continue
                x, y = offers(a, num, den, known, ranks), offers(b, num, den, known, ranks)
                assert len(np.intersect1d(x, y)), (num, den, len(a), len(b))


def test_a_large_family_travels_once(spark):
    """Rows went to a task for each pair of tiles of 16 rows; a family that fits one task is now one tile."""
    rows = [(f"c{k}", "f", 20 + k % 5) for k in range(200)]
    chosen = spark.createDataFrame(rows, "cls string, family string, n_shingles long")
    placed = ngram_join._tile_tasks(chosen, 80, 100, 16)
    assert placed.count() == 200
    long = chosen.withColumn("n_shingles", chosen.n_shingles * 20)  # more than one tile of 16 * 1024 entries
    counts = {r["count"] for r in ngram_join._tile_tasks(long, 80, 100, 16).groupBy("cls").count().collect()}
    assert 1 < max(counts) < 40


def test_parts_lose_no_link():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    rows = [np.unique(rng.choice(base, n, replace=False)) for n in rng.integers(1, 300, 120)]
    for num, den in ((8, 10), (1, 2)):
        for cut in (None, 50):
            left, right = (rows, None) if cut is None else (rows[:cut], rows[cut:])
            whole = list(tile_links(left, right, num, den, 64))
            got = ngram_join.block_links(left, right, num, den, 64, 7)

            def groups(pairs):
                parent = list(range(len(rows)))
                for a, b in pairs:
                    a, b = parent[a], parent[b]
                    parent = [a if p == b else p for p in parent]
                return {tuple(k for k, p in enumerate(parent) if p == q) for q in parent}

            assert whole and groups(got) == groups(whole)
            assert len(got) == len(rows) - len(groups(whole))


def test_hashing_and_product_hold_little_beside_their_input():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from contactscope.llm.common import word_hasher
    from contactscope.llm.ngram_join import _links

    texts = pa.array([" ".join(f"w{i % 911}" for i in range(3000))] * 60)
    tracemalloc.start()
    word_hasher()(texts)
    assert tracemalloc.get_traced_memory()[1] < 25e6  # steps of 1 MB of text took 39 MB
    tracemalloc.stop()

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << 60, 20_000, dtype=np.uint64)) for _ in range(100)]
    rows += [np.append(rows[4][:-1], np.uint64(1 << 61))]
    count = len(rows)
    chunks = [[rows[i].tobytes() for i in part] for part in (range(40), range(40, count))]
    fixed = {c: ["x"] * count for c in ("task", "own", "one", "two")} | {"family": [7] * count}
    table = pa.table(fixed | {"cls": [str(i) for i in range(count)], "row": pa.chunked_array(chunks, pa.binary())})
    found = _links(8, 10, 64, 1024)(table.slice(1))
    assert found.to_pylist() == [{"a": "4", "b": "100"}]


def test_sketches_lose_no_link():
    import numpy as np

    rng = np.random.default_rng(6)
    for num, den in ((8, 10), (90, 100), (1, 2)):
        rows = []
        for size in [1, 2, 5, 30, 63, 64, 65, 120, 130, 300, 520, 20_000]:
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            for _ in range(6):
                kept = rng.choice(base, rng.integers(max(1, size * num // den), size + 1), replace=False)
                rows.append(np.unique(np.append(kept, rng.integers(0, 1 << 63, rng.integers(0, 2 + size // 8), dtype=np.uint64))))
        rng.shuffle(rows := np.array(rows, object))
        small = [ngram_join.sketch(r) for r in rows]
        assert all((r[1:].nbytes * 8) & (r[1:].nbytes * 8 - 1) == 0 and int(r[0]) == len(h) for r, h in zip(small, rows, strict=True))
        links = 0
        for cut in (None, 30):
            left, right = (small, None) if cut is None else (small[:cut], small[cut:])
            got = list(ngram_join.block_links(left, right, num, den, 32, 9, sketches=True))
            parent = list(range(len(rows)))
            for a, b in got:
                a, b = parent[a], parent[b]
                parent = [a if p == b else p for p in parent]
            for x in range(len(rows)):
                for y in range(x):
                    both = len(np.intersect1d(rows[x], rows[y]))
                    if (cut is None or y < cut <= x) and den * both >= num * (len(rows[x]) + len(rows[y]) - both):
                        assert parent[x] == parent[y], (num, den, len(rows[x]), len(rows[y]))
                        links += 1
            assert len(got) < 80  # of 72 rows: a forest
        assert links


def test_rows_that_only_agree_on_a_range_do_not_travel_as_sets(spark, monkeypatch):
    """Each shares most of its words with the next one: row blocks, but no links. All their sets went to the tasks."""
    tables = {}

    def stored(df, name, keep=ngram_join.stored):
        return tables.setdefault(name, keep(df, name))

    monkeypatch.setattr(ngram_join, "stored", stored)
    texts = [" ".join(f"w{25 * k + i}" for i in range(150)) for k in range(40)]
    rows = [*enumerate(texts), (100, texts[7] + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_classes(docs, 3, 90, 100).collect()}
    assert got == {k: k for k, _ in rows} | {100: 7}
    assert tables["ngram-classes"].where("family is not null").count() > 30
    assert tables["ngram-set-tiles"].select("cls").distinct().count() == 2


def test_a_worker_holds_little_beside_its_batch():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    words = " ".join(f"w{i}" for i in range(700))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([f"{k} {words}" for k in range(3000)])], ["doc_id", "text"])
    none = type("Sent", (), {"value": (np.empty(0, np.uint64), np.empty(0, np.int64))})
    for run in (ngram_join._sizes(5), ngram_join._columns(5), ngram_join._offered(5, 8, 10, none)):
        tracemalloc.start()
        assert sum(b.num_rows for b in run([batch])) > 1000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 35e6, peak  # runs of 4 MB of text and 500,000 offers
