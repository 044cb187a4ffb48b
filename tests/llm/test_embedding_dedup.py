from pathlib import Path

import numpy as np
import pytest

from contactscope.llm.embedding_dedup import Forest, near_duplicates, tile_pairs, unit
from contactscope.llm.queries import QUERIES
from contactscope.sources.tables import shared_folder

SCHEMA = "vec_id long, embedding array<float>, weight int, key string"


def brute(rows, threshold):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v in rows]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(n):
        for y in range(x):
            if ok[x] and ok[y] and len(rows[x][1]) == len(rows[y][1]):
                a, b = (np.array(rows[k][1], np.float64) for k in (x, y))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold - 1e-15:
                    links[x] += 1
                    links[y] += 1
                    parent[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return sorted(((i, links[x], low.get(root(x), i), i is not None and i == low.get(root(x))) for x, (i, _) in enumerate(rows)), key=str)


def plain(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_query_equals_brute_force(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert plain(QUERIES["op4_embedding_dedup"](spark, folder)) == brute(rows, 0.9)


@pytest.mark.parametrize("tile_rows", [2048, 16])
def test_odd_vectors_copies_and_clusters(spark, tile_rows):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.normal(size=20)
        for _ in range(20):
            rows.append((len(rows) * 2 + 1, (centre + rng.normal(size=20) * rng.choice([0.05, 0.3, 0.5])).astype(np.float32).tolist()))
    rows += [(1000 + k, rows[7][1]) for k in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 20), (2003, [1.0, None] * 10), (2004, [float("nan")] * 20)]
    rows += [(2005, [float("inf")] * 20), (2006, rows[3][1][:10]), (2007, rows[3][1][:10]), (2008, [1e-30] * 20), (2009, [1e30] * 20)]
    rows += [(5, rows[9][1]), (None, rows[9][1]), (2010, [-0.0] * 19 + [1.0]), (2011, [0.0] * 19 + [2.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], SCHEMA)
    assert plain(near_duplicates(df, 0.9, tile_rows=tile_rows, sample_rows=200)) == brute(rows, 0.9)


def _on_disk(spark):
    """Bytes of each shuffle file and of each file in the shared folder."""
    local = [d.toString() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    found = [f for d in local for f in Path(d).rglob("shuffle_*")]
    found += [f for f in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file()]
    return {f: f.stat().st_size for f in found}


def test_disk_follows_the_input_not_the_pairs_of_tiles(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(4000, 64)).astype(np.float32)
    values[2000:2100] = values[:100] + 0.01
    df = spark.createDataFrame([(k, v, 1, "c") for k, v in enumerate(values.tolist())], SCHEMA)
    before = _on_disk(spark)
    got = plain(near_duplicates(df, 0.9, tile_rows=32))
    made = sum(size for f, size in _on_disk(spark).items() if f not in before)
    near = unit(values) @ unit(values).T >= 0.9
    assert got == sorted(((k, int(near[k].sum()) - 1, int(near[k].argmax()), bool(near[k].argmax() == k)) for k in range(4000)), key=str)
    assert near.sum() == 4200
    # 125 tiles meet in 7,875 pairs; files and columns have some bytes of their own.
    assert made < 3 * values.nbytes + 1_000_000


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equal_vectors_meet_in_one_cell_whatever_their_batch(spark, kind):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(601, 24)).astype(np.float32).tolist()
    rows = [(k * 3 + c, values[k]) for c in range(3) for k in range(len(values))]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(7)
    got = near_duplicates(df, 0.9, tile_rows=16)
    assert {tuple(r) for r in got.select("n_links", "class_size").distinct().collect()} == {(2, 3)}
    assert got.where("component_id = vec_id - vec_id % 3 and kept = (vec_id % 3 = 0)").count() == len(rows)


def test_forest_spans_its_links():
    rng = np.random.default_rng(6)
    i, j = rng.integers(0, 300, size=(2, 400))
    tree = Forest(300)
    for k in range(0, 400, 37):
        tree.add(i[k : k + 37], j[k : k + 37])
        tree.take()
    a, b = tree.edges()
    parts = []
    for x, y in ((i, j), (a, b)):
        label = np.arange(300)
        for _ in range(300):
            np.minimum.at(label, x, label[y])
            np.minimum.at(label, y, label[x])
        parts.append(label)
    assert (parts[0] == parts[1]).all() and len(a) == 300 - len(np.unique(parts[0]))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 48))
    raw = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.1, 0.3, 0.45, 0.6)])
    x = unit(raw)
    want = {(i, j) for i, j in np.argwhere(x @ x.T >= 0.9).tolist() if i < j}
    got = {p for i, j in tile_pairs(x, x, raw, raw, 0.9, True) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == want
    cross = {p for i, j in tile_pairs(x[:70], x[70:], raw[:70], raw[70:], 0.9, False) for p in zip(i.tolist(), (j + 70).tolist(), strict=True)}
    assert cross == {p for p in want if p[0] < 70 <= p[1]}
