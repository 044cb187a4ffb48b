"""Hard negatives by coordinate pruning in length buckets (LEMP).

Vectors become whole numbers, floor(``scale`` * component), and a score is an inner product of such
vectors, so scores are exact and ties are real. All rows are sorted by length and cut into buckets; a
bucket holds for each coordinate its rows in the order of that coordinate of the unit vectors. Anchors
are a stated query set, taken in blocks of ``ANCHOR_BYTES`` against all buckets.

An anchor asks for the best ``k`` rows in one or more windows of scores. Whatever it has found so far, and what the
``SEEDS`` longest buckets hold, gives the least score that still counts. A bucket whose longest
vector cannot reach it is passed over. In the others that score and the lengths give a least cosine, and so for each
of the anchor's ``FOCUS`` largest coordinates the range in which a row's coordinate must lie; a range is
a stretch of a sorted list, the stretches are intersected, and what is in all of them is verified by its exact
score. Pruning leaves some room for rounding. Positives come first (the best of the same label), then the windows
below each of them. A task keeps k rows a window; ranked windows merge the tasks.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take
no part. Of rows that share an id, the one with the smallest label, then vector stays. Vectors meet
only vectors with as many components; empty vectors have score 0. Components and scores beyond 64 bits count as the nearest
64-bit number. A positive with a negative score has no window. Equal scores go by the smaller id. Only the columns
named are read, whatever else a table carries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactscope.llm.common import only, stored

SCALE = 256
K = 5
BUCKET_ROWS = 2048
#: Bytes of anchors that are compared in one pass over the buckets.
ANCHOR_BYTES = 8 << 20
#: The longest buckets, searched first for a score to start from; this moves work, not results.
SEEDS = 4
FOCUS = 4
SLACK = 1e-9
MOST = (1 << 63) - 1

BUCKETS = "size int, longest double, ids array<long>, labels array<long>, width int, vectors binary, lists binary"


def _matrix(column, size: int):
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _units(vectors):
    """Lengths, and the vectors at length 1; a zero vector stays as it is."""
    real = vectors.astype(np.float64)
    lengths = np.sqrt((real * real).sum(axis=1))
    return lengths, real / np.where(lengths > 0, lengths, 1)[:, None]


def _bucketed(batches):
    """Rows sorted by number of components and length to buckets with their coordinate lists."""
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column("vector")).to_numpy()
        changes = np.flatnonzero(np.diff(sizes, prepend=-1, append=-1))
        for start, stop in zip(changes[:-1], changes[1:]):
            for at in range(start, stop, BUCKET_ROWS):
                part = batch.slice(at, min(BUCKET_ROWS, stop - at))
                size = int(sizes[start])
                vectors = _matrix(part.column("vector"), size) if size else np.zeros((part.num_rows, 0), np.int64)
                lengths, units = _units(vectors)
                most = int(max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))))
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                lists = np.argsort(units, axis=0, kind="stable").T.astype(np.int16)
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.record_batch(
                    [
                        pa.array([size], pa.int32()),
                        pa.array([lengths.max()]),
                        pa.ListArray.from_arrays(one, part.column("vec_id")),
                        pa.ListArray.from_arrays(one, part.column("label")),
                        pa.array([width], pa.int32()),
                        pa.array([vectors.astype(f"i{width}").tobytes()]),
                        pa.array([np.ascontiguousarray(lists).tobytes()]),
                    ],
                    ["size", "longest", "ids", "labels", "width", "vectors", "lists"],
                )


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector of whole numbers), one row an id, stored."""
    rows = only(rows, "vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL")
    parts = F.transform("embedding", lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), parts.alias("p"))
    rows = rows.where(F.col("p").isNotNull() & F.forall("p", fine))
    whole = F.transform("p", lambda x: F.floor(x * scale))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("vector"))).alias("r"))
    return stored(one.select("vec_id", "r.label", "r.vector"), "lemp-rows")


def buckets(rows: DataFrame) -> DataFrame:
    """All rows in buckets of like length, stored."""
    n = rows.count()
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    keys = [F.size("vector"), F.desc("length"), F.col("vec_id")]  # ids part rows of one length
    dealt = rows.withColumn("length", length).repartitionByRange(max(1, -(-n // (4 * BUCKET_ROWS))), *keys)
    return stored(
        dealt.sortWithinPartitions(*keys).select("vec_id", "label", "vector").mapInArrow(_bucketed, BUCKETS),
        "lemp-buckets",
    )


def _scores(vectors, vector, exact: bool):
    """Inner products as 64-bit numbers."""
    if exact:
        return (vectors.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    return np.array([max(-MOST, min(MOST, int(s))) for s in vectors.astype(object) @ vector.astype(object)], np.int64)


def _candidates(anchor, units, lists, cosine: float):
    """Rows whose focus coordinates allow a cosine of ``cosine`` with the unit vector ``anchor``."""
    focus = np.argsort(-np.abs(anchor))[:FOCUS]
    hits = np.zeros(len(units), np.int8)
    asked = 0
    for f in focus:
        q = float(anchor[f])
        room = np.sqrt(max(0.0, (1 - q * q) * (1 - cosine * cosine)))
        low = -np.inf if q <= -cosine + SLACK else q * cosine - room - SLACK
        high = np.inf if q >= cosine - SLACK else q * cosine + room + SLACK
        order = lists[f]
        a = np.searchsorted(units[:, f], low, "left", sorter=order)
        b = np.searchsorted(units[:, f], high, "right", sorter=order)
        if a == 0 and b == len(order):
            continue
        asked += 1
        hits[order[a:b]] += 1
    return np.flatnonzero(hits == asked)


def _scan(anchors: dict, windows: list, same: bool, k: int):
    """Buckets to (target, vec_id, score): the best k rows of the task for every window.

    ``anchors`` maps a number of components to (numbers, ids, labels, vectors); ``windows`` has for each anchor number
    its (target, lowest, highest) scores.
    """

    def run(batches):
        best: dict[int, tuple] = {}
        units_of = {size: _units(vectors) for size, (_, _, _, vectors) in anchors.items()}

        def least(target, low):
            held = best.get(target)
            return max(low, int(held[0][-1])) if held and len(held[0]) == k else low

        for batch in batches:
            for at in range(batch.num_rows):
                size = batch.column("size")[at].as_py()
                if size not in anchors:
                    continue
                ids, labels = (batch.column(c)[at].values.to_numpy() for c in ("ids", "labels"))
                raw = batch.column("vectors")[at].as_py()
                vectors = np.frombuffer(raw, f"i{batch.column('width')[at].as_py()}").reshape(len(ids), size)
                lists = np.frombuffer(batch.column("lists")[at].as_py(), np.int16).reshape(size, len(ids))
                longest = batch.column("longest")[at].as_py()
                _, units = _units(vectors)
                largest = float(np.abs(vectors.astype(np.float64)).max(initial=0))
                vectors = vectors.astype(np.int64)
                numbers, own_ids, own_labels, own = anchors[size]
                lengths, own_units = units_of[size]
                for i, number in enumerate(numbers):
                    open_windows = [(t, least(t, low), high) for t, low, high in windows[number]]
                    if not open_windows:
                        continue
                    lowest = min(low for _, low, _ in open_windows)
                    rows = None
                    if lowest > 0:
                        reach = float(lengths[i]) * longest
                        if reach * (1 + SLACK) < lowest:
                            continue
                        if np.isfinite(reach):
                            rows = _candidates(own_units[i], units, lists, min(1.0, lowest / reach))
                    rows = np.arange(len(ids)) if rows is None else rows
                    if same:
                        rows = rows[(labels[rows] == own_labels[i]) & (ids[rows] != own_ids[i])]
                    else:
                        rows = rows[labels[rows] != own_labels[i]]
                    if not len(rows):
                        continue
                    exact = size * largest * float(np.abs(own[i].astype(np.float64)).max(initial=0)) < 2**53
                    scores = _scores(vectors[rows], own[i], exact)
                    some = np.flatnonzero(scores >= lowest)
                    scores, found = scores[some], ids[rows[some]]
                    order = np.lexsort((found, -scores))
                    scores, found = scores[order], found[order]
                    for target, low, high in open_windows:
                        a = np.searchsorted(-scores, -high, "left")
                        b = min(a + k, np.searchsorted(-scores, -low, "right"))
                        if a < b:
                            held = best.get(target, (scores[:0], found[:0]))
                            both = np.concatenate([held[0], scores[a:b]]), np.concatenate([held[1], found[a:b]])
                            order = np.lexsort((both[1], -both[0]))[:k]
                            best[target] = both[0][order], both[1][order]
        if best:
            targets = np.repeat(list(best), [len(s) for s, _ in best.values()])
            scores, found = (np.concatenate(x) for x in zip(*best.values()))
            yield pa.record_batch([pa.array(targets), pa.array(found), pa.array(scores)], ["target", "vec_id", "score"])

    return run


FOUND = "target long, vec_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("target").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top(held: DataFrame, seeds: DataFrame, anchors: dict, windows: list, same: bool, k: int) -> DataFrame:
    """(target, vec_id, score, rank) over all buckets, from the least scores that the seeds give."""
    first = _ranked(seeds.mapInArrow(_scan(anchors, windows, same, k), FOUND), k).where(F.col("rank") == k)
    floors = {r.target: r.score for r in first.collect()}  # one a window of the block, at most
    windows = [[(t, max(low, floors.get(t, low)), high) for t, low, high in own] for own in windows]
    return _ranked(held.mapInArrow(_scan(anchors, windows, same, k), FOUND), k)


def _mined(held: DataFrame, seeds: DataFrame, block: DataFrame, positives: int, negatives: int, low: int, high: int):
    """The hard negatives of one block of anchors."""
    spark = held.sparkSession
    rows = block.orderBy("vec_id").collect()  # a block has a bound
    schema = """anchor_id long, positive_id long, rank int, negative_id long, positive_score long,
        negative_score long"""
    if not rows:
        return spark.createDataFrame([], schema)
    anchors = {}
    for size in {len(r.vector) for r in rows}:
        numbers = [i for i, r in enumerate(rows) if len(r.vector) == size]
        own = [rows[i] for i in numbers]
        vectors = np.array([r.vector for r in own], np.int64).reshape(len(own), size)
        anchors[size] = numbers, [r.vec_id for r in own], [r.label for r in own], vectors
    anything = [[(i, -MOST, MOST)] for i in range(len(rows))]
    best = _top(held, seeds, anchors, anything, True, positives).orderBy("target", "rank").collect()
    windows: list = [[] for _ in rows]
    for number, r in enumerate(best):  # ``positives`` an anchor of the block, at most
        lowest = -(-low * r.score // 100)
        highest = high * r.score // 100
        if lowest <= highest:
            windows[r.target].append((number, lowest, highest))
    pairs = [(n, rows[r.target].vec_id, r.vec_id, r.score) for n, r in enumerate(best)]
    pairs = spark.createDataFrame(pairs, "target long, anchor_id long, positive_id long, positive_score long")
    found = _top(held, seeds, anchors, windows, False, negatives)
    found = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, "target")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = K,
    negatives: int = K,
    low: int = 80,
    high: int = 100,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and embedding. A negative of another label counts where its score is
    between ``low`` and ``high`` hundredths of the positive's.
    """
    rows = prepared(rows, scale)
    held = buckets(rows)
    seeds = stored(held.orderBy(F.desc("longest")).limit(SEEDS), "lemp-seeds")
    asked = rows.where(is_anchor)
    size = asked.agg(F.sum(F.lit(8) * (F.size("vector") + 4))).first()[0] or 0
    blocks = max(1, -(-size // ANCHOR_BYTES))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    return reduce(
        DataFrame.union,
        [_mined(held, seeds, asked.where(part == b), positives, negatives, low, high) for b in range(blocks)],
    )
