"""K-means for several numbers of clusters and several restarts, one scan an iteration for all of them.

Rows are packed into small blocks once, so that what a task holds is bounded. An iteration is one pass over the blocks: every task assigns its rows to the centres of
all runs that go on and adds up, for each centre, rows, squared distances and coordinates; the
sums of the tasks meet in one small grouping. Runs that have settled are left out of later passes.
Every run starts from k-means++ centres that were settled on a bounded sample; the sample moves where
a run starts, the runs themselves see all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactscope.operators.sampling import sample_n
from contactscope.sources.tables import materialise

BLOCK_BYTES = 4096  # a task gets up to 10,000 blocks at once, however many rows a file holds
STEP_BLOCKS = 256  # blocks assigned together
START_ROWS = 20_000
MAX_ITERATIONS = 300
TOLERANCE = 1e-4  # of the mean variance of the coordinates, for the squared move of all centres


@dataclass(frozen=True)
class Fit:
    """One run: its centres and the squared distance of all rows to their nearest one."""

    k: int
    restart: int
    centres: np.ndarray
    trainingCost: float
    iterations: int

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    @property
    def summary(self) -> Fit:
        return self


def pack(df: DataFrame, features: str = "features") -> DataFrame:
    """(n, data): the feature vectors as blocks of doubles, stored. All vectors have the same length."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = x.nbytes // n
            cuts = np.append(np.arange(0, n, max(1, BLOCK_BYTES // max(size, 1))), n)
            data, ends = x.tobytes(), (cuts * size).tolist()
            blocks = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([pa.array(np.diff(cuts), pa.int32()), pa.array(blocks, pa.binary())], ["n", "data"])

    rows = df.where(F.col(features).isNotNull()).select(vector_to_array(features).alias("x"))
    return materialise(rows.mapInArrow(run, "n int, data binary"), "kmeans-blocks")


def _scan(centres: list[np.ndarray]):
    """Blocks to one row a run and centre: rows, squared distance, and the sums of the coordinates."""
    stacked = np.concatenate(centres)
    lengths = (stacked**2).sum(axis=1)
    cuts = np.cumsum([0, *map(len, centres)])

    def run(batches):
        n, cost = np.zeros(len(stacked)), np.zeros(len(stacked))
        sums = np.zeros(stacked.shape)
        for batch in batches:
            for first in range(0, batch.num_rows, STEP_BLOCKS):
                part = batch.column("data").slice(first, STEP_BLOCKS).to_pylist()
                x = np.frombuffer(b"".join(part)).reshape(-1, stacked.shape[1])
                near = lengths - 2 * (x @ stacked.T)  # squared distances, less the squared length of x
                own = (x**2).sum(axis=1)
                hits = np.zeros(near.shape)
                every = np.arange(len(x))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    at = a + near[:, a:b].argmin(axis=1)
                    hits[every, at] = 1
                    cost += np.bincount(at, np.maximum(near[every, at] + own, 0), len(stacked))
                n += hits.sum(axis=0)
                sums += hits.T @ x
        place = np.arange(len(stacked))
        columns = [pa.array(place, pa.int32()), pa.array(n.astype(np.int64)), pa.array(cost)]
        columns += [pa.array(np.ascontiguousarray(column)) for column in sums.T]
        yield pa.record_batch(columns, ["place", "n", "cost", *[f"s{j}" for j in range(stacked.shape[1])]])

    return run


def _pass(blocks: DataFrame, centres: list[np.ndarray]) -> list[tuple]:
    """For each run (rows, squared distance, sums) by centre, over all blocks."""
    size = centres[0].shape[1]
    names = ["n", "cost", *[f"s{j}" for j in range(size)]]
    schema = "place int, n long, cost double" + "".join(f", s{j} double" for j in range(size))
    found = blocks.mapInArrow(_scan(centres), schema).groupBy("place").agg(*[F.sum(c).alias(c) for c in names])
    table = np.zeros((sum(map(len, centres)), size + 2))
    for place, *values in found.collect():  # a row a centre
        table[place] = values
    cuts = np.cumsum([0, *map(len, centres)])
    return [(t[:, 0], t[:, 1], t[:, 2:]) for t in (table[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]


def _moved(centres: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The means of the assigned rows; a centre without rows stays."""
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)


def _start(sample: np.ndarray, k: int, seed: int, least: float) -> np.ndarray:
    """k-means++ centres on the sample, the best of a few draws each, settled on the sample."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    near = ((sample - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = near.sum()
        draws = np.searchsorted(np.cumsum(near), rng.random(2 + int(np.log(k))) * total) if total > 0 else [0]
        options = [np.minimum(near, ((sample - sample[min(i, len(sample) - 1)]) ** 2).sum(axis=1)) for i in draws]
        best = int(np.argmin([o.sum() for o in options]))
        centres.append(sample[min(draws[best], len(sample) - 1)])
        near = options[best]
    centres = np.array(centres)
    for _ in range(MAX_ITERATIONS):
        label = ((centres**2).sum(axis=1) - 2 * sample @ centres.T).argmin(axis=1)
        hits = np.eye(k)[label]
        moved = _moved(centres, hits.sum(axis=0), hits.T @ sample)
        shift, centres = ((moved - centres) ** 2).sum(), moved
        if shift <= least:
            break
    return centres


def fit_all(
    df: DataFrame, ks: Sequence[int], restarts: int, seed: int, key: str = "order_id", features: str = "features"
) -> dict[int, Fit]:
    """For every k the run with the least squared distance; ties go to the earlier one."""
    some = sample_n(df.select(key, features), START_ROWS, seed, [key]).orderBy(key)
    sample = np.array([r.x for r in some.select(vector_to_array(features).alias("x")).collect()])
    if not len(sample):
        raise ValueError("no rows to cluster")
    blocks = pack(df, features)
    least = TOLERANCE * float(sample.var(axis=0).mean())
    runs = [(k, i) for k in ks for i in range(restarts)]
    centres = [_start(sample, k, seed + 1000 * k + i, least) for k, i in runs]
    passes = [0] * len(runs)
    going = list(range(len(runs)))
    for _ in range(MAX_ITERATIONS):
        if not going:
            break
        still = []
        for r, (n, _, sums) in zip(going, _pass(blocks, [centres[r] for r in going])):
            moved = _moved(centres[r], n, sums)
            shift, centres[r] = ((moved - centres[r]) ** 2).sum(), moved
            passes[r] += 1
            if shift > least:
                still.append(r)
        going = still
    costs = [float(cost.sum()) for _, cost, _ in _pass(blocks, centres)]
    fits = [Fit(k, i, c, cost, p) for (k, i), c, cost, p in zip(runs, centres, costs, passes)]
    return {k: min((f for f in fits if f.k == k), key=lambda f: (f.trainingCost, f.restart)) for k in ks}


def assign(fit: Fit, df: DataFrame, name: str = "cluster", features: str = "features") -> DataFrame:
    """Add the number of each row's nearest centre; the smaller number where two are as near."""
    x = [F.col("__x")[j] for j in range(fit.centres.shape[1])]
    near = [
        sum((v * F.lit(-2 * float(c)) for v, c in zip(x, centre)), F.lit(float((centre**2).sum()))) for centre in fit.centres
    ]
    far = df.withColumn("__x", vector_to_array(features)).withColumn("__d", F.array(*near))
    place = F.array_position("__d", F.array_min("__d")).cast("int") - 1
    return far.withColumn(name, place).drop("__x", "__d")
