"""Mean silhouette with plain Euclidean distances over all rows, without all pairs.

A row needs the sum of its distances to each cluster. Rows of one cluster that lie close together form
a cell, kept as their number n, mean m and mean squared distance v from it. Whatever a cell's rows are,
the sum of their distances from x is at least n |x - m| and at most n sqrt(|x - m|^2 + v), so cells
bound the sums, and with them the row's silhouette, from both sides. One pass compares all rows with at most
``MOST_CELLS`` cells. If the mean of the bounds is not yet known to ``tolerance``, rows with wide bounds are
taken again: for each of their cells that leaves too much open, the cells it divides into are
joined, and so on down to single points. Cells of equal points are exact, so data with few distinct
points need one pass and no bounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.sources.tables import materialise

MOST_CELLS = 8192
WIDTHS = 14  # cell widths tried for the first pass, each half the one before
LEVELS = 12  # each level of refinement has cells a quarter as wide; the last ones are points
ROUNDS = 8
TASK_ROWS = 16_384
STEP_ROWS = 256  # rows compared with all cells at once
OPEN_CELLS = 1 << 18  # open cells that a task gathers before it passes rows on; a step can add more


def _cell(width: float | None) -> Column:
    """The id of a row's cell within its cluster; without a width, of its point."""
    place = F.col("x") if width is None else F.transform("x", lambda v: F.floor(v / width))
    return F.xxhash64("c", place)


def _cells(rows: DataFrame, size: int, width: float | None, parent: Column | None = None) -> DataFrame:
    """Number, mean and mean squared distance of the rows of every cell, within the parent cells if there are any."""
    parents = [] if parent is None else [parent.alias("parent")]
    sums = [F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(size)]
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    cells = rows.groupBy(*parents, "c", _cell(width).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), *sums, F.avg(square).alias("q"), F.min("x").alias("one"), F.max("x").alias("other")
    )
    mean = F.array(*[f"m{j}" for j in range(size)])
    spread = F.col("q") - F.aggregate(mean, F.lit(0.0), lambda s, v: s + v * v)
    same = F.col("one") == F.col("other")  # equal points: no rounding in the mean, and no spread
    return cells.select(
        *["parent"] * len(parents), "c", "cell", "n",
        F.when(same, F.col("one")).otherwise(mean).alias("m"),
        F.when(same, 0.0).otherwise(F.greatest(spread, F.lit(0.0)) + F.lit(1e-13) * F.col("q")).alias("v"),
    )


def _first_pass(cells: dict, sizes: np.ndarray, threshold: float):
    """Rows to their bounds of the distance sums by cluster, and the cells left open."""
    c, ids, n, means, spread = (cells[k] for k in ("c", "cell", "n", "m", "v"))
    cuts = np.searchsorted(c, np.arange(len(sizes)))
    lengths = (means**2).sum(axis=1)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = batch.column("c").to_numpy()
            low, high, scale, opened, begin = [], [], [], [], 0
            for at in range(0, len(x), STEP_ROWS):
                part, mine = x[at : at + STEP_ROWS], own[at : at + STEP_ROWS]
                square = np.maximum((part**2).sum(axis=1)[:, None] + lengths - 2 * part @ means.T, 0)
                least, most = n * np.sqrt(square), n * np.sqrt(square + spread)
                others = sizes - (np.arange(len(sizes)) == mine[:, None])
                middle = np.add.reduceat(least + most, cuts, axis=1) / 2 / np.maximum(others, 1)
                every = np.arange(len(part))
                a = middle[every, mine]
                middle[every, mine] = np.inf
                size = np.maximum(a, middle.min(axis=1))
                share = (most - least) / np.maximum(others, 1)[:, c]
                wide = share > threshold * size[:, None]
                low.append(np.add.reduceat(np.where(wide, 0, least), cuts, axis=1))
                high.append(np.add.reduceat(np.where(wide, 0, most), cuts, axis=1))
                scale.append(size)
                opened += [ids[w] for w in wide]
                end = at + len(part)
                if end < len(x) and sum(map(len, opened)) < OPEN_CELLS:
                    continue
                rows = batch.slice(begin, end - begin)
                yield pa.record_batch(
                    [
                        rows.column("id"),
                        rows.column("c"),
                        rows.column("x"),
                        _lists(np.concatenate(low)),
                        _lists(np.concatenate(high)),
                        pa.array(np.concatenate(scale)),
                        pa.array(opened, pa.list_(pa.int64())),
                    ],
                    ["id", "c", "x", "low", "high", "scale", "opened"],
                )
                low, high, scale, opened, begin = [], [], [], [], end

    return run


def _lists(table: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(0, table.size + 1, table.shape[1]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))


FIRST = """id long, c int, x array<double>, low array<double>, high array<double>, scale double,
    opened array<long>"""


def _bounds(rows: DataFrame, all_rows: DataFrame, cells: dict, sizes: np.ndarray, size: int, width, threshold: float):
    """(id, low, high): bounds of each row's silhouette. A cell is opened if its share of a distance is above the threshold."""
    first = materialise(rows.mapInArrow(_first_pass(cells, sizes, threshold), FIRST), "silhouette-rows")
    sums = [first.select("id", F.posexplode(F.arrays_zip("low", "high")).alias("k", "s")).select("id", "k", "s.low", "s.high")]
    pairs = first.select("id", F.col("c").alias("own"), "x", "scale", F.explode("opened").alias("parent"))
    number = F.element_at(F.array(*[F.lit(int(n)) for n in sizes]), F.col("c") + 1)
    for level in range(1, LEVELS + 1):
        if width is None or pairs.isEmpty():
            break
        finer = width / 4**level if level < LEVELS else None
        divided = _cells(all_rows, size, finer, _cell(width / 4 ** (level - 1)))
        square = F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        near = pairs.join(divided, "parent").withColumn("d", square)
        near = near.withColumns({"low": F.col("n") * F.sqrt("d"), "high": F.col("n") * F.sqrt(F.col("d") + F.col("v"))})
        others = F.greatest(number - (F.col("c") == F.col("own")).cast("int"), F.lit(1))
        wide = (F.col("high") - F.col("low")) / others > F.lit(threshold) * F.col("scale")
        near = materialise(
            near.select("id", "own", "x", "scale", "c", "cell", "low", "high", (wide & (F.col("v") > 0)).alias("wide")),
            "silhouette-pairs",
        )
        sums.append(near.where("not wide").select("id", F.col("c").alias("k"), "low", "high"))
        pairs = near.where("wide").select("id", "own", "x", "scale", F.col("cell").alias("parent"))
    by_cluster = reduce(DataFrame.union, sums).groupBy("id", "k").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    number = F.element_at(F.array(*[F.lit(int(n)) for n in sizes]), F.col("k") + 1)
    mine = F.col("k") == F.col("c")
    met = by_cluster.join(first.select("id", "c"), "id").groupBy("id").agg(
        *[F.max(F.when(mine, F.try_divide(s, number - 1))).alias(f"a_{s}") for s in ("low", "high")],
        *[F.min(F.when(~mine, F.col(s) / number)).alias(f"b_{s}") for s in ("low", "high")],
    )

    def width_of(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(b) - F.col(a), F.greatest(a, b)), F.lit(0.0))

    return met.select("id", width_of("a_high", "b_low").alias("low"), width_of("a_low", "b_high").alias("high"))


def euclidean_silhouette(
    df: DataFrame, cluster: str = "cluster", features: str = "features", tolerance: float = 1e-4
) -> DataFrame:
    """One row (silhouette, low, high, n): the mean over all rows, known to be within ``tolerance`` of the middle.

    Rows without a cluster or features do not count. Rows alone in their cluster count as 0; fewer than two
    clusters have no silhouette. Jobs run when this is called; the driver holds ``MOST_CELLS`` cells and a number a
    cluster.
    """
    spark = df.sparkSession
    base = df.where(F.col(cluster).isNotNull() & F.col(features).isNotNull())
    base = base.select(F.col(cluster).alias("label"), vector_to_array(features).alias("x"))
    stored = materialise(base.withColumn("id", F.monotonically_increasing_id()), "silhouette-points")
    clusters = stored.groupBy("label").count().orderBy("label").collect()
    n = sum(r["count"] for r in clusters)
    schema = "silhouette double, low double, high double, n long"
    if len(clusters) < 2:
        return spark.createDataFrame([(None, None, None, n)], schema)
    numbered = stored.select("label", F.lit(0).alias("c")).schema
    number = spark.createDataFrame([(r.label, i) for i, r in enumerate(clusters)], numbered)
    size = len(stored.first().x)
    moments = stored.agg(
        F.array(*[F.avg(F.col("x")[j]) for j in range(size)]).alias("mean"),
        F.greatest(*[F.stddev_pop(F.col("x")[j]) for j in range(size)], F.lit(0.0)).alias("spread"),
    ).first()
    centre = F.array(*[F.lit(m) for m in moments.mean])
    x = F.zip_with("x", centre, lambda a, b: a - b).alias("x")  # sums of squares lose less near the origin
    rows = stored.join(number, "label").select("id", "c", x)
    # A row meets thousands of cells, so a task gets fewer rows than a file of this size would hold.
    rows = materialise(rows.repartition(-(-n // TASK_ROWS), "id"), "silhouette-centred")
    widths = [moments.spread * 2.0 ** (2 - j) for j in range(WIDTHS)] if moments.spread > 0 else []
    tried = [None, *reversed(widths)]
    counts = rows.agg(*[F.approx_count_distinct(_cell(w), 0.02).alias(f"w{i}") for i, w in enumerate(tried)]).first()
    width = next((w for w, count in zip(tried, counts) if count <= 0.9 * MOST_CELLS), 1e3 * (moments.spread or 1.0))
    found = _cells(rows, size, width).orderBy("c", "cell").collect()
    cells = {k: np.array([r[k] for r in found]) for k in ("c", "cell", "n", "m", "v")}
    sizes = np.array([r["count"] for r in clusters])
    middle = ((F.col("low") + F.col("high")) / 2).alias("silhouette")
    done, rest, threshold = [], rows, np.inf
    for turn in range(ROUNDS):
        bounds = materialise(_bounds(rest, rows, cells, sizes, size, width, threshold), "silhouette-bounds")
        every = reduce(DataFrame.union, [*done, bounds])
        total = every.agg(F.avg("low").alias("low"), F.avg("high").alias("high"), F.count(F.lit(1)).alias("n")).first()
        if total.high - total.low <= 2 * tolerance or turn == ROUNDS - 1 or width is None:
            break
        wide = F.col("high") - F.col("low") > tolerance
        done.append(bounds.where(~wide))
        rest = rows.join(bounds.where(wide).select("id"), "id", "left_semi")
        threshold = tolerance / 16 if turn == 0 else threshold / 8
    result = spark.createDataFrame([(total.low, total.high, total.n)], "low double, high double, n long")
    return result.select(middle, "low", "high", "n")
