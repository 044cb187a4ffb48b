"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactscope.sources.tables import materialise

#: Bytes of text that one vectorised step takes; a longer text is taken alone.
STEP_BYTES = 1 << 18
#: Bytes of text in one run of ``text_runs``.
RUN_BYTES = 1 << 20
#: Rows in one bucket of ``ranked``, about.
BUCKET_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the folder that all executors share, and read back."""
    return materialise(df, f"llm-{name}")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{name}`") for name in names])


def ranked(
    df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, str], rows: int
) -> DataFrame:
    """Number the rows of each group from 0 and add running sums of the rows before.

    Rows are dealt to hash buckets within their group, so that a group with a third of all rows
    is many windows: bucket totals are summed first, and each bucket then goes on from its
    offset. The order is by bucket, then ``order``; it does not depend on the partitioning.
    ``sums`` maps new column names to the columns added up; ``_rank`` has the number.
    """
    buckets = max(1, rows // BUCKET_ROWS)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*groups, "_bucket"]
    totals = dealt.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()]
    )
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums],
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_rank", F.row_number().over(within) - 1).withColumns(
        {k: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for k, c in sums.items()}
    )
    match = [dealt[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return (
        dealt.hint("merge").join(totals, condition)
        .withColumn("_rank", F.col("_rank") + F.col("_n0"))
        .withColumns({k: F.col(k) + F.col(f"_s_{k}") for k in sums})
        .drop("_bucket", "_n0", *[f"_k_{k}" for k in keys], *[f"_s_{k}" for k in sums])
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root: the smallest node.

    In each round every node hands the smallest node it knows to all its neighbours, which are then
    tied to that one instead; reach doubles, until the edges are stars around the smallest nodes.
    A round is one grouped minimum, combined before the shuffle, and one join, over a table in the
    shared folder.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    seen = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = F.inline(
            F.array(
                F.struct(F.greatest("v", "m").alias("hi"), F.least("v", "m").alias("lo")),
                F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")),
            )
        )
        edges = stored(both.join(least, "u").select(tied).where("hi <> lo").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def forest(n: int, pairs: Iterator[tuple]) -> list[tuple[int, int]]:
    """The pairs that join different sets of 0..n-1, in order: a spanning forest."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def mixed(x):
    """A strong mix of unsigned 64-bit numbers (the finaliser of SplitMix64)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def lean(run: Callable) -> Callable:
    """The batch function, giving its memory back at the end of a task.

    Workers are kept for later tasks, and there can be more of them than tasks run at once; what an idle one
    holds counts against its executor.
    """

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Free memory of Arrow's pool and of the C library goes back to the system, where that is possible."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_runs(batches, column: str = "text", limit: int = RUN_BYTES):
    """The batches cut into runs of rows with about ``limit`` bytes in ``column`` at most.

    What a task holds besides a batch is bounded by a run; a longer text is a run of its own.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            start = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def word_hasher(gaps: bytes = b" \t\n\v\f\r") -> Callable:
    """A function from an Arrow string array to (word hashes, offsets of each text, begin, end).

    Words are runs of bytes other than ``gaps``, with A-Z lower-cased. ``begin`` and
    ``end`` are byte places in the text. Hashes are 64 bits; null counts as empty.
    """
    import numpy as np
    import pyarrow as pa

    gap = np.zeros(256, dtype=bool)
    gap[list(gaps)] = True
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    base, inverse = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
    powers = {"n": 0}

    def tables(n: int):
        if powers["n"] < n:
            for key, factor in (("up", base), ("down", inverse)):
                row = np.full(n + 1, factor, dtype=np.uint64)
                row[0] = 1
                powers[key] = np.cumprod(row, dtype=np.uint64)
            powers["n"] = n
        return powers["up"], powers["down"]

    def step(data, starts):
        up, down = tables(max(len(data), STEP_BYTES))
        is_gap = gap[data]
        edge = np.ones(len(data) + 1, dtype=bool)
        edge[1:-1] = is_gap[1:] != is_gap[:-1]
        edge[starts] = True
        places = np.flatnonzero(edge)
        begin, end = places[:-1], places[1:]
        word = ~is_gap[begin]
        begin, end = begin[word], end[word]
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=total[1:])
        hashes = (total[end] - total[begin]) * down[begin]
        return mixed(hashes + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begin, end

    def run(texts):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        if n == 0 or texts.buffers()[2] is None:
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), np.zeros(n + 1, np.int64), none, none
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        parts, at = [], 0
        with np.errstate(over="ignore"):
            while at < n:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES)) - 1)
                to = min(to, n)
                span = data[offsets[at] : offsets[to]]
                starts = offsets[at:to] - offsets[at]
                if len(span):
                    hashes, begin, end = step(span, starts[starts < len(span)])
                    owner = np.searchsorted(offsets[at : to + 1] - offsets[at], begin, "right") - 1
                    own = (offsets[at:to] - offsets[at])[owner]
                    parts.append((hashes, owner + at, begin - own, end - own))
                at = to
        if not parts:
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), np.zeros(n + 1, np.int64), none, none
        hashes, owner, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        return hashes, np.searchsorted(owner, np.arange(n + 1)), begin, end

    return run


def window_hashes(words, k: int):
    """Hashes of every run of ``k`` words; of the whole sequence, where it is shorter."""
    import numpy as np

    k = min(k, len(words))
    if k == 0:
        return words
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
    return out
