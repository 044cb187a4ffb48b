"""Best-fit packing of documents into sequences by linear grouping.

1. Documents become token ids and an end id; one longer than a sequence is cut into whole sequences,
   its first piece taking what is left over.
2. Lengths are counted: at most ``capacity`` numbers, whatever the data. All planning is on counts.
3. Large pieces, longest first, are cut into groups of equal cardinality, and each group's lengths
   are rounded up to its longest. The few sizes left are packed by configurations: the largest size
   still wanted, and the fullest combination of other sizes beside it, used as often as the counts
   allow, and again until all are placed.
4. The pieces themselves take the places of their group by their rank. They are no longer than it.
5. The room that is really left in each sequence is counted, and small pieces go, longest first,
   to the tightest room that holds them, many sequences of one room at a time; new sequences open
   only when no room is left.

Pieces learn their place by joining their (length, rank) to the plan, whose rows are bounded by
``capacity`` and ``groups``, so its broadcast is too. Ranks of a length that a third of all rows
share are counted in buckets.

Defined results: null and empty texts are one piece, the end id alone; repeated rows are packed each;
rows without an id are packed; other columns are passed by. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactscope.llm.common import lean, ranked, stored, text_runs
from contactscope.llm.tokens import VOCABULARY, batch_encoder

CAPACITY = 1024
END_ID = 2
ENCODE_BYTES = 1 << 20  # of text encoded at once; that takes several times the text
GROUPS = 256
SMALL = 64  # pieces up to this length are placed last, by best fit


def _pieces(capacity: int, end_id: int, vocabulary: str):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = batch_encoder(vocabulary)
        for batch in text_runs(batches, limit=ENCODE_BYTES):
            ids, offsets = encode(batch.column("text"))
            size = np.diff(offsets) + 1
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = size - (n - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
            end = np.array([end_id], "<u4").tobytes()
            crc = np.empty(len(doc), np.int64)
            for k, (d, at, long) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                lo = int(offsets[d]) + at
                if at + long == size[d]:
                    crc[k] = zlib.crc32(end, zlib.crc32(raw[4 * lo : 4 * (lo + long - 1)]))
                else:
                    crc[k] = zlib.crc32(raw[4 * lo : 4 * (lo + long)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start.astype(np.int64)),
                    pa.array(length.astype(np.int64)),
                    pa.array(crc),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY
) -> DataFrame:
    """doc_id, piece, start, length and CRC-32 of the ids of every piece of every document."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(
        lean(_pieces(capacity, end_id, vocabulary)),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint",
    )


def _fullest(room: int, sizes: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """(index, copies) of the combination of sizes that fills ``room`` best; a bit set of sums."""
    sums, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for k, size in enumerate(sizes):
        for _ in range(min(counts[k], room // size)):
            grown = sums | (sums << size) & mask
            steps.append((k, sums))
            if grown == sums:
                break
            sums = grown
        if sums >> room:
            break
    at, chosen = sums.bit_length() - 1, {}
    for k, before in reversed(steps):
        if not before >> at & 1:
            chosen[k] = chosen.get(k, 0) + 1
            at -= sizes[k]
    return sorted(chosen.items())


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple], int]:
    """Places for pieces of the counted lengths: rows (length, lo, hi, base, times, shift).

    The piece of a length with rank r, lo <= r < hi, goes to sequence base + (r - shift) % times.
    Also gives the number of sequences.
    """
    total = sum(counts.values())
    if not total:
        return [], 0
    each = -(-total // groups)
    # Equal-cardinality groups over the lengths, longest first: (rounded size, [(length, lo, hi)]).
    grouped: list[tuple[int, list]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        at = 0
        while at < counts[length]:
            if room == 0:
                grouped.append((length, []))
                room = each
            take = min(room, counts[length] - at)
            grouped[-1][1].append((length, at, at + take))
            at, room = at + take, room - take
    sizes = [size for size, _ in grouped]
    left = [sum(hi - lo for _, lo, hi in parts) for _, parts in grouped]
    queues = [list(reversed(parts)) for _, parts in grouped]
    rows, base = [], 0
    largest = 0
    while largest < len(sizes):
        if not left[largest]:
            largest += 1
            continue
        left[largest] -= 1
        beside = _fullest(capacity - sizes[largest], sizes[largest:], left[largest:])
        left[largest] += 1
        config = {largest: 1}
        for k, n in beside:
            config[largest + k] = config.get(largest + k, 0) + n
        times = min(left[k] // n for k, n in config.items())
        for k, n in config.items():
            left[k] -= n * times
            for _ in range(n):  # one place in each of the sequences
                want, done = times, 0
                while want:
                    length, lo, hi = queues[k].pop()
                    take = min(want, hi - lo)
                    if take < hi - lo:
                        queues[k].append((length, lo + take, hi))
                    rows.append((length, lo, lo + take, base + done, times - done, lo))
                    want, done = want - take, done + take
        base += times
    return rows, base


def plan_small(
    counts: dict[int, int], rooms: dict[int, int], capacity: int
) -> tuple[list[tuple], int]:
    """Best fit on counts: rows (length, lo, hi, room, first) and the number of new sequences.

    The piece of a length with rank r, lo <= r < hi, goes to the sequence with rank
    first + r - lo among those whose room was ``room``; room -1 stands for the new sequences.
    """
    classes: dict[int, list] = {}  # room now: [(room at first, first rank, end rank)]
    for room, n in rooms.items():
        if room > 0 and n:
            classes.setdefault(room, []).append((room, 0, n))
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        at, n = 0, counts[length]
        while at < n:
            fit = [room for room in classes if room >= length]
            if not fit:
                more = -(-(n - at) // (capacity // length))
                classes.setdefault(capacity, []).append((-1, opened, opened + more))
                opened += more
                continue
            room = min(fit)
            origin, a, b = classes[room].pop()
            take = min(b - a, n - at)
            if take < b - a:
                classes[room].append((origin, a + take, b))
            if not classes[room]:
                del classes[room]
            rows.append((length, at, at + take, origin, a))
            if room > length:
                classes.setdefault(room - length, []).append((origin, a, a + take))
            at += take
    return rows, opened


def _plan_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A plan, whose rows are bounded by the capacity and the groups, never by the data."""
    return F.broadcast(spark.createDataFrame(rows, columns))


def pack(
    cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL
) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = cut.sparkSession
    cut = stored(cut, "pack-pieces")
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    placed = stored(ranked(cut, ["length"], order, {}, cut.count()), "pack-ranked")
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = counts.pop(capacity, 0)
    large, opened = plan_large({k: n for k, n in counts.items() if k > small}, capacity, groups)
    plan = _plan_table(
        spark, large, "length long, lo long, hi long, base long, times long, shift long"
    ).withColumnRenamed("length", "_length")
    in_range = (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    names = cut.columns
    large_rows = (
        placed.join(plan, (F.col("length") == F.col("_length")) & in_range)
        .withColumn("sequence_id", F.expr("base + (_rank - shift) % times"))
        .select(*names, "sequence_id")
    )
    large_rows = stored(large_rows, "pack-large")
    rooms = large_rows.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    rooms = stored(ranked(rooms, ["room"], [F.col("sequence_id")], {}, opened), "pack-rooms")
    free = {r["room"]: r["n"] for r in rooms.groupBy("room").agg(F.count(F.lit(1)).alias("n")).collect()}
    fits, new = plan_small({k: n for k, n in counts.items() if k <= small}, free, capacity)
    plan = _plan_table(
        spark, fits, "length long, lo long, hi long, room long, first long"
    ).withColumnRenamed("length", "_length")
    small_rows = (
        placed.join(plan, (F.col("length") == F.col("_length")) & in_range)
        .withColumn("_at", F.col("first") + F.col("_rank") - F.col("lo"))
        .select(*names, F.col("room").alias("_room"), "_at")
    )
    fresh = small_rows.where("_room = -1").select(*names, (F.col("_at") + opened).alias("sequence_id"))
    rooms = rooms.select("room", F.col("_rank").alias("_n"), "sequence_id")
    fitted = small_rows.where("_room <> -1").join(
        rooms, (F.col("_room") == F.col("room")) & (F.col("_at") == F.col("_n"))
    )
    full = placed.where(F.col("length") == capacity).select(
        *names, (F.col("_rank") + opened + new).alias("sequence_id")
    )
    everything = large_rows.union(fitted.select(*names, "sequence_id")).union(fresh)
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32")
    before = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1))
    offsets = everything.withColumn("offset", F.coalesce(before, F.lit(0)).cast("bigint"))
    return offsets.union(full.withColumn("offset", F.lit(0).cast("bigint"))) if whole else offsets
