"""CSV records with quoted line breaks, read from all splits of a file at once.

A split of a text file begins at a line, but a line may begin inside a quoted cell. What a line does to
that state is a function of two values (outside, inside), and such functions compose: a first pass
gives one function a split, composing them in the order of a file's splits tells where each split
begins, and a second pass cuts every split into records on its own. The lines of a record that
crosses splits come from a third pass over the files concerned, which is left out if there is none; at most two
such pieces a split are put together by a shuffle. The driver holds one small row a split, as it does
for the splits themselves.

A quote opens a cell only where the cell begins; inside, two quotes are one; behind the closing quote the cell goes on
as plain text up to the separator. Records end in a line feed, which may follow a carriage return. Empty lines
outside quotes are no records. A cell that is never closed takes the rest of its file.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A longer record is taken for a quote that was never closed.
MAX_RECORD = 256 << 20

# A cell: quoted, perhaps with plain text behind the closing quote; or plain, with quotes as they are; or empty.
CELL = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
# Lines that end outside quotes, by the state they begin in; all others end inside.
OUT_OUT = f"(?s)^{CELL}(?:,{CELL})*$"
IN_OUT = f'(?s)^(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{CELL})*$'

PIECES = "file long, start long, opens boolean, value string"


def _steps(lines: pa.Array) -> tuple:
    """For each line the state after it if it begins outside, and if it begins inside."""
    outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(quoted):
        some = lines.take(pa.array(quoted))
        for out, pattern in ((outside, OUT_OUT), (inside, IN_OUT)):
            out[quoted] = ~pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
    return outside, inside


def _states(outside, inside, begins: bool):
    """The state before each line, and after the last one."""
    n = len(outside)
    fixed = np.flatnonzero(outside == inside)  # these lines end in one state whatever they begin in
    flips = np.concatenate([[0], np.cumsum(outside & ~inside)])
    last = np.zeros(n + 1, np.int64)
    last[fixed + 1] = fixed + 1
    last = np.maximum.accumulate(last)  # 0: none so far, else the number of lines up to the last one
    from_state = np.where(last > 0, outside[last - 1] if n else False, begins)
    return from_state ^ ((flips - flips[last]) % 2).astype(bool)


def _runs(batches: Iterable) -> Iterable:
    """((file, start of the split), its lines) for the stretches of each batch that lie in one split."""
    for batch in batches:
        file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(file)]):
            if a < b:
                yield (int(file[a]), int(start[a])), batch.column("value").slice(a, b - a)


def _summaries(batches):
    """One row a split with quotes: the state after it, if it begins outside, and if it begins inside."""
    found: dict[tuple, tuple] = {}
    for split, lines in _runs(batches):
        now, steps = found.get(split, (False, True)), _steps(lines)
        found[split] = tuple(bool(_states(*steps, begins)[-1]) for begins in now)
    if found:
        file, start = zip(*found)
        yield pa.record_batch([pa.array(c) for c in (file, start, *zip(*found.values()))], ["file", "start", "out", "ins"])


def _joined(lines: pa.Array, starts) -> pa.Array:
    """Records from the lines at ``starts`` on, each up to the next start."""
    offsets = pa.array(np.append(starts, len(lines)), pa.int32())
    if len(starts) == len(lines):
        return lines
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")


class _Cutter:
    """Cuts one split into records; keeps the pieces of records that begin or end outside it."""

    def __init__(self, inside: bool):
        self.state = inside
        self.head: list[str] = []  # lines of a record of an earlier split
        self.open: list[str] = []  # lines of a record that has not ended yet
        self.size = 0
        self.first = True  # no record has begun so far
        self.open_is_first = False

    def _add(self, to: list[str], lines: pa.Array) -> None:
        to.extend(lines.to_pylist())
        self.size += lines.nbytes
        if self.size > MAX_RECORD:
            raise ValueError(f"a quoted cell of over {MAX_RECORD} bytes: is its quote ever closed?")

    def cut(self, lines: pa.Array) -> Iterable[tuple[pa.Array, bool]]:
        """Whole records, and whether the first of them is the first of the split."""
        states = _states(*_steps(lines), self.state)
        starts = np.flatnonzero(~states[:-1])
        self.state = bool(states[-1])
        before = int(starts[0]) if len(starts) else len(lines)
        if before:
            self._add(self.head if self.first else self.open, lines.slice(0, before))
        if self.open and (len(starts) or not self.state):
            yield pa.array(["\n".join(self.open)]), self.open_is_first
            self.open = []
        if not len(starts):
            return
        self.size = 0
        whole, stop = starts, len(lines)
        if self.state:
            whole, stop = starts[:-1], int(starts[-1])
        was_first, self.first = self.first, False
        if self.state:
            self._add(self.open, lines.slice(stop))
            self.open_is_first = was_first and not len(whole)
        if len(whole):
            yield _joined(lines.slice(before, stop - before), whole - before), was_first


def _begins_inside(turns: dict, split: tuple) -> bool:
    """``turns`` has for each file the splits that end in another state than they begin in, and that state."""
    own = turns.get(split[0], [])
    at = bisect_left(own, (split[1],))
    return at > 0 and own[at - 1][1]


def _by_split(batches, turns: dict, work: Callable) -> Iterable:
    """``work(split, cutter, lines)`` for all lines, then ``work(split, cutter, None)``, split by split."""
    split = cutter = None
    for now, lines in _runs(batches):
        if now != split:
            if cutter:
                yield from work(split, cutter, None)
            split, cutter = now, _Cutter(_begins_inside(turns, now))
        yield from work(split, cutter, lines)
    if cutter:
        yield from work(split, cutter, None)


def _fine(records: pa.Array) -> pa.Array:
    """Without carriage returns at the end, and without empty records."""
    ended = pc.ends_with(records, "\r")
    records = pc.if_else(ended, pc.utf8_slice_codeunits(records, 0, -1), records) if pc.any(ended).as_py() else records
    return records.filter(pc.not_equal(records, ""))


def _records(turns: dict, header: bool):
    def work(split, cutter, lines):
        if lines is None:
            return
        for records, first in cutter.cut(lines):
            yield pa.record_batch([_fine(records.slice(int(header and first and split[1] == 0)))], ["value"])

    def run(batches):
        return _by_split(batches, turns, work)

    return run


def _pieces(turns: dict, header: bool):
    """The lines of each split that belong to records which cross its begin or end, and whether they open one."""

    def work(split, cutter, lines):
        if lines is not None:
            for _ in cutter.cut(lines):
                pass
            return
        rows = [(*split, False, "\n".join(cutter.head))] if cutter.head else []
        if cutter.open:
            is_header = header and cutter.open_is_first and split[1] == 0
            rows.append((*split, True, None if is_header else "\n".join(cutter.open)))
        if rows:
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.string()))],
                ["file", "start", "opens", "value"],
            )

    def run(batches):
        return _by_split(batches, turns, work)

    return run


def records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(value): one row a CSV record, quotes and line breaks as they are; without each file's header."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    quoted = lines.where(F.contains("value", F.lit('"')))  # other lines change nothing
    files = defaultdict(list)
    for file, *split in quoted.mapInArrow(_summaries, "file long, start long, out boolean, ins boolean").collect():
        files[file].append(split)
    # A split without quotes that lies inside a record is found as one that does not come up here.
    turns: dict[int, list[tuple]] = {}
    crossed = False
    for file, splits in files.items():
        state, turns[file] = False, []
        for start, out, ins in sorted(splits):
            after = ins if state else out
            crossed |= after
            if after != state:
                turns[file].append((start, after))
            state = after
    whole = lines.mapInArrow(_records(turns, header), "value string")
    if not crossed:
        return whole
    pieces = lines.mapInArrow(_pieces(turns, header), PIECES)
    in_order = Window.partitionBy("file").orderBy("start", "opens")  # two pieces a split at most
    pieces = pieces.withColumn("record", F.count_if("opens").over(in_order)).groupBy("file", "record")
    parts = pieces.agg(F.array_sort(F.collect_list(F.struct("start", "opens", "value"))).alias("p"))
    parts = parts.where(F.col("p")[0]["value"].isNotNull())  # not a header
    value = F.regexp_replace(F.array_join("p.value", "\n"), "\\r\\z", "")
    return whole.union(parts.select(value.alias("value")).where("value <> ''"))
