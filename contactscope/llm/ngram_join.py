"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents are rows and distinct word n-grams (64-bit hashes) are columns of a 0/1 matrix A. Two
documents link when the Jaccard similarity of their rows is at least ``num / den``; A times its
transpose holds the overlaps. Only blocks of it that can hold a link are computed:

1. Rows with equal sets are one class; a class is one row of the matrix from here on.
2. Columns are cut into ranges of their hash. A linking pair differs in fewer columns than a bound
   from its sizes, so with more ranges than that it agrees on a whole range. Rows that agree on a
   range that is not empty are candidates; a row block is closed over them. Columns that are frequent
   in a bounded sample are left out of the ranges. That only moves work: a row with so many empty
   ranges that the bound could rest on them offers its first ``a - ceil(a * num / den) + 1`` columns
   (a: its size; frequent columns last), of which two such linking rows share one.
3. Row blocks grow faster than the input, since few rows that agree on a range link. So rows are compared by
   parity sketches first: bit i tells whether an odd number of columns falls on i. Sketches differ in no more
   bits than the rows differ in columns, so no link is lost; a sketch has one to two bits a column, where a row has 64. Row blocks
   are closed anew over the pairs that are left, and only rows in these go on.
4. Within a row block the product is accumulated over slices of columns. After each slice the
   pairs that cannot reach their least overlap any more, given the sizes that remain, are
   discarded. Blocks of more than ``BLOCK_ROWS`` rows are tasks of their own. Those with more than
   ``TILE_COLUMNS`` entries for each of them are cut into bands of sizes, of which only neighbours can link, and
   bands into tiles of so many entries; pairs of tiles are separate tasks. A row travels once for
   every tile it is compared with, so tiles are large; a task takes them in parts, ordered by size.
5. A task returns a spanning forest of its links, never all pairs; links are closed into components.

Defined results: null text counts as empty; an empty row links with nothing; repeated rows and
repeated ids are rows of one class; the component of a row without an id is that of its class, and
texts that only rows without an id have link with nothing. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactscope.llm.common import (
    components,
    forest,
    give_back,
    lean,
    mixed,
    stored,
    text_runs,
    window_hashes,
    word_hasher,
)

#: Up to so many rows of ids (of some 100 bytes) are sent to every task.
BROADCAST_ROWS = 250_000
BLOCK_ROWS = 1024  # rows of one product's side, and about the rows of small blocks in one task
TILE_COLUMNS = 1024  # entries of one tile's side (8 bytes each), times BLOCK_ROWS
PART_COLUMNS = 256  # entries of one product's side, times BLOCK_ROWS; a longer row is taken alone
SLICE_COLUMNS = 4096
SKETCH_BITS = 64  # of a sketch, at least
SKETCH_TILE, SKETCH_PART = 4096, 1024  # as TILE_COLUMNS and PART_COLUMNS, where sketches are compared
SLICE_BYTES = 2048  # of sketches
SAMPLE_DOCS = 8_000  # about; documents in which frequent columns are looked for
FREQUENT_DOCS = 8  # a column in so many of them is frequent
FREQUENT_COLUMNS = 1 << 18  # at most, the most frequent ones
FLUSH_ROWS = 200_000  # offers that a task gathers before it passes them on


def _incidence(n: int, extra: str):
    """A batch function: the row of each text as a sorted array of distinct n-gram hashes."""

    def rows(batches):
        import numpy as np

        hashes_of = word_hasher()
        for batch in text_runs(batches):
            words, offsets, _, _ = hashes_of(batch.column("text"))
            cut = [
                np.unique(window_hashes(words[a:b], n))
                for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            yield batch.column(extra), cut

    return rows


def _columns(n: int):
    """The columns of the batch's rows with the number of rows in each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, rows in _incidence(n, "doc_id")(batches):
            found, times = np.unique(np.concatenate([*rows, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["col", "n"]
            )

    return run


def _frequent(docs: DataFrame, n: int):
    """The sample's frequent columns as sorted hashes, and the rank of each: rarer ones first."""
    import numpy as np

    total = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20))
    sample = docs.where(draw < math.ceil((1 << 20) * min(1.0, SAMPLE_DOCS / max(total, 1))))
    counts = sample.mapInArrow(lean(_columns(n)), "col bigint, n bigint").groupBy("col").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT_DOCS).orderBy(F.desc("n"), "col").limit(FREQUENT_COLUMNS)
    found = top.collect()
    columns = np.array([r["col"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(columns)
    ranks = np.arange(len(found), 0, -1)  # the most frequent one comes last
    return columns[order], ranks[order]


def _set_key(h) -> tuple[int, int]:
    """Two 64-bit sums that stand for the set of hashes."""
    import numpy as np

    with np.errstate(over="ignore"):
        one = mixed(h + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        two = mixed(h ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _sizes(n: int):
    """Id, size and set key of each row."""

    def run(batches):
        import pyarrow as pa

        for ids, rows in _incidence(n, "doc_id")(batches):
            keys = [_set_key(h) for h in rows]
            arrays = [ids, *[pa.array(c, pa.int64()) for c in ([len(h) for h in rows], [k[0] for k in keys], [k[1] for k in keys])]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "d1", "d2"])

    return run


def ranges_for(differ: int) -> int:
    """The number of ranges used where rows may differ in so many columns: the next of 1.5^i."""
    count = 1
    while count < differ + 1:
        count = -(-count * 3 // 2)
    return count


def offers(h, num: int, den: int, known, ranks):
    """Hashes of which two linking rows share one; ``h`` is a sorted row, its equals are no matter."""
    import numpy as np

    def differ(total: int) -> int:
        """The most columns in which linking rows of so many columns in total can differ."""
        return total * (den - num) // (den + num)

    def own_ranges(size: int) -> int:
        """As many as a partner of this size or larger needs; 1 where only an equal row can link."""
        return ranges_for(differ(size + size * den // num))

    a = len(h)
    rank = np.zeros(a, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[at] == h, ranks[at], 0)
    rare = h[rank == 0]
    with np.errstate(over="ignore"):
        x = mixed(rare + np.uint64(0xA0761D6478BD642F))
        out, short = [], False
        # The smallest partner decides the lowest number of ranges under which this row is sought.
        lowest, highest = own_ranges(-(-a * num // den)), own_ranges(a)
        count = lowest
        while count <= highest:
            if count > 1:
                block = (rare >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
                first = np.flatnonzero(np.append(True, np.diff(block) != 0)) if len(rare) else np.empty(0, np.int64)
                if len(first):
                    salt = np.uint64(count) * np.uint64(0x9E3779B97F4A7C15)
                    out.append(mixed(np.add.reduceat(x, first) + mixed(block[first] + salt)))
                bound = differ(a + a * den // num) if count == highest else differ(2 * a)
                short |= len(first) - min(bound, count - 1) < 1
            count = -(-count * 3 // 2)
        if short:
            take = a - -(-a * num // den) + 1
            order = np.argsort(rank, kind="stable")[:take]
            out.append(mixed(h[order] ^ np.uint64(0x94D049BB133111EB)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _offered(n: int, num: int, den: int, frequent):
    """(offer, d1) of each class, once a task; of classes that share an offer within the task only the
    smallest goes on under it, and the others are tied to that one (offer null, d1, b)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, ranks = frequent.value
        done: set = set()
        held: list = []
        rows = 0

        def flush():
            offer = np.concatenate([o for o, _ in held])
            d1 = np.concatenate([np.full(len(o), d, np.int64) for o, d in held])
            order = np.lexsort((d1, offer))
            offer, d1 = offer[order], d1[order]
            new = np.append(True, offer[1:] != offer[:-1])
            least = d1[new][np.cumsum(new) - 1]
            ties = np.unique(np.stack([d1[~new], least[~new]], axis=1), axis=0) if (~new).any() else np.empty((0, 2), np.int64)
            ties = ties[ties[:, 0] != ties[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(offer[new].view(np.int64)), pa.array(d1[new]), pa.nulls(int(new.sum()), pa.int64())],
                ["offer", "d1", "b"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(ties), pa.int64()), pa.array(ties[:, 0]), pa.array(ties[:, 1])],
                ["offer", "d1", "b"],
            )

        for _, incidence in _incidence(n, "doc_id")(batches):
            for h in incidence:
                key = _set_key(h)
                if not len(h) or key in done:
                    continue
                if len(done) > 1_000_000:
                    done.clear()  # only saves work: a class may make its offers twice
                done.add(key)
                found = offers(h, num, den, known, ranks)
                if len(found):
                    held.append((found, key[0]))
                    rows += len(found)
            if rows > FLUSH_ROWS:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return run


def _tied(batches):
    """Rows sorted by (offer, d1): each class tied to the smallest with its offer; ties pass through."""
    import numpy as np
    import pyarrow as pa

    offer = least = None
    for batch in batches:
        given = batch.column("b")
        ties = batch.filter(given.is_valid())
        yield pa.RecordBatch.from_arrays([ties.column("d1"), ties.column("b")], ["a", "b"])
        batch = batch.filter(given.is_null())
        if not batch.num_rows:
            continue
        offers_, d1 = batch.column("offer").to_numpy(), batch.column("d1").to_numpy()
        new = np.append(offers_[0] != offer if offer is not None else True, offers_[1:] != offers_[:-1])
        group = np.cumsum(new)
        firsts = np.append(least if least is not None else d1[0], d1[new])
        b = firsts[group]
        offer, least = offers_[-1], b[-1]
        keep = d1 != b
        yield pa.RecordBatch.from_arrays([pa.array(d1[keep]), pa.array(b[keep])], ["a", "b"])


def tile_links(left: list, right: list | None, num: int, den: int, slice_columns: int):
    """A spanning forest of the links within ``left``, or between ``left`` and ``right``.

    Both are lists of sorted hash arrays. Yields index pairs; right indices go on after the left.
    """
    import numpy as np

    same = right is None
    rows = left if same else [*left, *right]
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    column = (np.cumsum(times > 1) - 1)[column]
    cut = len(left)
    a, b = sizes[:cut], sizes if same else sizes[cut:]
    total = a[:, None] + b[None, :]
    least = -(-num * total // (den + num))  # the smallest overlap that links
    alive = np.minimum(a[:, None], b[None, :]) >= least
    alive &= (a > 0)[:, None]
    if same:
        alive &= np.arange(cut)[:, None] < np.arange(cut)[None, :]
    overlap = np.zeros(total.shape, dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    left_of = np.bincount(owner, minlength=len(rows))
    for at in range(0, width, slice_columns):
        rest = np.minimum(left_of[:cut, None], (left_of if same else left_of[cut:])[None, :])
        alive &= overlap + rest >= least
        if not alive.any():
            return
        lo, hi = np.searchsorted(column, [at, at + slice_columns])
        part = np.zeros((len(rows), min(slice_columns, width - at)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        overlap += part[:cut] @ (part if same else part[cut:]).T
        left_of = left_of - np.bincount(owner[lo:hi], minlength=len(rows))
    x, y = np.nonzero(alive & (overlap >= least))
    yield from forest(len(rows), zip(x.tolist(), (y if same else y + cut).tolist(), strict=True))


def sketch(h):
    """The row's size, and its parity sketch: a power of two of bits, as many as columns or more."""
    import numpy as np

    bits = max(SKETCH_BITS, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.append(np.uint64(len(h)), np.packbits(odd.astype(np.uint8)).view(np.uint64))


def sketch_links(left: list, right: list | None, num: int, den: int, slice_bytes: int):
    """A spanning forest of the pairs that can link by their sketches, as ``tile_links`` has it of the links.

    Sketches of each side have one width; the wider ones are folded: of columns that fall on one bit, the parity stays.
    """
    import numpy as np

    same = right is None
    width = min(len(left[0]), len((right or left)[0])) - 1

    def folded(rows):
        table = np.stack([r[1:] for r in rows])
        while table.shape[1] > width:
            half = table.shape[1] // 2
            table = table[:, :half] ^ table[:, half:]
        return np.ascontiguousarray(table).view(np.uint8)

    def bits(table, at):
        return np.unpackbits(table[:, at : at + slice_bytes], axis=1).astype(np.float32)

    a = np.array([int(r[0]) for r in left])
    b = a if same else np.array([int(r[0]) for r in right])
    total = a[:, None] + b[None, :]
    most = total * (den - num) // (den + num)  # columns in which a linking pair can differ
    alive = np.abs(a[:, None] - b[None, :]) <= most
    if same:
        alive &= np.arange(len(a))[:, None] < np.arange(len(a))[None, :]
    one = folded(left)
    two = one if same else folded(right)
    differ = np.zeros(total.shape, np.int64)
    for at in range(0, width * 8, slice_bytes):
        if not alive.any():
            return
        x = bits(one, at)
        y = x if same else bits(two, at)
        both = (x @ y.T).astype(np.int64)
        differ += x.sum(axis=1).astype(np.int64)[:, None] + y.sum(axis=1).astype(np.int64)[None, :] - 2 * both
        alive &= differ <= most
    x, y = np.nonzero(alive)
    yield from forest(
        len(a) if same else len(a) + len(b), zip(x.tolist(), (y if same else y + len(a)).tolist(), strict=True)
    )


def _parts(rows: list, block_rows: int, columns: int = 0, size=len) -> list:
    """Runs of places of ``rows``, by size, with a bounded number of rows and entries and one width of sketches each."""
    import numpy as np

    sizes = np.array([size(r) for r in rows], np.int64)
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    widths = np.array([len(rows[k]) for k in order]) if size is not len else np.zeros(len(order), np.int64)
    out, at = [], 0
    while at < len(order):
        start = int(ends[at - 1]) if at else 0
        to = int(np.searchsorted(ends, start + block_rows * (columns or PART_COLUMNS), side="right"))
        to = min(to, int(np.searchsorted(widths, widths[at], side="right")))
        to = max(at + 1, min(to, at + block_rows))
        out.append(order[at:to])
        at = to
    return out


def block_links(
    left: list, right: list | None, num: int, den: int, slice_columns: int, block_rows: int, sketches: bool = False
):
    """``tile_links`` in parts of bounded size; parts whose sizes are too far apart to link are not compared.

    With ``sketches`` the rows are sketches, ``slice_columns`` is in bytes of them, and ``sketch_links`` is used.
    """
    links, size = (sketch_links, lambda r: int(r[0])) if sketches else (tile_links, len)
    columns = SKETCH_PART if sketches else PART_COLUMNS

    def near(a: list, b: list) -> bool:
        """Whether a row of ``a`` and one of ``b``, both by size, can link."""
        return size(a[-1]) * den >= size(b[0]) * num and size(b[-1]) * den >= size(a[0]) * num

    ours = [(at, [left[k] for k in at]) for at in _parts(left, block_rows, columns, size)]
    theirs = (
        []
        if right is None
        else [(at + len(left), [right[k] for k in at]) for at in _parts(right, block_rows, columns, size)]
    )

    def found():
        for i, (at, rows) in enumerate(ours):
            if right is None:
                for x, y in links(rows, None, num, den, slice_columns):
                    yield int(at[x]), int(at[y])
            for at2, rows2 in ours[i + 1 :] if right is None else theirs:
                if near(rows, rows2):
                    for x, y in links(rows, rows2, num, den, slice_columns):
                        yield int(at[x]), int(at2[y - len(rows)])

    return forest(len(left) + len(right or []), found())


def _arrays(column) -> list:
    """The hashes of each row of a binary column, without a copy of them."""
    import numpy as np
    import pyarrow as pa

    out = []
    for chunk in column.chunks:
        kind = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        _, places, data = chunk.buffers()
        if not len(chunk):
            continue
        ends = np.frombuffer(places, kind)[chunk.offset : chunk.offset + len(chunk) + 1]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out.append(np.frombuffer(data, np.uint64, (b - a) // 8, a) if b > a else np.empty(0, np.uint64))
    return out


def _links(num: int, den: int, slice_columns: int, block_rows: int, sketches: bool = False):
    def run(table):
        import numpy as np
        import pyarrow as pa

        hashes = _arrays(table.column("row"))
        frame = table.select(["family", "own", "one", "two", "cls"]).to_pandas()
        found = []
        for _, block in frame.groupby(["family", "one", "two"]):
            block = block.drop_duplicates("cls")
            cls = block["cls"].to_numpy()
            rows = [hashes[at] for at in block.index]
            first = (block["own"] == block["one"]).to_numpy()
            cut = int(first.sum())
            if cut == len(rows):
                pairs = block_links(rows, None, num, den, slice_columns, block_rows, sketches)
            elif cut:
                order = np.argsort(~first, kind="stable")
                cls, rows = cls[order], [rows[k] for k in order]
                pairs = block_links(rows[:cut], rows[cut:], num, den, slice_columns, block_rows, sketches)
            else:
                continue
            found += [(cls[x], cls[y]) for x, y in pairs]
        give_back()
        return pa.table([pa.array([link[side] for link in found], pa.string()) for side in (0, 1)], names=["a", "b"])

    return run


def _rows(n: int, sketches: bool):
    """The rows of the classes' own documents, or their sketches; other texts under a repeated id are left out."""

    def run(batches):
        import pyarrow as pa

        for cls, rows in _incidence(n, "cls")(batches):
            keys = ["{:X}:{:X}".format(*(k % (1 << 64) for k in _set_key(r))) for r in rows]
            own = [k for k, c in enumerate(cls.to_pylist()) if keys[k] == c]
            yield pa.RecordBatch.from_arrays(
                [cls.take(pa.array(own, pa.int64())), pa.array([(sketch(rows[k]) if sketches else rows[k]).tobytes() for k in own], pa.binary())],
                ["cls", "row"],
            )

    return run


def _tile_tasks(chosen: DataFrame, num: int, den: int, block_rows: int, columns: int = TILE_COLUMNS) -> DataFrame:
    """cls, family, its own tile, and the pair of tiles (one, two) of each task it takes part in."""
    most = block_rows * columns
    size = [F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("entries")]
    many = chosen.join(chosen.groupBy("family").agg(*size), "family")
    # Sizes of a linking pair differ by at most one band.
    band = F.floor(F.log(F.col("n_shingles")) / math.log(den / num)).cast("int")
    many = many.withColumn("band", F.when(F.col("entries") > most, band).otherwise(0))
    cells = many.groupBy("family", "band").agg(F.ceil(F.sum("n_shingles") / most).cast("int").alias("tiles"))
    own = many.join(cells, ["family", "band"])
    own = own.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    met = own.join(cells.select("family", F.col("band").alias("b2"), F.col("tiles").alias("t2")), "family")
    met = met.where(F.abs(F.col("band") - F.col("b2")) <= 1).withColumn(
        "p2", F.explode(F.expr("sequence(0, t2 - 1)"))
    )
    here = F.struct(F.col("band").alias("b"), F.col("part").alias("p"))
    there = F.struct(F.col("b2").alias("b"), F.col("p2").alias("p"))
    name = lambda s: F.concat_ws(".", s["b"], s["p"])
    return met.select(
        "cls",
        "family",
        (F.col("n") > block_rows) | (F.col("entries") > most),
        name(here).alias("own"),
        name(F.least(here, there)).alias("one"),
        name(F.greatest(here, there)).alias("two"),
    ).toDF("cls", "family", "large", "own", "one", "two")


def _by_size(rows: int) -> str:
    """How a list of so many rows meets the texts: sent to all tasks while it is short, so that texts stay in place."""
    return "broadcast" if rows <= BROADCAST_ROWS else "merge"


def _compared(
    docs: DataFrame, chosen: DataFrame, n: int, num: int, den: int, block_rows: int, sketches: bool
) -> DataFrame:
    """(a, b): classes of the families that link, or with ``sketches`` that can, as spanning forests of the tasks."""
    n_chosen = chosen.count()
    wanted = chosen.select("cls", "class_id").hint(_by_size(n_chosen))
    texts = docs.join(wanted, F.col("doc_id") == F.col("class_id")).select("cls", "text")
    sets = texts.mapInArrow(lean(_rows(n, sketches)), "cls string, row binary")
    kind = "sketch" if sketches else "set"
    tiles = _tile_tasks(chosen, num, den, block_rows, SKETCH_TILE if sketches else TILE_COLUMNS)
    tiles = stored(tiles, f"ngram-{kind}-tiles")
    by_size = _by_size(tiles.count())
    if by_size == "merge":  # the shuffle then reads a table, and a lost executor does not make the sets anew
        sets = stored(sets, f"ngram-{kind}s")
    placed = sets.join(tiles.hint(by_size), "cls")
    tasks = max(1, n_chosen // block_rows)
    small = F.pmod(F.xxhash64("family"), F.lit(tasks)).cast("string")
    task = F.when(F.col("large"), F.concat_ws("|", "family", "one", "two")).otherwise(small)
    step = SLICE_BYTES if sketches else SLICE_COLUMNS
    links = (
        placed.select(task.alias("task"), "family", "own", "one", "two", "cls", "row")
        .groupBy("task")
        .applyInArrow(_links(num, den, step, block_rows, sketches), "a string, b string")
    )
    return stored(links, f"ngram-{kind}-links")


def jaccard_classes(
    docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, class_size, component_id.

    ``class_id`` is the smallest doc_id with the same set, ``component_id`` the smallest one that
    links of similarity ``num / den`` or more reach. The result reads tables written on the way.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    frequent = spark.sparkContext.broadcast(_frequent(docs, n))  # bounded by FREQUENT_COLUMNS
    rows = stored(
        docs.mapInArrow(lean(_sizes(n)), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint"), "ngram-rows"
    )
    # Candidates: classes that share an offer, each tied to the smallest one. Offers are sorted, not
    # grouped, so that a task streams over its part.
    offered = docs.mapInArrow(lean(_offered(n, num, den, frequent)), "offer bigint, d1 bigint, b bigint")
    spread = F.coalesce("offer", F.xxhash64("d1"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    offered = offered.repartition(parts, spread).sortWithinPartitions("offer", "d1")
    star = stored(offered.mapInArrow(lean(_tied), "a bigint, b bigint").distinct(), "ngram-candidates")
    family = components(star, "ngram-families").select(F.col("node").alias("d1"), F.col("root").alias("family"))
    cls = F.concat(F.hex("d1"), F.lit(":"), F.hex("d2")).alias("cls")
    members = (
        rows.where("n_shingles > 0")
        .groupBy("d1", "d2", "n_shingles")
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
        .hint("merge")
        .join(family, "d1", "left")
        .select("d1", "d2", cls, "class_id", "class_size", "n_shingles", "family")
    )
    members = stored(members, "ngram-classes")
    chosen = members.where("family is not null").select("cls", "class_id", "n_shingles", "family")
    # Rows that can link by their sketches are row blocks of their own; only they travel as sets.
    near = components(_compared(docs, chosen, n, num, den, block_rows, sketches=True), "ngram-near")
    chosen = chosen.drop("family").join(near.withColumnRenamed("root", "family"), F.col("cls") == F.col("node"))
    chosen = stored(chosen.drop("node"), "ngram-chosen")
    links = _compared(docs, chosen, n, num, den, block_rows, sketches=False)
    linked = components(links, "ngram-components")
    named = linked.join(members.select("cls", "class_id"), F.col("node") == F.col("cls"))
    lowest = named.groupBy("root").agg(F.min("class_id").alias("component"))
    named = named.join(lowest, "root").select("cls", "component")
    classes = members.join(named, "cls", "left").select(
        "d1", "d2", "class_id", "class_size", F.coalesce("component", "class_id").alias("component")
    )
    found = rows.select("doc_id", "n_shingles", "d1", "d2").hint("merge").join(classes, ["d1", "d2"], "left")
    alone = F.col("n_shingles") == 0
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents without near copies: of each component the row of the smallest id stays.

    Rows that share an id go together, when one of them goes; rows without an id stay.
    """
    found = jaccard_classes(docs, **how)
    gone = stored(found.where("component_id <> doc_id").select("doc_id").distinct(), "ngram-gone")
    return docs.join(gone.hint(_by_size(gone.count())), "doc_id", "left_anti").select(docs.columns)
