"""Embedding near-duplicates by a PCA-ordered tiled comparison.

1. Equal vectors are one class, weighted by its rows.
2. An orthogonal basis, the principal axes of a bounded sample, orders the dimensions by energy. Any
   orthogonal basis gives right results, so the sample only affects speed.
3. Classes are cut into cells by a k-d tree over the leading coordinates, and large cells into tiles of
   about ``TILE_ROWS`` classes. Each tile is one file in the shared folder, in the precision the vectors
   came in. Two tiles are compared only if the boxes around their leading coordinates and the norms of
   the rest allow a cosine of the threshold.
4. A pair of tiles is compared in bands of dimensions: products of the leading ones first; what the
   rest can add is at most the product of the suffix norms. Rows for which the bound stays below the
   threshold are dropped after each band, and the comparison stops when none is left. Bounds are in
   single precision, with a margin for its rounding.
5. Tiles next to each other are a block. A task compares pairs of blocks and reads their tiles from the
   shared folder, so no vector travels once per partner. A pair of blocks returns its rows' link counts
   and a spanning forest of its links, never all pairs.

Vectors are shuffled once and lie on disk once besides the input, which is scanned four times; disk grows
with the input, while comparing grows with the square of what the boxes and the threshold leave.

Cosines are in double precision; one within 1e-9 of the threshold is computed again from the vectors
as they came. Defined results: a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of different lengths do not link; repeated rows link; the
component of a row without an id is the smallest id of its component. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactscope.llm.common import components, lean, stored
from contactscope.sources.tables import shared_folder

TILE_ROWS = 2048
SAMPLE_ROWS = 4096
LEADING = 8  # coordinates that cells are cut by
CELLS = 1024  # at most
BANDS = (8, 16, 24, 32, 48, 64, 128, 256)
STRIP = 256
MARGIN = 1e-9
#: Bytes of vectors in a block of tiles at most, and blocks that an input has at least where it has the tiles.
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 24
#: Pairs of rows that a task compares, about, and tasks at most.
TASK_PAIRS = 1 << 33
MOST_TASKS = 10_000
#: Links that are gathered before the forest takes them, and candidates that are verified at once.
GATHERED = 1 << 18
PART = 1 << 14

PLACED = "vec_id bigint, key binary, size int, cell bigint"
DEALT = "grp bigint, size int, key binary, weight bigint, first_id bigint, v binary"
MADE = (
    "key binary, node bigint, weight bigint, first_id bigint, "
    "tile string, n int, size int, lo array<double>, hi array<double>, rest double"
)


def _usable(batch):
    """By length: the batch's rows that can link, their components and a key of equal vectors."""
    column = batch.column("embedding")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        rows = flat.reshape(-1, size) if len(own) == len(sizes) else flat[starts[own][:, None] + np.arange(size)]
        with np.errstate(invalid="ignore"):
            top = np.abs(rows).max(axis=1)
        fine = np.isfinite(top) & (top > 0)
        rows = np.ascontiguousarray(rows[fine] + rows.dtype.type(0))  # no negative zeros
        yield own[fine], rows, [hashlib.md5(row).digest() for row in rows]


def unit(rows):
    """Rows of length 1; scaled first, so that very large and small components keep their sizes."""
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _low(x, first: int):
    """The first coordinates and the norm of the rest: their product bounds the cosine."""
    rest = np.sqrt((x[:, first:] * x[:, first:]).sum(axis=1, keepdims=True))
    return np.ascontiguousarray(np.concatenate([x[:, :first], rest], axis=1), np.float32)


class Layout:
    """The basis, the k-d cells and the first band for vectors of one length, from a bounded sample.

    Without a sample the basis is the one the vectors came in, and there is one cell.
    """

    def __init__(self, size: int, sample, cells: int, threshold: float, leading: int = LEADING):
        self.leading = min(leading, size)
        self.axes = None
        self.first = min(BANDS[1], size)
        self.splits = []  # by level: (dimension, threshold of each cell)
        if not len(sample):
            return
        rows = unit(sample)
        _, axes = np.linalg.eigh(rows.T @ rows)
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        turned = rows @ self.axes
        lead = turned[:, : self.leading]
        cell = np.zeros(len(lead), dtype=np.int64)
        while (2 << len(self.splits)) <= cells:
            # The widest coordinate within the cells is cut at each cell's median.
            n = 1 << len(self.splits)
            spread = [sum(np.ptp(lead[cell == c, d]) for c in range(n) if (cell == c).any()) for d in range(self.leading)]
            d = int(np.argmax(spread))
            cuts = np.array([np.median(lead[cell == c, d]) if (cell == c).any() else 0.0 for c in range(n)])
            cell = 2 * cell + (lead[:, d] > cuts[cell])
            self.splits.append((d, cuts))
        # A coordinate more in the first band costs each pair a little, a pair that stays some 20,000 times that (measured).
        some = turned[:: max(1, len(turned) // 512)][:512]
        cost = {}
        for first in [b for b in BANDS if b < size] + [size]:
            low = _low(some, first)
            cost[first] = first + 20_000 * float((low @ low.T >= threshold).mean())
        self.first = min(cost, key=cost.get)

    def turn(self, rows):
        """Coordinates of unit rows in the basis."""
        return rows if self.axes is None else rows @ self.axes

    def cell(self, rows):
        """The cell of each unit row."""
        cell = np.zeros(len(rows), dtype=np.int64)
        # Row by row, not as a matrix product: equal rows need equal sums, whatever batch they are in.
        lead = {d: (rows * self.axes[:, d]).sum(axis=1) for d in {d for d, _ in self.splits}}
        for d, cuts in self.splits:
            cell = 2 * cell + (lead[d] > cuts[cell])
        return cell


def _placed(layouts: dict):
    """Every row with its key and cell; both are null where it cannot link."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            keys, sizes, cells = [None] * n, np.zeros(n, np.int32), np.zeros(n, np.int64)
            for own, rows, found in _usable(batch):
                if len(own):
                    size = rows.shape[1]
                    sizes[own], cells[own] = size, layouts[size].cell(unit(rows))
                    for at, key in zip(own.tolist(), found, strict=True):
                        keys[at] = key
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(sizes), pa.array(cells)],
                ["vec_id", "key", "size", "cell"],
            )

    return lean(run)


def _classes(keys, weights, ids):
    """Equal keys as one: key, number of rows, smallest id, place of the first; by key."""
    rows = pa.table({"key": keys, "weight": weights, "id": ids, "at": pa.array(np.arange(len(keys)))})
    found = rows.group_by("key").aggregate([("weight", "sum"), ("id", "min"), ("at", "min")]).sort_by("key")
    return found["key"], found["weight_sum"], found["id_min"], found["at_min"].to_numpy()


def _dealt(layouts: dict, groups: dict):
    """The vectors of each batch, equal ones once, with the group of rows whose tiles they belong to."""

    def run(batches):
        for batch in batches:
            for own, rows, found in _usable(batch):
                if not len(own):
                    continue
                keys, weights, ids, at = _classes(
                    pa.array(found, pa.binary()), pa.array(np.ones(len(own), np.int64)), batch.column("vec_id").take(pa.array(own))
                )
                rows = np.ascontiguousarray(rows[at])
                size, width = rows.shape[1], rows.shape[1] * rows.itemsize
                base, parts = groups[size]
                cell = layouts[size].cell(unit(rows))
                mark = np.frombuffer(b"".join(keys.to_pylist()), np.uint64)[::2]
                grp = base[cell] + (mark % parts[cell].astype(np.uint64)).astype(np.int64)
                cut = np.arange(len(rows) + 1, dtype=np.int64) * width
                step = max(1, (1 << 30) // width)  # offsets of a binary column have 32 bits
                for a in range(0, len(rows), step):
                    b = min(a + step, len(rows))
                    data = [None, pa.py_buffer((cut[a : b + 1] - cut[a]).astype(np.int32)), pa.py_buffer(rows[a:b])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grp[a:b]),
                            pa.array(np.full(b - a, size, np.int32)),
                            keys.slice(a, b - a).combine_chunks(),
                            weights.slice(a, b - a).combine_chunks(),
                            ids.slice(a, b - a).combine_chunks(),
                            pa.Array.from_buffers(pa.binary(), b - a, data),
                        ],
                        ["grp", "size", "key", "weight", "first_id", "v"],
                    )

    return lean(run)


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, as a URI; it goes when the application ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/contactscope/llm-vector-tiles-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(path)
    system.deleteOnExit(path)
    folder = str(system.makeQualified(path).toString())
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return folder


def _tiles(folder: str, layouts: dict, kind: str, tile_rows: int):
    """Writes the tiles of a group; gives its classes, and a row on each tile.

    Classes are in the order of their keys, so a second attempt puts the same content in the place of the first.
    """
    schema = pa.schema(
        [("key", pa.binary()), ("node", pa.int64()), ("weight", pa.int64()), ("first_id", pa.int64()), ("tile", pa.string())]
        + [("n", pa.int32()), ("size", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("rest", pa.float64())]
    )

    def run(key, table):
        grp, size = key[0].as_py(), table["size"][0].as_py()
        keys, weights, ids, at = _classes(table["key"], table["weight"], table["first_id"])
        n = len(at)
        vectors, layout = table["v"].take(pa.array(at)), layouts[size]
        counts = weights.to_numpy()
        system, path = fs.FileSystem.from_uri(folder)
        about = {name: [] for name in schema.names}
        pieces = max(1, round(n / tile_rows))
        for k in range(pieces):
            a, b = n * k // pieces, n * (k + 1) // pieces
            data = b"".join(vectors.slice(a, b - a).to_pylist())
            name, part = f"{grp}-{k}", f"{path}/_{grp}-{k}-{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(np.ascontiguousarray(counts[a:b], np.int64).tobytes())
                out.write(data)
            system.move(part, f"{path}/{name}")
            turned = layout.turn(unit(np.frombuffer(data, kind).reshape(-1, size)))
            lead, rest = turned[:, : layout.leading], turned[:, layout.leading :]
            row = {"node": grp << 32 | a, "tile": name, "n": b - a, "size": size}
            row |= {"lo": lead.min(axis=0).tolist(), "hi": lead.max(axis=0).tolist()}
            row["rest"] = float(np.sqrt((rest * rest).sum(axis=1)).max())
            for column, values in about.items():
                values.append(row.get(column))
        every = pa.table({"key": keys, "node": pa.array((grp << 32) + np.arange(n)), "weight": weights, "first_id": ids})
        for name in schema.names[4:]:
            every = every.append_column(name, pa.nulls(n, schema.field(name).type))
        return pa.concat_tables([every.cast(schema), pa.Table.from_pydict(about, schema)])

    return run


def _may_link(lo, hi, rest, a, b, threshold: float):
    """For tiles ``a`` and ``b``: whether boxes of leading coordinates and norms of the rest allow the threshold."""
    most = rest[a][:, None] * rest[b][None] + 1e-9
    gap = np.zeros(most.shape)
    for d in range(lo.shape[1]):
        al, ah, bl, bh = lo[a, d][:, None], hi[a, d][:, None], lo[b, d][None], hi[b, d][None]
        most += np.maximum(np.maximum(al * bl, al * bh), np.maximum(ah * bl, ah * bh))
        gap += np.maximum(0.0, np.maximum(al - bh, bl - ah)) ** 2
    # Unit vectors at that cosine are no further apart than this.
    return (most >= threshold) & (gap <= 2 - 2 * threshold + 1e-9)


class Side:
    """A tile's rows made ready for comparisons: ``x`` are unit rows in the basis, ``raw`` the rows as they came."""

    def __init__(self, x, raw, first: int, weights=None):
        dims = x.shape[1]
        self.x = np.ascontiguousarray(x, np.float32)
        self.raw, self.weights, self._exact = raw, weights, None
        first = min(first, dims)
        self.ends = [first] + [b for b in BANDS if first < b < dims] + [dims] * (first < dims)
        squares = self.x * self.x
        self.tails = [np.sqrt(squares[:, e:].sum(axis=1)) for e in self.ends]
        self.low = np.ascontiguousarray(np.concatenate([self.x[:, :first], self.tails[0][:, None]], axis=1))

    @property
    def exact(self):
        """Unit rows in double precision, made when they are first asked for."""
        if self._exact is None:
            self._exact = unit(self.raw)
        return self._exact


def _places(flags):
    """Places of the true ones in a contiguous array of flags, most of which are false."""
    flat = flags.reshape(-1)
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    row, at = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[row] * 8 + at, whole + np.flatnonzero(flat[whole:])])


def _links(a: Side, b: Side, threshold: float, same: bool):
    dims = a.x.shape[1]
    # Rounding in single precision: of the rows, of turning them, and of products of unit rows.
    least = np.float32(threshold - (3 * dims + 16) * 2.0**-23)

    def settled(i, j, sums):
        stay = sums >= threshold - MARGIN
        i, j, sums = i[stay], j[stay], sums[stay]
        near = np.abs(sums - threshold) <= MARGIN
        if near.any():
            p, q = (np.asarray(side.raw[k[near]], np.float64) for side, k in ((a, i), (b, j)))
            sums[near] = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
        linked = sums >= threshold
        return i[linked], j[linked]

    room = np.empty(STRIP * len(b.x), np.float32), np.empty(STRIP * len(b.x), bool)
    for at in range(0, len(a.x), STRIP):
        begin = at if same else 0
        strip, columns = a.low[at : at + STRIP], b.low[begin:].T
        bound, alive = (x[: len(strip) * columns.shape[1]].reshape(len(strip), -1) for x in room)
        np.matmul(strip, columns, out=bound)
        i, j = np.divmod(_places(np.greater_equal(bound, least, out=alive)), bound.shape[1])
        if same:
            later = i < j
            i, j = i[later], j[later]
        if len(i) * 16 >= bound.size:
            sums = a.exact[at : at + STRIP] @ b.exact[begin:].T
            alive = sums >= threshold - MARGIN
            if same:
                alive &= np.arange(alive.shape[0])[:, None] < np.arange(alive.shape[1])[None, :]
            i, j = np.nonzero(alive)
            yield settled(i + at, j + begin, sums[i, j])
            continue
        for p in range(0, len(i), PART):
            u, v = i[p : p + PART], j[p : p + PART]
            sums = bound[u, v]
            u, v = u + at, v + begin
            sums = sums - a.tails[0][u] * b.tails[0][v]
            for k in range(1, len(a.ends)):
                band = slice(a.ends[k - 1], a.ends[k])
                sums = sums + np.einsum("ij,ij->i", a.x[u, band], b.x[v, band])
                stay = sums + a.tails[k][u] * b.tails[k][v] >= least
                u, v, sums = u[stay], v[stay], sums[stay]
                if not len(u):
                    break
            if len(u):
                yield settled(u, v, np.einsum("ij,ij->i", a.exact[u], b.exact[v]))


def tile_pairs(x, y, raw_x, raw_y, threshold: float, same: bool, first: int = BANDS[1]):
    """Index pairs (i, j) with a cosine of the threshold or more, by bands with suffix bounds.

    ``x`` and ``y`` are unit rows in the basis, ``raw_*`` the rows as they came.
    """
    a = Side(x, raw_x, first)
    yield from _links(a, a if same else Side(y, raw_y, first), threshold, same)


class Forest:
    """A spanning forest of the links between 0..n-1, which may come in any number of parts."""

    def __init__(self, n: int):
        self.label, self.kept, self.held, self.waiting = np.arange(n), [], [], 0

    def add(self, i, j) -> None:
        self.held.append((i, j))
        self.waiting += len(i)
        if self.waiting >= GATHERED:
            self.take()

    def take(self) -> None:
        if not self.held:
            return
        i, j = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.waiting = [], 0
        while len(i):
            p, q = self.label[i], self.label[j]
            apart = p != q
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            if not len(i):
                break
            # Each set that has a link to a lower one is tied to one such set.
            high, at = np.unique(np.maximum(p, q), return_index=True)
            self.kept.append((i[at], j[at]))
            to = np.arange(len(self.label))
            to[high] = np.minimum(p, q)[at]
            while (further := to[to] != to).any():
                to[further] = to[to[further]]
            self.label = to[self.label]

    def edges(self) -> tuple:
        self.take()
        if not self.kept:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.kept, strict=True))


class Plan:
    """Which tiles meet: blocks of tiles, the pairs of blocks that may hold a link, and their tasks."""

    def __init__(self, tiles: list, threshold: float, width: int, tile_rows: int, least_tasks: int):
        self.names = [t["tile"] for t in tiles]
        self.nodes = np.array([t["node"] for t in tiles], np.int64)
        self.rows = np.array([t["n"] for t in tiles], np.int64)
        self.sizes = np.array([t["size"] for t in tiles], np.int64)
        most = max((len(t["lo"]) for t in tiles), default=0)
        self.lo, self.hi = (np.array([t[c] + [0.0] * (most - len(t[c])) for t in tiles]).reshape(len(tiles), most) for c in ("lo", "hi"))
        self.rest = np.array([t["rest"] for t in tiles], np.float64)
        self.blocks, left, right, work = [], [], [], []
        for size in np.unique(self.sizes):
            own = np.flatnonzero(self.sizes == size)
            step = max(1, min(BLOCK_BYTES // (tile_rows * int(size) * width), -(-len(own) // LEAST_BLOCKS)))
            before = len(self.blocks)
            self.blocks += [own[k : k + step] for k in range(0, len(own), step)]
            for a in range(before, len(self.blocks)):
                ours = self.blocks[a]
                later = own[own >= ours[0]]
                met = self.met(ours, later, threshold) * self.rows[ours][:, None] * self.rows[later][None]
                load = np.add.reduceat(met.sum(axis=0), np.arange(0, len(later), step))
                some = np.flatnonzero(load)
                left += [a] * len(some)
                right += (a + some).tolist()
                work += load[some].tolist()
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        done = np.cumsum(np.array(work, np.int64))
        total = int(done[-1]) if len(done) else 0
        self.tasks = min(len(left), MOST_TASKS, max(least_tasks, -(-total // TASK_PAIRS)))
        # Every task gets the same share of the work, about.
        self.cuts = np.searchsorted(done, [total * t // max(1, self.tasks) for t in range(self.tasks)], "right")
        self.cuts = np.append(self.cuts, len(left))
        if self.tasks:
            self.cuts[0] = 0

    def met(self, a, b, threshold: float):
        """Of tiles ``a`` and ``b``, those that have to be compared; a pair counts once."""
        return _may_link(self.lo, self.hi, self.rest, a, b, threshold) & (a[:, None] <= b[None]) | (a[:, None] == b[None])


def _compared(plan: Plan, folder: str, layouts: dict, kind: str, threshold: float):
    """(node, null, links) for the rows of each pair of blocks, and (node, node, 0) for a forest of their links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def side(system, path, tile) -> Side:
        n, size = int(plan.rows[tile]), int(plan.sizes[tile])
        with system.open_input_stream(f"{path}/{plan.names[tile]}") as file:
            data = file.read()
        weights = np.frombuffer(data, np.int64, n)
        raw = np.frombuffer(data, kind, n * size, 8 * n).reshape(n, size)
        layout, x = layouts[size], unit(raw).astype(np.float32)
        if layout.axes is not None:
            x = x @ layout.axes.astype(np.float32)
        return Side(x, raw, layout.first, weights)

    def places(tiles):
        cut = np.concatenate([[0], np.cumsum(plan.rows[tiles])])
        nodes = [np.arange(plan.nodes[t], plan.nodes[t] + plan.rows[t]) for t in tiles]
        return cut, np.concatenate(nodes)

    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            held, ours = None, {}
            units = [u for t in batch.column("id").to_pylist() for u in range(plan.cuts[t], plan.cuts[t + 1])]
            for u in units:
                left, right = plan.blocks[plan.left[u]], plan.blocks[plan.right[u]]
                if held != plan.left[u]:
                    held, ours = plan.left[u], {}
                within = plan.left[u] == plan.right[u]
                cut, nodes = places(left)
                if within:
                    shift = cut
                else:
                    more, others = places(right)
                    shift, nodes = more + cut[-1], np.concatenate([nodes, others])
                links, joined = np.zeros(len(nodes)), Forest(len(nodes))
                met = plan.met(left, right, threshold)
                for q, tile in enumerate(right):
                    if not met[:, q].any():
                        continue
                    other = ours.get(tile) if within else None
                    if other is None:
                        other = side(system, path, tile)
                        if within:
                            ours[tile] = other
                    for p in np.flatnonzero(met[:, q]):
                        if left[p] not in ours:
                            ours[left[p]] = side(system, path, left[p])
                        one = ours[left[p]]
                        for i, j in _links(one, other, threshold, left[p] == tile):
                            if not len(i):
                                continue
                            a, b = slice(cut[p], cut[p + 1]), slice(shift[q], shift[q + 1])
                            # Sums of whole numbers, exact in double precision.
                            links[a] += np.bincount(i, other.weights[j], len(one.x))
                            links[b] += np.bincount(j, one.weights[i], len(other.x))
                            joined.add(i + cut[p], j + shift[q])
                some = np.flatnonzero(links)
                if len(some):
                    a, b = joined.edges()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([nodes[some], nodes[a]])),
                            pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(nodes[b])]),
                            pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(a), np.int64)])),
                        ],
                        schema=schema,
                    )

    return lean(run)


def _layouts(rows: DataFrame, threshold: float, tile_rows: int, sample_rows: int) -> dict:
    """A layout for each length; the sample is taken by a hash of the vector, equal ones once."""
    some = rows.where(F.size("embedding") > 0).select("embedding", F.xxhash64("embedding").alias("h"))
    counts = some.groupBy(F.size("embedding").alias("size")).agg(F.approx_count_distinct("h").alias("n")).collect()
    every = max(1, sum(r["n"] for r in counts) // sample_rows)
    sample = some.where(F.pmod("h", F.lit(every)) == 0).groupBy("h").agg(F.first("embedding").alias("embedding"))
    seen: dict[int, list] = {}
    for batch in sample.toArrow().sort_by("h").to_batches():
        for _, found, _ in _usable(batch):
            seen.setdefault(found.shape[1], []).append(found)
    layouts = {}
    for size, n in [(r["size"], r["n"]) for r in counts]:
        own = np.concatenate(seen[size]) if size in seen else np.empty((0, 0))
        layouts[size] = Layout(size, own, min(CELLS, max(1, len(own) // 16), max(1, n // tile_rows)), threshold)
    return layouts


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    tile_rows: int = TILE_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, class_size (equal vectors)."""
    spark = vectors.sparkSession
    single = isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType)
    kind, width = ("float32", 4) if single else ("float64", 8)
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
    )
    layouts = _layouts(rows, threshold, tile_rows, sample_rows)
    placed = stored(rows.mapInArrow(_placed(layouts), PLACED), "vector-keys")
    counts = placed.where("key is not null").groupBy("size", "cell").agg(F.approx_count_distinct("key").alias("n"))
    # At most CELLS counts for each length. A cell's groups of rows have numbers from ``base`` on.
    groups = {size: (np.zeros(1 << len(x.splits), np.int64), np.ones(1 << len(x.splits), np.int64)) for size, x in layouts.items()}
    at = 0
    for r in sorted(counts.collect()):
        base, parts = groups[r["size"]]
        base[r["cell"]], parts[r["cell"]] = at, max(1, round(r["n"] / tile_rows))
        at += int(parts[r["cell"]])
    folder = _folder(spark)
    tiles = rows.mapInArrow(_dealt(layouts, groups), DEALT).groupBy("grp").applyInArrow(_tiles(folder, layouts, kind, tile_rows), MADE)
    made = stored(tiles, "vector-classes")
    # Tiles are as many as the input has lots of ``tile_rows``; groups are numbered by length and cell.
    tiles = sorted(made.where("tile is not null").drop("key", "weight", "first_id").collect(), key=lambda r: r["node"])
    plan = Plan(tiles, threshold, width, tile_rows, 4 * spark.sparkContext.defaultParallelism)
    work = spark.range(0, plan.tasks, 1, max(1, plan.tasks))
    found = stored(work.mapInArrow(_compared(plan, folder, layouts, kind, threshold), "a bigint, b bigint, n bigint"), "vector-links")
    classes = made.where("tile is null").select("key", "node", "weight", "first_id")
    linked = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"), "vector-components")
    named = roots.join(classes.select(F.col("node").alias("own"), "first_id"), F.col("node") == F.col("own"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component"))
    named = named.join(lowest, "root").select("node", "component")
    classes = (
        classes.join(linked.withColumnRenamed("a", "node"), "node", "left")
        .join(named, "node", "left")
        .select(
            "key",
            "weight",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"),
            F.coalesce("component", "first_id").alias("component"),
        )
    )
    everything = placed.select("vec_id", "key").join(classes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return everything.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        F.coalesce("weight", F.lit(1)).cast("bigint").alias("class_size"),
    )
