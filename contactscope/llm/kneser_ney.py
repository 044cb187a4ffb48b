"""Language-model scores: an interpolated modified Kneser-Ney n-gram model, counted in Spark.

Words are runs of characters other than white space, with A-Z lower-cased; each text ends in one end
token, which is counted and predicted, and begins after ``order - 1`` begin marks, which are not.

Counting. Each run of texts counts its own words, then its own n-grams, before anything is
shuffled, and deals them out by hash in packed blocks, so that a word or phrase that a third of all
texts hold is one entry a run. A shard adds its blocks up and writes them as files of the shared
folder: sorted 64-bit hashes, and counts in the same order. The vocabulary comes first; a word's id
is its rank by hash, and n-grams are blocks of id columns. A level's shards also give what the
level below needs: in how many ways an n-gram is extended to the left, which is its count there, and
for each context the total and the number of words that follow once, twice, or more often. Nothing
is pruned; the model grows with the corpus. The driver gets a row a shard: its number of entries and
of those with counts 1 to 4, from which the discounts are computed.

Scoring is one pass over the texts. Workers map the files into memory and look up a run's distinct
n-grams in sorted order, so that only pages that are needed are read, once a run. Where the shared
folder is no file system that can be mapped, a worker copies a file to an unlinked temporary one first.

Defined results: a null or empty text is its end token alone. Rows are scored one by one, whatever
their ids: repeated ids and texts count as often as they occur, a null id is an ordinary row. With no
training text every token has probability 1. Very long texts are cut in no way; a task holds one text
or about ``RUN_BYTES`` of shorter ones. Only the columns named are read, whatever else a table carries.
"""

from __future__ import annotations

import functools
import os
import struct
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.llm.common import mixed, only, stored, text_runs, word_hasher
from contactscope.sources.tables import shared_folder

ORDER = 2
#: Bytes of text for which there is a shard more, and the least number of shards.
SHARD_BYTES = 32 << 20
LEAST_SHARDS = 16
#: Bytes of text that are counted together before the shuffle.
RUN_BYTES = 12 << 20
#: The hash that stands for the end token; no word is known to have it.
END = np.uint64(0x9D39247E33776D41)
STEP = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "kind string, shard int, data binary, n array<long>"


@dataclass
class Model:
    """Where the arrays are, and the few numbers that are not arrays."""

    folder: str
    shards: int
    order: int
    starts: np.ndarray  # ids of the first word of each vocabulary shard; the last is the number of words
    tokens: int  # training tokens, end tokens included
    present: dict[str, set[int]] = field(default_factory=dict)  # which shards have files
    discounts: dict[int, list[float]] = field(default_factory=dict)  # by level, for counts 0, 1, 2, 3 or more
    empty: list[int] = field(default_factory=list)  # the empty context: total, followed once, twice, more often

    @property
    def words(self) -> int:
        return int(self.starts[-1])


def _pack(columns: list) -> bytes:
    """Integer columns of one length as bytes; the first one does not fall, and is kept as steps."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    columns = [c.astype(np.min_scalar_type(int(c.max()))) for c in columns]
    raw = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    head = struct.pack(f"<qB{len(columns)}B", len(columns[0]), len(columns), *[c.itemsize for c in columns])
    return head + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> list:
    n, k = struct.unpack_from("<qB", data)
    widths = struct.unpack_from(f"{k}B", data, 9)
    raw = np.frombuffer(pa.decompress(data[9 + k :], n * sum(widths), "zstd", asbytes=True), np.uint8)
    columns, at = [], 0
    for width in widths:
        plane = raw[at : at + n * width].reshape(width, n)
        columns.append(np.ascontiguousarray(plane.T).view(f"u{width}").ravel())
        at += n * width
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


def _gram(columns: list):
    """The hash of each row of id columns."""
    with np.errstate(over="ignore"):
        out = np.full(len(columns[0]), len(columns), np.uint64)
        for ids in columns:
            out = mixed(out * STEP + ids.astype(np.uint64))
    return out


def _summed(keys: list, values: list) -> tuple[list, list]:
    """The distinct rows of the key columns, in order, and the sums of their values."""
    if not len(keys[0]):
        return keys, values
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(v[order], first, dtype=np.int64) for v in values]


def _shard(hashes, shards: int):
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _dealt(kind: str, keys: list, values: list, hashes, shards: int):
    """(kind, shard, block) for the rows of every shard that has some."""
    own = _shard(hashes, shards)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[s] : cuts[s + 1]]
        yield kind, int(s), _pack([c[at] for c in (*keys, *values)])


def _batch(rows: list) -> pa.RecordBatch:
    kinds, shards, data, n = ([r[i] if i < len(r) else None for r in rows] for i in range(4))
    return pa.record_batch(
        [pa.array(kinds, pa.string()), pa.array(shards, pa.int32()), pa.array(data, pa.binary()),
         pa.array(n, pa.list_(pa.int64()))],
        ["kind", "shard", "data", "n"],
    )


def _columns(table: pa.Table, kind: str) -> list:
    """The blocks of one kind, one below the other."""
    blocks = [_unpack(d) for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist()) if k == kind]
    return [np.concatenate(parts) for parts in zip(*blocks)]


def _save(folder: str, name: str, values) -> None:
    """One array as a file; a second attempt puts the same content in the place of the first."""
    system, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        np.save(out, values.astype(np.min_scalar_type(int(values.max()))) if values.dtype != np.uint64 else values)
    system.move(part, f"{path}/{name}.npy")


@functools.lru_cache(maxsize=4096)
def _mapped(folder: str, name: str):
    """One array of the model, mapped into memory."""
    system, path = fs.FileSystem.from_uri(folder)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    handle, copy = tempfile.mkstemp(suffix=".npy")
    try:
        with system.open_input_stream(f"{path}/{name}.npy") as source, os.fdopen(handle, "wb") as target:
            while data := source.read(1 << 20):
                target.write(data)
        return np.load(copy, mmap_mode="r")
    finally:
        os.unlink(copy)


def _found(model: Model, name: str, columns: list[str], keys) -> list:
    """For each key its place within its shard, -1 where it is not, then the named columns, 0 where it is not."""
    keys, inverse = np.unique(keys, return_inverse=True)
    place = np.full(len(keys), -1, np.int64)
    out = [np.zeros(len(keys), np.int64) for _ in columns]
    own = _shard(keys, model.shards)
    cuts = np.searchsorted(own, np.arange(model.shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        if s not in model.present[name]:
            continue
        a, b = cuts[s], cuts[s + 1]
        held = _mapped(model.folder, f"{name}-{s}")
        at = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
        hit = np.flatnonzero(held[at] == keys[a:b])
        place[a + hit] = at[hit]
        for values, column in zip(out, columns):
            values[a + hit] = _mapped(model.folder, f"{name}-{column}-{s}")[at[hit]]
    return [place[inverse], *[values[inverse] for values in out]]


def _tokens(hasher, texts) -> tuple:
    """Hashes of the words and ends of all texts, and where each text begins; the last is their number."""
    hashes, offsets, _, _ = hasher(texts)
    starts = offsets + np.arange(len(offsets))
    out = np.full(starts[-1], END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[starts[1:] - 1] = False
    out[is_word] = hashes
    return out, starts


def _ids(model: Model, hashes) -> tuple:
    """Word ids and training counts; a word that is not in the vocabulary has an id past the begin mark."""
    place, counts = _found(model, "words", ["counts"], hashes)
    ids = model.starts[_shard(hashes, model.shards)] + place
    return np.where(place >= 0, ids, model.words + 1).astype(np.uint32 if model.words < 1 << 31 else np.uint64), counts


def _windows(model: Model, ids, starts, size: int) -> list:
    """Columns of ids: the ``size`` tokens up to and with each token, begin marks before each text."""
    marks = model.order - 1
    shift = np.repeat(np.arange(1, len(starts)) * marks, np.diff(starts))
    padded = np.full(len(ids) + marks * (len(starts) - 1), model.words, ids.dtype)
    at = np.arange(len(ids)) + shift
    padded[at] = ids
    return [padded[at - (size - 1) + j] for j in range(size)]


def _word_blocks(shards: int):
    def run(batches):
        hasher = word_hasher()
        for batch in text_runs(batches, limit=RUN_BYTES):
            hashes, _ = _tokens(hasher, batch.column("text"))
            keys, counts = np.unique(hashes, return_counts=True)
            yield _batch(list(_dealt("word", [keys], [counts], keys, shards)))

    return run


def _vocabulary(folder: str):
    def run(key, table):
        shard = key[0].as_py()
        words, counts = _columns(table, "word")
        (words,), (counts,) = _summed([words], [counts])
        _save(folder, f"words-{shard}", words)
        _save(folder, f"words-counts-{shard}", counts)
        return pa.Table.from_batches([_batch([("made", shard, None, [len(words), int(counts.sum())])])])

    return run


def _gram_blocks(model: Model):
    def run(batches):
        hasher = word_hasher()
        for batch in text_runs(batches, limit=RUN_BYTES):
            hashes, starts = _tokens(hasher, batch.column("text"))
            ids, _ = _ids(model, hashes)
            columns = _windows(model, ids, starts, model.order)
            keys, counts = _summed(columns, [np.ones(len(ids), np.int32)])
            yield _batch(list(_dealt("gram", keys, counts, _gram(keys), model.shards)))

    return run


def _level(model: Model, level: int):
    """One shard of a level: its n-grams and contexts to files, and blocks for the level below."""

    def run(key, table):
        shard, rows, made = key[0].as_py(), [], {}
        if columns := _columns(table, "context"):
            keys, values = _summed(columns[:level], columns[level:])
            order = np.argsort(hashes := _gram(keys))
            _save(model.folder, f"context{level}-{shard}", hashes[order])
            for name, column in zip(("total", "once", "twice", "more"), values):
                _save(model.folder, f"context{level}-{name}-{shard}", column[order])
            rows.append((f"context{level}", shard, None, []))
        if columns := _columns(table, "gram"):
            keys, (counts,) = _summed(columns[:level], columns[level:])
            order = np.argsort(hashes := _gram(keys))
            _save(model.folder, f"gram{level}-{shard}", hashes[order])
            _save(model.folder, f"gram{level}-counts-{shard}", counts[order])
            made = [int(counts.sum()), len(counts), *[int((counts == c).sum()) for c in (1, 2, 3, 4)]]
            rows.append((f"gram{level}", shard, None, made))
            if level > 1:
                below, times = _summed(keys[1:], [np.ones(len(counts), np.int32)])
                rows += _dealt("gram", below, times, _gram(below), model.shards)
                stats = [counts, counts == 1, counts == 2, counts > 2]
                before, stats = _summed(keys[:-1], stats)
                rows += _dealt("context", before, stats, _gram(before), model.shards)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _discounts(of: list[int]) -> list[float]:
    """Discounts for counts 0, 1, 2, 3 or more, from how many n-grams occur once to four times."""
    y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
    out = [0.0]
    for c, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
        d = c - (c + 1) * y * of[c] / of[c - 1] if of[c - 1] and of[c] else usual
        out.append(d if 0 < d < c else usual)
    return out


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Count ``text`` of all rows; the arrays go to the shared folder and stay until the application ends."""
    spark = docs.sparkSession
    texts = only(docs, "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    folder = f"{shared_folder(spark).rstrip('/')}/contactscope/llm-kneser-ney-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(path)
    system.deleteOnExit(path)
    folder = str(system.makeQualified(path).toString())
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")

    blocks = texts.mapInArrow(_word_blocks(shards), BLOCKS)
    made = stored(blocks.groupBy("shard").applyInArrow(_vocabulary(folder), BLOCKS), "kneser-ney-words")
    sizes, tokens, present = np.zeros(shards, np.int64), 0, set()
    for shard, (n, total) in made.select("shard", "n").collect():
        sizes[shard], tokens = n, tokens + total
        present.add(shard)
    model = Model(folder, shards, order, np.concatenate([[0], np.cumsum(sizes)]), tokens, {"words": present})

    blocks = texts.mapInArrow(_gram_blocks(model), BLOCKS)
    for level in range(order, 0, -1):
        done = stored(blocks.groupBy("shard").applyInArrow(_level(model, level), BLOCKS), f"kneser-ney-{level}")
        totals = np.zeros(6, np.int64)
        model.present |= {f"gram{level}": set(), f"context{level}": set()}
        for kind, shard, n in done.where("data is null").select("kind", "shard", "n").collect():
            model.present[kind].add(shard)
            totals += n or 0
        model.discounts[level] = _discounts(totals[2:].tolist())
        blocks = done.where("data is not null")
    total, distinct, once, twice = totals[:4].tolist()
    model.empty = [total, once, twice, distinct - once - twice]
    return model


def _probabilities(model: Model, ids, starts):
    """The interpolated probability of every token after the tokens before it."""
    p = np.full(len(ids), 1 / (model.words + 1))  # every word, and one unknown
    for level in range(1, model.order + 1):
        columns = _windows(model, ids, starts, level)
        (counts,) = _found(model, f"gram{level}", ["counts"], _gram(columns))[1:]
        if level == 1:
            total, *follow = model.empty
        else:
            names = ["total", "once", "twice", "more"]
            total, *follow = _found(model, f"context{level - 1}", names, _gram(columns[:-1]))[1:]
        discounts = np.array(model.discounts[level])
        spare = sum(d * n for d, n in zip(discounts[1:], follow))
        seen = counts - discounts[np.minimum(counts, 3)]
        p = np.where(np.greater(total, 0), (seen + spare * p) / np.maximum(total, 1), p)
    return p


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """One row a document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    ``score`` is the base-10 logarithm of the text's probability by the model, ``base_score`` the same by
    counts of single tokens with one half added, ``n_known`` the tokens that occur in training.
    """
    schema = """doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,
        base_score double, score double"""

    def run(batches):
        hasher = word_hasher()
        for batch in text_runs(batches, limit=RUN_BYTES):
            hashes, starts = _tokens(hasher, batch.column("text"))
            ids, counts = _ids(model, hashes)
            base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            first = starts[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.diff(starts)),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), first)),
                    pa.array(np.full(len(first), model.tokens)),
                    pa.array(np.add.reduceat(base, first)),
                    pa.array(np.add.reduceat(np.log10(_probabilities(model, ids, starts)), first)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    return rows.mapInArrow(run, schema)


def fold(parts: int = 5) -> Column:
    """The fold of a document, by its id; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))


def language_scores(docs: DataFrame, order: int = ORDER, held: int = 1) -> DataFrame:
    """Scores of all documents by a model of those that are not in fold ``held``."""
    out = fold() == held
    return score(docs, fit(docs.where(~out), order), out)
