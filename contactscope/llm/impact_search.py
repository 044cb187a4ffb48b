"""Ranked lexical search by NRA: no random access, only sequential reads of impact-sorted lists.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. The
items are a stated query set; they are taken in blocks of ``ITEM_BYTES``, so that what every task gets
of them has a bound. For a block, one pass over whole texts writes the postings of the block's terms,
a run of documents at a time, with the numbers of documents and of terms; document frequencies are
added up from the runs. A run is a shard of the index: its postings lie together, so a term
that every document holds is many lists, and no group of postings grows with the corpus.

In each shard the lists are sorted by impact, the largest first. For an item they are read in turn,
some entries of every list at once. What has been read gives a document's lower bound; the upper bound adds, for
the lists in which it has not been met, the largest impact still to come. Reading goes on until no document outside
the best ``k`` can reach them, by score or, at the same score, by its id, and until the bounds of
the best have met; lists that can change nothing are not read on. The best of each shard are merged by
a ranked window, which keeps ``k`` rows an item before it shuffles.

Defined results: null and empty texts, and texts without terms, are no documents and no items. Rows
are items and documents of their own, whatever their ids: repeated rows are ranked each, repeated
items answered each. Equal scores go by doc_id, a null id last. Hashes of terms have 64 bits. Only the
columns named are read, whatever else a table carries. A shard holds one text or about ``RUN_BYTES`` of shorter ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactscope.llm.common import only, stored, text_runs, word_hasher

K = 20
#: Bytes of item texts that are searched for in one pass over the documents.
ITEM_BYTES = 8 << 20
#: Bytes of document texts in one shard.
RUN_BYTES = 16 << 20
#: Entries of each list that are read at first; each turn reads as many again as have been read.
FIRST_READ = 64
GAPS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def _counts(hasher, texts) -> tuple:
    """(text, term hash, occurrences) without repeats, and the number of terms of each text."""
    hashes, offsets, _, _ = hasher(texts)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return owner[first], hashes[first], np.diff(np.append(first, len(order))), sizes


def _postings(terms):
    """Texts to shards: ids and sizes of the documents, and the postings of ``terms`` (sorted hashes)."""

    def run(batches):
        hasher = word_hasher(GAPS)
        for batch in text_runs(batches, limit=RUN_BYTES):
            owner, hashes, tf, sizes = _counts(hasher, batch.column("text"))
            at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
            asked = terms[at] == hashes
            owner, at, tf = owner[asked], at[asked], tf[asked]
            held = np.bincount(at, minlength=len(terms))
            some = np.flatnonzero(held)
            # Only documents with a posting are kept; the others count in the totals.
            kept = np.unique(owner)
            place = np.zeros(len(sizes), np.int64)
            place[kept] = np.arange(len(kept))
            lists = [some, held[some], sizes[kept], place[owner], at, tf]
            ids = batch.column("doc_id").take(pa.array(kept))
            yield pa.record_batch(
                [
                    pa.array([int((sizes > 0).sum())]),
                    pa.array([int(sizes.sum())]),
                    *[pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in lists[:3]],
                    *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in lists[3:]],
                    pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), ids),
                ],
                ["documents", "occurrences", "held", "frequency", "sizes", "document", "term", "tf", "ids"],
            )

    return run


SHARDS = """documents long, occurrences long, held array<long>, frequency array<long>, sizes array<long>,
    document array<int>, term array<int>, tf array<int>, ids array<long>"""


def _best(lists: list, documents: int, k: int) -> tuple:
    """The ``k`` best documents and their scores, by reading the lists from their heads.

    ``lists`` has (documents, impacts) of each term, impacts not rising; documents are numbers in the
    order in which equal scores are ranked. Scores are above 0.
    """
    lower = np.zeros(documents, np.int64)
    read = [0] * len(lists)
    ends = [len(d) for d, _ in lists]
    depth = FIRST_READ
    open_lists = list(range(len(lists)))
    while True:
        for i in open_lists:
            to = min(depth, ends[i])
            where, impacts = lists[i]
            lower[where[read[i] : to]] += impacts[read[i] : to]
            read[i] = to
        # The largest impact still to come in each list, and so a bound for every document.
        rest = [int(lists[i][1][read[i]]) if read[i] < ends[i] else 0 for i in range(len(lists))]
        unmet = sum(rest)
        upper = lower + unmet
        for i, most in enumerate(rest):
            if most:
                upper[lists[i][0][: read[i]]] -= most
        # Ranked by lower bound, equal ones by number: lexsort's last key counts first.
        top = np.flatnonzero(lower >= _kth(lower, k))
        top = top[np.lexsort((top, -lower[top]))][:k]
        top = top[lower[top] > 0]
        if not unmet:
            return top, lower[top]
        least, last = (lower[top[-1]], top[-1]) if len(top) == k else (0, documents)
        rivals = (upper > least) | ((upper == least) & (np.arange(documents) < last)) if least else upper > 0
        rivals[top] = False
        if not rivals.any():
            loose = top[upper[top] > lower[top]]
            if not len(loose):
                return top, lower[top]
            # Only what the best documents still lack is looked for: lists that all of them have been met
            # in are read no further.
            open_lists = [i for i in range(len(lists)) if rest[i] and not np.isin(loose, lists[i][0][: read[i]]).all()]
        else:
            open_lists = [i for i in range(len(lists)) if rest[i]]
        depth *= 2


def _kth(values, k: int):
    """The k-th largest value, 1 at least."""
    return max(1, np.partition(values, len(values) - k)[len(values) - k] if len(values) > k else 1)


def _searched(items: list, weights, documents: int, occurrences: int, k: int):
    """Shards to (row, doc_id, score), the ``k`` best of the shard for each item."""

    def run(batches):
        for batch in batches:
            for shard in range(batch.num_rows):
                names = ["sizes", "document", "term", "tf"]
                sizes, document, term, tf = (
                    batch.column(c)[shard].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in names
                )
                ids = batch.column("ids")[shard].values
                # Documents are numbered in the order of their ids, nulls last.
                ranked = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
                number = np.empty(len(ranked), np.int64)
                number[ranked] = np.arange(len(ranked))
                m = 100 - 25 + (25 * sizes * documents) // max(occurrences, 1)
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[document]))
                document = number[document]
                order = np.lexsort((document, -impact, term))
                document, impact = document[order], impact[order]
                cuts = np.searchsorted(term[order], np.arange(len(weights) + 1))
                found = [[], [], []]
                for row, terms, times in items:
                    lists = [
                        (document[cuts[t] : cuts[t + 1]], impact[cuts[t] : cuts[t + 1]] * n)
                        for t, n in zip(terms, times)
                        if cuts[t] < cuts[t + 1]
                    ]
                    if lists:
                        top, scores = _best(lists, len(ids), k)
                        found[0].append(np.full(len(top), row))
                        found[1].append(ranked[top])
                        found[2].append(scores)
                if found[0]:
                    rows, places, scores = (np.concatenate(x) for x in found)
                    yield pa.record_batch(
                        [pa.array(rows), ids.take(pa.array(places)), pa.array(scores)], ["row", "doc_id", "score"]
                    )

    return run


def _search(shards_of, items: DataFrame, k: int) -> DataFrame:
    """(row, doc_id, score): the best of every shard for one block of items (row, text)."""
    spark = items.sparkSession
    rows = items.select("row", "text").collect()  # a block has a bound
    owner, hashes, times, _ = _counts(word_hasher(GAPS), pa.array([r.text for r in rows], pa.large_string()))
    terms, at = np.unique(hashes, return_inverse=True)
    if not len(terms):
        return spark.createDataFrame([], "row long, doc_id long, score long")
    cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
    asked = [(r.row, at[a:b], times[a:b]) for r, a, b in zip(rows, cuts, cuts[1:]) if a < b]
    shards = stored(shards_of(terms), "impact-shards")
    documents, occurrences = shards.agg(F.sum("documents"), F.sum("occurrences")).first()
    frequency = np.zeros(len(terms), np.int64)
    pairs = shards.select(F.explode(F.arrays_zip("held", "frequency")).alias("p")).groupBy("p.held")
    for term, n in pairs.agg(F.sum("p.frequency")).collect():  # as many as the block has terms, at most
        frequency[term] = n
    documents, occurrences = documents or 0, occurrences or 0
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * frequency + 1))).astype(np.int64)
    return shards.mapInArrow(
        _searched(asked, weights, documents, occurrences, k), "row long, doc_id long, score long"
    )


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item.

    ``docs`` has doc_id and text, ``items`` has item_id and text.
    """
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = stored(only(items, "item_id", "text").withColumn("row", F.monotonically_increasing_id()), "impact-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    part = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found = [
        _search(lambda terms: texts.mapInArrow(_postings(terms), SHARDS), asked.where(part == b), k)
        for b in range(blocks)
    ]
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
