"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from contactscope.llm import impact_search

DOCS = "doc_id long, text string, item_id long, score string"
ITEMS = "item_id long, text string, doc_id string, rank int"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            score = 0
            for t in terms(text):
                if tf := bag.get(t, 0):
                    m = 75 + (25 * sum(bag.values()) * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, k=20, parts=4):
    made = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(parts)
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS)
    got = impact_search.search(made, asked, k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, items, k)


def corpus(n, seed=3):
    draw = random.Random(seed)
    words = ["de", "The", "la", "x1", "ñu", *[f"w{i}" for i in range(60)]]
    weights = [40, 30, 20, 5, 5, *[60 / (i + 3) for i in range(60)]]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randrange(1, 60)))) for i in range(n)]
    items = [(i, ", ".join(draw.choices(words, k=draw.randrange(1, 30)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("k", [1, 3, 20])
def test_equals_all_scores(spark, monkeypatch, k):
    monkeypatch.setattr(impact_search, "FIRST_READ", 2)
    docs, items = corpus(400)
    check(spark, docs, items, k)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "FIRST_READ", 1)
    docs, items = corpus(60)
    same = [(i, "The same-text, again") for i in range(1000, 1100)]  # ties, more than k
    docs += [*same, (None, "the same text again"), (2000, None), (2001, ""), (2002, "--- \x00 .")]
    docs += [(5, "w1 the"), (5, "w1 the"), (3000, "de w3 " * 60_000), (3001, "語彙 語彙 x"), (3002, "é" * 30_000)]
    items += [(100, "same again THE"), (101, None), (102, "-"), (103, "nowhere"), (None, "語彙 w3"), (104, "w1"), (104, "w1")]
    items += [(105, "de " * 3000 + " ".join(f"w{i}" for i in range(5000)))]
    check(spark, docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "ITEM_BYTES", 700)
    check(spark, *corpus(80, 9))


@pytest.mark.parametrize("docs", [[], [(1, None), (2, " ")]])
def test_no_documents(spark, docs):
    check(spark, docs, [(1, "de"), (2, None)])
    check(spark, [(1, "de")], [])


def test_lists_are_left_early():
    """A document that leads by far is found without reading to the ends of the lists."""
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice) and at.stop:
                reads.append(at.stop)
            return super().__getitem__(at)

    n = 100_000
    lists = []
    for shift in (0, 7):
        numbers = np.roll(np.arange(n), shift)
        numbers[numbers == 5], numbers[0] = numbers[0], 5
        lists.append((numbers.view(Watched), np.concatenate([[10**6], np.arange(n - 1, 0, -1)])))
    top, scores = impact_search._best(lists, n, 1)
    assert list(top) == [5] and list(scores) == [2 * 10**6] and max(reads) < 1000
