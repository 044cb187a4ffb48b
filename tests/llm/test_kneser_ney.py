"""The language model against a plain one that counts with dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from contactscope.llm import kneser_ney as kn

SCHEMA = "doc_id long, text string, score string, n_tokens long"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def out_of(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def plain(rows, order):
    """(n_tokens, n_known, N, base, score) of every row."""
    train = [words(text) for i, text in rows if not out_of(i)]
    single = Counter(w for ws in train for w in ws)
    n, v = sum(single.values()), len(single)
    grams = {order: Counter()}
    for ws in train:
        marked = ["<"] * (order - 1) + [("w", w) for w in ws]
        grams[order].update(tuple(marked[i : i + order]) for i in range(len(ws)))
    for level in range(order - 1, 0, -1):
        grams[level] = Counter(g[1:] for g in grams[level + 1])
    cuts, after = {}, {}
    for level, counts in grams.items():
        of = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0
        cuts[level] = [0]
        for k, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
            d = k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] and of[k] else usual
            cuts[level].append(d if 0 < d < k else usual)
        after[level] = defaultdict(list)
        for g, c in counts.items():
            after[level][g[:-1]].append(c)

    def p(gram):
        level = len(gram)
        if level == 0:
            return 1 / (v + 1)
        follow = after[level].get(gram[:-1])
        lower = p(gram[1:])
        if not follow:
            return lower
        spare = sum(cuts[level][min(c, 3)] for c in follow)
        count = grams[level].get(gram, 0)
        return (count - cuts[level][min(count, 3)] + spare * lower) / sum(follow)

    out = []
    for _, text in rows:
        ws = words(text)
        marked = ["<"] * (order - 1) + [("w", w) for w in ws]
        score = sum(math.log10(p(tuple(marked[i : i + order]))) for i in range(len(ws)))
        base = sum(math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((len(ws), sum(single[w] > 0 for w in ws), n, base, score))
    return out


def made(seed=5):
    draw = random.Random(seed)
    some = ["a", "B", "ab", "ñu", "the", "THE", "été", "x" * 300, "語", "0"]
    rows = [(i, " ".join(draw.choices(some, k=draw.randrange(1, 40)))) for i in range(120)]
    rows += [(i, "\t the  only\nline \x0b") for i in range(120, 140)]
    rows += [(None, "a b"), (None, None), (200, None), (201, ""), (202, " \n"), (7, rows[7][1]), (7, "other text")]
    return [*rows, (300, "one two " * 20_000), (301, "unseen word a")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_plain_model(spark, order):
    rows = made()
    docs = spark.createDataFrame([(i, t, "own", 5) for i, t in rows], SCHEMA).repartition(3)
    got = kn.language_scores(docs, order).collect()
    want = sorted((str(i), out_of(i), *rest) for (i, _), rest in zip(rows, plain(rows, order), strict=True))
    for have, should in zip(sorted((str(r[0]), *r[1:]) for r in got), want, strict=True):
        assert have[:5] == should[:5]
        assert have[5:] == pytest.approx(should[5:], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    """After any word, all words, the end and one unknown word share the whole probability."""
    rows = [(i, t) for i, t in made() if not out_of(i)]
    model = kn.fit(spark.createDataFrame([(i, t, "own", 5) for i, t in rows], SCHEMA), 2)
    every = np.arange(model.words + 2)  # the last is the unknown one, the one before the begin mark
    for before in (0, 3, model.words, model.words + 1):
        pairs = np.stack([np.full(len(every), before), every], 1).ravel()
        starts = np.arange(0, len(pairs) + 1, 2)
        p = kn._probabilities(model, pairs.astype(np.uint32), starts)[1::2]
        assert p[every != model.words].sum() == pytest.approx(1)


def _held():
    return next(i for i in range(1000, 2000) if out_of(i))


def test_held_out_text_is_better_told_than_by_single_words(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    base, score = kn.language_scores(docs).where("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert score > base


@pytest.mark.parametrize("rows", [[], [(_held(), "a b")]])
def test_nothing_to_learn_from(spark, rows):
    got = kn.language_scores(spark.createDataFrame([(i, t, "own", 5) for i, t in rows], SCHEMA)).collect()
    assert [tuple(r)[1:] for r in got] == [(True, 3, 0, 0, 0.0, 0.0) for _ in rows]
