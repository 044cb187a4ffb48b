"""Toxicity by a weighted lexicon, matched by one Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones, digits and
signs inside words to the letters they stand for, everything else between words to one space. The
lexicon holds whole words and word beginnings with their log-odds of standing in a toxic document.
Exception phrases cancel the matches inside them. The weights found are summed and normalised by the
length of the text; a logistic curve over sum and normalised sum gives the score.

Weights, learned exceptions and the curve are fitted on at most ``max_rows`` labelled rows, drawn by
a hash of the id. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts match nothing and get the score of a text without matches;
a repeated or missing id is scored by its text; a missing id is not held out; labels without a value
are left out, and of several labels of one id the largest counts. Without labels of both kinds the
lexicon is empty and the score 0. Other columns are passed by; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.llm.common import lean, stored, text_runs

MAX_ROWS = 20_000
MAX_TERMS = 2_000
LEAST_WEIGHT = 3.0  # log-odds of a lexicon term
STEMS = (4, 5, 6)  # lengths of word beginnings that can be terms
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "pond scum", "soap scum",
    "clown fish", "circus clown", "stupid mistake", "sore loser", "worthless check",
)

#: Letters that look like Latin ones: Cyrillic and Greek, small, then a few signs of their own.
_LOOK = dict(zip("аеорсухіјѕԁһкмтвнпгԛԝ", "aeopcyxijsdhkmtbhnrqw", strict=True))
_LOOK |= dict(zip("αβεικνορτυχωϲ", "abeikvoptuxwc", strict=True))
_LOOK |= {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
_LOOK |= {chr(0xFF10 + k): chr(48 + k) for k in range(10)}
_LOOK |= {c: "" for c in "​‌‍⁠﻿­"}
_LOOK |= {"ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l"}
_SIGNS = str.maketrans("@$!€", "asie")
_DIGITS = str.maketrans("0123456789", "oizeasgtbg")
_ELL = str.maketrans("0123456789", "olzeasgtbg")
_IN_WORD = re.compile(r"(?<=\w)[@$!€](?=\w)|(?<!\w)[@$](?=\w)")
_NUMBERED = re.compile(r"(?=\w*\d)(?=\w*[^\W\d_])\w+")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words with one space before and after each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _IN_WORD.sub(lambda m: m[0].translate(_SIGNS), text)
    text = _NUMBERED.sub(_unleet, text)
    return f" {_GAPS.sub(' ', text).strip()} "


def _unleet(match: re.Match) -> str:
    word = match[0]
    plain = word.translate(_DIGITS)
    return f"{plain} {word.translate(_ELL)}" if "1" in word else plain


_FOLD = {ord(a): b for a, b in _LOOK.items()}


@dataclass
class Lexicon:
    """What scoring needs: at most ``MAX_TERMS`` terms, the exceptions, and the curve."""

    terms: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _matcher(lexicon: Lexicon):
    """A function from a text to (sum of weights, number of words)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, weight in lexicon.terms.items():
        automaton.add_word(term, (weight, len(term)))
    for phrase in lexicon.exceptions:
        automaton.add_word(f" {phrase} ", (0.0, len(phrase) + 2))
    if len(automaton):
        automaton.make_automaton()

    def run(text: str | None) -> tuple[float, int]:
        folded = fold(text or "")
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not len(automaton):
            return 0.0, words
        hits = list(automaton.iter(folded))
        if not hits:
            return 0.0, words
        spared = [(end - n + 1, end) for end, (w, n) in hits if w == 0.0]
        total, last = 0.0, {}
        for end, (weight, n) in hits:
            begin = end - n + 1
            if weight and not any(lo <= begin and end <= hi for lo, hi in spared):
                last[begin] = max(last.get(begin, 0.0), weight)  # one hit a word
        total = sum(last.values())
        return total, words

    return run


def _features(total, words):
    import numpy as np

    total, words = np.asarray(total, float), np.asarray(words, float)
    return np.stack([np.ones_like(total), np.log1p(total), total / np.sqrt(words + 25.0)], axis=1)


def _terms_of(batches):
    """Partial document counts of words and beginnings by label."""
    import collections

    import pyarrow as pa

    counts = (collections.Counter(), collections.Counter())
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(fold(text or "").split())
            terms = {f" {w} " for w in words if 3 <= len(w) <= 30}
            terms |= {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}
            counts[label].update(terms)
    terms = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(terms), 100_000):
        part = terms[at : at + 100_000]
        yield pa.RecordBatch.from_pydict(
            {"term": part, "neg": [counts[0][t] for t in part], "pos": [counts[1][t] for t in part]},
            pa.schema([("term", pa.string()), ("neg", pa.int64()), ("pos", pa.int64())]),
        )


def _sampled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled rows that are not held out."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    labels = labels.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_ROWS,
    max_terms: int = MAX_TERMS,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Learn the lexicon and the curve; what comes to the driver is bounded by the parameters."""
    import numpy as np

    sample = stored(_sampled(docs, labels, max_rows), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Lexicon()
    share = n1 / (n0 + n1)
    counts = sample.mapInArrow(_terms_of, "term string, neg bigint, pos bigint")
    counts = counts.groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    weight = F.log((F.col("pos") + 0.5) / (n1 + 1.0)) - F.log((F.col("neg") + 0.5) / (n0 + 1.0))
    n = F.col("pos") + F.col("neg")
    proof = 2 * (
        F.col("pos") * F.log(F.col("pos") / (n * share))
        + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - share)))).otherwise(0.0)
    )
    counts = stored(counts.where("pos >= 3").withColumns({"weight": weight, "proof": proof}), "toxicity-terms")
    # The best of m terms that say nothing has a statistic of some 2 log m; a term must have more, and its weight
    # is shrunk by the share of that in its own.
    evidence = 2 * np.log(max(1, counts.count()))
    counts = counts.where((F.col("weight") >= LEAST_WEIGHT) & (F.col("proof") >= F.lit(float(evidence))))
    found = counts.orderBy(F.desc("proof"), "term").limit(max_terms).collect()
    terms = {r["term"]: r["weight"] * np.sqrt(1 - evidence / r["proof"]) for r in found if r["proof"] > evidence}
    lexicon = Lexicon(terms, tuple(p for p in exceptions))

    def measure(batches):
        import pyarrow as pa

        run = _matcher(lexicon)
        for batch in batches:
            got = [run(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())],
                ["toxic", "total", "words"],
            )

    seen = sample.mapInArrow(measure, "toxic int, total double, words bigint").toPandas()
    x, y = _features(seen["total"], seen["words"]), seen["toxic"].to_numpy(float)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge @ w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        move = np.linalg.solve(hess, grad)
        w = w + move * min(1.0, 4.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    lexicon.curve = tuple(float(v) for v in w)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, and the sum of weights and the number of words behind it, for every row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        measure = _matcher(lexicon)
        for batch in text_runs(batches):
            got = [measure(t) for t in batch.column("text").to_pylist()]
            total, words = [g[0] for g in got], [g[1] for g in got]
            z = np.clip(_features(total, words).reshape(-1, 3) @ np.array(lexicon.curve), -30, 30)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(1 / (1 + np.exp(-z)), pa.float64()),
                    pa.array(total, pa.float64()),
                    pa.array(words, pa.int64()),
                ],
                ["doc_id", "score", "weight", "n_words"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(lean(run), "doc_id bigint, score double, weight double, n_words bigint")


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on), and weight and words behind the score."""
    found = score(docs, fit(docs, labels, **how))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "weight",
        "n_words",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    lexicon = fit(docs, labels, **how)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        measure = _matcher(lexicon)
        for batch in text_runs(batches):
            got = [measure(t) for t in batch.column("text").to_pylist()]
            z = _features([g[0] for g in got], [g[1] for g in got]).reshape(-1, 3) @ np.array(lexicon.curve)
            yield batch.filter(pa.array(z < 0.0))

    return docs.mapInArrow(lean(run), docs.schema)
