"""Licence scan by ordered signature rules, in DataFrame operations only.

Texts are normalised to lower-case words with single spaces. A document without any of a few coarse
substrings is done; in the rest each rule runs only where its keyword occurs. All places of a rule
are found, as word intervals. Where detections overlap, one whose interval lies in that of a stronger
one is suppressed; stronger is the smaller level, within a level the longer interval, then the
earlier rule. Everything stays in the row: there is no shuffle.

The base phrases are searched besides the rules, and their labels are never suppressed. ``score`` is
the certainty of the surest detection that is left, 0 without any.

Defined results: null text counts as empty and has no words; repeated rows are scanned each; other
columns are passed by. An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactscope.llm.license_rules import RULES

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
CERTAINTY = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.4}
#: Every keyword of a rule contains one of these.
COARSE = [
    "licen", "spdx", "gpl", "copyright", "reserved", "public domain", "publicdomain", "warrant",
    "permission", "redistribut", "creative", "cc by", "cc0", "bsd", "mit ", "apache", "asl 2", "expat",
    "software", "mpl", "eclipse", "cddl", "development and distribution", "gfdl", "zlib", "wtfpl",
    "perl", "program", "restriction", "ofl", "eupl", "odbl", "open data", "beer", "polyform",
    "openrail", "llama", "proprietary", "unauthorized", "reproduc", "no part of", "trade secret",
    "eula", "freeware", "share", "openssl", "may not use", "same terms", "opensource", "products", "advertising",
    "either version", "modify", "source code form", "fuck", "as is", "restrictions", "gnu ",
]
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rules() -> list[tuple[int, str, str, str]]:
    """(level, label, keyword, regex) of every signature, in order."""
    out = []
    for line in RULES.splitlines():
        head, keyword, regex = (part.strip() for part in line.split(" | ", 2))
        level, label = head.split(" ")
        out.append((int(level), label, keyword, regex))
    return out


def normalised(text: Column) -> Column:
    """Lower-case words joined by single spaces; null gives an empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAP, " "))


def _words(text: Column) -> Column:
    """The number of spaces."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(norm: Column, regex: Column) -> Column:
    """(first word, end word) of each match of a regex over whole words in the padded text."""
    bounded = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    found = F.regexp_extract_all(norm, bounded, F.lit(0))
    gaps = F.transform(F.split(norm, bounded, -1), _words)
    pairs = F.arrays_zip(found.alias("text"), gaps.alias("gap"))
    start = F.struct(F.lit(-1).alias("at"), F.expr("cast(array() as array<struct<lo:int,hi:int>>)").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        lo = acc["at"] + pair["gap"]
        hi = lo + _words(pair["text"])
        one = F.array(F.struct(lo.alias("lo"), (hi + 1).alias("hi")))
        return F.struct(
            F.when(pair["text"].isNull(), lo).otherwise(hi).alias("at"),
            F.when(pair["text"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"),
        )

    return F.aggregate(pairs, start, step)["out"]


def _kept(found: Column) -> Column:
    """Detections that no stronger one contains; ``found`` has lo, neg_hi, level, rule, label."""
    levels = sorted(CERTAINTY)
    start = F.struct(
        F.array(*[F.lit(-1) for _ in levels]).alias("reach"),
        F.expr("cast(array() as array<struct<lo:int,hi:int,level:int,rule:int,label:string>>)").alias("out"),
    )

    def step(acc: Column, d: Column) -> Column:
        hi = -d["neg_hi"]
        covered = F.element_at(acc["reach"], d["level"]) >= hi
        reach = F.transform(
            acc["reach"], lambda r, k: F.when(k + 1 >= d["level"], F.greatest(r, hi)).otherwise(r)
        )
        one = F.struct(
            d["lo"].alias("lo"), hi.alias("hi"), d["level"].alias("level"), d["rule"].alias("rule"), d["label"].alias("label")
        )
        return F.struct(
            reach.alias("reach"),
            F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"),
        )

    return F.aggregate(F.array_sort(found), start, step)["out"]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, base (lo, hi, label), detections (lo, hi, ..., label)."""
    known = rules()
    keywords = sorted({k for _, _, k, _ in known})
    signature = "array<struct<level:int,rule:int,label:string,regex:string>>"
    by_keyword = {
        k: [
            {"level": level, "rule": n, "label": label, "regex": regex}
            for n, (level, label, key, regex) in enumerate(known)
            if key == k
        ]
        for k in keywords
    }
    table = F.from_json(F.lit(json.dumps(by_keyword)), f"map<string,{signature}>")
    rows = docs.select(F.col("doc_id"), normalised(F.col("text").cast("string")).alias("norm"))
    rows = rows.select(
        "doc_id",
        F.when(F.col("norm") == "", 0).otherwise(_words(F.col("norm")) + 1).cast("bigint").alias("n_words"),
        F.concat(F.lit(" "), F.col("norm"), F.lit(" ")).alias("norm"),
    )
    coarse = F.contains("norm", F.lit(COARSE[0]))
    for word in COARSE[1:]:
        coarse = coarse | F.contains("norm", F.lit(word))
    hits = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains("norm", k))
    rows = rows.withColumn("hits", F.when(coarse, hits))
    tried = F.flatten(F.transform("hits", lambda k: F.element_at(table, k)))

    def detections(r: Column) -> Column:
        return F.transform(
            _places(F.col("norm"), r["regex"]),
            lambda p: F.struct(
                p["lo"].alias("lo"), (-p["hi"]).alias("neg_hi"), r["level"].alias("level"), r["rule"].alias("rule"), r["label"].alias("label")
            ),
        )

    found = F.when(F.size("hits") > 0, F.flatten(F.transform(tried, detections)))
    rows = rows.withColumn("found", found)
    none = F.expr("cast(array() as array<struct<lo:int,hi:int,label:string>>)")

    def places(phrase: str, label: str) -> Column:
        return F.transform(
            _places(F.col("norm"), F.lit(phrase)),
            lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), F.lit(label).alias("label")),
        )

    base = [F.when(F.contains("norm", F.lit(p)), places(p, x)).otherwise(none) for p, x in BASE.items()]
    base = F.when(coarse, F.flatten(F.array(*base))).otherwise(none)
    nothing = F.expr("cast(array() as array<struct<lo:int,hi:int,level:int,rule:int,label:string>>)")
    return rows.select(
        "doc_id",
        "n_words",
        base.alias("base"),
        F.when(F.size("found") > 0, _kept(F.col("found"))).otherwise(nothing).alias("detections"),
    )


def licence_report(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places and labels, all labels, and the score."""
    rows = scan(docs)
    sure = F.create_map(*[F.lit(x) for pair in CERTAINTY.items() for x in pair])
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    more = F.transform("detections", lambda d: d["label"])
    surest = F.array_max(F.transform("detections", lambda d: F.element_at(sure, d["level"])))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["lo"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["lo"])).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.coalesce(surest, F.lit(0.0)).alias("score"),
        F.size("detections").cast("bigint").alias("n_detections"),
    )
