import re

from contactscope.llm.license_scan import BASE, COARSE, licence_report, rules, scan
from contactscope.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, norm string, labels int"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    words, out = words_of(text), []
    for phrase, label in BASE.items():
        want = phrase.split()
        out += [(k, label) for k in range(len(words)) if words[k : k + len(want)] == want]
    return len(words), len(out), min((k for k, _ in out), default=None), max((k for k, _ in out), default=None), ",".join(sorted({x for _, x in out}))


def detections(text):
    """Every rule by Python's regexes, and the suppression pair by pair."""
    norm, found = " " + " ".join(words_of(text)) + " ", []
    for n, (level, label, keyword, regex) in enumerate(rules()):
        if keyword in norm:
            for m in re.finditer(f"(?<= )(?:{regex})(?= )", norm):
                lo = norm[: m.start()].count(" ") - 1
                found.append((lo, lo + m[0].count(" ") + 1, level, n, label))
    kept = []
    for d in found:
        stronger = [
            e for e in found
            if e[0] <= d[0] and d[1] <= e[1] and e != d
            and (e[2] < d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or (e[:2] == d[:2] and e[3] < d[3])))
        ]
        if not stronger:
            kept.append(d)
    return sorted(kept)


TEXTS = [
    None, "", "MIT License", "the MIT\nlicense, and the Apache License Version 2.0; mit license",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "mit  lİcense MIT LICENSE",
    "GNU General Public License v3.0 or later general public license", "SPDX-License-Identifier: Apache-2.0",
    "Licensed under CC BY-NC 4.0.", "All rights reserved. Copyright (c) 2020 X", "commit license smit license",
    "mit license " * 3000, "licensed under the MIT license.", "kelvin K license", "BSD 3-Clause License",
    "This is free and unencumbered software released into the public domain.", "--mit--license--",
]


def test_query_base_columns_equal_brute_force(spark, folder):
    got = QUERIES["op6_license_scan"](spark, folder).collect()
    docs = dict(map(tuple, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()))
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(docs[r["doc_id"]])
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_detections_equal_pairwise_suppression(spark):
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(TEXTS)], SCHEMA)
    got = {r["doc_id"]: r for r in scan(docs).collect()}
    for k, text in enumerate(TEXTS):
        found = sorted((d["lo"], d["hi"], d["level"], d["rule"], d["label"]) for d in got[k]["detections"])
        assert found == detections(text), text
    report = {r["doc_id"]: r for r in licence_report(docs).collect()}
    assert [report[k]["n_base"] for k in (0, 1, 11)] == [0, 0, 3000]
    assert report[8]["labels"] == "cc-by-nc" and report[0]["score"] == 0.0


def test_every_keyword_passes_the_coarse_gate_and_every_rule_needs_its_keyword():
    assert len(rules()) > 200
    for _, _, keyword, regex in rules():
        assert any(c in f" {keyword} " for c in COARSE), keyword
        assert " ".join(words_of(keyword)) == keyword
        # Without optional parts and classes, the regex spells the keyword.
        plain = re.sub(r"\[cs\]", "s", regex)
        assert keyword.split()[0][:3] in plain


def test_no_python_and_no_shuffle(spark, folder):
    plan = QUERIES["op6_license_scan"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert licence_report(spark.createDataFrame([], SCHEMA)).count() == 0
