import re

from helpers import AWKWARD, documents

from planloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resolved(found):
    far, covered, labels = 0, 0, set()
    for s, back, _, label in sorted(found):
        if -back > far:
            covered += -back - max(far, s)
            far = -back
            labels.add(label)
    return covered, labels


def brute(text):
    """Every rule on every text, without gates."""
    ws = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    line = f" {' '.join(ws)} "

    def places(pattern):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line):
            first = line.count(" ", 0, m.start()) - 1
            yield first, first + m.group().count(" ") + 1

    base = [(s, e, label) for p, label in licenses.BASE.items() for s, e in places(p)]
    found = [(s, -e, k, r.label) for k, r in enumerate(licenses.rules()) for s, e in places(r.pattern)]
    found += [(s, -e, len(licenses.rules()), label) for s, e, label in base]
    covered, labels = resolved(found)
    if not labels:
        covered, labels = resolved([(s, -e, k, r.label) for k, r in enumerate(licenses.FALLBACK) for s, e in places(r.pattern)])
    own = {b for *_, b in base}
    starts = [s for s, *_ in base]
    return len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), covered / len(ws) if ws else 0.0


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. or any later version",
    "released under CC BY-NC 4.0. and cc-by and CC,\nBY sa 3.0",
    "All rights\nreserved. ALL RIGHTS RESERVED all rights reserved",
    "Released under the MIT License. SPDX-License-Identifier: GPL-2.0-only",
    "GNU Lesser General Public License v2.1 or later; LGPL 3.0; agplv3; GPLv2",
    "3-clause BSD license, BSD 2-Clause, bsd style license",
    "Creative Commons Attribution-NonCommercial-ShareAlike 2.5 Generic, cc0 1.0, public domain: released into the public domain",
    "accby ccby cc byx xcc by ccc by ÉCC BY cc\x00by",
    "Mozilla Public License 1.1 Eclipse Public License 2.0 permission is hereby granted, free of charge, to any person obtaining a copy",
    "general public license general public license",
    "Licensed under the terms of the Foo Bar Baz License copyright (c) 2019",
    "mit und mit der gpl nichts gpl 2",
]


def rows():
    out = [(200 + i, t) for i, t in enumerate(TEXTS)]
    out += [(300 + i, " ".join(TEXTS[i:] + ["filler words here"] * i)) for i in range(len(TEXTS))]
    for i, r in enumerate(licenses.rules()):  # a text for each rule, without its optional parts
        plain = re.sub(r"\(\?![^)]*\)", "", r.pattern)
        for _ in range(6):
            plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", plain)
        plain = re.sub(r"(.)\?", r"\1", plain.replace("[sc]", "s").replace("\\d", "1").replace("\\S+", "word").replace("{0,3}", ""))
        out.append((1000 + i, f"intro {plain} end"))
    return out


def test_against_brute_force(spark):
    every = AWKWARD + rows()
    got = sorted((tuple(r) for r in licenses.scan(documents(spark, every)).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in every), key=str)


def test_rules_fire_and_are_hundreds(spark):
    assert len(licenses.rules()) > 200
    got = {r.doc_id: r.labels for r in licenses.scan(documents(spark, rows())).collect()}
    assert "apache-2.0" in got[200].split(",")
    assert "gpl-3.0-or-later" in got[201]
    assert {"cc-by", "cc-by-nc-4.0", "cc-by-sa-3.0"} <= set(got[202].split(","))
    assert got[203] == "reserved"
    assert {"gpl-2.0-only", "mit"} <= set(got[204].split(","))
    assert sum(bool(got[1000 + i]) for i in range(len(licenses.rules()))) > 0.9 * len(licenses.rules())


def test_real_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = sorted(tuple(r) for r in licenses.scan(docs).collect())
    assert got == sorted((r.doc_id, *brute(r.text)) for r in docs.collect())


def test_empty_and_only_jvm_operators(spark):
    scanned = licenses.scan(documents(spark, []))
    assert scanned.count() == 0
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_thousands_of_detections(spark):
    """One text with very many places of several phrases, and one without any in many words."""
    rows = [(1, "All rights reserved. CC BY, GPL 2.0 or later; " * 3000), (2, "general public license " * 5000), (3, "licence of nothing " * 30000)]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {d: brute(t) for d, t in rows}
