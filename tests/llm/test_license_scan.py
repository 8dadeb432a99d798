"""Licence scans against all rules over whole texts, without keywords and windows."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skyloom.llm import license_scan as S
from skyloom.llm.license_rules import REACH, all_rules

RULES = all_rules()


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hides(o, m):
    """Whether the match o = (start, end, rank, rule) hides m: it holds m and is stronger, or longer, or of an earlier rule."""
    return o[0] <= m[0] and o[1] >= m[1] and o[2] <= m[2] and (o[:2] != m[:2] or o[2:] < m[2:])


def brute(text):
    ws = words(text)
    line = "".join(w + " " for w in ws)
    start = [0]
    for w in ws:
        start.append(start[-1] + len(w) + 1)
    number = {b: i for i, b in enumerate(start)}
    places = [(label, i) for phrase, label in S.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    found = [(*m.span(), r.rank, k) for k, r in enumerate(RULES) for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?= )", line)]
    stand = [m for m in found if not any(hides(o, m) for o in found)]
    named = [(RULES[k].label, k, number[a], number[b + 1] - 1) for a, b, _, k in stand if RULES[k].label]
    base = sorted({x for x, _ in places})
    best = {}
    for label, k, _, _ in named:
        best[label] = max(best.get(label, 0), RULES[k].weight)
    for label in base:
        best[label] = max(best.get(label, 0), S.PHRASE_WEIGHT)
    score = 1.0
    for label in sorted(best):
        score *= 1 - best[label]
    at = [i for _, i in places]
    return (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(best)), round(1 - score, 9)), sorted(named)


TEXTS = [
    None, "", " \n", "nothing of the kind", "Released under the MIT License.", "UNDER THE MIT LICENSE under the mit-license under the mit licenses", "Licensed under the Apache License, Version 2.0.",
    "apache license version 2", "apache license version 20", "Licensed under CC BY-NC 4.0.", "CC-BY-NC-SA 4.0, cc by nc", "This work is licensed under the GNU General Public License, version 3.",
    "GNU Lesser General Public License v2.1 or later", "not licensed under the MIT license", "is compatible with the GPL v2 but distributed under the BSD 3-Clause License",
    "// SPDX-License-Identifier: GPL-2.0-or-later", "see https://www.gnu.org/licenses/gpl-3.0.html", "mit der Lizenz", "\x00under\x7fthe mit license\x00", "éunder the mit license", "under the mit licenseé",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "all rights reserved. " * 40, "cc by nc " * 2000, "gpl " * 900 + "gpl version 2", "a" * 70_000 + " under the mit license",
    "Neither the name of the University of Somewhere nor the names of its contributors may be used", "License: Apache-2.0", "released into the public domain",
]


def test_against_all_rules(spark):
    r = random.Random(3)
    pool = [w for t in TEXTS if t and len(t) < 400 for w in t.split()] + ["gpl", "version", "3", "license", "the", "not", "é"]
    texts = TEXTS + [" ".join(r.choices(pool, k=r.randint(1, 60))) for _ in range(60)] + [" ".join(r.sample([t for t in TEXTS if t and len(t) < 400], 6)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, TEXTS[4]), (4, TEXTS[4])]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, labels string, t int").repartition(3)
    got = sorted(((x.doc_id is None, x.doc_id or 0), tuple(x)[1:7] + (round(x.score, 9),)) for x in S.license_scan(docs).collect())
    want = sorted(((i is None, i or 0), brute(t)[0]) for i, t in rows)
    assert got == want
    found = {x.doc_id: sorted((f.label, f.rule, f.first, f.last) for f in x.found) for x in S.scan(docs).collect() if x.doc_id is not None}
    assert found == {i: brute(t)[1] for i, t in rows if i is not None}
    labels = {x.doc_id: x.labels for x in S.license_scan(docs).collect()}
    assert [labels[i] for i in (4, 9, 11, 12, 13, 14, 15, 16, 17)] == ["mit", "cc-by-nc", "gpl-3", "lgpl-2-1", "mit", "bsd-3-clause", "gpl-2", "gpl-3", ""]
    assert S.license_scan(docs.limit(0)).collect() == []


def test_small_steps_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    want = sorted(map(str, S.license_scan(docs).collect()))
    monkeypatch.setattr(S.C, "STEP_BYTES", 100)
    monkeypatch.setattr(S, "HELD", 3)
    assert sorted(map(str, S.license_scan(docs).collect())) == want


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sampled_from(RULES).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(rf"\A(?:{r.pattern})\Z", alphabet=st.sampled_from("abcdefghijklmnopqrstuvwxyz0123456789 ")))))
def test_every_match_holds_a_keyword(case):
    rule, text = case
    assert any(k in text + " " for k in rule.keywords), (rule, text)
    assert len(text) < REACH


def test_hundreds_of_rules():
    assert len(RULES) > 400 and len({r.label for r in RULES}) > 80
