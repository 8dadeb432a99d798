"""Words, near words, forms and roots against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from skyloom.llm import spelling
from skyloom.llm.spelling import spelling_variants, vocabulary


def words_of(rows, damage):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            out[w] += 1
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, damage, min_chars=5, min_count=3):
    n = {w: c for w, c in words_of(rows, damage).items() if len(w) >= min_chars and c >= min_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def documents(seed):
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(4, 7))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaab", "ÿÿÿÿÿ", "ÀBCDE", "straße", "l×÷õt"]
    rows = [(None, "Hello hello HELLO hellO"), (1, None), (2, ""), (3, "12 ,.; œœœœœœ中中中中中"), (4, "x" * 3_000 + " ") , (4, "x" * 3_000), (5, "x" * 3_000 + " " + "x" * 2_999)]
    for i in range(10, 120):
        picked = r.choices(stems, [1 / (k + 1) for k in range(len(stems))], k=60)
        for k in range(len(picked)):
            if r.random() < 0.25:
                w, at = picked[k], r.randrange(len(picked[k]))
                picked[k] = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abé") + w[at:], w[:at] + r.choice("abéc") + w[at + 1 :]])
        rows.append((i, r.choice([" ", ", ", "\n", "œ"]).join(picked)))
    return rows + [rows[-1], (None, rows[-2][1])]


@pytest.mark.parametrize("hot", [10, spelling.HOT])
def test_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling.C, "STEP_BYTES", 500)
    rows = documents(hot)
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling_variants(docs, damage=97)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(x) for x in got.collect()]
    want = brute(rows, 97)
    assert len(got) == len(want) and set(got) == want
    assert sum(x[1] is not None for x in want) > 50 and any(x[1] and x[2] != x[1] for x in want)


def test_no_damage_short_words_and_empty(spark):
    rows = [(1, "ab ab ac ac ac ac b b b c"), (2, "ab B C")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(x) for x in spelling_variants(docs, min_chars=1, min_count=1).collect()}
    assert got == brute(rows, 0, 1, 1)
    assert vocabulary(docs.limit(0)).collect() == [] and spelling_variants(docs.limit(0)).collect() == []
