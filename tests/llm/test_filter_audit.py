"""The filter audit against each order applied document by document."""

import random
import re
from collections import Counter
from itertools import permutations

from skyloom.llm.filter_audit import FILTERS, audit, filter_audit, flagged


def fails(rows, i, letter):
    doc, text, _ = rows[i]
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    if letter == "A":
        return len(words) < 200
    if letter == "B":
        return 100 * len(set(words)) < 50 * len(words)
    if letter == "C":
        return 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)
    if letter == "D":
        return any(c in "#$%&*|" for c in text)
    return doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = [{c for c in FILTERS if fails(rows, i, c)} for i in range(len(rows))]
    out, total = {}, Counter()
    for part in {s or "" for _, _, s in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations(FILTERS):
            left = list(own)
            for step, c in enumerate(order, 1):
                here = [i for i in left if c in failed[i]]
                gone = [i for i in own if i not in left and c in failed[i]]
                left = [i for i in left if c not in failed[i]]
                unique = sum(failed[i] == {c} for i in own)
                out[part, "".join(order), step] = [len(left), len(here), len(gone), unique, sum(rows[i][0] in good for i in here), sum(rows[i][0] in toxic for i in here)]
                total[part, c] += len(here)
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def documents():
    r = random.Random(1)
    words = ["w%d" % i for i in range(400)] + ["é", "中文", "Ab", "ABC"]
    text = lambda n, k: r.choice([" ", "\n", "\t\x0b ", "  "]).join(r.choices(words[:k] + words[-4:], k=n))
    rows = [(0, None, None), (1, "", "a"), (2, " \n", "a"), (None, "", "b"), (None, None, None), (None, "x " * 300, "b"), (0, "x " * 300, "b"), (9, "x " * 300, None), (9, "x " * 300, "a"), (9, "x " * 300, "a")]
    for i in range(10, 90):
        rows.append((i, text(r.choice([1, 150, 199, 200, 201, 400]), r.choice([5, 90, 400])) + r.choice(["", "", "$", " | ", "."]), r.choice([None, "", "a", "b", "c"])))
    rows += [(100, rows[15][1], "a"), (101, rows[15][1], "c"), (5, rows[16][1], "c"), (102, "word " * 60_000, "c"), (102, "other text with this id", "c")]
    return rows


def test_against_every_order(spark):
    rows = documents()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 110, 2)] + [(10, 1, 1), (10, 0, 0), (None, 1, 1), (12, None, None)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    docs = spark.createDataFrame([(i, t, s, "c", 1) for i, t, s in rows], "doc_id long, text string, source string, key string, words int").repartition(4)
    said = spark.createDataFrame([(i, q, x, "p") for i, q, x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit(docs, said)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)
    assert filter_audit(docs.limit(0), said).collect() == []
    assert {x.good_lost for x in filter_audit(docs, said.limit(0)).collect()} == {0}
    three = audit(flagged(docs), said, "CAE")
    assert three.count() == 18 * len({s or "" for _, _, s in rows}) and three.filter("filter_order = 'AEC' and step = 2").count() == len({s or "" for _, _, s in rows})
