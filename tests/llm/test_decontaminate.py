"""Planted passages, whole and with substitutions, and seeds against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from skyloom.llm import common as C
from skyloom.llm import decontaminate as D


def test_seeds_against_brute_force():
    r = random.Random(4)
    docs = [[r.choice("abc") for _ in range(r.randint(0, 60))] for _ in range(30)]
    w, rows = D.words(*C.buffers(pa.array([" ".join(x) for x in docs])))
    for mask in D.ALL_MASKS:
        h, at = D.seeds(w, rows, mask)
        key = lambda s, i: tuple(x for x, m in zip(s[i : i + len(mask)], mask) if m == "1")  # noqa: E731,B023
        want = [(d, i, key(s, i)) for d, s in enumerate(docs) for i in range(len(s) - len(mask) + 1)]
        assert [int(rows[d]) + i for d, i, _ in want] == at.tolist()
        assert len({(k, x) for (_, _, k), x in zip(want, h.tolist())}) == len({k for *_, k in want}) == len(set(h.tolist()))


def least_changes(masks, n):
    """The fewest changed words, neither first nor last, of 1 to n aligned words that leave no seed whole."""
    side = 1 << (max(map(len, masks)) - 1)
    whole = lambda x: any(x & int(m, 2) == int(m, 2) for m in masks)
    cost, out = {0: 0}, [0]
    for k in range(n):
        new = {}
        for state, c in cost.items():
            for bit in (1, 0) if k else (1,):
                x = state << 1 | bit
                if not whole(x):
                    new[x % side] = min(new.get(x % side, 10**9), c + 1 - bit)
        cost = new
        out.append(min([c for x, c in cost.items() if x & 1], default=10**9))
    return out


def test_no_accepted_overlap_is_without_a_seed():
    for masks, lo, hi in ((D.MASKS, 13, 600), (D.MEDIUM_MASKS, 9, 12), (D.SHORT_MASKS, 3, 8)):
        least = least_changes(masks, hi)
        assert all(least[n] > n // 4 for n in range(lo, hi + 1))
        assert {D.masks_of(n) for n in range(lo, hi + 1)} == {masks}


def test_planted(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [text(r.randint(20, 60)) for _ in range(30)] + [["short", "item"], text(12)]
    rows, want = [], set()
    for i in range(300):
        words = text(r.randint(0, 200))
        if i % 3 == 0:
            k = r.randrange(len(items))
            p = list(items[k])
            if i % 6 == 0 and len(p) >= 20:  # every tenth word changed
                for j in range(r.randrange(10), len(p), 10):
                    p[j] = r.choice(vocabulary)
            at = r.randint(0, len(words))
            words[at:at] = [(w.title() if w.isascii() else w) + r.choice(["", ",", "!"]) for w in p]
            if len(p) >= 12:
                want.add((i, k))
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (None, rows[0][1]), (502, "a " * 20_000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "a a " * 30)], "item_id long, text string")
    for bits in (D.FILTER_BITS, 6):  # a full filter costs rows only
        monkeypatch.setattr(D, "FILTER_BITS", bits)
        got = {(x.doc_id, x.item_id) for x in D.contaminated(docs, bench).collect()}
        assert {x for x in got if x[0] is not None and x[0] < 500} == want
        assert (None, 0) in {(a, 0) for a, _ in got} and (502, 91) in got
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows if i is not None and i != 502} - {i for i, _ in want}
    assert D.contaminated(docs, bench.limit(0)).collect() == [] and D.contaminated(docs.limit(0), bench).collect() == []


def test_every_accepted_overlap_is_found(spark):
    items, docs, want = [], [], set()
    for n in (*range(3, 18), 20, 28, 40, 50):
        item = [f"w{n}x{j}" for j in range(n)]
        most = n // 4
        changes = list(combinations(range(1, n - 1), most)) if n <= 15 else [tuple(range(s, n - 1, 4))[:most] for s in (1, 2, 3)] + [tuple(range(n // 2, n // 2 + most))]
        for c in changes:
            want.add((len(docs), len(items)))
            docs.append(["before"] * 3 + ["other" if j in c else x for j, x in enumerate(item)] + ["behind"] * 3)
        if 3 < n < 14:  # one change too many
            docs.append(["other" if 1 <= j <= most + 1 else x for j, x in enumerate(item)])
        items.append(item)
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], f"{key} long, text string").repartition(4)
    assert {(x.doc_id, x.item_id) for x in D.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()} == want


@pytest.mark.parametrize("rate", [0.05, 0.15, 0.25, 0.35])
def test_substitutions_against_every_diagonal(spark, rate):
    r = random.Random(int(100 * rate))
    vocabulary = [f"v{k}" for k in range(60)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [text(r.randint(1, 45)) for _ in range(25)] + [["same"] * 20]
    docs = []
    for _ in range(80):
        p = [r.choice(vocabulary) if r.random() < rate else w for w in r.choice(items)]
        docs.append(text(r.randint(0, 40)) + p[r.randrange(3) :] + text(r.randint(0, 40)))
    docs += [docs[0], docs[0], ["same"] * 300]
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], f"{key} long, text string").repartition(3)
    got = sorted(tuple(x) for x in D.contaminated(frame(docs, "doc_id"), frame([*items, items[0]], "item_id")).collect())
    want = []
    for i, doc in enumerate(docs):
        for k, item in enumerate([*items, items[0]]):
            best = None
            for d in range(1 - len(item), len(doc)) if len(item) > 2 else ():
                lo, hi = max(0, d), min(len(doc), len(item) + d)
                found = D.longest(np.array([doc[x] == item[x - d] for x in range(lo, hi)]), min(D.MIN_WORDS, len(item)))
                if found:
                    best = max(best or (0, 0, 0), (found[0], found[1], -(lo + found[2])))
            if best:
                want.append((i, k, best[1], best[0], -best[2]))
    assert got == sorted(want) and len(want) > 10


def test_longest_against_brute_force():
    r = random.Random(6)
    for _ in range(2000):
        same = np.array([r.random() < 0.7 for _ in range(r.randint(1, 40))])
        want = [(int(same[a:b].sum()), b - a, -a) for a in range(len(same)) for b in range(a + 5, len(same) + 1) if same[a] and same[b - 1] and same[a:b].sum() >= 0.75 * (b - a)]
        got = D.longest(same, 5)
        assert (got and (got[0], got[1], -got[2])) == max(want, default=None)
