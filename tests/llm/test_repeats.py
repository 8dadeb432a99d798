"""Suffix and substring deduplication against brute force over every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import repeats as R
from skyloom.llm.substring_dedup import Index, decided, solve, substring_dedup
from skyloom.llm.suffix_dedup import suffix_dedup, suffix_order


def brute(seqs, w):
    seen = Counter(s[i : i + w] for s in seqs for i in range(len(s) - w + 1))
    return [[any(seen[s[i : i + w]] > 1 for i in range(max(0, p - w + 1), min(p, len(s) - w) + 1)) for p in range(len(s))] for s in seqs]


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [text(n) for n in (34, 35, 36, 60, 80, 120, 150, 300)]
    docs = [text(r.randint(0, 500)) for _ in range(40)]
    for _ in range(70):
        i = r.randrange(len(docs))
        words = docs[i].split(" ")
        p = r.choice(passages).split(" ")
        a = r.randrange(len(p))
        k = r.randrange(len(words) + 1)
        docs[i] = " ".join(words[:k] + p[a // 4 : len(p) - r.randint(0, 5)] + words[k:])
    near = docs[3] + " " + text(200)
    for _ in range(12):  # near copies
        words = near.split(" ")
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        docs.append(" ".join(words))
    docs += [docs[5], docs[5], "a" * 1500, "ab" * 900, "x" * 399, "y" * 400, "y" * 401, "", None, " \t\n", "b a c \xa0 d " * 150]
    return list(enumerate(docs)) + [(None, docs[7]), (None, docs[7]), (0, docs[0]), (0, docs[9])]


@pytest.mark.parametrize("hot", [None, 1500])
def test_bytes_and_words_against_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(R, "HOT_SYMBOLS", hot)
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, t string, h int, spans int").repartition(5)
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, gone in zip(rows, texts, brute(texts, 400)):
        left = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(t), sum(gone), runs, hashlib.sha256(left).hexdigest(), left))
    got = [tuple(x) for x in suffix_dedup(docs).collect()]
    assert Counter((*x[:5], bytes(x[5])) for x in got) == Counter(want)
    seqs = [tuple(t.split()) for t in texts]
    want = []
    for (i, _), s, gone in zip(rows, seqs, brute(seqs, 35)):
        left = b" ".join(w for w, g in zip(s, gone) if not g)
        want.append((i, len(s), sum(gone), hashlib.sha256(left).hexdigest(), left.decode()))
    assert Counter(tuple(x) for x in substring_dedup(docs).collect()) == Counter(want)
    assert sum(x[2] for x in want) > 100


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(docs).collect() == []
    assert substring_dedup(docs).collect() == []


def test_suffix_order_is_the_suffix_array():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 9, 10, 11, 50, 300):
        for k in (1, 2, 4):
            x = r.integers(1, k + 1, n)
            assert suffix_order(x, 10**9).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_factors_decide_windows():
    """Windows by factors against brute force over all blocks; in near copies few places are looked up, without factors all are."""
    r = np.random.default_rng(4)
    for case in range(200):
        length, letters = int(r.integers(2, 8)), int(r.integers(2, 30))
        blocks = [r.integers(0, letters, int(r.integers(length, 40))) for _ in range(int(r.integers(1, 8)))]
        blocks += [b.copy() for b in blocks[: int(r.integers(0, 3))]]
        rows = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))
        windows = np.array([len(b) - length + 1 for b in blocks])
        seen = Counter(tuple(b[i : i + length]) for b in blocks for i in range(len(b) - length + 1))
        want = [seen[tuple(b[i : i + length])] > 1 for b in blocks for i in range(len(b) - length + 1)]
        assert solve(None, np.concatenate(blocks), rows, windows, length).tolist() == want, case
    base = r.integers(0, 10**9, 400)
    copies = [base.copy() for _ in range(3)]
    for i, c in enumerate(copies):
        c[100 * i + 50] = -1 - i
    index = Index(np.concatenate(copies), np.array([0, 400, 800, 1200]))
    found = decided(index, np.array([0, 400, 800, 1200]), np.array([366] * 3), 35)
    assert found.sum() == 3 * (366 - 35) and index.asked < 300
