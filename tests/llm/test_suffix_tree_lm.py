"""Base scores against plain counting; the model against a plain suffix tree and on held-out text."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from skyloom.llm import suffix_tree_lm as L


def stream(before, w):
    """What stands before a word, the word and its closing, and where its symbols begin."""
    tail = (b" " + before.encode())[-2:] if before is not None else b"\n\n"
    return tail + b" " + (w.encode() + b" " if w else b"\n")


def places(s):
    """(symbol, longest context) of a token in its stream."""
    for i in range(3, len(s)):
        yield s[i], s[max(0 if i < 3 + L.HEAD else 2, i - L.DEPTH) : i]


def plain_model(pairs):
    """The same tree, with dictionaries. ``pairs``: how often training has each token behind each."""
    seen = defaultdict(Counter)
    counts = Counter()
    for (before, w), c in pairs.items():
        counts[w] += c
        for symbol, context in places(stream(before, w)):
            for d in range(len(context) + 1):
                seen[context[d:]][symbol] += c
    kept = {b""}
    for ctx, dist in seen.items():
        n, p = sum(dist.values()), seen[ctx[1:]]
        if ctx and sum(k * math.log(k / n / (p[s] / sum(p.values()))) for s, k in dist.items()) >= L.MIN_DIVERGENCE:
            kept.add(ctx)

    def lp(before, w):
        out = 0.0
        for symbol, context in places(stream(before, w)):
            p = 1 / 256
            for d in range(len(context), -1, -1):
                ctx = context[d:]
                if ctx in kept:
                    n, u = sum(seen[ctx].values()), len(seen[ctx])
                    p = (seen[ctx][symbol] + u * p) / (n + u)
            out += math.log10(p)
        return out

    new = (sum(c == 1 for c in counts.values()) + 1) / (sum(counts.values()) + 2)
    return lambda before, w: math.log10(1 - new) + lp(before, w) if counts[w] else math.log10(new)


def test_scores(spark):
    r = random.Random(7)
    parts = ["th", "er", "on", "ing", "é", "an", "st"]
    word = lambda: "".join(r.choice(parts) for _ in range(min(6, 1 + int(r.expovariate(0.7)))))
    rows = [(i, " ".join(word().title() if r.random() < 0.1 else word() for _ in range(r.randint(0, 120)))) for i in range(300)]
    rows += [(400, None), (401, " \n"), (None, "The end"), (7, rows[7][1]), (8, "x" * 3000), (402, "the " * 5000)]
    docs = spark.createDataFrame([(*x, "c", 1.0) for x in rows], "doc_id long, text string, w string, c double").repartition(5)
    tokens = lambda t: [w.encode().lower().decode() for w in (t or "").split()] + [""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    behind = lambda ts: zip([None, *ts], ts)
    n, v, lp = sum(counts.values()), len(counts), plain_model(Counter(x for i, t in rows if not held(i) for x in behind(tokens(t))))
    want = []
    for i, t in rows:
        ts = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
        want.append((-1 if i is None else i, held(i), len(ts), sum(counts[w] > 0 for w in ts), n, base, sum(lp(*x) for x in behind(ts))))
    got = sorted((-1 if x[0] is None else x[0], *x[1:]) for x in map(tuple, L.score(docs).collect()))
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want)]
    for a, b in zip(got, sorted(want)):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    # the order of words counts
    turned = docs.filter("doc_id = 8 or text like '% %'").selectExpr("doc_id", "array_join(reverse(split(text, ' ')), ' ') text")
    assert sum(abs(a.score - b.score) > 1e-6 for a, b in zip(*(sorted(L.score(x).collect(), key=lambda x: x.doc_id or -1) for x in (docs.filter("text like '% %'"), turned.filter("text like '% %'"))))) > 200
    # held-out prose is likelier under the model than under the base
    fresh = [i for i, t in rows if i is not None and i < 300 and held(i) and i not in (7, 8)]
    assert sum(x[6] for x in got if x[0] in fresh) > sum(x[5] for x in got if x[0] in fresh)
    assert L.score(docs.limit(0)).collect() == []


def test_rare_contexts_stay_however_large_the_corpus(spark):
    words = [("qzx", 40), ("qzy", 1)] + [(f"{a}{b}", 1_000_000) for a in "abcdefgh" for b in "uvwxyz"]
    frame = spark.createDataFrame(words, "w string, c long")
    number = lambda w: int.from_bytes((w.encode() + b" ").ljust(L.HEAD, b"\0")[: L.HEAD] + b"\n\n", "big")
    windows = spark.createDataFrame([(number(w), c) for w, c in words] + [(number("qzz"), 0)], "k long, c long")
    kept = {(d, x.ctx) for d, table in enumerate(L.tree(L.counted(frame, windows))) for x in table.filter('stays').collect()}
    context = lambda b: (len(b), int.from_bytes(b, "big"))
    assert context(b"qz") in kept or context(b"q") in kept  # 41 of some 144 million symbols
    want, (bodies, heads) = plain_model(Counter({(None, w): c for w, c in words})), L.token_scores(frame, windows, 0.5)
    bodies, heads = {x.w: x.lp - math.log10(0.5) for x in bodies.collect()}, {x.k: x.lp for x in heads.collect()}
    for w, _ in words:
        assert bodies[w] + heads[number(w)] == pytest.approx(want(None, w) - math.log10(1 - 2 / 48_000_043), rel=1e-9)
    assert heads[number("qzz")] < heads[number("qzx")]
