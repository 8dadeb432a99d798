"""Base counts against plain Python; verdicts on planted junk."""

import random
import re
from collections import Counter

from skyloom.llm.quality_rules import MIN_GROUP, MIN_WORDS, REACH, SPREADS, judged, keep_good, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choice("aehinorstüé") for _ in range(r.randint(2, 8))) for _ in range(200)]
    prose = lambda n: "\n".join(" ".join(r.choice(vocabulary) for _ in range(11)) for _ in range(n))
    texts = [prose(r.randint(6, 40)) for _ in range(300)]
    junk = [" ".join(w + "%%%" for w in prose(10).split()), "spam and ham\n" * 60, prose(3) + " x" * 3000, prose(20).upper(), "\n".join([prose(1)] * 9 + [prose(8)])]
    odd = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "\x0ba\x0cb\rc d  ", "x " * 6000, "a b " * 4000, prose(900) + prose(900), " ".join(str(i % 150) for i in range(4000)), "l\r\nl\n\nl \n l\nl"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}") for i, t in enumerate(texts + junk + odd)] + [(None, odd[4], None, None), (3, texts[3], "en", "s1")]
    docs = spark.createDataFrame([(*x, 0, 0) for x in rows], "doc_id long, text string, lang string, source string, t long, words int").repartition(4)
    got = {}
    for x in quality_rules(docs).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, _, _ in rows:
        for x in got[i]:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == plain(t), (i, (t or "")[:60])
            assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
    assert all(got[i][0].kept for i in range(len(texts)))
    assert not any(got[len(texts) + i][0].kept for i in range(len(junk)))
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(i for i, *_ in rows if i is not None and got[i][0].kept)
    assert quality_rules(docs.limit(0)).collect() == []


def test_groups_decide(spark):
    """The same statistics get another verdict in another source."""
    r = random.Random(9)
    columns = "doc_id long, lang string, source string, t long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_caps long"
    plain = lambda i: (i, "en", "prose", i, 100, 450 + r.randint(0, 100), 0, 20, 0, 0, 10)
    code = lambda i: (i, "en", "code", i, 100, 450 + r.randint(0, 500), r.randint(0, 120), 20, r.randint(0, 8), r.randint(0, 30), r.randint(0, 90))
    rows = [plain(i) for i in range(300)] + [code(i) for i in range(300, 600)]
    odd = [(850, 0, 0, 0, 10), (500, 45, 0, 0, 10), (500, 0, 9, 0, 10), (500, 0, 0, 40, 10), (500, 0, 0, 0, 60)]
    for k, (chars, symbols, dup, repeat, caps) in enumerate(odd):
        rows += [(1000 + 2 * k + j, "en", s, 0, 100, chars, symbols, 20, dup, repeat, caps) for j, s in enumerate(("prose", "code"))]
    got = {x.doc_id: x.kept for x in judged(spark.createDataFrame(rows, columns)).collect()}
    assert all(got[i] for i in range(600))
    assert [(got[1000 + 2 * k], got[1001 + 2 * k]) for k in range(len(odd))] == [(False, True)] * len(odd)


def exact(values, q):
    """The least value that a share q of the values doesn't exceed."""
    return sorted(values)[max(0, -(-int(q * 1000) * len(values) // 1000) - 1)]


def test_verdicts_by_exact_quantiles(spark):
    """kept against fences from exact quantiles, by group where it is large enough, else by language, else over all."""
    r = random.Random(21)
    columns = "doc_id long, lang string, source string, t long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_caps long"
    rows = []
    for g, (lang, source, n) in enumerate([("en", "a", 400), ("en", "b", 260), ("en", "c", 40), ("de", "a", 230), ("fr", "a", 20), (None, None, 15), ("de", None, 210)]):
        for _ in range(n):
            chars = 400 + r.randint(0, 20 * g + 20)
            rows.append((len(rows), lang, source, 0, r.choice([20, 100, 100, 100]), chars, int(chars * r.choice([0, 0, 0.002 * g, 0.02, 0.05])), 20, r.choice([0, 0, 1, g, 9]), r.choice([0, 2, 3 * g, 40, 60]), r.randint(5, 5 + 4 * g)))
    shares = {}
    for i, lang, source, _, words, chars, symbols, lines, dup, repeat, caps in rows:
        shares[i] = {"symbol_share": symbols / chars, "dup_line_share": dup / lines, "repeat_share": repeat / words, "caps_share": caps / chars, "word_length": chars / words}
    base = {x[0]: x[4] < MIN_WORDS or 100 * x[9] > 50 * x[4] for x in rows}
    fences = {}
    for key in (lambda x: (x[1], x[2]), lambda x: x[1], lambda x: 0):
        groups = {}
        for x in rows:
            if not base[x[0]]:
                groups.setdefault(key(x), []).append(shares[x[0]])
        for x in rows:
            own = groups.get(key(x), [])
            if x[0] not in fences and (len(own) >= MIN_GROUP or key(x) == 0 and isinstance(key(x), int)):
                low, high = ({k: exact([s[k] for s in own], q) for k in SPREADS} for q in (0.25, 0.75))
                fences[x[0]] = {k: high[k] + REACH * max(SPREADS[k], high[k] - low[k]) for k in SPREADS}
    want = {i: not base[i] and all(shares[i][k] <= fences[i][k] for k in SPREADS) for i in shares}
    got = {x.doc_id: x.kept for x in judged(spark.createDataFrame(rows, columns).repartition(4)).collect()}
    assert got == want and 100 < sum(want.values()) < len(rows) - sum(base.values())
