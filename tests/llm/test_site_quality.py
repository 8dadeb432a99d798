"""Held-out accuracy on planted junk and toxic words; shrinkage; odd rows."""

import random

from skyloom.llm import site_quality as S


def test_held_out_and_sites(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeginorst") for _ in range(r.randint(2, 7))) for _ in range(500)]
    rows, labels, truth = [], [], {}
    for i in range(1500):
        host = f"h{r.choice([0, 0, 0, 1, 2, 3])}"
        bad, toxic = r.random() < (0.4 if host == "h3" else 0.1), r.random() < 0.12
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        if bad:
            words = [w + "%%%" if r.random() < 0.8 else w for w in words]
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["xslur", "yslur", "zslur"])
        rows.append((i, " ".join(words), host, r.choice(["en", "de"])))
        truth[i] = (bad, toxic)
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(2000, None, "h0", "en"), (2001, "", None, None), (None, "plain", "h9", None), (2002, "plain words " * 80_000 + "x" * 300_000, "h1", "en"), (3, rows[3][1], rows[3][2], rows[3][3])]
    labels += [(None, 0, 1), (9999, 0, 1), (4, None, None), labels[0]]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, source string, lang string, host string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {}
    for x in S.classify(docs, lab).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, got.values())) == len(rows)
    held = [i for i in range(1500) if i % 3 == 0]
    wrong = [i for i in held if (got[i][0].p_low_quality >= 0.5, got[i][0].p_toxic >= 0.5) != truth[i]]
    assert len(wrong) <= 0.02 * len(held), len(wrong)
    assert got[2002][0].kept and got[2000][0].kept and got[2001][0].kept and got[None][0].kept
    assert [x.kept for x in S.classify(docs.limit(50), lab.limit(0)).collect()] == [True] * 50
    assert S.classify(docs.limit(0), lab).collect() == []


def test_only_near_copies_leave_the_sample(spark):
    r = random.Random(4)
    prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    shared = prose(200)
    rows = [(i, " ".join(prose(40) + shared[:60] + prose(40))) for i in range(60)]  # a passage in common, otherwise distinct
    copy = prose(100)
    rows += [(100 + i, " ".join(copy)) for i in range(5)] + [(200, ""), (201, "")]
    want = [*range(60), 100, 200]
    for seed in (1, 2):
        r.shuffle(rows)
        docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, label long").repartition(seed * 3)
        assert sorted(x.doc_id for x in S._one_of_each(docs).collect()) == want
