"""Fingerprints and components against brute force over all pairs."""

import random

import xxhash

from skyloom.llm.simhash import SEGMENTS, _ball, fingerprint, fingerprints, keep_one, linked, near_duplicates, segments_for


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    label = dict(zip(prints, prints))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in prints:
        for y in prints:
            if x < y and bin(x ^ y).count("1") <= 4:
                label[max(find(x), find(y))] = min(find(x), find(y))
    return {x: find(x) for x in prints}


def test_components_against_all_pairs(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdeÉs") for _ in range(r.randint(1, 6))) for _ in range(120)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n", "One", "one two three", "a b c d", "A B C D", "x " * 9000] + [text(r.randint(1, 90)) for _ in range(150)]
    for _ in range(150):
        words = (texts[20] + " " + text(150) if r.random() < 0.2 else texts[r.randrange(8, 40)] or "a").split(" ")
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (None, "only here without an id at all"), (9, texts[9]), (9, texts[9])]
    docs = spark.createDataFrame([(a, b, "f", 1) for a, b in rows], "doc_id long, text string, fp string, label int").repartition(5)
    prints = [plain(t) for _, t in rows]
    assert [fingerprint((t or "").encode()).hex() for _, t in rows] == [f"{x:016x}" for x in prints]
    label = groups(sorted(set(prints)))
    least = {}
    for (i, _), x in zip(rows, prints):
        if i is not None:
            least[label[x]] = min(i, least.get(label[x], i))
    want = sorted((i is None, i or 0, f"{x:016x}", least.get(label[x])) for (i, _), x in zip(rows, prints))
    got = near_duplicates(docs)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.fingerprint, x.component_id) for x in got.collect()) == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(set(least.values()))
    assert kept.filter("doc_id is null").count() == 1
    assert near_duplicates(docs.limit(0)).collect() == []


def test_chains_of_fingerprints(spark):
    """Links of up to four bits around many centres, without texts."""
    r = random.Random(8)
    prints = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = groups(sorted(prints))
    for segments in (None, min(SEGMENTS)):
        got = {x.fp: x.label for x in linked(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), segments=segments).collect()}
        assert len(got) == len(prints)
        pairs = {(want[x], got[signed(x)]) for x in prints}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert [segments_for(n, 4) for n in (10**3, 10**6, 10**9)] == sorted([segments_for(n, 4) for n in (10**3, 10**6, 10**9)], reverse=True)


def test_one_large_component(spark):
    """A chain of 3,000 fingerprints, two bits apart each."""
    r, x, prints = random.Random(9), 0, []
    for _ in range(3000):
        for b in r.sample(range(64), 2):
            x ^= 1 << b
        prints.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = linked(spark.createDataFrame([(signed(x),) for x in set(prints)], "fp long"))
    assert got.select("label").distinct().count() == 1 and got.count() == len(set(prints))
    assert len(_ball(21, 1)) == 22 and fingerprints
