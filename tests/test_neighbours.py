"""Neighbours within a table against a search over all pairs."""

import math
import random

from skyloom.operators import match as J


def test_pairs_once_and_neighbours(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        # around a pole, the step of right ascension and an ordinary place; some places twice, some unknown
        ra, dec = r.choice([(r.uniform(0, 360), r.uniform(89.2, 90)), (r.uniform(-1, 1), r.uniform(-0.8, 0.8)), (r.uniform(120, 122), r.uniform(-50, -49))])
        a, d = math.radians(ra), math.radians(dec)
        rows.append((i, math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d), "payload"))
    rows += [(1000 + i, *rows[i][1:]) for i in range(20)] + [(2000, None, 0.0, 1.0, "x"), (5, *rows[7][1:])]
    stars = spark.createDataFrame(rows, "id long, x double, y double, z double, more string").repartition(4)
    for radius in (60.0, 900.0, 5400.0):
        h2 = J.chord(radius) ** 2
        want = []
        for n, p in enumerate(rows):
            for q in rows[n + 1 :]:
                if p[1] is not None and q[1] is not None and p[0] != q[0]:
                    d2 = sum((u - v) * (u - v) for u, v in zip(p[1:4], q[1:4]))
                    if d2 < h2:
                        want.append((min(p[0], q[0]), max(p[0], q[0]), round(d2, 14)))
        got = [(min(x.a, x.b), max(x.a, x.b), round(x.d2, 14)) for x in J.pairs_once(stars, radius).collect()]
        assert sorted(got) == sorted(want) and want
        count, best = {}, {}
        for a, b, d2 in want:
            for k, o in ((a, b), (b, a)):
                count[k] = count.get(k, 0) + 1
                best[k] = min(best.get(k, (9.0, 0)), (d2, o))
        out = {x.id: (x.n, x.nearest) for x in J.neighbours(stars, radius).collect()}
        assert {k: v[0] for k, v in out.items()} == count
        assert all(out[k][1] == best[k][1] or abs(best[k][0]) < 1e-13 for k in count)
    assert J.neighbours(stars.limit(0), 60.0).count() == 0
