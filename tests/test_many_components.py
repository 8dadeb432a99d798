"""Many small components in few calls: the same matches as one by one."""

import random

import numpy as np

from skyloom.operators import components as G


def test_lists_and_arrays_agree():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 7)
        m = r.randint(n, 9)
        cost = [[r.choice([G.NO_MATCH, r.uniform(0, 60), 3.0]) for _ in range(m)] for _ in range(n)]
        assert G._paths(cost) == G.hungarian(np.array(cost))


def test_components_across_batches(spark):
    r = random.Random(6)
    edges = [(8 * c + i, 5 * c + j, r.uniform(0, 75)) for c in range(400) for i in range(r.randint(1, 8)) for j in range(r.randint(1, 5))]
    edges += [(10**6 + i, 10**6 + j, r.uniform(0, 60)) for i in range(30) for j in range(25)]  # by arrays
    by = {}
    for l, m, c in edges:  # noqa: E741
        by.setdefault(l // 8 if l < 10**6 else -1, []).append((l, m, c))
    df = spark.createDataFrame(edges, "l long, r long, cost double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for partial in (False, True):
        # a component's edges all hang together where its first left or right row has all the others
        joined = [x for e in by.values() if len({a for a, _, _ in e}) == 1 or len(e) == len({a for a, _, _ in e}) * len({b for _, b, _ in e}) for x in e]
        keep = spark.createDataFrame(joined, "l long, r long, cost double")
        want = sorted(m for k, e in by.items() if e[0] in joined for m in G._solve(*map(list, zip(*e)), partial))
        for rows in (7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            try:
                out = G.assign(keep, partial)
                got = sorted((x.l, x.r, x.cost) for x in out.collect())
            finally:
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
            assert got == want and want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert G.assign(df.limit(0)).count() == 0
