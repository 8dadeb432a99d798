"""Great components by auction: the same total cost as the matrix solver finds."""

import random

import numpy as np
import pytest

from skyloom.operators import components as G


def total(rows):
    assert len({x.l for x in rows}) == len({x.r for x in rows}) == len(rows)
    return len(rows), round(sum(x.cost for x in rows), 5)


def edges_of(seed, n, m, degree):
    r = random.Random(seed)
    out = [(i, j, round(r.uniform(0, 80), 1)) for i in range(n) for j in r.sample(range(m), degree)]
    return out + [(i, i % m, 70.0 + i % 3) for i in range(n)] + out[:3] + [(i, 0, 60.0) for i in range(n)]


@pytest.mark.parametrize("n, m, degree", [(7, 6, 2)])
def test_auction_equals_the_matrix_solver(spark, n, m, degree):
    edges = edges_of(n, n, m, degree)
    df = spark.createDataFrame(edges, "l long, r long, cost double")
    cost = np.full((n, m), G.NO_MATCH)
    for a, b, c in edges:
        cost[a, b] = min(cost[a, b], c)
    pairs = G.hungarian(cost) if n <= m else [(b, a) for a, b in G.hungarian(cost.T)]
    want = sum(cost[a, b] for a, b in pairs if cost[a, b] < G.NO_MATCH) + G.NO_MATCH * sum(cost[a, b] >= G.NO_MATCH for a, b in pairs)
    got = G.assign(df, cells=10, digits=1).collect()
    k, have = total(got)
    assert have + G.NO_MATCH * (min(n, m) - k) == pytest.approx(want, abs=1e-4)
    assert {(x.l, x.r, x.cost) for x in got} <= {(a, b, cost[a, b]) for a in range(n) for b in range(m)}


def test_auction_without_edges(spark):
    assert G.auction(spark.createDataFrame([], "l long, r long, cost double")).collect() == []
    assert G.auction(spark.createDataFrame([(1, 1, 69.0), (1, 2, 100.0)], "l long, r long, cost double")).collect() == []
