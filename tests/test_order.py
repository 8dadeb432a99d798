"""Numbers and states along an order against the sequential rule; one key with all rows runs in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import match, order, stats
from skyloom.sources import lists


def rows_of(r, n, keys):
    return [(i, r.choice(keys), r.choice([None, r.randint(0, 9)]), r.randint(0, 300), r.random() < 0.4) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("keys", [["a"], ["a", None, "b"], list("abcdefghij")])
@pytest.mark.parametrize("stretches", [1, 7, 64])
def test_states_equal_the_sequential_rule(spark, keys, stretches):
    r = random.Random(stretches)
    rows = rows_of(r, 400, keys)
    df = spark.createDataFrame(rows, "i int, k string, v int, n int, c boolean").repartition(9)
    known, before, least, last, count, jump, all_ = {}, {}, {}, {}, {}, set(), {}
    state = {}
    for place, (i, k, v, n, c) in enumerate(sorted(rows), 1):
        s = state.setdefault(k, {"v": None, "least": None, "last": 0, "n": 0})
        all_[i], before[i], least[i] = place, s["v"], s["least"]
        s["v"] = v if v is not None else s["v"]
        known[i] = s["v"]
        s["least"] = n if s["least"] is None else min(n, s["least"])
        s["n"] += 1
        count[i] = s["n"]
        if c:
            if abs(n - s["last"]) > 50:
                jump.add((i, s["last"]))
            s["last"] = n
    got = lambda df, c: {x.i: x[c] for x in df.collect()}
    cut = {"stretches": stretches}
    assert got(order.last_known(df, ["k"], ["i"], F.col("v"), "o", **cut), "o") == known
    assert got(order.last_known(df, ["k"], ["i"], F.col("v"), "o", False, **cut), "o") == before
    assert got(order.least_before(df, ["k"], ["i"], "n", "o", **cut), "o") == least
    assert got(order.numbered(df, ["i"], "o", ["k"], **cut), "o") == count
    assert got(order.numbered(df, ["i"], "o", **cut), "o") == all_
    assert {(x.i, x.previous) for x in order.jumps(df, ["k"], ["i"], "n", F.col("c"), 50, **cut).collect()} == jump
    assert order.numbered(df.limit(0), ["i"], "o").collect() == []


def test_one_key_runs_in_many_tasks(spark):
    df = spark.range(5000).select("id", F.lit("one").alias("k"), F.when(F.col("id") % 100 == 0, F.col("id")).alias("v"))
    cuts = order.bounds(df, "id")
    assert len(cuts) >= 60
    sizes = [x["count"] for x in df.groupBy(order.stretch("id", cuts).alias("s")).count().collect()]
    assert len(sizes) == len(cuts) + 1 and max(sizes) < 3 * 5000 / 64
    done = order.last_known(df, ["k"], ["id"], F.col("v"), "o")
    assert done.filter("o <> id div 100 * 100").count() == 0


def test_fold_keeps_one_row(spark):
    r = random.Random(5)
    rows = [(r.choice("abc"), i, r.choice([0.0, 1.0, 2.0]), r.random()) for i in range(500)]
    better = lambda c, x: x["m"] < c["m"] if c["m"] > 0 and x["m"] > 0 and c["m"] != x["m"] else x["d"] < c["d"]
    want = {}
    for k, i, m, d in rows:
        x = {"i": i, "m": m, "d": d}
        want[k] = x if k not in want or better(want[k], x) else want[k]
    got = order.fold(spark.createDataFrame(rows, "k string, i int, m double, d double").repartition(5), "k", "i", ["m", "d"], better)
    assert {x.k: {"i": x.i, "m": x.m, "d": x.d} for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    text = ["".join(f"{k}:{i}\n" for i in range(3000)) for k in "ab"]
    for k, t in zip("ab", text):
        (tmp_path / f"{k}.txt").write_text(t)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = order.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = sorted((x.line, x.value) for x in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate("".join(text).splitlines(), 1))
    (tmp_path / "empty.txt").write_text("")
    assert order.numbered_lines(spark, str(tmp_path / "empty.txt")).collect() == []


def test_supplement_counts_from_one(spark, tmp_path):
    row = "|".join(["id", "f", "10.0", "-50.0", *["x"] * 9, "5.0", "end"])
    (tmp_path / "s.txt").write_text((row + "\n") * 17590)
    main = spark.createDataFrame([("|".join(["x"] * 26),)], "line string").limit(0)
    lines = order.numbered_lines(spark, str(tmp_path / "s.txt")).select(F.col("line").alias("line_no"), F.col("value").alias("line"))
    assert lists.bright(main, lines, -10.0).count() == 17588


def test_chains_with_repeats(spark):
    rows = [(1, 1, 9), (1, 10, 19), (1, 10, 19), (2, 1, 9), (2, 1, 9), (2, 10, 19), (2, 20, 29), (2, 50, 60)]
    got = {x.page: (x.n, x.lo, x.hi) for x in stats.longest_chain(spark.createDataFrame(rows, "page int, lo int, hi int"), "page").collect()}
    assert got == {1: (2, 1, 19), 2: (3, 1, 29)}


def place(x, y, z):
    n = (x * x + y * y + z * z) ** 0.5
    return x / n, y / n, z / n


@pytest.mark.parametrize("crowd", [4, 256])
def test_nearest_anywhere_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(match, "CROWD", crowd)
    r = random.Random(crowd)
    anywhere = lambda: place(*[r.gauss(0, 1) for _ in range(3)])
    near = lambda p, s: place(*[c + r.gauss(0, s) for c in p])
    centre = anywhere()
    right = [(i, *near(centre, 10.0 ** -r.randint(1, 7))) for i in range(300)] + [(300 + i, *anywhere()) for i in range(5)]
    right += [(400 + i, *right[3][1:]) for i in range(20)] + [(900, None, 1.0, 0.0)]
    left = [(i, *anywhere()) for i in range(60)] + [(100 + i, *near(centre, 1e-5)) for i in range(60)] + [(200, *(-c for c in centre)), (201, *right[3][1:]), (202, 0.0, 0.0, 1.0), (203, None, None, None)]
    a = spark.createDataFrame(left, "id int, x double, y double, z double").repartition(3)
    b = spark.createDataFrame(right, "no int, x double, y double, z double")
    d2 = lambda p, q: sum((u - v) * (u - v) for u, v in zip(p, q))
    want = {i: min((d2(p, q), no) for no, *q in right if q[0] is not None) for i, *p in left if p[0] is not None}
    got = {x.id: (x.d2, x.match) for x in match.nearest_anywhere(a, b, "id", "no").collect()}
    assert {i: m for i, (_, m) in got.items()} == {i: m for i, (_, m) in want.items()}
    assert all(abs(got[i][0] - want[i][0]) < 1e-12 for i in want)
    assert match.nearest_anywhere(a, b.limit(0), "id", "no").collect() == []
    assert match.nearest_anywhere(a.limit(0), b, "id", "no").collect() == []
    one = match.nearest_anywhere(a, b.filter("no = 302"), "id", "no")
    assert {x.match for x in one.collect()} == {302} and one.count() == len(want)
    assert "Cartesian" not in one._jdf.queryExecution().toString() and "NestedLoop" not in one._jdf.queryExecution().toString()
