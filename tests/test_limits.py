"""Places just at a limit, near the axis, and plans that hold no table whole; against the SQL or brute force."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from skyloom.functions import sky
from skyloom.operators import match as J


def differences(spark, folder, name):
    """Rows that only Spark has and rows that only the SQL has."""
    E.queries()[name](spark, folder).write.mode("overwrite").parquet(f"{folder}/out-{name}")
    q = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            q.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}/*.parquet')")
    q.execute(f"create table o as {E.oracle_sql()[name]}")
    columns = ", ".join(r[0] for r in q.execute("describe o").fetchall())
    got = f"(select {columns} from read_parquet('{folder}/out-{name}/*.parquet'))"
    return [q.execute(s).fetchall() for s in (f"from {got} except all from o", f"from o except all from {got}")]


@pytest.mark.parametrize("name", ["nearest_within_radius", "nearest_rmse", "reference_limits", "alone_anti_join"])
def test_twins_just_at_the_limit(spark, tmp_path, name):
    # twins that are 120 arcseconds off
    spark.range(0, 4000).selectExpr("id * 679 + 448 AS o_orderkey", "id % 100 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    assert differences(spark, str(tmp_path), name) == [[], []]


def test_functions_of_the_c_library(spark):
    r = random.Random(3)
    rows = [(r.uniform(-1, 1), r.uniform(0, 360), r.uniform(-90, 90)) for _ in range(5000)]
    got = sky.placed(spark.createDataFrame(rows, "s double, ra double, dec double").withColumn("a", sky.asin_c(F.col("s")))).collect()
    for x in got:
        a, d = math.radians(x.ra), math.radians(x.dec)
        assert (x.a, x.x, x.y, x.z) == (math.asin(x.s), math.cos(a) * math.cos(d), math.sin(a) * math.cos(d), math.sin(d))
    odd = sky.placed(spark.createDataFrame([(None, None, 1.0), (2.0, 1.0, math.nan)], "s double, ra double, dec double").withColumn("a", sky.asin_c(F.col("s")))).orderBy("s").collect()
    assert odd[0].a is None and math.isnan(odd[1].a) and [odd[0].x, odd[1].z] == [None, None]


@pytest.mark.parametrize("name", ["transform_command"])
def test_places_near_the_axis(spark, tmp_path, name):
    # right ascensions of nearly 6 and 18 hours
    spark.createDataFrame([(306007, 33298), (526181, 55748), (688404, 74428), (278230, 15110), (7, 9)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert differences(spark, str(tmp_path), name) == [[], []]


def test_frames_keep_places_near_the_axis(spark):
    x = spark.createDataFrame([(5e-7, 0.8, 0.6)], "x double, y double, z double")
    assert x.select(F.expr(sky.turned_place("x", "y", "z")[0])).first()[0] == pytest.approx(90 - math.degrees(5e-7 / 0.8), abs=1e-12)


def test_no_side_of_a_spatial_join_is_broadcast(spark):
    # small for the optimizer, which does not see that rows multiply
    s = sky.with_vector(spark.range(1000).selectExpr("id", "id * 0.36D AS ra", "id % 90 * 1.0D AS dec", "5.0D AS mag"))
    for df in (J.pairs_once(s, 600.0), J.neighbour_counts(s, 600.0), J.isolated_doubles(s, 3600.0, 3000.0), J.within(s, s, 600.0), J.nearest(s, s, 600.0, ["id"], "id")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    counts = J.neighbour_counts(s, 600.0)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in counts and "SortAggregate" not in counts


def test_brightest_by_bands(spark):
    r = random.Random(8)
    place = lambda: (r.uniform(10, 13), r.uniform(-1, 1))
    left = [(i, *place()) for i in range(200)] + [(900, 200.0, 5.0), (901, 300.0, 5.0)]
    right = [(i, r.choice([None, 1.0, 4.0, *(r.uniform(3, 11) for _ in range(8))]), *place()) for i in range(600)] + [(700, None, 200.0, 5.1), (701, 12.0, 200.0, 5.2)]
    a = sky.with_vector(spark.createDataFrame(left, "id long, ra double, dec double"))
    b = sky.with_vector(spark.createDataFrame(right, "id long, mag double, ra double, dec double"))
    d2 = lambda p, q: sum((u - v) ** 2 for u, v in zip((p.x, p.y, p.z), (q.x, q.y, q.z)))
    right = b.collect()
    want = {}
    for p in a.collect():
        near = [(math.inf if q.mag is None else q.mag, d2(p, q), q.id) for q in right if d2(p, q) < J.chord(3600.0) ** 2]
        if near:
            want[p.id] = min(near)[2]
    seen, J.SEEN = J.SEEN, 0.002  # the places are crowded, so the area says too little: five bands
    try:
        bands = J.brightest(a, b, 3600.0, "id", "id")
        assert {x.id: x.match for x in bands.collect()} == want and want[900] == 701
    finally:
        J.SEEN = seen
    assert {x.id: x.match for x in J.brightest(a, b, 3600.0, "id", "id").collect()} == want
    assert J.brightest(a, b.limit(0), 3600.0, "id", "id").count() == 0


def test_nearest_anywhere_in_portions(spark):
    from skyloom.plans import lineage

    r = random.Random(12)
    place = lambda n, low: [(i, r.uniform(0, 360), r.uniform(low, 90)) for i in range(n)]
    a = sky.with_vector(spark.createDataFrame(place(120, -90), "id long, ra double, dec double"))
    b = sky.with_vector(spark.createDataFrame(place(60, 40), "no long, ra double, dec double"))
    right, kept = b.collect(), set(lineage._kept)
    portion, J.PORTION = J.PORTION, 60
    try:
        got = J.nearest_anywhere(a, b, "id", "no").collect()
    finally:
        J.PORTION = portion
    want = {p.id: min((sum((u - v) ** 2 for u, v in zip((p.x, p.y, p.z), (q.x, q.y, q.z))), q.no) for q in right)[1] for p in a.collect()}
    assert {x.id: x.match for x in got} == want and len(got) == 120
    # only the portions' results are left on disk
    assert [p.rsplit("/", 1)[1].startswith("nearest-found") for p in set(lineage._kept) - kept] == [True, True]
