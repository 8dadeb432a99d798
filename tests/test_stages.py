"""Frames against published vectors, zones at their edges, stages, second looks and readers with state on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.operators import checks
from skyloom.operators import match as J
from skyloom.sources import lists


def vector(ra, dec):
    return np.array([math.cos(ra) * math.cos(dec), math.sin(ra) * math.cos(dec), math.sin(dec)])


def apart(a, b):
    return math.degrees(np.linalg.norm(a - b)) * 3600


def test_published_vector(spark):
    # a near star of large motion, B1950 to J2000 (the standard library's test of the conversion); its motion leads from 2000 back to 1950
    ra, dec, motion, toward = 0.08757989933556446040, -1.132279113042091895, 0.1953670614474396139e-4, 0.5637686678659640164e-5
    east, north = np.array([-math.sin(ra), math.cos(ra), 0]), np.array([-math.cos(ra) * math.sin(dec), -math.sin(ra) * math.sin(dec), math.cos(dec)])
    then = vector(ra, dec) - 50 * (motion * math.cos(dec) * east + toward * north)
    b1950 = sky.with_vector(spark.createDataFrame([(math.degrees(0.07626899753879587532), math.degrees(-1.137405378399605780))], "a double, b double"), "a", "b")
    got = sky.from_fk4(b1950, 1950.0, 1950.0, icrs=False).first()
    assert apart(vector(math.radians(got.ra), math.radians(got.dec)), then / np.linalg.norm(then)) < 0.01


def test_round_trip(spark):
    rows = [(float(a), float(b)) for a in range(0, 360, 30) for b in (-89.99, -60, -22.5, 0, 45, 88)]
    df = sky.to_fk4(spark.createDataFrame(rows, "a double, b double"), "a", "b", 1875.0, 1875.0)
    for x in sky.from_fk4(df, 1875.0, 1875.0, icrs=False).collect():
        assert apart(vector(math.radians(x.ra), math.radians(x.dec)), vector(math.radians(x.a), math.radians(x.b))) < 0.01
        assert abs(x.x**2 + x.y**2 + x.z**2 - 1) < 1e-12
    one = {(x.a, x.b): (x.ra, x.dec) for x in sky.from_fk4(df, 1875.0, 1875.0).collect()}
    assert all(apart(vector(*map(math.radians, v)), vector(*map(math.radians, k))) < 0.04 for k, v in one.items())


def test_transform_checks_ranges(spark):
    rows = [(12, 35, 4789, "+", 24, 15, 83), (24, 0, 0, "+", 0, 0, 0), (0, 60, 0, "-", 0, 0, 0), (0, 0, 6000, "-", 0, 0, 0), (0, 0, 0, "-", 90, 0, 0), (0, 0, 0, "-", 0, 60, 0), (0, 0, 0, "-", 0, 0, 600), (None, 0, 0, "-", 0, 0, 0), (0, 0, 0, "-", -1, 0, 0), (3, 0, 0, "-", 0, 0, 1)]
    df = spark.createDataFrame(rows, "h int, m int, s100 int, dec_sign string, d int, dm int, ds10 int").coalesce(1)
    got = sky.transformed(df, 1875).collect()
    assert [x.error for x in got[1:9]] == ["h must be between 0 and 23", "m must be between 0 and 59", "s100 must be between 0 and 5999", "d must be between 0 and 89", "dm must be between 0 and 59", "ds10 must be between 0 and 599", "h must be between 0 and 23", "d must be between 0 and 89"]
    assert got[0].error is None and (got[0].to_h, got[0].to_m, got[0].to_sign, got[0].to_d) == (12, 29, "+", 24) and got[1].to_h is None and got[9].to_sign == "-"
    with pytest.raises(ValueError):
        sky.transformed(df, 1600)


def test_zones_at_their_edges(spark):
    zones = [(1, 0.0, 360.0, 80.0, "cap"), (2, 350.0, 360.0, 10.0, "wrap"), (3, 0.0, 20.0, 10.0, "wrap"), (4, 20.0, 350.0, 10.0, "north"), (5, 100.0, 110.0, -95.0, "strip"), (6, 0.0, 360.0, -90.0, "south")]
    stars = {1: (0.0, 90.0), 2: (359.999, 80.0), 3: (0.0, 79.999), 4: (350.0, 10.0), 5: (349.999, 10.0), 6: (20.0, 10.0), 7: (105.0, 9.999), 8: (110.0, 9.999), 9: (0.0, -90.0), 10: (100.0, -90.0), 11: (5.0, 9.999), 12: (359.9999999, -0.0)}
    got = J.zoned(spark.createDataFrame([(k, *v) for k, v in stars.items()], "id int, ra double, dec double"), spark.createDataFrame(zones, "row int, ra_lo double, ra_hi double, dec_lo double, name string"))
    want = {k: min((row, name) for row, lo, hi, least, name in zones if lo <= ra < hi and dec >= least)[1] for k, (ra, dec) in stars.items()}
    assert {x.id: x.name for x in got.collect()} == want


def around(df, arcsec):
    return sky.with_vector(df.withColumn("dec", F.col("dec") + arcsec / 3600))


def test_stages_read_what_is_left(spark):
    rows = sky.with_vector(spark.range(200).selectExpr("id", "id * 1.5D AS ra", "-45.0D + id / 10 AS dec"))
    tables = [around(rows.filter(f"id % 4 = {k}"), 1.0) for k in range(3)]
    tables.append(sky.with_vector(rows.filter("id % 4 = 3").selectExpr("id * 10 AS id", "ra", "dec + 5 / 3600.0D AS dec").unionByName(rows.filter("id % 4 = 3").selectExpr("id * 10 + 1 AS id", "ra", "dec + 4.5 / 3600.0D AS dec"))))
    before = []


    stages = [(f"t{k}", tables[k], 10.0, "id >= 0", None) for k in range(3)] + [("list", tables[3], 10.0, "id % 2 = 1", 1.0)]
    seen = J.within

    def counting(left, right, radius):
        before.append(left.count())
        return seen(left, right, radius)

    J.within = counting
    try:
        got = {x.id: (x.source, x.match) for x in J.staged(rows, "id", stages).collect()}
    finally:
        J.within = seen
    assert before == [200, 150, 100, 50]
    assert got == {i: (f"t{i % 4}", i) if i % 4 < 3 else ("list", i * 10) for i in range(200)}
    far = J.nearest_with_margin(rows.filter("id = 3"), tables[3], 10.0, "id", "id", 0.4).first()
    assert far.match == 31 and far.dist == pytest.approx(4.5)


def test_second_look_and_limits(spark):
    place = lambda i: tuple(map(float, vector(0.1 * i, 0.2)))
    table = spark.createDataFrame([(i, n, 5.0 + i, *place(i)) for i, n in [(1, 100), (2, 101), (3, 300), (4, 300), (5, 0), (6, 700)]], "star int, number int, mag double, x double, y double, z double")
    rows = spark.createDataFrame([(10, 1, 100, 5.9, *place(1)), (11, 1, 101, 6.0, *place(1)), (12, 1, 300, 6.0, *place(1)), (13, 1, 999, 6.0, *place(1)), (14, 5, 100, 6.0, *place(5)), (15, 1, 0, 6.0, *place(1))], "id int, star int, ref int, mag double, x double, y double, z double")
    got = {x.id: (x.verdict, x.other, x.kept) for x in J.second_look(rows, table).collect()}
    assert got == {10: ("match", None, True), 11: ("note", 2, False), 12: ("mismatch", 3, False), 13: ("mismatch", None, True)}
    dist = {x.id: x.other_dist for x in J.second_look(rows, table).collect()}
    assert dist[12] == pytest.approx(apart(vector(0.1, 0.2), vector(0.3, 0.2)), rel=1e-2) and dist[13] is None
    limits = {x.id: (x.place, x.mag_differs) for x in J.reference_limits(rows.withColumnRenamed("ref", "number"), table, 120.0, 0.05).collect()}
    assert limits == {10: ("ok", True), 11: ("far", True), 12: ("far", True), 13: ("absent", False), 14: ("far", False), 15: ("far", True)}


def test_serpens_and_signs(spark):
    def line(mark, number, cst, place="12"):
        return f"{mark} {number:>3} {cst:<3}".ljust(100) + place + " 34 56"

    rows = ["", line("G", 3, "Ser"), line("G", 49, "Ser", "  "), line(" ", 49, "Ser"), line("G", 49, "Oph"), line("G", 49, "Ser"), line("G", 50, "Ser"), line("G", 7, "Cen"), line(" ", 0, ""), line("G", 49, "Ser")]
    df = spark.createDataFrame(list(enumerate(rows, 1)), "line_no int, line string").repartition(4)
    got = [tuple(x) for x in lists.gould_designations(df, stretches=3).orderBy("line_no").collect()]
    assert got == [(2, 3, "Sera", "3G Sera"), (4, 0, None, "Annonymous"), (5, 49, "Oph", "49G Oph"), (6, 49, "Sera", "49G Sera"), (7, 50, "Serb", "50G Serb"), (8, 7, "Cen", "7G Cen"), (9, 0, None, "Annonymous"), (10, 49, "Serb", "49G Serb")]
    som = ["No,x,h,m,s,d,dm" + "," * 11, "34a,x,1,2,3,-0,30.5" + ",." * 10, "34b,x,1,2,3,0,30.5" + ",." * 10 + "\r\n", "35,x,1,2,3,-12,0" + ",." * 9, "36,x,23,59,59,-89,59.9" + ",." * 12]
    got = lists.magnitude_standards(spark.createDataFrame(list(enumerate(som, 1)), "line_no int, line string")).orderBy("line_no").collect()
    assert [(x.id, round(x.dec, 6), x.place) for x in got] == [("34a", -0.508333, "01h 02m 03s -00°30.5'"), ("34b", 0.508333, "01h 02m 03s +00°30.5'"), ("36", -89.998333, "23h 59m 59s -89°59.9'")]


def test_pages_are_judged_after_moves(spark):
    intervals = spark.createDataFrame([(1, 1, 24, 500, 699), (1, 2, 22, 100, 299), (1, 3, 23, 500, 640)], "page int, place int, decl int, first int, last int")
    numbers = [(22, "dpl", 1, 150), (22, "dpl", 2, 520), (22, "dpl", 3, 160), (22, "color", 1, 9999), (22, "color", 2, 5200), (24, "dpl", 1, 600), (24, "dpl", 2, 120), (23, "dpl", 1, 550), (23, "dpl", 2, 540)]
    df = spark.createDataFrame([(1, *x) for x in numbers], "page int, decl int, kind string, seq int, n int")
    got = {(x.decl, x.kind, x.seq): (x.verdict, x["at"], x.value, x.beyond, x.ascending) for x in checks.placed(df, intervals, spark.createDataFrame([(22, 9000)], "decl int, last_star long")).collect()}
    assert got[22, "dpl", 1] == ("inside", 22, 150, False, True) and got[22, "dpl", 3] == ("inside", 22, 160, False, True)
    assert got[22, "dpl", 2] == ("moved", 24, 520, False, False)  # the first declination of the page, behind its own 600
    assert got[22, "color", 1] == ("outside", 22, 9999, True, True) and got[22, "color", 2] == ("repaired", 22, 200, False, False)
    assert got[24, "dpl", 2] == ("moved", 22, 120, False, False) and got[23, "dpl", 2][4] is False and got[23, "dpl", 1][4] is True


def test_ends_by_most_runs(spark):
    rows = [(1, 5, 22, 100, 200), (2, 5, 22, 101, 200), (3, 5, 22, 101, None), (1, 5, 23, 7, 9), (2, 5, 23, 8, 9), (3, 5, 24, None, None)]
    got = {x.decl: (x.first, x["last"]) for x in checks.merged_ends(spark.createDataFrame(rows, "run int, page int, decl int, first int, last int")).collect()}
    assert got == {22: (101, 200), 23: (7, 9), 24: (None, None)}


def test_precession_constants():
    assert checks.precession_constants(1850.0) == (3.07177, 20.0564)
    m, n = checks.precession_constants(1881.0)
    assert m == pytest.approx(3.072359) and n == pytest.approx(20.053734)
