"""Operators on literal rows: edge cases of scans and joins, brute force on the sphere, assignment, sinks."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import mags, sky
from skyloom.operators import components as G
from skyloom.operators import match as J
from skyloom.operators import stats as A
from skyloom.sources import fixed_width as S
from skyloom.sources import sinks, tables


def test_fields(spark):
    rows = spark.createDataFrame([(1, "12 &7x"), (2, "1 "), (3, ""), (4, "-5ab")], "line long, value string")
    got = {r.line: r for r in rows.select("line", S.digits("value", 1, 2).alias("d"), S.leading_int(S.slice_("value", 1, 6)).alias("i"), S.slice_("value", 5, 9).alias("past"), S.leading_int(S.digits("value", 3, 3)).alias("z")).collect()}
    assert got[2].d == "10" and got[3].d == "00" and got[1].i == 12 and got[4].i == -5 and got[3].i == 0
    assert got[2].past == "" and got[1].z == 7


def test_scan_keeps_file_order(spark, tmp_path):
    (tmp_path / "f.txt").write_text("".join(f"{i:5d} 1 55N    1234&678" + " " * 15 + "2233 44\n" for i in range(5000)))
    got = tables.read(spark, str(tmp_path / "f.txt"), "gc").orderBy("line").select("line", "number", "mag", "ra", "dec", "type").collect()
    assert [(r.line, r.number) for r in got] == [(i + 1, i) for i in range(5000)]
    assert got[3].mag == 5.5 and got[3].type == "N"
    assert got[3].ra == pytest.approx((12 + 34 / 60 + 6.78 / 3600) * 15) and got[3].dec == pytest.approx(-(22 + 33 / 60 + 4.4 / 3600))


def test_every_table_parses(spark):
    lines = spark.createDataFrame([(1, ""), (2, "1" * 220), (3, " " * 220), (4, "&" * 220)], "line long, value string")
    for name in tables.TABLES:
        rows = tables.stars(lines, name).collect()
        assert len(rows) <= 4, name


def test_precession_vector_and_round_trip(spark):
    start = spark.createDataFrame([(100.0, -30.0)], "ra double, dec double")
    v = sky.with_vector(start)
    for c, e in zip("pqr", sky.precess("x", "y", "z", 1855.0, 1875.0)):
        v = v.withColumn(c, F.expr(e))
    for c, e in zip("uvw", sky.precess("p", "q", "r", 1875.0, 1855.0)):
        v = v.withColumn(c, F.expr(e))
    there, back = sky.ra_dec("p", "q", "r"), sky.ra_dec("u", "v", "w")
    r = v.select(*[F.expr(e) for e in (*there, *back)]).first()
    assert r[0] == pytest.approx(100.19263497610196, abs=3e-5) and r[1] == pytest.approx(-30.01952669029709, abs=3e-5)
    assert r[2] == pytest.approx(100.0, abs=1e-7) and r[3] == pytest.approx(-30.0, abs=1e-7)


def test_formats(spark):
    r = spark.createDataFrame([(359.9999999, -0.001), (0.0, 0.0)], "ra double, dec double").select(F.expr(sky.hms("ra")), F.expr(sky.dms("dec"))).collect()
    assert tuple(r[0]) == ("0h 0m 0.0s", "-0d 0.1m") and tuple(r[1]) == ("0h 0m 0.0s", "+0d 0.0m")
    r = spark.sql(f"SELECT {mags.two_integers('8', '9', 0.3, 0.3)}, {mags.two_integers('9', '8', 0.5, 0.2)}, {mags.two_integers('9', '5', 0.5, 0.2)}, {mags.volume('31')}, {mags.volume('10')}").first()
    assert tuple(float(x) if x is not None else None for x in r) == (8.3, 8.8, None, 1.0, None)


def sphere(seed, n):
    r = random.Random(seed)
    out = [(90.0 * s, 0.0) for s in (1, -1)] + [(d, a) for d in (0.0, 89.999) for a in (0.0, 359.99, 0.01)]
    while len(out) < n:
        d = math.degrees(math.asin(2 * r.random() - 1)) if r.random() < 0.5 else r.choice([89.9, -89.9, 0.0]) + r.gauss(0, 0.05)
        if abs(d) <= 90:
            out.append((d, r.choice([r.random() * 360, r.gauss(0, 0.1) % 360])))
    return [(i, a, d) for i, (d, a) in enumerate(out)]


def test_nearest_and_pairs_against_brute_force(spark):
    a, b, radius = sphere(1, 500), sphere(2, 800), 600.0
    b.append((9000, a[20][1], a[20][2]))
    b.append((9001, a[20][1], a[20][2]))  # a tie
    vec = lambda s: np.array([(math.cos(math.radians(r)) * math.cos(math.radians(d)), math.sin(math.radians(r)) * math.cos(math.radians(d)), math.sin(math.radians(d))) for _, r, d in s])
    d2 = ((vec(a)[:, None] - vec(b)[None]) ** 2).sum(-1)
    near = d2 < J.chord(radius) ** 2
    frame = lambda s: sky.with_vector(spark.createDataFrame(s, "id long, ra double, dec double")).repartition(7)
    for side in ("left", "right"):
        got = {(r.l_id, r.r_id) for r in J.within(frame(a), frame(b), radius, side).collect()}
        assert got == {(a[i][0], b[j][0]) for i, j in zip(*np.nonzero(near))}
    got = {r.l_id: r.r_id for r in J.nearest(frame(a), frame(b), radius, ["id"], "id").collect()}
    assert set(got) == {a[i][0] for i in np.nonzero(near.any(1))[0]} and got[20] == 9000
    for i, j in got.items():
        k = next(n for n, x in enumerate(b) if x[0] == j)
        assert d2[i, k] == pytest.approx(d2[i].min(), abs=1e-15)


def test_greedy_order(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 4.0), ("a", 4, 9.0), ("a", 5, 4.0), ("b", 6, 1.0)]
    got = sorted(tuple(r) for r in J.keep_nearest_in_order(spark.createDataFrame(rows, "k string, line int, dist double").repartition(3), "k", "line", "dist").select("k", "line", "discard").collect())
    assert got == [("a", 1, True), ("a", 3, False), ("b", 6, False)]


@pytest.mark.parametrize("partial", [False, True])
def test_assignment_against_permutations(spark, partial):
    r = random.Random(5)
    edges = []
    for c in range(40):
        n, m = r.randint(1, 4), r.randint(1, 4)
        edges += [(100 * c + i, 100 * c + j, r.uniform(0, 30)) for i in range(n) for j in range(m) if r.random() < 0.7]
    got = G.assign(spark.createDataFrame(edges, "l long, r long, cost double"), partial).collect()
    cost = {(a, b): c for a, b, c in edges}
    by = {}
    labels = {}
    for a, b, _ in edges:  # components by repeated merging
        x, y = labels.setdefault(("l", a), ("l", a)), labels.setdefault(("r", b), ("r", b))
        if x != y:
            labels = {k: x if v == y else v for k, v in labels.items()}
    for a, b, c in edges:
        by.setdefault(labels[("l", a)], []).append((a, b))
    for pairs in by.values():
        left, right = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
        flip = len(left) > len(right)
        small, large = (right, left) if flip else (left, right)
        best = None
        for p in itertools.permutations(large, len(small)):
            cs = [cost.get((y, x) if flip else (x, y)) for x, y in zip(small, p)]
            if partial:
                v = sum(G.NO_MATCH if c is None else c for c in cs)
            elif None in cs:
                continue
            else:
                v = sum(cs)
            best = v if best is None else min(best, v)
        mine = [x for x in got if (x.l, x.r) in set(pairs)]
        assert len({x.l for x in mine}) == len({x.r for x in mine}) == len(mine)
        if best is None:
            assert not mine
        elif mine or partial:
            assert sum(x.cost for x in mine) + G.NO_MATCH * (len(small) - len(mine)) == pytest.approx(best)
        else:
            raise AssertionError("a feasible component got nothing")


def test_folds_and_windows_ignore_partitioning(spark):
    r = random.Random(9)
    rows = [(r.randrange(9), i, float(r.randrange(4)), float(r.randrange(50))) for i in range(400)]
    better = "CASE WHEN c.mag > 0 AND x.mag > 0 AND c.mag <> x.mag THEN x.mag < c.mag ELSE x.dist < c.dist END"
    want = {}
    for k, i, m, d in rows:
        c = want.get(k)
        if c is None or (m < c[1] if c[1] > 0 and m > 0 and c[1] != m else d < c[2]):
            want[k] = (i, m, d)
    for n in (1, 6):
        got = A.ordered_fold(spark.createDataFrame(rows, "k int, line int, mag double, dist double").repartition(n), "k", "line", ["mag", "dist"], better).collect()
        assert {x.k: (x.line, x.mag, x.dist) for x in got} == want


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("CD -22°1", "PPM 5", 7.25, 3.456), ("x", "HD 2", None, 1.0)], "index1 string, index2 string, mag double, dist double")
    sinks.write_cross(rows.filter("mag is not null"), str(tmp_path / "cross"))
    assert tuple(sinks.read_cross(spark, str(tmp_path / "cross")).first()) == ("CD -22°1", "PPM 5", 7.3, 3.46)
    sinks.write_ragged(rows, str(tmp_path / "ragged"))
    assert {tuple(x) for x in sinks.read_ragged(spark, str(tmp_path / "ragged")).collect()} == {("CD -22°1", "PPM 5", 7.3, 3.46), ("x", "HD 2", None, 1.0)}
    v = spark.createDataFrame([("a", 0.6, 0.8, 0.0, 5.0)], "name string, x double, y double, z double, mag double")
    sinks.write_normalised(v, str(tmp_path / "n"))
    assert sinks.read_normalised(spark, str(tmp_path / "n")).first().x == pytest.approx(0.6)
    (tmp_path / "rnao14_page7.csv").write_text("5477, 7.2, L. 1618\n5478, , (OA. 2), x\n\n5479, V, \n")
    got = sinks.read_scan_pages(spark, str(tmp_path / "rnao14_page*.csv")).orderBy("num").collect()
    assert [(x.page, x.num, x.mag, x.ref) for x in got] == [(7, 5477, "7.2", "L. 1618"), (7, 5478, "", "(OA. 2), x"), (7, 5479, "V", "")]
    (tmp_path / "list.txt").write_text("12\n34 ?\n")
    assert [tuple(x) for x in sinks.read_number_list(spark, str(tmp_path / "list.txt")).collect()] == [(12, False), (34, True)]
    (tmp_path / "page3.json").write_text('[{"decl": -22, "first": 1, "last": 9, "dpl": [3], "color": [], "dpl_uncertain": [], "color_uncertain": [], "notes": ["n"]}]')
    assert sinks.read_scan_json(spark, str(tmp_path / "page3.json")).first().page == 3


def test_references_and_footnotes_by_literal_rows(spark):
    from pyspark.sql import functions as F

    from skyloom.operators import ocr

    refs = [
        ("LI. 5477, seq.", "Ll. 5477"), ("L1.12", "Ll. 12"), ("Ll. 3", "Ll. 3"), ("0A. 7", "OA. 7"), ("O.A. 7", "OA. 7"), ("Z.C. 11h 3707", "ZC. 11h 3707"), ("ZC. 1", "ZC. 1"), ("W.B. 9", "WB. 9"), ("WB. 9", "WB. 9"),
        ("Melb. I. 5", "Melb.I. 5"), ("L. 1618,dup. var", "L. 1618"), ("seq. L. 2", "L. 2"), ("Laplace 1", "Laplace 1"), ("L.2.x", "L. 2. x"), ("", ""), (None, ""), ("  pr,  ", ""),
    ]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(refs)], "i int, a string").select("i", ocr.clean("a").alias("b")).collect()
    assert [x.b for x in sorted(got)] == [b for _, b in refs]
    notes = [("Dpl: 12, 45. 7", "12;45;7", ""), ("Dpl 1 p. 2", "1", ""), ("COLOR Nº. 3. olor 4 pl. 5", "5", "3;4"), ("Duplex 3", "", ""), ("color no 7", "", "7"), ("color to 7", "", ""), ("12 Dpl", "", ""), ("Dpl. N 10,", "10", "")]
    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(notes)], "i int, a string")
    got = rows.select("i", *[F.array_join(ocr.footnotes("a", k), ";").alias(k) for k in ("dpl", "color")]).collect()
    assert [(x.dpl, x.color) for x in sorted(got)] == [x[1:] for x in notes]


def test_published_scales(spark):
    from skyloom.functions import mags

    rows = [(9.0, -25), (9.0, -35), (9.0, -45), (9.0, -55), (9.0, -89), (9.0, -10), (9.0, 20), (2.5, -25), (3.0, -62)]
    got = spark.createDataFrame(rows, "m double, d int").selectExpr(f"{mags.v_to_cd('m', 'd')} a", f"{mags.cd_to_v('m', 'd')} b", f"{mags.gc_to_v('m')} c").collect()
    want_cd = [8.745145, 8.739437, 9.053137, 9.025834, 9.145075, 9.258879, 9.258879]
    want_v = [9.342, 9.427, 9.165, 9.086, 8.983, None, None]
    assert [round(x.a, 6) for x in got[:7]] == want_cd
    assert [x.b if x.b is None else round(x.b, 3) for x in got[:7]] == want_v
    assert [round(x.c, 3) for x in got] == [8.857] * 7 + [2.5, 3.0]
