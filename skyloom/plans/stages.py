"""Named queries with state, stages and second looks. Their SQL is written from the rules, not from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.operators import checks, order
from skyloom.operators import components as G
from skyloom.operators import match as J
from skyloom.plans.catalog import _BAND, _D2, _DEC, _H2, _RA, PLACE_SQL, SKY_SQL, _dot, _r, _vec, fk4_sql, query, stars, t
from skyloom.sources import lists, reports, tables

# ---------------------------------------------------------------- nearest without a radius

#: customers as a list of places in the north only, two by two at the same place
_LISTED = "SELECT c_custkey AS no, 360.0D * ((c_custkey // 2) * 0.6180339887498949D % 1) AS ra, degrees(asin(0.64D + 0.36D * ((c_custkey // 2) * 0.7548776662466927D % 1))) AS dec FROM customer"


@query(f"WITH s AS ({_vec(f'SELECT o_orderkey AS id, {_RA} AS ra, {_DEC} AS dec FROM orders')}), l AS ({_vec(_LISTED)}) SELECT id, b.no AS match, round(degrees(2 * asin(sqrt(b.d2) / 2)) * 3600, 1) AS dist FROM (SELECT s.id, min({{'d2': (s.x-l.x)*(s.x-l.x)+(s.y-l.y)*(s.y-l.y)+(s.z-l.z)*(s.z-l.z), 'no': l.no}}) AS b FROM s, l GROUP BY s.id)")
def nearest_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a list however far: the south has none of its own."""
    listed = t(spark, sf_dir, "customer").selectExpr("c_custkey AS no", "360.0D * ((c_custkey div 2) * 0.6180339887498949D % 1) AS ra", "degrees(asin(0.64D + 0.36D * ((c_custkey div 2) * 0.7548776662466927D % 1))) AS dec")
    return J.nearest_anywhere(stars(spark, sf_dir), sky.with_vector(listed), "id", "no").select("id", "match", _r("dist", 1, "dist"))


# ---------------------------------------------------------------- frames

_A1875 = f"[{', '.join(repr(v) for v in sky.e_terms(1875.0))}]::DOUBLE[]"
_SIZE2 = repr(1 - sum(v * v for v in sky.e_terms(1875.0)))


@query(SKY_SQL + f"""SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec FROM (SELECT id, {PLACE_SQL} FROM (SELECT id, {_dot(sky.fk5_in_icrs() @ sky.fk4_to_fk5(1875.0), 'u')} AS v FROM
 (SELECT id, list_transform(list_zip(v, {_A1875}), lambda p: p[1] * (along + sqrt(along * along + {_SIZE2})) - p[2]) AS u FROM (SELECT id, v, list_dot_product(v, {_A1875}) AS along FROM (SELECT id, {_dot(sky.newcomb(1875.0, 1950.0), '[x, y, z]')} AS v FROM stars)))))""")
def b1875_to_icrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sky.from_fk4(stars(spark, sf_dir).select("id", "x", "y", "z"), 1875.0, 1875.0).select("id", _r("ra", 6, "ra"), _r("dec", 6, "dec"))


_PRINTED = "o_orderkey AS id, cast(o_orderkey % 25 AS int) AS h, cast(o_custkey % 60 AS int) AS m, cast(o_orderkey % 6003 AS int) AS s100, CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END AS dec_sign, cast(o_custkey % 90 AS int) AS d, cast(o_orderkey % 61 AS int) AS dm, cast(o_custkey % 600 AS int) AS ds10"
_TO = "(h + m / 60.0 + s100 / 360000.0) * 15", "CASE dec_sign WHEN '-' THEN -1 ELSE 1 END * (d + dm / 60.0 + ds10 / 36000.0)"


@query(f"""WITH p AS (SELECT {_PRINTED} FROM orders), e AS (SELECT *, CASE WHEN h > 23 THEN 'h must be between 0 and 23' WHEN s100 > 5999 THEN 's100 must be between 0 and 5999' WHEN dm > 59 THEN 'dm must be between 0 and 59' END AS error FROM p),
g AS (SELECT id, {PLACE_SQL} FROM ({fk4_sql(_TO[0] + '::DOUBLE', _TO[1] + '::DOUBLE', 1875.0, 1875.0, "(SELECT * FROM e WHERE error IS NULL)")})),
i AS (SELECT id, CAST(floor(ra / 15 * 360000) AS BIGINT) AS a, CAST(floor(abs(dec) * 36000) AS BIGINT) AS b, dec FROM g)
SELECT e.id, error, CASE WHEN i.id IS NOT NULL THEN printf('%02dh %02dm %02ds%02d %s%02d° %02d'' %02d''''%d', a // 360000, a // 6000 % 60, a % 6000 // 100, a % 100, CASE WHEN dec < 0 THEN '-' ELSE '+' END, b // 36000, b // 600 % 60, b % 600 // 10, b % 10) END AS place FROM e LEFT JOIN i USING (id)""")
def transform_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed J2000 places at B1875 in the form of the command's answer, or which field is out of range."""
    rows = sky.transformed(t(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in _PRINTED.split(", ")]), 1875)
    place = F.format_string("%02dh %02dm %02ds%02d %s%02d° %02d' %02d''%d", "to_h", "to_m", F.expr("to_s100 div 100"), F.expr("to_s100 % 100"), "to_sign", "to_d", "to_dm", F.expr("to_ds10 div 10"), F.expr("to_ds10 % 10"))
    return rows.select("id", "error", F.when(F.col("error").isNull(), place).alias("place"))


#: five bands of five zones, each band turned against the one above, zones across 0 degrees in two rows; no published table is at hand
_ZONES = """SELECT n_nationkey * 2 + part AS row, n_name AS name, CASE WHEN part = 0 THEN lo ELSE 0.0 END AS ra_lo, CASE WHEN part = 0 THEN least(lo + 72, 360.0) ELSE lo + 72 - 360 END AS ra_hi, dec_lo FROM (
 SELECT *, (n_nationkey % 5 * 72 + n_nationkey // 5 * 13) % 360 * 1.0 AS lo, CASE WHEN n_nationkey >= 20 THEN -90.0 ELSE 66 - 36 * (n_nationkey // 5) - n_nationkey % 5 * 5.0 END AS dec_lo FROM nation), (SELECT unnest([0, 1]) AS part) WHERE part = 0 OR lo + 72 > 360"""


@query(SKY_SQL + f", z AS ({_ZONES}), p AS (SELECT id, {PLACE_SQL} FROM ({fk4_sql('ra', 'dec', 1875.0, 1875.0, 'stars')})) SELECT id, arg_min(name, row) AS name FROM p JOIN z ON ra >= ra_lo AND ra < ra_hi AND dec >= dec_lo GROUP BY id")
def constellation_b1875(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2000 places, taken to B1875, against a table of zones in two dimensions whose first row that holds a place counts."""
    lo = "(n_nationkey % 5 * 72 + n_nationkey div 5 * 13) % 360 * 1.0D"
    zones = t(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name AS name", f"{lo} AS lo", "CASE WHEN n_nationkey >= 20 THEN -90.0D ELSE 66 - 36 * (n_nationkey div 5) - n_nationkey % 5 * 5.0D END AS dec_lo", "explode(array(0, 1)) AS part").filter("part = 0 OR lo + 72 > 360")
    zones = zones.selectExpr("n_nationkey * 2 + part AS row", "name", "IF(part = 0, lo, 0.0D) AS ra_lo", "IF(part = 0, least(lo + 72, 360.0D), lo + 72 - 360) AS ra_hi", "dec_lo")
    p = sky.to_fk4(stars(spark, sf_dir).select("id", "ra", "dec"), "ra", "dec", 1875.0, 1875.0)
    ra, dec = sky.turned_place("x", "y", "z")
    return J.zoned(p.select("id", F.expr(ra).alias("ra"), F.expr(dec).alias("dec")), zones)


# ---------------------------------------------------------------- a cascade in stages

#: the tables of the stages: which stars they have, and by how many arcseconds theirs lie nearer to the equator
_TABLES = {"ppm": ("id % 5 = 0", "id % 25 * 4 + 1"), "dm": ("id % 5 = 2", "id % 25 * 4 + 1"), "sd": ("id % 5 IN (2, 3)", "id % 25 * 4 + 1"), "cpd": ("id % 5 > 1", "id % 25 * 4 + 1")}
_LEVELS = [("ppm", 15.0, "id > 0", None), ("unidentified", 15.0, "id > 0", 1.0), ("dm", 60.0, "dec <= -22", None), ("sd", 60.0, "dec BETWEEN -23 AND -1", None), ("cpd", 30.0, "dec <= -18", None)]


def _near(off: str) -> str:
    return f"CASE WHEN dec > 0 THEN dec - ({off}) / 3600.0D ELSE dec + ({off}) / 3600.0D END"


def _level(name: str, rest: str, radius: float, condition: str) -> str:
    return f"{name}_m AS (SELECT id, '{name}' AS source, match, d2 FROM (SELECT a.id, b.id AS match, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS k FROM (SELECT * FROM {rest} WHERE {condition}) a JOIN {name} b ON {_BAND(radius)} AND {_D2} < {_H2(radius)}) WHERE k = 1)"


def _cascade_sql() -> str:
    parts = [f"{n} AS ({_vec(f'SELECT id, ra, {_near(off)}::DOUBLE AS dec FROM (SELECT id, ra, dec FROM stars WHERE {which}) q')})" for n, (which, off) in _TABLES.items()]
    listed = " UNION ALL ".join(f"SELECT id * 10 + {j} AS id, ra, {_near(f'id % 8 * 2 + {more}')}::DOUBLE AS dec FROM (SELECT id, ra, dec FROM stars WHERE id % 5 = 1) q{j}" for j, more in enumerate((2.0, 1.3, 0.0)))
    parts.append(f"unidentified AS ({_vec(listed)})")
    rest = "stars"
    for i, (name, radius, condition, margin) in enumerate(_LEVELS):
        if margin is None:
            parts.append(_level(name, rest, radius, condition))
        else:
            fold = f"list_reduce(list({{'match': b.id, 'dist': {sky.arcsec(_D2)}}} ORDER BY b.id), lambda u, w: CASE WHEN u.dist - {margin} > w.dist THEN w ELSE u END)"
            parts.append(f"{name}_m AS (SELECT id, '{name}' AS source, f.match AS match, pow(2 * sin(radians(f.dist / 3600) / 2), 2) AS d2 FROM (SELECT a.id, {fold} AS f FROM {rest} a JOIN {name} b ON {_BAND(radius)} AND {_D2} < {_H2(radius)} GROUP BY a.id))")
        parts.append(f"rest{i} AS (SELECT * FROM {rest} WHERE id NOT IN (SELECT id FROM {name}_m))")
        rest = f"rest{i}"
    return SKY_SQL + ", " + ", ".join(parts) + f" SELECT id, source, match, round({sky.arcsec('d2')}, 3) AS dist FROM (" + " UNION ALL ".join(f"SELECT * FROM {n}_m" for n, *_ in _LEVELS) + ")"


def _nearer(df: DataFrame, off: str) -> DataFrame:
    return sky.with_vector(df.withColumn("dec", F.expr(_near(off)).cast("double")))


@query(_cascade_sql())
def staged_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tables in their order; the second is a list in which a later star must be over an arcsecond nearer."""
    s = stars(spark, sf_dir).select("id", "ra", "dec", "x", "y", "z")
    tables = {n: _nearer(s.filter(which), off) for n, (which, off) in _TABLES.items()}
    listed = s.filter("id % 5 = 1").selectExpr("*", "inline(array(struct(0 AS j, 2.0D AS more), struct(1 AS j, 1.3D AS more), struct(2 AS j, 0.0D AS more)))")
    tables["unidentified"] = _nearer(listed, "id % 8 * 2 + more").withColumn("id", F.expr("id * 10 + j"))
    return J.staged(s, "id", [(n, tables[n], radius, condition, margin) for n, radius, condition, margin in _LEVELS]).select("id", "source", "match", _r("dist", 3, "dist"))


# ---------------------------------------------------------------- references with a second look

_REFERS = "id % 997 + CASE WHEN id % 7 = 0 THEN 1 WHEN id % 11 = 0 THEN 250 ELSE 0 END"


@query(SKY_SQL + f""", r AS (SELECT *, {_REFERS} AS ref FROM stars WHERE id % 997 > 0), n AS (SELECT id % 997 AS number, min(id) AS other FROM stars WHERE id % 997 > 0 GROUP BY 1)
SELECT a.id, a.ref, a.id % 997 AS number, CASE abs(a.ref - a.id % 997) WHEN 0 THEN 'match' WHEN 1 THEN 'note' ELSE 'mismatch' END AS verdict, b.id AS other, b.mag AS other_mag, CASE WHEN b.id IS NOT NULL THEN round({sky.arcsec(_D2)}, 1) END AS other_dist, b.id IS NULL AS kept
FROM r a LEFT JOIN n ON n.number = a.ref AND a.ref <> a.id % 997 LEFT JOIN stars b ON b.id = n.other""")
def reference_second_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stars(spark, sf_dir)
    rows = s.select("id", F.col("id").alias("star"), "x", "y", "z", F.expr(_REFERS).alias("ref"))
    found = J.second_look(rows, s.selectExpr("id AS star", "id % 997 AS number", "mag", "x", "y", "z"))
    return found.select("id", "ref", "number", "verdict", "other", "other_mag", _r("other_dist", 1, "other_dist"), "kept")


@query(SKY_SQL + f"SELECT a.id, CASE WHEN b.id IS NULL THEN 'absent' WHEN {sky.arcsec(_D2)} > 120 THEN 'far' ELSE 'ok' END AS place, coalesce(abs(a.mag - b.mag) > 0.15, false) AS mag_differs FROM twins a LEFT JOIN stars b ON b.id = a.id AND a.id % 9 > 0")
def reference_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars that name another by number: limits on position and on magnitude."""
    from skyloom.plans.catalog import twins

    table = stars(spark, sf_dir).filter("id % 9 > 0").selectExpr("id AS star", "id AS number", "mag", "x", "y", "z")
    return J.reference_limits(twins(spark, sf_dir).withColumn("number", F.col("id")), table, 120.0, 0.15).select("id", "place", "mag_differs")


# ---------------------------------------------------------------- lines with state

_GOULD = "concat(CASE WHEN o_orderkey % 5 > 0 THEN 'G' ELSE ' ' END, ' ', lpad(cast({n} as string), 3, ' '), ' ', CASE WHEN o_custkey % 3 = 0 THEN 'Ser' ELSE 'Cen' END, repeat(' ', 91), CASE WHEN o_orderkey % 6 > 0 THEN '12' ELSE '  ' END, ' 34 56')"


@query("""WITH r AS (SELECT o_orderkey AS k, (o_orderkey // 40) % 120 AS n, o_custkey % 3 = 0 AS ser FROM orders WHERE o_orderkey % 6 > 0),
first_b AS (SELECT min(k) AS k FROM r WHERE k % 5 > 0 AND ser AND n = 49)
SELECT r.k AS line_no, CASE WHEN r.k % 5 > 0 THEN CAST(n AS INTEGER) ELSE 0 END AS number, CASE WHEN r.k % 5 > 0 THEN CASE WHEN NOT ser THEN 'Cen' WHEN r.k > (SELECT k FROM first_b) THEN 'Serb' ELSE 'Sera' END END AS constellation,
CASE WHEN r.k % 5 > 0 THEN n || 'G ' || CASE WHEN NOT ser THEN 'Cen' WHEN r.k > (SELECT k FROM first_b) THEN 'Serb' ELSE 'Sera' END ELSE 'Annonymous' END AS name FROM r""")
def gould_designations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _GOULD.format(n="o_orderkey div 40 % 120")
    return lists.gould_designations(t(spark, sf_dir, "orders").selectExpr("o_orderkey AS line_no", f"{line} AS line"))


@query("""SELECT o_orderkey AS line_no, concat(o_orderkey % 300, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END) AS id, round((o_orderkey % 24 + o_custkey % 60 / 60.0 + o_orderkey % 60 / 3600.0) * 15, 8) AS ra,
round(CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey % 3 + (o_custkey % 600) / 600.0), 8) + 0.0 AS dec,
printf('%02dh %02dm %02ds %s%02d°%04.1f''', o_orderkey % 24, o_custkey % 60, o_orderkey % 60, CASE WHEN o_custkey % 2 = 0 THEN '-' ELSE '+' END, o_orderkey % 3, (o_custkey % 600) / 10.0) AS place FROM orders WHERE o_orderkey % 300 > 0 AND o_orderkey % 13 > 0""")
def magnitude_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth line lacks its last field; degrees of 0 keep their sign."""
    line = """concat_ws(',', concat(o_orderkey % 300, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END), 'x', o_orderkey % 24, o_custkey % 60, o_orderkey % 60, concat(CASE WHEN o_custkey % 2 = 0 THEN '-' ELSE '' END, o_orderkey % 3),
    cast((o_custkey % 600) / 10.0D as string), array_join(array_repeat('.', CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE 10 END), ','))"""
    rows = lists.magnitude_standards(t(spark, sf_dir, "orders").selectExpr("o_orderkey AS line_no", f"{line} AS line"))
    return rows.select("line_no", "id", _r("ra", 8, "ra"), _r("dec", 8, "dec"), "place")


@query("SELECT id, number, previous FROM (SELECT o_orderkey AS id, n AS number, coalesce(lag(n) OVER (ORDER BY o_orderkey), 0) AS previous FROM (SELECT o_orderkey, (o_orderkey // 10 + CASE WHEN o_custkey % 50 = 0 THEN 80 ELSE 0 END) AS n FROM orders WHERE o_custkey % 4 > 0)) WHERE abs(number - previous) > 50")
def association_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that leap from the one before; lines of another declination neither count nor are remembered."""
    rows = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 4 > 0 AS same", "o_orderkey div 10 + CASE WHEN o_custkey % 50 = 0 THEN 80 ELSE 0 END AS number")
    return order.jumps(rows, [], ["id"], "number", F.col("same"), 50).select("id", "number", "previous")


@query("SELECT o_orderkey, line FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders) WHERE line % 3 = 1 AND o_totalprice > 100000")
def every_third_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of the whole file, counted before any line is left out."""
    rows = order.numbered(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return rows.filter("line % 3 = 1 AND o_totalprice > 100000").select("o_orderkey", "line")


# ---------------------------------------------------------------- precessions of a year, pages of several runs

@query("""SELECT o_orderkey AS id, round(3.07177 + 0.000019 * 31 + d, 4) AS pre_ra, abs(d - (20.0564 - 0.000086 * 31) / 15 * sin(radians(a)) * tan(radians(b))) > 0.0099 + 0.002 * abs(d) AS wrong_ra,
 abs(0.3 * (o_orderkey % 3 - 1)) > 0.099 AS wrong_dec FROM (SELECT *, (20.0564 - 0.000086 * 31) / 15 * sin(radians(a)) * tan(radians(b)) + (o_orderkey % 41 - 20) / 1000.0 AS d FROM (SELECT *, (o_orderkey % 3600) / 10.0 AS a, -(o_custkey % 890) / 10.0 AS b FROM orders))""")
def precessions_of_a_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants of 1881; printed values some thousandths off; the tolerance grows toward the pole."""
    m, n = checks.precession_constants(1881.0)
    rows = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "(o_orderkey % 3600) / 10.0D AS ra", "-(o_custkey % 890) / 10.0D AS dec")
    rows = rows.withColumns({"pre_ra": F.expr(f"{m!r}D + {n / 15!r}D * sin(radians(ra)) * tan(radians(dec)) + (id % 41 - 20) / 1000.0D"), "pre_dec": F.expr(f"{n!r}D * cos(radians(ra)) + 0.3D * (id % 3 - 1)")})
    return checks.precessions(rows, 1881.0).select("id", _r("pre_ra", 4, "pre_ra"), "wrong_ra", "wrong_dec")


#: what three runs read of a number x of a page: run, declination and value, and in the last column its list and whether it is doubtful
_READ = {0: ((1, 22, 0), (2, 22, 0), (3, 22, 0)), 1: ((1, 22, 0),), 2: ((1, 22, 400), (2, 22, 400)), 3: ((1, 22, 777000), (2, 22, 777000)), 4: ((1, 23, 400), (2, 22, 400)), 5: ((1, 22, 5000), (2, 22, 0), (3, 22, 0)), 6: ((1, 22, 0), (3, 22, 0)), 7: ((2, 22, 0), (2, 22, 0))}


def _readings_sql() -> str:
    out = []
    for kind, read in _READ.items():
        for run, decl, more in read:
            at, value, doubt = (23, "x + 400", "false") if more == 400 else (22, "x", "true") if more == 5000 else (22, "x + 777000", "true") if more > 5000 else (decl, "x", "false")
            out.append(f"SELECT page, {at} AS decl, {value} AS n, {run} AS run, {doubt} AS doubt FROM k WHERE kind = {kind}")
    return " UNION ALL ".join(out)


@query(f"WITH k AS (SELECT o_orderkey % 40 AS page, 100 + o_orderkey // 40 % 200 AS x, o_custkey % 8 AS kind FROM orders), r AS ({_readings_sql()}) SELECT page, decl, n, count(DISTINCT run) AS runs, count(DISTINCT run) >= 2 AND NOT bool_or(doubt) AS certain FROM r GROUP BY page, decl, n")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read three times: numbers moved and repaired run by run, then voted on."""
    cases = " ".join(f"WHEN {k} THEN array({', '.join(f'struct({a} AS run, {b} AS decl, {c}L AS more)' for a, b, c in v)})" for k, v in _READ.items())
    numbers = t(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 40 AS page", "100 + o_orderkey div 40 % 200 AS x", f"posexplode(CASE o_custkey % 8 {cases} END) AS (i, r)")
    numbers = numbers.selectExpr("r.run AS run", "page", "r.decl AS decl", "'dpl' AS kind", "o_orderkey * 10 + i AS seq", "x + r.more AS n")
    sides = "inline(array(struct(22 AS decl, 1 AS place, 100L AS first, 299L AS last), struct(23 AS decl, 2 AS place, 500L AS first, 699L AS last)))"
    ends = numbers.select("run", "page").distinct().selectExpr("run", "page", sides)
    return checks.merge_runs(numbers, ends).select("page", "decl", "n", "runs", "certain")


# ---------------------------------------------------------------- assignment

#: blocks of at most eight orders and five places; the first order of a block knows all places, so a block is one component
_GRAPH = "SELECT l_orderkey AS l, l_orderkey {div} 8 * 5 + l_suppkey % 5 AS r, (l_partkey % 65 + l_linenumber / 8.0{d}) AS cost FROM lineitem UNION ALL SELECT l, b * 5 + j, 66.0{d} + j / 16.0{d} FROM (SELECT min(l_orderkey) AS l, l_orderkey {div} 8 AS b FROM lineitem GROUP BY 2), {five}"
_BLOCKS = _GRAPH.format(div="//", d="", five="(SELECT unnest([0, 1, 2, 3, 4]) AS j)")


@query(f"""WITH RECURSIVE e AS (SELECT l, r, min(cost) AS cost FROM ({_BLOCKS}) GROUP BY l, r), k AS (SELECT l // 8 AS block FROM e GROUP BY 1 HAVING count(DISTINCT l) >= 5),
w(block, j, used, total) AS (SELECT block, 0, CAST([] AS BIGINT[]), 0.0::DOUBLE FROM k UNION ALL SELECT w.block, w.j + 1, list_append(w.used, e.l), w.total + e.cost FROM w JOIN e ON e.r = w.block * 5 + w.j WHERE w.j < 5 AND NOT list_contains(w.used, e.l))
SELECT block, count(*) FILTER (j = 5) > 0 AS matched, round(min(total) FILTER (j = 5), 4) AS total FROM w GROUP BY block""")
def assignment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least total cost at which all five places of a block get an order of their own, or none at all."""
    t(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem")
    edges = spark.sql(_GRAPH.format(div="div", d="D", five="(SELECT explode(array(0, 1, 2, 3, 4)) AS j)").replace("lineitem", "_lineitem"))
    edges = edges.withColumn("cost", F.col("cost").cast("double"))
    blocks = edges.groupBy(F.expr("l div 8").alias("block")).agg(F.count_distinct("l").alias("n")).filter("n >= 5").select("block")
    found = G.assign(edges).groupBy(F.expr("l div 8").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("total"))
    return blocks.join(found, "block", "left").select("block", (F.coalesce("n", F.lit(0)) == 5).alias("matched"), _r("total", 4, "total"))


# ---------------------------------------------------------------- register lines, zones in ascending order

_REGISTER = "printf('     Register CD %d°%d (en %.0fh):  %.1f | %.0fm%.1fs | %.1f''     (pag. %d)', decl, number, hour::DOUBLE, mag::DOUBLE, minute::DOUBLE, second::DOUBLE, arcminute::DOUBLE, CAST(pages * (index - min(index) OVER (PARTITION BY v)) // count(*) OVER (PARTITION BY v) AS BIGINT))"


@query(f"""WITH s AS (SELECT p_partkey AS index, CAST(-22 - p_partkey // 30 % 60 AS INTEGER) AS decl, p_partkey % 500 AS number, p_partkey % 24 AS hour, p_partkey % 60 AS minute, (p_partkey % 600) / 10.0 AS second, (p_partkey % 590) / 10.0 AS arcminute, (p_partkey % 100) / 10.0 AS mag FROM part),
v AS (SELECT *, CASE WHEN decl >= -31 THEN 1 WHEN decl >= -41 THEN 2 WHEN decl >= -51 THEN 3 WHEN decl >= -61 THEN 4 ELSE 5 END AS v FROM s), l AS (SELECT index, {_REGISTER} AS text FROM (SELECT *, [605, 539, 503, 305, 400][v] AS pages FROM v)), f AS (SELECT index AS i FROM s WHERE index % 17 = 0)
SELECT i AS seq, 0 AS k, text FROM f JOIN l ON index = i UNION ALL SELECT i, 1, '   Neighbors:' FROM f UNION ALL SELECT i, 2, text FROM f JOIN l ON index = i - 1 UNION ALL SELECT i, 3, text FROM f JOIN l ON index = i + 1""")
def register_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register lines under warnings, with the stars before and behind; volumes' places come from the whole list."""
    s = t(spark, sf_dir, "part").selectExpr("p_partkey AS index", "cast(-22 - p_partkey div 30 % 60 AS int) AS decl", "p_partkey % 500 AS number", "p_partkey % 24 AS hour", "p_partkey % 60 AS minute", "(p_partkey % 600) / 10.0D AS second", "(p_partkey % 590) / 10.0D AS arcminute", "(p_partkey % 100) / 10.0D AS mag")
    return reports.registers(s, s.filter("index % 17 = 0").selectExpr("index AS seq", "index"), True)


@query("""SELECT id, row_number() OVER (ORDER BY CASE WHEN south THEN -zone - 1 ELSE zone END, id) - 1 AS place, code FROM (SELECT o_orderkey AS id, o_custkey % 5 = 0 AS south, CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 2 ELSE o_orderkey % 90 END AS zone,
 CASE o_orderkey % 20 WHEN 0 THEN 'nebula' WHEN 1 THEN 'variable' WHEN 2 THEN 'nova' WHEN 3 THEN 'cluster' WHEN 4 THEN 'unknown' END AS code FROM orders)""")
def ascending_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars numbered by ascending zones: -1, -0, +0 and so on; codes that stand in place of magnitudes."""
    s = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 5 = 0 AS south", "CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 2 ELSE o_orderkey % 90 END AS zone", "CASE o_orderkey % 20 WHEN 0 THEN 20.0D WHEN 1 THEN 30.0D WHEN 2 THEN 40.0D WHEN 3 THEN 50.0D WHEN 4 THEN 12.2D ELSE 9.5D END AS mag")
    return tables.ascending(s, "south", "zone", "id").select("id", "place", tables.magnitude_code(F.col("mag")).alias("code"))
