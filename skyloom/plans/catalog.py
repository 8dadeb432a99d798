"""Named queries over the benchmark tables, each with the SQL that gives the same rows elsewhere.

The tables stand in for star tables: an order is a star whose place follows from its key, and its twin is the
same star in another table, some arcseconds off. Lines of fixed width are written and parsed again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import mags, sky
from skyloom.operators import components as G
from skyloom.operators import match as J
from skyloom.operators import ocr, order
from skyloom.operators import stats as A
from skyloom.sources import fixed_width as S
from skyloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = _duck(sql)
        return f

    return add


def _duck(sql: str) -> str:
    """Double literals are written 1.0D in Spark SQL."""
    import re

    return re.sub(r"(?<![A-Za-z_])(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"CAST(\1 AS DOUBLE)", sql)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- the sky of orders

_U = "(o_orderkey * 0.6180339887498949D - floor(o_orderkey * 0.6180339887498949D))"
_W = "(o_orderkey * 0.7548776662466927D - floor(o_orderkey * 0.7548776662466927D))"
#: seconds of arc that the twin is off, in declination and in right ascension
_OFF = "((o_orderkey % 97) * 2 + (o_orderkey % 7) * 0.25D)"
_RA, _DEC = f"360.0D * {_U}", f"degrees(asin(2.0D * {_W} - 1.0D))"
_MAG = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 1.0D + (o_orderkey % 110) / 10.0D END"
_STAR = f"SELECT o_orderkey AS id, {_RA} AS ra, {_DEC} AS dec, {_MAG} AS mag, o_custkey FROM orders"
_TWIN = f"SELECT o_orderkey AS id, {_RA} AS ra, CASE WHEN {_DEC} > 0 THEN {_DEC} - {_OFF} / 3600.0D ELSE {_DEC} + {_OFF} / 3600.0D END AS dec, 1.0D + ((o_orderkey + o_orderkey % 5) % 110) / 10.0D AS mag FROM orders"


def _vec(sql: str) -> str:
    x, y, z = sky.unit("ra", "dec")
    return f"SELECT *, {x} AS x, {y} AS y, {z} AS z FROM ({sql}) q"


SKY_SQL = f"WITH stars AS ({_vec(_STAR)}), twins AS ({_vec(_TWIN)}) "


def _orders(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """id, ra, dec, mag of orders as stars, and ``more``: the SQL's places to the last digit, because twins lie just at the limits of searches."""
    dec = F.degrees(sky.asin_c(F.expr(f"2.0D * {_W} - 1.0D")))
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_RA).alias("ra"), dec.alias("dec"), F.expr(_MAG).alias("mag"), *more)


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sky.placed(_orders(spark, sf_dir, "o_custkey"))


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = _OFF.replace("o_orderkey", "id")
    moved = _orders(spark, sf_dir).withColumn("dec", F.expr(f"CASE WHEN dec > 0 THEN dec - {off} / 3600.0D ELSE dec + {off} / 3600.0D END"))
    return sky.placed(moved.withColumn("mag", F.expr("1.0D + ((id + id % 5) % 110) / 10.0D")))


def _r(e: str | F.Column, n: int, name: str) -> F.Column:
    return F.round(F.expr(e) if isinstance(e, str) else e, n).alias(name)


_D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
_H2 = lambda radius: f"{J.chord(radius) ** 2!r}"
_BAND = lambda radius: f"b.dec BETWEEN a.dec - {radius / 3600 * 1.01!r} AND a.dec + {radius / 3600 * 1.01!r}"


# ---------------------------------------------------------------- scans

_LINE = "concat(' ', lpad(cast(o_orderkey % 1000000 AS varchar), 6, '0'), ' ', lpad(cast(o_orderkey % 24 AS varchar), 2, ' '), lpad(cast(o_orderkey % 60 AS varchar), 2, '&'), lpad(cast(o_orderkey % 5999 AS varchar), 4, ' '), CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END, lpad(cast(o_orderkey % 90 AS varchar), 2, ' '), lpad(cast(o_orderkey % 59 AS varchar), 2, ' '), lpad(cast(o_orderkey % 599 AS varchar), 3, ' '), CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE lpad(cast(o_orderkey % 99 AS varchar), 3, ' ') END)"
_LAYOUT = [S.Field("number", 2, 6, "int"), S.Field("sign", 17, 1), S.Field("mag", 25, 3, "decimal", 10.0)]
_DIG = lambda a, n: f"CAST(translate(rpad(substr(value, {a}, {n}), {n}, ' '), ' &', '00') AS INTEGER)"


@query(f"""SELECT CAST(substr(value, 2, 6) AS INTEGER) AS number, substr(value, 17, 1) AS sign, {_DIG(25, 3)} / 10.0 AS mag,
  round(({_DIG(9, 2)} + {_DIG(11, 2)} / 60.0 + {_DIG(13, 4)} / 360000.0) * 15.0, 6) AS ra,
  round({_DIG(18, 2)} + {_DIG(20, 2)} / 60.0 + {_DIG(22, 3)} / 36000.0, 6) AS dec_abs
  FROM (SELECT {_LINE} AS value FROM orders)""")
def fixed_width_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "orders").select(F.expr(_LINE.replace("varchar", "string")).alias("value"))
    rows = S.parse(lines, _LAYOUT).withColumns({"ra": S.hours("value", 9), "dec_abs": S.degrees("value", 18, 10)})
    return rows.select("number", "sign", "mag", _r("ra", 6, "ra"), _r("dec_abs", 6, "dec_abs"))


_ZLINE = "concat('CD', lpad(cast(-(22 + o_orderkey % 60) AS varchar), 3, ' '), lpad(cast(o_orderkey % 100000 AS varchar), 5, ' '), CASE o_orderkey % 17 WHEN 0 THEN 'D' WHEN 1 THEN 'a' ELSE ' ' END, CASE o_orderkey % 19 WHEN 0 THEN '20.0' WHEN 1 THEN '30.0' ELSE concat(' ', cast(o_orderkey % 10 AS varchar), '.', cast(o_orderkey % 7 AS varchar)) END, lpad(cast(o_orderkey % 24 AS varchar), 2, ' '), lpad(cast(o_orderkey % 60 AS varchar), 2, ' '), lpad(cast(o_orderkey % 60 AS varchar), 2, ' '), '.', cast(o_orderkey % 10 AS varchar), '-', lpad(cast(22 + o_orderkey % 60 AS varchar), 2, ' '), lpad(cast(o_orderkey % 59 AS varchar), 2, ' '), '.', cast(o_orderkey % 9 AS varchar))"


@query(f"SELECT zone, number, supplement, mag, round(ra, 6) AS ra, round(dec, 6) AS dec FROM (SELECT CAST(substr(value, 3, 3) AS INTEGER) AS zone, CAST(trim(substr(value, 6, 5)) AS INTEGER) AS number, trim(substr(value, 11, 1)) AS supplement, trim(substr(value, 12, 4)) AS mag, (CAST(trim(substr(value, 16, 2)) AS DOUBLE) + CAST(trim(substr(value, 18, 2)) AS DOUBLE) / 60 + CAST(trim(substr(value, 20, 4)) AS DOUBLE) / 3600) * 15 AS ra, -(CAST(trim(substr(value, 25, 2)) AS DOUBLE) + CAST(trim(substr(value, 27, 4)) AS DOUBLE) / 60) AS dec FROM (SELECT {_ZLINE} AS value FROM orders)) WHERE supplement <> 'D' AND CAST(mag AS DOUBLE) NOT IN (20, 40, 50)")
def scan_zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "orders").select(F.expr(_ZLINE.replace("varchar", "string")).alias("value"))
    return tables.stars(lines, "cd").select("zone", "number", "supplement", "mag", _r("ra", 6, "ra"), _r("dec", 6, "dec"))


_TLINE = "concat(lpad(cast(c_custkey % 9999 AS varchar), 4, ' '), ' ', lpad(cast(c_custkey % 99999 AS varchar), 5, ' '))"
for _place, _what in (
    (111, "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat(lpad(cast(c_custkey % 12 AS varchar), 2, ' '), '.125') END"),
    (124, "concat(lpad(cast(c_custkey % 11 AS varchar), 2, ' '), '.250')"),
    (153, "concat(lpad(cast(c_custkey % 360 AS varchar), 3, ' '), '.12345678')"),
    (166, "concat(lpad(cast((c_custkey % 179) - 89 AS varchar), 3, ' '), '.12345678')"),
):
    _TLINE = f"concat(rpad({_TLINE}, {_place - 1}, ' '), {_what})"
_TV = mags.visual("coalesce(bt, 0.0D)", "coalesce(vt, 0.0D)")


@query(f"SELECT tyc1, tyc2, ra, dec, round({_TV} + 1e-9, 4) AS v FROM (SELECT CAST(trim(substr(value, 1, 4)) AS INTEGER) AS tyc1, CAST(trim(substr(value, 6, 5)) AS INTEGER) AS tyc2, TRY_CAST(trim(substr(value, 111, 6)) AS DOUBLE) AS bt, TRY_CAST(trim(substr(value, 124, 6)) AS DOUBLE) AS vt, CAST(trim(substr(value, 153, 12)) AS DOUBLE) AS ra, CAST(trim(substr(value, 166, 12)) AS DOUBLE) AS dec FROM (SELECT {_TLINE} AS value FROM customer)) WHERE dec < 0")
def scan_tycho(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "customer").select(F.expr(_TLINE.replace("varchar", "string")).alias("value"))
    rows = tables.stars(lines, "tycho2").withColumns({"bt": F.col("bt").try_cast("double"), "vt": F.col("vt").try_cast("double")})
    return rows.filter("dec < 0").select("tyc1", "tyc2", "ra", "dec", _r(f"{_TV} + 1e-9", 4, "v"))


_SAN = "CASE s_suppkey % 5 WHEN 0 THEN '1 ' WHEN 1 THEN '&7' WHEN 2 THEN '' WHEN 3 THEN ' 4' ELSE lpad(cast(s_suppkey % 100 AS varchar), 2, '0') END"


@query(f"SELECT s_suppkey, f AS raw, CAST(translate(rpad(f, 2, ' '), ' &', '00') AS INTEGER) AS sanitized, coalesce(TRY_CAST(regexp_extract(f, '^\\s*([+-]?\\d+)', 1) AS INTEGER), 0) AS prefix FROM (SELECT s_suppkey, {_SAN} AS f FROM supplier)")
def sanitized_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_SAN.replace("varchar", "string")).alias("raw"))
    return rows.select("s_suppkey", "raw", S.leading_int(S.digits("raw", 1, 2)).alias("sanitized"), S.leading_int(F.col("raw")).alias("prefix"))


_M1, _M2 = "(1 + s_suppkey % 9)", "CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 2 + s_suppkey % 9 WHEN 2 THEN s_suppkey % 9 ELSE 5 + s_suppkey % 9 END"
_FR = "CASE s_suppkey % 3 WHEN 0 THEN '1/4' WHEN 1 THEN '3/4' ELSE '' END"
_TX = "CASE s_suppkey % 4 WHEN 0 THEN ' V ' WHEN 1 THEN '075' WHEN 2 THEN ' 8 ' ELSE '' END"
_NOTES = f"""s_suppkey, {mags.two_integers(_M1, _M2, 0.3, 0.3)} AS wb, {mags.two_integers(_M1, _M2, 0.5, 0.2)} AS oa,
  {mags.int_half(_M1, "CASE WHEN s_suppkey % 2 = 0 THEN '5' ELSE ' ' END")} AS half, {mags.fraction(_M1, f"({_FR})", mags.CATALOGUE_FRACTIONS)} AS printed,
  {mags.fraction(_M1, f"({_FR})", mags.SCAN_FRACTIONS)} AS scanned, {mags.tenths(f"({_TX})")} AS tenths"""


@query("""SELECT CASE WHEN second IS NULL OR second = 0 THEN m1 WHEN k % 4 = 1 THEN m1 + 0.3::DOUBLE WHEN k % 4 = 2 THEN m1 - 0.3::DOUBLE END AS wb, s_suppkey,
  CASE WHEN second IS NULL OR second = 0 THEN m1 WHEN k % 4 = 1 THEN m1 + 0.5::DOUBLE WHEN k % 4 = 2 THEN m1 - 0.2::DOUBLE END AS oa, m1 + 0.5::DOUBLE * (1 - k % 2) AS half,
  m1 + [0.2, 0.8, 0.0][k % 3 + 1]::DOUBLE AS printed, m1 + [0.2, 0.7, 0.0][k % 3 + 1]::DOUBLE AS scanned, CASE k % 4 WHEN 1 THEN 7.5::DOUBLE WHEN 2 THEN 8.0::DOUBLE END AS tenths
  FROM (SELECT s_suppkey, s_suppkey AS k, (1 + s_suppkey % 9)::DOUBLE AS m1, [NULL, 2 + s_suppkey % 9, s_suppkey % 9, 5 + s_suppkey % 9][s_suppkey % 4 + 1] AS second FROM supplier)""")
def mag_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "supplier").selectExpr(*_split(_NOTES))


def _split(select: str) -> list[str]:
    """The items of a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[at:i])
            at = i + 1
    return [*out, select[at:]]


@query("""SELECT a.line, a.value AS name, b.value AS price FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS line, o_orderpriority AS value FROM orders) a
  JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) AS line, o_orderstatus AS value FROM orders) b USING (line)""")
def zip_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders")
    cuts = order.bounds(orders, "o_orderkey")

    def lines(column: str, name: str) -> DataFrame:
        return order.numbered(orders.select("o_orderkey", F.col(column).alias(name)), ["o_orderkey"], cuts=cuts).drop("o_orderkey")

    return lines("o_orderpriority", "name").join(lines("o_orderstatus", "price"), "line")


@query(f"SELECT c_custkey, label, mag_unknown, mag_ok FROM (SELECT c_custkey, CASE WHEN abs(m) < 1e-5 THEN 'unknown' WHEN m > 29.9 THEN 'variable' ELSE 'ok' END AS label, CASE WHEN abs(m) < 1e-5 THEN 1 ELSE 0 END AS mag_unknown, CASE WHEN abs(m) >= 1e-5 AND m <= 29.9 THEN m END AS mag_ok FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 30.0 ELSE c_custkey % 12 + 0.5 END AS m FROM customer))")
def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t(spark, sf_dir, "customer").selectExpr("c_custkey", "cast(CASE c_custkey % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 30.0 ELSE c_custkey % 12 + 0.5 END AS double) AS m")
    return m.select("c_custkey", S.mag_flag(F.col("m")).alias("label"), (F.abs("m") < 1e-5).cast("int").alias("mag_unknown"), S.known_mag(F.col("m")).alias("mag_ok"))


# ---------------------------------------------------------------- geometry

@query(SKY_SQL + "SELECT id, round(cos(radians(dec)) * cos(radians(ra)), 9) AS x, round(cos(radians(dec)) * sin(radians(ra)), 9) AS y, round(sin(radians(dec)), 9) AS z, round(CASE WHEN abs(cos(radians(dec)) * cos(radians(ra))) >= 0.000001 THEN ra WHEN cos(radians(dec)) * sin(radians(ra)) > 0 THEN 90 ELSE 270 END, 6) AS ra, round(dec, 6) AS dec FROM stars")
def sph2rec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = sky.ra_dec("x", "y", "z")
    return stars(spark, sf_dir).select("id", *[_r(c, 9, c) for c in "xyz"], _r(ra, 6, "ra"), _r(dec, 6, "dec"))


@query(SKY_SQL + """SELECT id, round(h, 3) AS chord_dist, abs(c - h) < 1 AS acos_agrees FROM (SELECT a.id, 3600 * degrees(2 * asin(sqrt(pow(sin(radians(a.dec - b.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(a.ra - b.ra) / 2), 2)))) AS h,
  3600 * degrees(acos(least(1, sin(radians(a.dec)) * sin(radians(b.dec)) + cos(radians(a.dec)) * cos(radians(b.dec)) * cos(radians(a.ra - b.ra))))) AS c FROM stars a JOIN twins b USING (id))""")
def angular_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = stars(spark, sf_dir).alias("a").join(twins(spark, sf_dir).alias("b"), F.expr("a.id = b.id"))
    return both.select("a.id", _r(sky.arcsec(sky.chord_squared("a.", "b.")), 3, "chord_dist"), F.expr(f"abs({sky.arcsec_acos('a.', 'b.')} - {sky.arcsec(sky.chord_squared('a.', 'b.'))}) < 1").alias("acos_agrees"))


def _moved(start: float, end: float) -> str:
    x, y, z = sky.precess("x", "y", "z", start, end)
    ra, dec = sky.ra_dec("px", "py", "pz")
    return f"SELECT id, round({ra}, 6) AS ra, round({dec}, 6) AS dec FROM (SELECT id, {x} AS px, {y} AS py, {z} AS pz FROM stars) p"


@query(SKY_SQL + """, k AS (SELECT 0.005 * 0.9999784::DOUBLE AS t0, 0.02 * 0.9999784::DOUBLE AS t), g AS (SELECT radians(((23035.545 + 139.72 * t0 + 0.06 * t0 * t0) * t + (30.24 - 0.27 * t0) * t * t + 17.995 * t * t * t) / 3600) AS zeta,
  radians(((23035.545 + 139.72 * t0 + 0.06 * t0 * t0) * t + (109.48 + 0.39 * t0) * t * t + 18.325 * t * t * t) / 3600) AS zz, radians(((20051.12 - 85.29 * t0 - 0.37 * t0 * t0) * t - (42.65 + 0.37 * t0) * t * t - 41.8 * t * t * t) / 3600) AS theta FROM k),
  m AS (SELECT id, degrees(atan2(cos(radians(dec)) * sin(radians(ra) + zeta), cos(theta) * cos(radians(dec)) * cos(radians(ra) + zeta) - sin(theta) * sin(radians(dec))) + zz) AS a,
  degrees(asin(sin(theta) * cos(radians(dec)) * cos(radians(ra) + zeta) + cos(theta) * sin(radians(dec)))) AS d FROM stars, g)
  SELECT id, round(CASE WHEN a < 0 THEN a + 360 WHEN a >= 360 THEN a - 360 ELSE a END, 6) AS ra, round(d, 6) AS dec FROM m""")
def precess_1855_1875(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = stars(spark, sf_dir).select("id", *[F.expr(e).alias(f"p{c}") for c, e in zip("xyz", sky.precess("x", "y", "z", 1855.0, 1875.0))])
    ra, dec = sky.turned_place("px", "py", "pz")
    return moved.select("id", _r(ra, 6, "ra"), _r(dec, 6, "dec"))


_PM = ("((id % 21) - 10) / 36000.0D", "((id % 17) - 8) / 36000.0D")


def _dot(m: object, at: str) -> str:
    """A list of three numbers: a matrix, row by row, with the list ``at``."""
    return "[" + ", ".join(f"list_dot_product([{', '.join(repr(float(v)) for v in row)}]::DOUBLE[3]::DOUBLE[], {at})" for row in m) + "]"


def fk4_sql(ra: str, dec: str, epoch: float, equinox: float, source: str) -> str:
    """SQL that gives id and v, the FK4 place as a list, by steps of its own: rotate, add the E-terms, scale, precess."""
    a = f"[{', '.join(repr(v) for v in sky.e_terms(epoch))}]::DOUBLE[]"
    place = f"[cos(radians({dec})) * cos(radians({ra})), cos(radians({dec})) * sin(radians({ra})), sin(radians({dec}))]"
    inner = f"SELECT id, list_transform(list_zip({_dot(np.linalg.inv(sky.fk4_to_fk5(epoch)), place)}, {a}), lambda p: p[1] + p[2]) AS u FROM {source}"
    return f"SELECT id, {_dot(sky.newcomb(1950.0, equinox), 'list_transform(u, lambda c: c / sqrt(list_dot_product(u, u)))')} AS v FROM ({inner})"


PLACE_SQL = "degrees(atan2(v[2], v[1])) + CASE WHEN atan2(v[2], v[1]) < 0 THEN 360 ELSE 0 END AS ra, 90 - degrees(acos(v[3])) AS dec"


@query(SKY_SQL + f"SELECT id, round(ra, 5) AS ra, round(dec, 5) AS dec FROM (SELECT id, {PLACE_SQL} FROM ({fk4_sql(f'(ra - 125 * {_PM[0]})', f'(dec - 125 * {_PM[1]})', 1875.0, 1875.0, 'stars')}))")
def j2000_to_b1875(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sky.to_fk4(stars(spark, sf_dir).select("id", "ra", "dec"), "ra", "dec", 1875.0, 1875.0, *_PM)
    ra, dec = sky.turned_place("x", "y", "z")
    return p.select("id", _r(ra, 5, "ra"), _r(dec, 5, "dec"))


@query(SKY_SQL + """SELECT id, printf('%dh %dm %d.%ds', t // 36000 % 24, t // 600 % 60, t // 10 % 60, t % 10) AS ra_text, printf('%s%dd %d.%dm', CASE WHEN dec < 0 THEN '-' ELSE '+' END, u // 600, u // 10 % 60, u % 10) AS dec_text, ra <= 7 OR ra >= 357 AS near_zero
  FROM (SELECT *, round(ra * 2400)::BIGINT AS t, round(abs(dec) * 600)::BIGINT AS u FROM stars)""")
def sexagesimal_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars(spark, sf_dir).select("id", F.expr(sky.hms("ra")).alias("ra_text"), F.expr(sky.dms("dec")).alias("dec_text"), F.expr(sky.ra_window("ra", "2.0D", "5.0D")).alias("near_zero"))


_PAGE = "id, " + sky.page("id", 605, "100000") + " AS page_volume, " + sky.page_of_line("(id % 5000)") + " AS page_line"


@query("SELECT o_orderkey AS id, 605 * o_orderkey // 100000 + 1 AS page_volume, CASE WHEN o_orderkey % 5000 <= 52 THEN 1 ELSE (o_orderkey % 5000 - 53) // 70 + 2 END AS page_line FROM orders")
def page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars(spark, sf_dir).selectExpr(*_split(_PAGE))


_ZONES = "(SELECT n_nationkey AS zone, n_nationkey * 14.4D AS ra_lo, n_nationkey * 14.4D + 14.4D AS ra_hi, n_name AS name FROM nation)"


@query(SKY_SQL + f"SELECT s.id, z.name AS constellation FROM stars s JOIN {_ZONES} z ON s.ra >= z.ra_lo AND s.ra < z.ra_hi WHERE s.dec >= 0")
def constellation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join on a boundary table: bins of right ascension make it an equi-join with an exact filter."""
    zones = t(spark, sf_dir, "nation").selectExpr("n_nationkey * 14.4D AS ra_lo", "n_nationkey * 14.4D + 14.4D AS ra_hi", "n_name AS constellation")
    bins = zones.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ra_lo") / 15), F.floor(F.col("ra_hi") / 15))))
    found = stars(spark, sf_dir).filter("dec >= 0").withColumn("bin", F.floor(F.col("ra") / 15)).join(bins, "bin")
    return found.filter("ra >= ra_lo AND ra < ra_hi").select("id", "constellation")


# ---------------------------------------------------------------- spatial joins

_NEAREST = f"SELECT id, match_id, d2, mag FROM (SELECT a.id AS id, b.id AS match_id, {_D2} AS d2, a.mag AS mag, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS k FROM stars a JOIN twins b ON {_BAND(120.0)} AND {_D2} < {_H2(120.0)}) WHERE k = 1"


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.nearest(stars(spark, sf_dir), twins(spark, sf_dir), 120.0, ["id"], "id")


@query(SKY_SQL + f"SELECT id, match_id, round({sky.arcsec('d2')}, 3) AS dist FROM ({_NEAREST})")
def nearest_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select(F.col("l_id").alias("id"), F.col("r_id").alias("match_id"), _r("dist", 3, "dist"))


@query(SKY_SQL + f"SELECT count(*) AS n, round(sqrt(sum(dist * dist) / count(*)), 3) AS rmse FROM (SELECT {sky.arcsec('d2')} AS dist FROM ({_NEAREST}))")
def nearest_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(A.rmse("dist"), 3).alias("rmse"))


_EMB = "SELECT vec_id AS id, CAST(embedding[{0}] AS DOUBLE) AS a, CAST(embedding[{1}] AS DOUBLE) AS b, CAST(embedding[{2}] AS DOUBLE) AS c, label FROM embeddings"
_EMB_MAG = "CASE WHEN id % 11 = 0 THEN NULL ELSE 1.0D + (id % 30) / 10.0D END"
EMB_SQL = f"WITH points AS (SELECT id, a / n AS x, b / n AS y, c / n AS z, {_EMB_MAG} AS mag FROM (SELECT *, sqrt(a*a + b*b + c*c) AS n FROM ({_EMB.format(1, 2, 3)}) e) f WHERE n > 0) "
_WIDE = 7200.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("abc")])
    e = e.withColumn("n", F.sqrt(F.expr("a*a + b*b + c*c"))).filter("n > 0")
    return e.select("id", *[(F.col(a) / F.col("n")).alias(x) for a, x in zip("abc", "xyz")], F.expr(_EMB_MAG).alias("mag"))


_PAIRS = f"SELECT a.id AS id1, b.id AS id2, {sky.arcsec(_D2)} AS dist, a.mag AS l_mag, b.mag AS r_mag FROM points a JOIN points b ON a.id < b.id AND {_D2} < {_H2(_WIDE)}"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    ends = J.pairs_once(p, _WIDE).select(F.least("a", "b").alias("l_id"), F.greatest("a", "b").alias("r_id"), F.expr(sky.arcsec("d2")).alias("dist"))
    return ends.join(p.select(F.col("id").alias("l_id"), F.col("mag").alias("l_mag")), "l_id").join(p.select(F.col("id").alias("r_id"), F.col("mag").alias("r_mag")), "r_id")


@query(EMB_SQL + f"SELECT id1, id2, round(dist, 2) AS dist FROM ({_PAIRS})")
def pairs_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("l_id").alias("id1"), F.col("r_id").alias("id2"), _r("dist", 2, "dist"))


_COST = G.edge_cost("(dist / 24)", "l_mag", "r_mag")


@query(EMB_SQL + f"SELECT id1, id2, round({_COST}, 4) AS cost FROM ({_PAIRS}) WHERE l_mag IS NULL OR r_mag IS NULL OR abs(l_mag - r_mag) <= 3")
def likelihood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _pairs(spark, sf_dir).filter("l_mag IS NULL OR r_mag IS NULL OR abs(l_mag - r_mag) <= 3")
    return kept.select(F.col("l_id").alias("id1"), F.col("r_id").alias("id2"), _r(_COST, 4, "cost"))


_REACH = f"reach(a, b) AS (SELECT id1, id2 FROM ({_PAIRS}) UNION SELECT id2, id1 FROM ({_PAIRS}))"


@query(EMB_SQL.replace("WITH points", "WITH RECURSIVE points") + f", {_REACH}, walk(node, seen) AS (SELECT a, b FROM reach UNION SELECT w.node, r.b FROM walk w JOIN reach r ON r.a = w.seen) SELECT node, min(seen) AS component FROM (SELECT * FROM walk UNION SELECT a, a FROM reach) GROUP BY node")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _pairs(spark, sf_dir).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    labels = G.components(edges)
    roots = labels.select(F.col("least").alias("node"), "least").distinct()
    return labels.unionByName(roots).select("node", F.col("least").alias("component"))


@query(EMB_SQL.replace("WITH points", "WITH RECURSIVE points") + f", {_REACH}, walk(node, seen) AS (SELECT a, b FROM reach UNION SELECT w.node, r.b FROM walk w JOIN reach r ON r.a = w.seen) SELECT size, count(*) AS n FROM (SELECT component, count(*) AS size FROM (SELECT node, min(seen) AS component FROM (SELECT * FROM walk UNION SELECT a, a FROM reach) GROUP BY node) GROUP BY component) GROUP BY size")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.component_sizes(G.components(_pairs(spark, sf_dir).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))))


@query()
def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of stars and twins; no SQL, tested against brute force."""
    pairs = J.within(stars(spark, sf_dir), twins(spark, sf_dir), 300.0).withColumn("cost", F.expr(G.edge_cost()))
    return G.assign(pairs.selectExpr("l_id AS l", "r_id AS r", "cost")).selectExpr("l AS id", "r AS match_id", "round(cost, 4) AS cost")


_CLOSE = 3600.0
_NB = f"SELECT a.id, a.mag, b.id AS other, {_D2} AS d2 FROM stars a JOIN stars b ON a.id <> b.id AND {_BAND(_CLOSE)} AND {_D2} < {_H2(_CLOSE)}"


@query(SKY_SQL + f"SELECT id, count(*) AS n, round({sky.arcsec('min(d2)')}, 2) AS dist FROM ({_NB}) GROUP BY id")
def neighbour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.neighbour_counts(stars(spark, sf_dir), _CLOSE).select("id", "n", _r("dist", 2, "dist"))


@query(SKY_SQL + f", nb AS (SELECT id, count(*) AS n, min(other) AS other, min(d2) AS d2 FROM ({_NB}) GROUP BY id HAVING count(*) = 1 AND {sky.arcsec('min(d2)')} < 3000), p AS (SELECT a.id AS i, b.id AS j, x.mag AS mi, y.mag AS mj, {sky.arcsec('a.d2')} AS dist FROM nb a JOIN nb b ON a.other = b.id AND b.other = a.id AND a.id < b.id JOIN stars x ON x.id = a.id JOIN stars y ON y.id = b.id WHERE x.mag BETWEEN 3 AND 8 AND y.mag BETWEEN 3 AND 8) SELECT CASE WHEN mj < mi THEN j ELSE i END AS id1, CASE WHEN mj < mi THEN i ELSE j END AS id2, least(mi, mj) AS mag1, greatest(mi, mj) AS mag2, round(dist, 2) AS dist FROM p")
def isolated_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.isolated_doubles(stars(spark, sf_dir), _CLOSE, 3000.0).select("id1", "id2", "mag1", "mag2", _r("dist", 2, "dist"))


@query(SKY_SQL + f"SELECT id, match_id, mag FROM (SELECT a.id, b.id AS match_id, b.mag, row_number() OVER (PARTITION BY a.id ORDER BY b.mag, {_D2}, b.id) AS k FROM stars a JOIN twins b ON {_BAND(3600.0)} AND {_D2} < {_H2(3600.0)}) WHERE k = 1")
def brightest_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.brightest(stars(spark, sf_dir), twins(spark, sf_dir), 3600.0, "id", "id").select("id", F.col("match").alias("match_id"), "mag")


# ---------------------------------------------------------------- identifier joins

_L = "l_orderkey * 8 + l_linenumber"
#: a line item as an observation of its part: several observations share an identifier, each at its own place
_OBS = f"SELECT {_L} AS row_id, l_partkey AS number, CAST(l_suppkey % 10 AS INTEGER) AS zone, l_quantity AS q, 10.0D + l_quantity / 100.0D AS ra, l_tax * 100.0D AS dec, l_shipdate FROM lineitem"
_CAT = "SELECT p_partkey AS number, p_partkey AS part_row, 10.0D + (p_partkey % 50) / 100.0D AS ra, (p_partkey % 9) * 1.0D AS dec FROM part"
OBS_SQL = f"WITH obs AS ({_vec(_OBS)}), cat AS ({_vec(_CAT)}) "


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "lineitem").select(F.expr(_L).alias("row_id"), F.col("l_partkey").alias("number"), F.expr("CAST(l_suppkey % 10 AS INT)").alias("zone"), F.col("l_quantity").alias("q"), F.expr("10.0D + l_quantity / 100.0D").alias("ra"), F.expr("l_tax * 100.0D").alias("dec"))
    return sky.with_vector(o)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sky.with_vector(t(spark, sf_dir, "part").selectExpr("p_partkey AS number", "p_partkey AS part_row", "10.0D + (p_partkey % 50) / 100.0D AS ra", "(p_partkey % 9) * 1.0D AS dec"))


@query(OBS_SQL + f"SELECT part_row, candidates, row_id, round({sky.arcsec('d2')}, 1) AS dist FROM (SELECT a.part_row, b.row_id, {_D2} AS d2, count(*) OVER (PARTITION BY a.part_row) AS candidates, row_number() OVER (PARTITION BY a.part_row ORDER BY {_D2}, b.row_id) AS k FROM cat a JOIN obs b USING (number)) WHERE k = 1")
def id_join_nearest_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = J.id_nearest(catalogue(spark, sf_dir), observations(spark, sf_dir), ["number"], "part_row", "row_id")
    return best.select(F.col("l_part_row").alias("part_row"), "candidates", F.col("r_row_id").alias("row_id"), _r("dist", 1, "dist"))


_SEQ = f"SELECT l_partkey AS dm, {_L} AS line, l_quantity * 2.0D + l_linenumber AS dist FROM lineitem"
_GREEDY = f"e AS (SELECT * FROM (SELECT *, min(dist) OVER (PARTITION BY dm ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({_SEQ})) WHERE b IS NULL OR dist < b), g AS (SELECT dm, line, dist, dist > min(dist) OVER (PARTITION BY dm) AS discard FROM e)"


def _greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = t(spark, sf_dir, "lineitem").selectExpr("l_partkey AS dm", f"{_L} AS line", "l_quantity * 2.0D + l_linenumber AS dist")
    return J.keep_nearest_in_order(seq, "dm", "line", "dist")


@query(f"WITH {_GREEDY} SELECT * FROM g")
def greedy_running_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greedy(spark, sf_dir).select("dm", "line", "dist", "discard")


@query(f"WITH {_GREEDY} SELECT dm, count(*) - 1 AS others, count(*) FILTER (discard) AS discarded FROM g GROUP BY dm HAVING count(*) > 1")
def dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _greedy(spark, sf_dir).groupBy("dm").agg((F.count(F.lit(1)) - 1).alias("others"), F.count_if("discard").alias("discarded"))
    return g.filter("others > 0")


_AGK = "SELECT p_partkey AS agk, p_partkey AS number, CAST(p_size % 10 AS INTEGER) AS zone, 10.0D + (p_partkey % 50) / 100.0D AS ra, (p_partkey % 9) * 1.0D AS dec FROM part"


@query(f"WITH obs AS ({_vec(_OBS)}), agk AS ({_vec(_AGK)}), c AS (SELECT a.agk, a.zone AS z, b.zone AS bz, b.row_id, {_D2} AS d2, CASE b.zone - a.zone WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS o FROM agk a JOIN obs b ON a.number = b.number AND b.zone BETWEEN a.zone - 1 AND a.zone + 1) SELECT agk, row_id, round({sky.arcsec('d2')}, 1) AS dist, round({sky.arcsec('s')}, 1) AS same_zone_dist, bz <> z AS other_zone FROM (SELECT *, min(CASE WHEN o = 0 THEN d2 END) OVER (PARTITION BY agk) AS s, row_number() OVER (PARTITION BY agk ORDER BY d2, o, row_id) AS k FROM c) WHERE k = 1")
def adjacent_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    agk = sky.with_vector(t(spark, sf_dir, "part").selectExpr("p_partkey AS agk", "p_partkey AS number", "CAST(p_size % 10 AS INT) AS zone", "10.0D + (p_partkey % 50) / 100.0D AS ra", "(p_partkey % 9) * 1.0D AS dec"))
    obs = observations(spark, sf_dir).withColumnRenamed("row_id", "agk").select("agk", "number", "zone", "x", "y", "z")
    best = J.adjacent(agk, obs, "zone", "number", "agk")
    return best.select(F.col("l_agk").alias("agk"), F.col("r_agk").alias("row_id"), _r("dist", 1, "dist"), _r("same_zone_dist", 1, "same_zone_dist"), "other_zone")


_MAP = "SELECT o_orderkey AS line, o_custkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '4' WHEN 1 THEN '2' ELSE '' END AS code, o_custkey % 500 AS target_id, CASE o_orderkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '4' ELSE '' END AS target_code FROM orders"


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").selectExpr(*_split(_MAP[len("SELECT ") : -len(" FROM orders")]))


@query(f"SELECT line, CASE WHEN code = '4' THEN id ELSE target_id END AS source_id, CASE WHEN code = '4' THEN target_id ELSE id END AS target_id FROM ({_MAP}) WHERE (code = '4' AND target_code = '2') OR (code = '2' AND target_code = '4')")
def either_way_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.either_way(_mapping(spark, sf_dir), "4", "2")


@query(f"SELECT id, arg_max(target_id, line) AS target_id FROM (SELECT line, id % 700 AS id, line % 1000 AS target_id FROM ({_MAP})) GROUP BY id")
def last_writer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.last_writer(_mapping(spark, sf_dir).selectExpr("line", "id % 700 AS id", "line % 1000 AS target_id"), "id", "target_id")


@query(f"WITH a AS (SELECT id, arg_max(target_id, line) AS t1 FROM (SELECT line, id, line % 1000 AS target_id FROM ({_MAP}) WHERE code = '4') GROUP BY id), b AS (SELECT id, arg_max(target_id, line) AS t2 FROM (SELECT line, id, line % 998 AS target_id FROM ({_MAP}) WHERE code = '2') GROUP BY id) SELECT a.id, t1, t2 FROM a LEFT JOIN b USING (id) WHERE t2 IS NULL OR t1 <> t2")
def mapping_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapping(spark, sf_dir)
    a = J.last_writer(m.filter("code = '4'").selectExpr("line", "id", "line % 1000 AS t1"), "id", "t1")
    b = J.last_writer(m.filter("code = '2'").selectExpr("line", "id", "line % 998 AS t2"), "id", "t2")
    return a.join(b, "id", "left").filter("t2 IS NULL OR t1 <> t2")


@query("SELECT hour, number, min(line) AS line, count(*) AS n FROM (SELECT o_orderkey AS line, o_orderkey % 24 AS hour, o_custkey % 300 AS number FROM orders) GROUP BY hour, number")
def zc_first_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS line", "o_orderkey % 24 AS hour", "o_custkey % 300 AS number")
    return J.first_registered(rows, ["hour", "number"], ["line"])


# ---------------------------------------------------------------- references

_REF = "CASE id % 6 WHEN 0 THEN concat('L. ', cast(o_custkey AS varchar)) WHEN 1 THEN concat('Ll. ', cast(o_custkey AS varchar)) WHEN 2 THEN concat('(OA. ', cast(o_custkey AS varchar), ')') WHEN 3 THEN '' WHEN 4 THEN concat('ZC. ', cast(o_custkey AS varchar)) ELSE concat('B. ', cast(o_custkey AS varchar)) END"
_CATS = {"L.": "lacaille", "Ll.": "lalande", "ZC.": "zc", "B.": "brisbane"}
_CASE = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CATS.items()) + " END"
_REFS = f"refs AS (SELECT id, x, y, z, {_CASE} AS cat, num FROM (SELECT *, regexp_extract(ref, '^([A-Za-z]+\\.) *([0-9]+)$', 1) AS p, TRY_CAST(regexp_extract(ref, '^([A-Za-z]+\\.) *([0-9]+)$', 2) AS BIGINT) AS num FROM (SELECT *, {_REF} AS ref FROM stars) s) s2 WHERE ref <> '' AND ref NOT LIKE '%(%')"
_TARGETS = "targets AS (SELECT CASE id % 4 WHEN 0 THEN 'lacaille' WHEN 1 THEN 'lalande' WHEN 2 THEN 'zc' ELSE 'brisbane' END AS cat, o_custkey AS num, id AS target_id, x, y, z FROM stars)"


def _refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = stars(spark, sf_dir)
    refs = ocr.references(s.withColumn("ref", F.expr(_REF.replace("varchar", "string"))), "ref", _CATS).select("id", "x", "y", "z", "cat", "num")
    targets = s.selectExpr("CASE id % 4 WHEN 0 THEN 'lacaille' WHEN 1 THEN 'lalande' WHEN 2 THEN 'zc' ELSE 'brisbane' END AS cat", "o_custkey AS num", "id AS target_id", "x", "y", "z")
    return refs, targets


@query(SKY_SQL + f", {_REFS}, {_TARGETS} SELECT a.id, a.cat, a.num, b.target_id, CASE WHEN b.target_id IS NULL THEN 'missing' WHEN {sky.arcsec(_D2)} > 120 THEN 'far' ELSE 'ok' END AS status FROM refs a LEFT JOIN targets b ON a.cat = b.cat AND a.num = b.num")
def ref_dispatch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, targets = _refs(spark, sf_dir)
    a, b = refs.alias("a"), targets.alias("b")
    dist = sky.arcsec(sky.chord_squared("a.", "b."))
    return a.join(b, ["cat", "num"], "left").select("a.id", "cat", "num", "target_id", F.expr(f"CASE WHEN target_id IS NULL THEN 'missing' WHEN {dist} > 120 THEN 'far' ELSE 'ok' END").alias("status"))


@query(SKY_SQL + f", {_REFS}, {_TARGETS} SELECT a.id, min(b.target_id) AS target_id FROM refs a JOIN targets b ON a.cat = b.cat AND a.num = b.num GROUP BY a.id")
def ref_break_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, targets = _refs(spark, sf_dir)
    return refs.select("id", "cat", "num").join(targets.select("cat", "num", "target_id"), ["cat", "num"]).groupBy("id").agg(F.min("target_id").alias("target_id"))


@query("SELECT a.o_orderkey AS id, a.h AS hour, a.n AS number, count(b.o_orderkey) AS hits FROM (SELECT o_orderkey, o_orderkey % 24 AS h, o_custkey AS n FROM orders) a LEFT JOIN (SELECT o_orderkey, (o_orderkey + 1) % 24 AS h, o_custkey AS n FROM orders) b ON a.h = b.h AND a.n = b.n GROUP BY ALL")
def ref_hour_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    a = o.selectExpr("o_orderkey AS id", "o_orderkey % 24 AS hour", "o_custkey AS number")
    b = o.selectExpr("(o_orderkey + 1) % 24 AS hour", "o_custkey AS number").groupBy("hour", "number").agg(F.count(F.lit(1)).alias("hits"))
    return a.join(b, ["hour", "number"], "left").select("id", "hour", "number", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("SELECT o.o_orderkey AS id, CASE WHEN c.c_custkey IS NULL THEN 'absent' WHEN abs(c.c_nationkey - o.o_orderkey % 25) = 0 THEN 'match' WHEN abs(c.c_nationkey - o.o_orderkey % 25) = 1 THEN 'note' ELSE 'mismatch' END AS verdict FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def ref_value_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left")
    gap = "abs(c_nationkey - o_orderkey % 25)"
    return o.selectExpr("o_orderkey AS id", f"CASE WHEN c_nationkey IS NULL THEN 'absent' WHEN {gap} = 0 THEN 'match' WHEN {gap} = 1 THEN 'note' ELSE 'mismatch' END AS verdict")


@query(SKY_SQL + f"SELECT id FROM stars WHERE id NOT IN (SELECT a.id FROM stars a JOIN twins b ON b.id % 3 <> 0 AND {_BAND(120.0)} AND {_D2} < {_H2(120.0)})")
def alone_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stars(spark, sf_dir)
    matched = J.within(s.select("id", "x", "y", "z"), twins(spark, sf_dir).filter("id % 3 <> 0").select("id", "x", "y", "z"), 120.0).select(F.col("l_id").alias("id"))
    return s.join(matched, "id", "left_anti").select("id")


_CAS = "CASE WHEN dist < 10.1 AND id % 5 <> 0 THEN 'ppm' WHEN id % 9 = 0 THEN 'unidentified' WHEN dist < 60.1 THEN 'dm' WHEN dec BETWEEN -23 AND -1 AND dist < 90.1 THEN 'sd' WHEN dec <= -18 THEN 'cpd' END"


@query(SKY_SQL + f", m AS (SELECT s.id, s.dec, {sky.arcsec('n.d2')} AS dist, n.match_id FROM stars s LEFT JOIN ({_NEAREST}) n ON n.id = s.id) SELECT id, {_CAS} AS source, CASE {_CAS} WHEN 'ppm' THEN concat('P', cast(match_id AS varchar)) WHEN 'unidentified' THEN concat('U', cast(id AS varchar)) WHEN 'dm' THEN concat('D', cast(match_id AS varchar)) WHEN 'sd' THEN concat('S', cast(match_id AS varchar)) WHEN 'cpd' THEN concat('C', cast(id AS varchar)) END AS name FROM m")
def priority_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stars(spark, sf_dir)
    m = s.join(_nearest(spark, sf_dir).select(F.col("l_id").alias("id"), F.col("r_id").alias("match_id"), "dist"), "id", "left")
    e = F.expr
    levels = [
        ("ppm", e("coalesce(dist < 10.1, false)"), e("CASE WHEN id % 5 <> 0 THEN concat('P', match_id) END")),
        ("unidentified", e("id % 9 = 0"), e("concat('U', id)")),
        ("dm", e("coalesce(dist < 60.1, false)"), e("concat('D', match_id)")),
        ("sd", e("dec BETWEEN -23 AND -1 AND coalesce(dist < 90.1, false)"), e("concat('S', match_id)")),
        ("cpd", e("dec <= -18"), e("concat('C', id)")),
    ]
    return J.cascade(m, levels).select("id", "source", "name")


@query("SELECT c_custkey, array_to_string(list_slice(list(label ORDER BY rank), 1, 3), ';') AS notes, count(*) AS n FROM (SELECT o_custkey AS c_custkey, label, rank FROM (SELECT o_custkey, o_orderpriority AS label, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1) GROUP BY c_custkey")
def top_k_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey", "o_orderpriority AS label", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank", "o_totalprice", "o_orderkey")
    best = o.groupBy("c_custkey", "label").agg(F.min(F.struct("o_totalprice", "o_orderkey", "rank")).alias("b"))
    lists = best.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("b.rank").alias("rank"), "label"))).alias("a"), F.count(F.lit(1)).alias("n"))
    return lists.select("c_custkey", F.array_join(F.slice("a", 1, 3)["label"], ";").alias("notes"), "n")


# ---------------------------------------------------------------- versions, classes, thresholds

_DIFF = "CASE WHEN abs(a.ra - b.ra) > 1e-9 THEN 'ra' WHEN abs(a.dec - b.dec) > 0.02 THEN 'dec' WHEN abs(a.mag - b.mag) > 0.15 THEN 'mag' END"


@query(SKY_SQL + f"SELECT a.id, {_DIFF} AS difference FROM stars a JOIN twins b ON a.id = b.id WHERE {_DIFF} IS NOT NULL")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = stars(spark, sf_dir).alias("a").join(twins(spark, sf_dir).alias("b"), F.expr("a.id = b.id"))
    return both.select("a.id", F.expr(_DIFF).alias("difference")).filter("difference IS NOT NULL")


_STATUS = "CASE WHEN dist IS NULL THEN 'alone' WHEN dist >= 100.1 THEN 'drop' WHEN dist >= 60.1 THEN 'far' WHEN mag IS NULL THEN 'mag skipped' WHEN abs(mag - match_mag) > 0.2 THEN 'mag bad' ELSE 'good' END"
_CLASSED = f"c AS (SELECT id, {_STATUS} AS status, dist FROM (SELECT n.id, n.mag, {sky.arcsec('n.d2')} AS dist, tw.mag AS match_mag FROM ({_NEAREST}) n JOIN twins tw ON tw.id = n.match_id))"


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).selectExpr("l_id AS id", "l_mag AS mag", "r_mag AS match_mag", "dist").select("id", F.expr(_STATUS).alias("status"), "dist")


@query(SKY_SQL + f", {_CLASSED} SELECT id, status FROM c")
def classify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).select("id", "status")


@query(SKY_SQL + f", {_CLASSED} SELECT status, count(*) AS n, round(sqrt(sum(dist*dist)/count(*)), 3) AS rmse FROM c GROUP BY status")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(A.rmse("dist"), 3).alias("rmse"))


_VOL = mags.volume("CAST(floor(abs(dec)) AS INTEGER)")


@query(SKY_SQL + """SELECT v.volume::INTEGER AS volume, count(*) AS n, min(id) AS first_id, count(*) - count(mag) AS unknown FROM stars LEFT JOIN (VALUES (1, 22, 32), (2, 32, 42), (3, 42, 52), (4, 52, 62), (5, 62, 91)) v(volume, lo, hi) ON -dec >= lo AND -dec < hi WHERE dec < 0 GROUP BY 1""")
def volume_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stars(spark, sf_dir).filter("dec < 0").withColumn("volume", F.expr(_VOL))
    return v.groupBy("volume").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.count_if(F.col("mag").isNull()).alias("unknown"))


_CAUSES = ("CASE WHEN mag IS NULL THEN 'no magnitude' END", "CASE WHEN dec > -22 THEN 'outside coverage' END", "CASE WHEN id % 60 = 0 THEN 'zero seconds' END", "CASE WHEN id % 43 = 0 THEN 'nebula' END")


@query(SKY_SQL + """SELECT id, array_to_string(causes, ', ') AS causes FROM (SELECT id, list_filter([CASE WHEN id % 11 = 0 THEN 'no magnitude' END, CASE WHEN dec > -22 THEN 'outside coverage' END, CASE WHEN id % 60 = 0 THEN 'zero seconds' END, CASE WHEN id % 43 = 0 THEN 'nebula' END], lambda c: c IS NOT NULL) AS causes FROM stars) WHERE len(causes) > 0""")
def log_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars(spark, sf_dir).select("id", F.concat_ws(", ", *map(F.expr, _CAUSES)).alias("causes")).filter("causes <> ''")


@query("SELECT o_orderkey, k AS line FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k % 3 = 1")
def every_third_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.numbered(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], by=["o_orderpriority"])
    return rows.filter("line % 3 = 1").select("o_orderkey", F.col("line").cast("int").alias("line"))


_PRINTED = "3.07224D + 1.33695D * sin(radians(ra)) * tan(radians(dec)) / 15.0D"
_PDEC = "20.05D * cos(radians(ra))"


@query(SKY_SQL + "SELECT id, round((id % 41 - 20) / 1000.0, 4)::DOUBLE AS residual FROM stars WHERE dec > -80 AND dec < 80 AND abs(id % 41 - 20) >= 10")
def precession_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stars(spark, sf_dir).filter("abs(dec) < 80").withColumn("printed", F.expr(f"{_PRINTED} + ((id % 41) - 20) / 1000.0D"))
    return s.filter(f"abs(printed - ({_PRINTED})) > 0.0099 AND abs(printed) > 1e-8").select("id", _r(f"printed - ({_PRINTED})", 4, "residual"))


@query(SKY_SQL + f"SELECT CAST(floor(ra / 15) AS INTEGER) AS hour, count(*) FILTER (abs(((id % 31) - 15) / 100.0D) > 0.099) AS off, count(*) AS n, round(sum({_PDEC}), 3) AS motion FROM stars GROUP BY 1")
def precession_dec_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stars(spark, sf_dir).withColumn("hour", F.expr("CAST(floor(ra / 15) AS INT)"))
    return s.groupBy("hour").agg(F.count_if(F.expr("abs(((id % 31) - 15) / 100.0D) > 0.099")).alias("off"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.expr(_PDEC)), 3).alias("motion"))


# ---------------------------------------------------------------- magnitudes, histograms, fits

#: Coefficients a + b m + c m^2 of five volumes of this synthetic sky; the printed volumes' are in functions/mags.py (query volume_scales).
_COEF = {1: (0.2, 0.98, 0.001), 2: (0.25, 0.97, 0.002), 3: (0.01, 1.0, 0.0), 4: (0.0, 1.01, -0.001), 5: (-0.01, 1.0, 0.0005)}
_V = mags.visual("(2.0D + (l_partkey % 90) / 10.0D)", "(CASE WHEN l_suppkey % 6 = 0 THEN 0.0D ELSE 2.0D + (l_suppkey % 80) / 10.0D END)")
_ZONE = "CAST(22 + l_orderkey % 60 AS INTEGER)"


@query("""WITH k(lo, hi, a, b, c) AS (VALUES (22, 31, 0.2, 0.98, 0.001), (32, 41, 0.25, 0.97, 0.002), (42, 51, 0.01, 1.0, 0.0), (52, 61, 0.0, 1.01, -0.001), (62, 90, -0.01, 1.0, 0.0005)),
  r AS (SELECT *, CASE WHEN l_suppkey % 6 = 0 THEN b ELSE 1.09::DOUBLE * v0 - 0.09::DOUBLE * b END AS v FROM (SELECT *, 2.0::DOUBLE + (l_partkey % 90) / 10.0::DOUBLE AS b, 2.0::DOUBLE + (l_suppkey % 80) / 10.0::DOUBLE AS v0 FROM lineitem))
  SELECT l_orderkey * 8 + l_linenumber AS row_id, round(v + 1e-9, 4) AS v, round(k.a::DOUBLE + k.b::DOUBLE * v + k.c::DOUBLE * v * v + 1e-9, 4) AS cd, round(17.37::DOUBLE - 2.5::DOUBLE * log10(CASE WHEN l_extendedprice > 100 THEN l_extendedprice ELSE 100 END) + 1e-9, 4) AS inst FROM r JOIN k ON 22 + l_orderkey % 60 BETWEEN lo AND hi""")
def magnitude_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select(F.expr(_L).alias("row_id"), _r(_V + " + 1e-9", 4, "v"), _r(mags.scale(f"({_V})", _ZONE, _COEF) + " + 1e-9", 4, "cd"), _r(mags.instrumental("l_extendedprice") + " + 1e-9", 4, "inst"))


_HX, _HY = "(2.0D + (l_partkey % 1237) / 200.0D)", "(2.2D + (l_partkey % 1237) / 210.0D + l_discount)"
_HIST = f"h AS (SELECT l_returnflag AS tome, CAST(floor({_HX} * 10 + 0.5) AS INTEGER) AS bin, avg({_HY}) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5)"


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tome"), F.expr(_HX).alias("x"), F.expr(_HY).alias("y"))
    b = F.floor(F.col("x") * 10 + 0.5).cast("int")
    return rows.withColumn("bin", b).groupBy("tome", "bin").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query(f"WITH h AS (SELECT CAST(floor({_HX} * 10 + 0.5) AS INTEGER) AS bin, avg({_HY}) AS mean, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 5) SELECT bin, round(mean, 6) AS mean, n FROM h WHERE bin BETWEEN 0 AND 199")
def hist_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(F.expr(_HX).alias("x"), F.expr(_HY).alias("y"))
    return A.histogram(rows, "x", "y", 5).select("bin", _r("mean", 6, "mean"), "n")


_PTS = f"p AS (SELECT tome, bin / 10.0D AS x, mean AS y, log10(n) AS w FROM h)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist(spark, sf_dir).selectExpr("tome", "bin / 10.0D AS x", "mean AS y", "log10(n) AS w")


@query(f"WITH {_HIST}, {_PTS}, s AS (SELECT tome, count(*) AS n, sum(w) AS w, sum(w*x) AS wx, sum(w*y) AS wy, sum(w*x*x) AS wxx, sum(w*x*y) AS wxy FROM p GROUP BY tome HAVING count(*) > 5) SELECT tome, n, round((w*wxy - wx*wy) / (w*wxx - wx*wx), 5) AS slope, round((wy - wx*(w*wxy - wx*wy) / (w*wxx - wx*wx)) / w, 5) AS intercept, round((wy - wx) / w, 5) AS offset_mag FROM s")
def fit_constant_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.fit_line(_points(spark, sf_dir), "x", "y", "w", ["tome"])
    return f.select("tome", "n", _r("slope", 5, "slope"), _r("intercept", 5, "intercept"), _r("offset", 5, "offset_mag"))


@query(f"WITH {_HIST}, {_PTS}, s AS (SELECT tome, sum(w*y) AS wy, sum(w*x) AS wx, sum(w) AS w FROM p GROUP BY tome) SELECT p.tome, round(sqrt(avg(pow(p.y - p.x - (s.wy - s.wx) / s.w, 2))), 5) AS rmse, round(avg(abs(p.y - p.x - (s.wy - s.wx) / s.w) / p.y * 100), 4) AS mape FROM p JOIN s ON s.tome = p.tome GROUP BY p.tome")
def fit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    e = p.join(A.fit_line(p, "x", "y", "w", ["tome"]).select("tome", "offset"), "tome").withColumn("e", F.expr("y - x - offset"))
    return e.groupBy("tome").agg(F.round(A.rmse("e"), 5).alias("rmse"), F.round(F.avg(F.expr("abs(e) / y * 100")), 4).alias("mape"))


def _cramer(k: int | None) -> str:
    base = ["s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4"]
    m = base if k is None else [f"r{i // 3}" if i % 3 == k else v for i, v in enumerate(base)]
    return f"({m[0]}*({m[4]}*{m[8]}-{m[5]}*{m[7]}) - {m[1]}*({m[3]}*{m[8]}-{m[5]}*{m[6]}) + {m[2]}*({m[3]}*{m[7]}-{m[4]}*{m[6]}))"


@query(f"WITH {_HIST}, {_PTS}, q AS (SELECT p.*, x - avg(x) OVER (PARTITION BY tome) AS t FROM p), s AS (SELECT tome, count(*) AS n, " + ", ".join(f"sum(w*pow(t,{k})) AS s{k}" for k in range(5)) + ", " + ", ".join(f"sum(w*y*pow(t,{k})) AS r{k}" for k in range(3)) + f" FROM q GROUP BY tome HAVING count(*) > 5) SELECT tome, n, round({_cramer(0)} / {_cramer(None)}, 4) AS a, round({_cramer(1)} / {_cramer(None)}, 4) AS b, round({_cramer(2)} / {_cramer(None)}, 4) AS c FROM s")
def fit_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.fit_quadratic(_points(spark, sf_dir), "x", "y", "w", ["tome"])
    return f.select("tome", "n", *[_r(c, 4, c) for c in "abc"])


@query(f"SELECT l_returnflag AS tome, round(regr_slope({_HY}, {_HX}), 5) AS slope, round(regr_intercept({_HY}, {_HX}), 5) AS intercept, count(*) AS n FROM lineitem WHERE {_HX} > 3 GROUP BY 1")
def ensemble_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tome"), F.expr(_HX).alias("x"), F.expr(_HY).alias("y")).filter("x > 3")
    return rows.groupBy("tome").agg(F.round(F.regr_slope("y", "x"), 5).alias("slope"), F.round(F.regr_intercept("y", "x"), 5).alias("intercept"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- ordered folds

_FOLD = f"SELECT l_partkey AS k, {_L} AS line, CASE WHEN l_linenumber = 2 THEN 0.0D ELSE l_quantity END AS mag, l_extendedprice AS dist FROM lineitem"
_BETTER = "CASE WHEN c.mag > 0 AND x.mag > 0 AND c.mag <> x.mag THEN x.mag < c.mag ELSE x.dist < c.dist END"


def _brighter_or_nearer(c: dict, x: dict) -> bool:
    if c["mag"] > 0 and x["mag"] > 0 and c["mag"] != x["mag"]:
        return x["mag"] < c["mag"]
    return x["dist"] < c["dist"]


def _duck_fold(better: str) -> str:
    return f"SELECT k, f.line AS line, f.mag AS mag, f.dist AS dist FROM (SELECT k, list_reduce(list({{'line': line, 'mag': mag, 'dist': dist}} ORDER BY line), lambda c, x: CASE WHEN {better} THEN x ELSE c END) AS f FROM ({_FOLD}) GROUP BY k)"


def _fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").selectExpr(*_split(_FOLD[len("SELECT ") : -len(" FROM lineitem")]))


@query(_duck_fold(_BETTER))
def keep_nearest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.fold(_fold_rows(spark, sf_dir), "k", "line", ["mag", "dist"], _brighter_or_nearer)


@query(_duck_fold("x.dist < c.dist - 1000"))
def hysteresis_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.fold(_fold_rows(spark, sf_dir), "k", "line", ["mag", "dist"], lambda c, x: x["dist"] < c["dist"] - 1000)


# ---------------------------------------------------------------- file-order windows

_EV = "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS mag FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").selectExpr(*_split(_EV[len("SELECT ") : -len(" FROM events")]))


@query(f"SELECT event_id, last_value(mag IGNORE NULLS) OVER w AS carried, coalesce(max(CASE WHEN event_id % 49 = 0 THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS second_part FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = {"carried": (F.col("mag"), True), "second": (F.expr("CASE WHEN event_id % 49 = 0 THEN true END"), False)}
    rows = order.all_last_known(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], states)
    return rows.select("event_id", "carried", F.coalesce("second", F.lit(False)).alias("second_part"))


@query("SELECT user_id, event_id, prev FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL AND event_id - prev > 50")
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.last_known(t(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], F.col("event_id"), "prev", False)
    return rows.filter("event_id - prev > 50").select("user_id", "event_id", "prev")


_RANGES = "SELECT event_id % 50 AS page, (event_id // 50) * 10 AS lo, (event_id // 50) * 10 + 9 + (CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS hi FROM events, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR event_id % 13 = 3"


@query(f"WITH r AS ({_RANGES}), s AS (SELECT *, CASE WHEN lo = lag(hi) OVER (PARTITION BY page ORDER BY lo, hi) + 1 THEN 0 ELSE 1 END AS st FROM r), c AS (SELECT *, sum(st) OVER (PARTITION BY page ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS chain FROM s), g AS (SELECT page, chain, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM c GROUP BY page, chain) SELECT page, n, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, lo) AS k FROM g) WHERE k = 1")
def longest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events")
    events = events.unionByName(events.filter("event_id % 13 = 3"))  # ranges that were read twice
    r = events.selectExpr("event_id % 50 AS page", "(event_id div 50) * 10 AS lo", "(event_id div 50) * 10 + 9 + (CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS hi")
    return A.longest_chain(r, "page")


@query("SELECT event_id, NOT (coalesce(p = event_type, false) AND coalesce(n = event_type, false)) AS visible FROM (SELECT event_id, event_type, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def run_blanking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_visible(t(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type", "visible").select("event_id", "visible")


# ---------------------------------------------------------------- transcriptions

_VOTES = "SELECT user_id AS star, event_id AS run, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE event_type END AS reading FROM events"


@query(f"SELECT star, reading, c AS votes, c >= 2 AS certain FROM (SELECT *, row_number() OVER (PARTITION BY star ORDER BY c DESC, f, reading DESC) AS k FROM (SELECT star, reading, count(DISTINCT run) AS c, min(run) AS f FROM ({_VOTES}) GROUP BY star, reading)) WHERE k = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = t(spark, sf_dir, "events").selectExpr("user_id AS star", "event_id AS run", "CASE WHEN event_id % 4 = 0 THEN 'x' ELSE event_type END AS reading")
    return A.majority(votes, ["star"], "reading", "run")


@query("WITH b AS (SELECT p_partkey AS id, CAST(p_partkey % 1000 AS VARCHAR) AS txt, p_partkey % 100 * 5 AS lo, p_partkey % 100 * 5 + 20 AS hi FROM part), v AS (SELECT DISTINCT id, lo, hi, CAST(concat(substr(txt, 1, i - 1), CAST(d AS VARCHAR), substr(txt, i + 1)) AS INTEGER) AS n FROM (SELECT *, unnest(range(1, length(txt) + 1)) AS i FROM b) CROSS JOIN (SELECT unnest(range(0, 10)) AS d)) SELECT id, min(n) AS repaired FROM v WHERE n BETWEEN lo AND hi GROUP BY id HAVING count(*) = 1")
def digit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_partkey % 1000 AS STRING) AS txt", "p_partkey % 100 * 5 AS lo", "p_partkey % 100 * 5 + 20 AS hi")
    return rows.select("id", ocr.repair("txt", "lo", "hi").alias("repaired")).filter("repaired IS NOT NULL")


@query("WITH a AS (SELECT DISTINCT l_partkey AS n FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_partkey AS n FROM lineitem WHERE l_linenumber = 2) SELECT n, 'missing' AS side FROM (SELECT n FROM a EXCEPT SELECT n FROM b) UNION ALL SELECT n, 'extra' FROM (SELECT n FROM b EXCEPT SELECT n FROM a)")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    a, b = (li.filter(f"l_linenumber = {k}").select(F.col("l_partkey").alias("n")).distinct() for k in (1, 2))
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


@query("SELECT l_partkey AS n, bool_and(l_tax > 0.04) AS uncertain FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_partkey")
def certain_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_partkey").alias("n")).agg(F.bool_and(F.col("l_tax") > 0.04).alias("uncertain"))


_NAME = "CASE o_orderkey % 4 WHEN 0 THEN concat('CD -', cast(22 + o_orderkey % 60 AS varchar), chr(176), cast(o_custkey AS varchar)) WHEN 1 THEN concat(cast(o_custkey % 300 AS varchar), 'G Sgr') WHEN 2 THEN concat('BD +', cast(o_orderkey % 20 AS varchar), chr(176), cast(o_custkey AS varchar)) ELSE concat('  alp   Cen  ', cast(o_orderkey AS varchar)) END"


@query(f"SELECT o_orderkey AS id, ltrim(regexp_replace({_NAME}, ' +', ' ', 'g')) AS name, length(ltrim(regexp_replace({_NAME}, ' +', ' ', 'g'))) AS chars, strlen(ltrim(regexp_replace({_NAME}, ' +', ' ', 'g'))) AS bytes, TRY_CAST(regexp_extract({_NAME}, '([0-9]+)$', 1) AS BIGINT) AS trailing FROM orders")
def name_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _NAME.replace("varchar", "string")
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(name).alias("raw")).withColumn("name", ocr.squeeze("raw"))
    return rows.select("id", "name", F.length("name").cast("long").alias("chars"), F.octet_length("name").cast("long").alias("bytes"), F.regexp_extract("raw", "([0-9]+)$", 1).try_cast("long").alias("trailing"))


# ---------------------------------------------------------------- unions, semi-joins, sinks

@query("SELECT source, count(*) AS n, min(k) AS first_key FROM (SELECT 0 AS source, s_suppkey AS k FROM supplier UNION ALL SELECT 1, c_custkey FROM customer UNION ALL SELECT 2, p_partkey FROM part) GROUP BY source")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplements before main tables: a source number keeps their order."""
    parts = [t(spark, sf_dir, n).select(F.lit(i).alias("source"), F.col(k).alias("k")) for i, (n, k) in enumerate((("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key"))


@query("SELECT o.o_orderkey AS segment FROM orders o JOIN customer a ON a.c_custkey = o.o_custkey AND a.c_acctbal > 0 JOIN customer b ON b.c_custkey = o.o_custkey % 100 + 1 AND b.c_acctbal > 0")
def both_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure segments whose two stars are both in view."""
    view = t(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    o = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS segment", "o_custkey AS a", "o_custkey % 100 + 1 AS b")
    return o.join(view.withColumnRenamed("c_custkey", "a"), "a").join(view.withColumnRenamed("c_custkey", "b"), "b").select("segment")


@query(SKY_SQL + f"SELECT 'ppm' AS target, concat('PPM ', cast(id AS varchar)) AS index2, printf('%.1f', coalesce(mag, 0.0)) AS mag FROM stars WHERE id > 0 UNION ALL SELECT 'sao', concat('SAO ', cast(id % 1000 AS varchar)), printf('%.1f', coalesce(mag, 0.0)) FROM stars WHERE id % 1000 > 500 UNION ALL SELECT 'hd', concat('HD ', cast(id % 800 AS varchar)), printf('%.1f', coalesce(mag, 0.0)) FROM stars WHERE id % 800 > 600")
def triple_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.sources import sinks

    rows = stars(spark, sf_dir).selectExpr("id", "CASE WHEN id % 1000 > 500 THEN id % 1000 ELSE 0 END AS sao", "CASE WHEN id % 800 > 600 THEN id % 800 ELSE 0 END AS hd", "coalesce(mag, 0.0D) AS mag")
    return sinks.cross_rows(rows, {"ppm": "id", "sao": "sao", "hd": "hd"}, "mag")


from skyloom.plans import records, reports, stages  # noqa: E402,F401  register their queries
