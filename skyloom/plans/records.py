"""Named queries over lists, pages and magnitude scales. Their SQL is written from the rows that the lines are made of, not from the readers' rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import mags
from skyloom.operators import checks, ocr
from skyloom.plans.catalog import query, t
from skyloom.sources import lists

_L = "l_orderkey * 10 + l_linenumber"


@query("""
WITH k(lo, hi, a, b, c) AS (VALUES (-31, -22, -0.157169, 1.188316, -0.022130), (-41, -32, -1.517044, 1.595675, -0.050674), (-51, -42, -4.903298, 2.435433, -0.098302), (-61, -52, -1.347719, 1.513742, -0.040125), (-999, -62, -4.814060, 2.342925, -0.087990)),
g(lo, hi, a, b, c) AS (VALUES (-31, -22, -8.955, 3.221, -0.132), (-41, -32, -4.874, 2.084, -0.055), (-51, -42, -1.302, 1.163, 0.0), (-61, -52, -5.647, 2.384, -0.083), (-999, -62, 0.154, 0.981, 0.0)),
r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, 10 - l_orderkey % 100 AS decl, CAST(1 + (l_partkey % 110) / 10.0 AS DOUBLE) AS m FROM lineitem)
SELECT row_id, round(coalesce(CAST(k.a AS DOUBLE) + CAST(k.b AS DOUBLE) * m + CAST(k.c AS DOUBLE) * m * m, 0.441147::DOUBLE + 1.699235::DOUBLE * m - 0.079943::DOUBLE * m * m) + 1e-9, 4) AS cd,
  round(CAST(g.a AS DOUBLE) + CAST(g.b AS DOUBLE) * m + CAST(g.c AS DOUBLE) * m * m + 1e-9, 4) AS v, round(CASE WHEN m > 3 THEN -5.003::DOUBLE + 2.305::DOUBLE * m - 0.085::DOUBLE * m * m ELSE m END + 1e-9, 4) AS gc_v
FROM r LEFT JOIN k ON decl BETWEEN k.lo AND k.hi LEFT JOIN g ON decl BETWEEN g.lo AND g.hi
""")
def volume_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed volumes' scales: V to CD (BD's outside), CD to V (NULL outside), GC to V (the same up to 3.0)."""
    rows = t(spark, sf_dir, "lineitem").selectExpr(f"{_L} AS row_id", "10 - l_orderkey % 100 AS decl", "1.0D + (l_partkey % 110) / 10.0D AS m")
    r = lambda e, name: F.expr(f"round({e} + 1e-9D, 4)").alias(name)
    return rows.select("row_id", r(mags.v_to_cd("m", "decl"), "cd"), r(mags.cd_to_v("m", "decl"), "v"), r(mags.gc_to_v("m"), "gc_v"))


_REFERENCE = """CASE o_orderkey % 8 WHEN 0 THEN concat('LI. ', cast(o_custkey as string), ' seq.') WHEN 1 THEN concat('L1.', cast(o_custkey as string)) WHEN 2 THEN concat('0A.  ', cast(o_custkey as string), ', dup')
 WHEN 3 THEN concat(' Z. C. ', cast(o_custkey as string)) WHEN 4 THEN concat('W.B.', cast(o_custkey as string)) WHEN 5 THEN concat('Melb. I. ', cast(o_custkey as string)) WHEN 6 THEN concat('O. A. ', cast(o_custkey as string), ',Dpl') ELSE NULL END"""


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 7 THEN '' ELSE ['Ll. ', 'Ll. ', 'OA. ', 'ZC. ', 'WB. ', 'Melb.I. ', 'OA. '][o_orderkey % 8 + 1] || o_custkey || CASE WHEN o_orderkey % 8 = 6 THEN ' Dpl' ELSE '' END END AS ref FROM orders")
def ref_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_REFERENCE).alias("raw")).select("id", ocr.clean("raw").alias("ref"))


_A, _B, _C = ("cast(o_orderkey % 900 as string)", "cast(o_custkey % 900 as string)", "cast(o_orderkey % 77 as string)")
_FOOT = f"""concat(CASE o_orderkey % 4 WHEN 0 THEN concat('Dpl: ', {_A}, ', ', {_B}, ' p. ', {_C}) WHEN 1 THEN concat('olor Nº. ', {_A}, '. ', {_B}, '; COLOR. ', {_C})
 WHEN 2 THEN concat('pl ', {_A}, ', x ', {_B}, ' Color: ', {_C}) ELSE concat('Duplex ', {_A}) END, ' | ', cast(o_custkey % 900 as string), '-', cast(o_custkey % 900 + o_orderkey % 120 as string))"""


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN concat(o_orderkey % 900, ';', o_custkey % 900) WHEN 2 THEN concat(o_orderkey % 900) ELSE '' END AS dpl,
 CASE o_orderkey % 4 WHEN 1 THEN concat(o_orderkey % 900, ';', o_custkey % 900, ';', o_orderkey % 77) WHEN 2 THEN concat(o_orderkey % 77) ELSE '' END AS color,
 CAST(CASE WHEN o_custkey % 900 >= 1 AND o_orderkey % 120 <= 90 AND o_custkey % 900 + o_orderkey % 120 <= 980 THEN o_orderkey % 120 END AS INTEGER) AS span FROM orders""")
def footnote_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_FOOT).alias("txt"))
    return rows.select("id", *[F.array_join(ocr.footnotes("txt", k), ";").alias(k) for k in ("dpl", "color")], ocr.plausible_span("txt", 980, 90).alias("span"))


_PAGE = "SELECT p_partkey // 60 AS page, p_partkey AS num, CASE WHEN p_partkey % 41 = 0 THEN 0.1 ELSE 0.0 END + (p_partkey % 100) / 10.0 AS mag FROM part WHERE p_partkey % 97 <> 5"


@query("SELECT p_partkey // 60 AS page, p_partkey AS num FROM part WHERE p_partkey % 97 = 5 AND p_partkey % 60 NOT IN (0, 59) AND p_partkey < (SELECT max(p_partkey) FROM part WHERE p_partkey % 97 <> 5) AND p_partkey > (SELECT min(p_partkey) FROM part WHERE p_partkey % 97 <> 5)")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing(t(spark, sf_dir, "part").filter("p_partkey % 97 <> 5").selectExpr("p_partkey div 60 AS page", "p_partkey AS num"))


@query(f"""WITH s AS ({_PAGE}), p AS (SELECT page, count(*) AS n, min(num) AS first, max(num) AS last, count(*) FILTER (WHERE num % 59 = 0) AS n_unknown, count(*) FILTER (WHERE num % 41 = 0 AND num % 59 <> 0 AND num % 53 <> 0) AS n_wrong FROM s GROUP BY page)
SELECT page, n, first, last, last - first + 1 - n AS n_missing, CASE WHEN lag(page) OVER w = page - 1 THEN first = lag(last) OVER w + 1 END AS chained, n BETWEEN 35 AND 80 AS plausible, n_unknown, n_wrong FROM p WINDOW w AS (ORDER BY page)""")
def page_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    mag = "(p_partkey % 100) / 10.0D"
    stars = part.filter("p_partkey % 97 <> 5").selectExpr("p_partkey div 60 AS page", "p_partkey AS num", f"CASE WHEN p_partkey % 41 = 0 THEN 0.1D ELSE 0.0D END + {mag} AS mag")
    return checks.pages(stars, part.filter("p_partkey % 59 <> 0").selectExpr("p_partkey AS num", f"CASE WHEN p_partkey % 53 <> 0 THEN {mag} END AS mag"))


@query("""WITH e AS (SELECT o_orderkey AS seq, o_orderkey % 40 AS page, o_orderkey % 8 AS kind, o_orderkey % 40 + 100 AS x FROM orders),
v AS (SELECT page, CASE WHEN kind >= 6 THEN 23 ELSE 22 END AS decl, CASE WHEN seq % 3 = 0 THEN 'color' ELSE 'dpl' END AS kind, seq, CASE kind WHEN 0 THEN x WHEN 1 THEN x + 400 WHEN 2 THEN x + 5000 WHEN 6 THEN x + 405 WHEN 7 THEN x + 10 ELSE 777000 + seq % 7 END AS n, kind AS k, x FROM e),
w AS (SELECT *, CASE WHEN k IN (0, 6) THEN 'inside' WHEN k IN (1, 7) THEN 'moved' WHEN k = 2 THEN 'repaired' ELSE 'outside' END AS verdict, CASE WHEN k = 1 THEN 23 WHEN k = 7 THEN 22 ELSE decl END AS dest, CASE WHEN k = 2 THEN x ELSE n END AS value FROM v)
SELECT page, decl, kind, seq, n, verdict, dest AS "at", value, k IN (3, 4, 5) AND n > 777003 AS beyond, coalesce(value >= lag(value) OVER (PARTITION BY page, dest, kind ORDER BY CASE WHEN verdict = 'moved' THEN 1 ELSE 0 END, decl, seq), true) AS ascending FROM w""")
def page_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 40 pages whose intervals are 100 to 299 for declination 22 and 500 to 699 for 23; a number may be moved either way."""
    kind = "CASE o_orderkey % 8 WHEN 0 THEN x WHEN 1 THEN x + 400 WHEN 2 THEN x + 5000 WHEN 6 THEN x + 405 WHEN 7 THEN x + 10 ELSE 777000 + o_orderkey % 7 END"
    numbers = t(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 40 + 100 AS x")
    numbers = numbers.selectExpr("o_orderkey % 40 AS page", "CASE WHEN o_orderkey % 8 >= 6 THEN 23 ELSE 22 END AS decl", "CASE WHEN o_orderkey % 3 = 0 THEN 'color' ELSE 'dpl' END AS kind", "o_orderkey AS seq", f"{kind} AS n")
    sides = "explode(array(struct(22 AS decl, 1 AS place, 100L AS first, 299L AS last), struct(23 AS decl, 2 AS place, 500L AS first, 699L AS last))) AS i"
    intervals = numbers.select("page").distinct().selectExpr("page", sides).select("page", "i.*")
    last = numbers.select("decl").distinct().filter("decl = 22").withColumn("last_star", F.lit(777003).cast("long"))
    return checks.placed(numbers, intervals, last)


@query("SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, lag(l_partkey) OVER w AS before, lead(l_partkey) OVER w AS behind, l_discount FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)) WHERE l_discount > 0.08")
def neighbour_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged lines with the line before and the one behind."""
    rows = t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_L} AS row_id", "l_partkey", "l_extendedprice", "l_discount")
    return checks.with_neighbours(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], "l_partkey", "l_discount > 0.08").select("row_id", "before", "behind", "l_discount")


@query("SELECT count(*) FILTER (WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 3 <> c_nationkey % 3) AS n_mismatch FROM customer")
def designation_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designations that name another constellation than the one the place lies in; stars without one don't count."""
    rows = t(spark, sf_dir, "customer").selectExpr("CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey % 3 END AS named", "c_nationkey % 3 AS con")
    return rows.agg(F.count_if(F.col("named").isNotNull() & (F.col("named") != F.col("con"))).alias("n_mismatch"))


@query("SELECT CAST(h AS VARCHAR) AS hd, CAST(arg_min(o_orderkey % 1000, o_orderkey) AS VARCHAR) AS gould FROM (SELECT *, o_custkey % 500 + 1 AS h FROM orders) WHERE o_orderkey % 3 > 0 AND o_orderkey % 1000 > 0 GROUP BY h")
def gould_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(CASE WHEN o_orderkey % 3 > 0 THEN 'G' ELSE ' ' END, CASE WHEN o_orderkey % 1000 > 0 THEN lpad(cast(o_orderkey % 1000 as string), 4, ' ') ELSE '    ' END, repeat('x', 59), lpad(cast(o_custkey % 500 + 1 as string), 7, ' '), ' tail')"
    return lists.gould(t(spark, sf_dir, "orders").selectExpr("o_orderkey AS line_no", f"{line} AS line"))


@query("SELECT s AS sao, CASE min(r * 100000 + num) // 100000 WHEN 0 THEN 'Σ ' WHEN 1 THEN 'Σ I ' ELSE 'Σ II ' END || (min(r * 100000 + num) % 100000) AS struve FROM (SELECT o_custkey % 700 AS s, o_orderkey % 3 AS r, o_orderkey % 3000 AS num FROM orders WHERE o_orderkey % 5 < 4 AND o_orderkey % 7 < 6) GROUP BY s")
def struve_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "concat(CASE WHEN o_orderkey % 5 = 4 THEN 'HJ' ELSE elt(o_orderkey % 3 + 1, 'STF', 'STFA', 'STFB') END, ' ', cast(o_orderkey % 3000 as string), ' AB')"
    return lists.struve(t(spark, sf_dir, "orders").selectExpr(f"{name} AS wds_name", "CASE WHEN o_orderkey % 7 < 6 THEN cast(o_custkey % 700 AS double) END AS SAO"))


@query("SELECT CAST(o_custkey % 300 AS INTEGER) AS hr, string_agg(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'D' || o_orderkey % 4 || ' ' END || 'note ' || o_orderkey, '|' ORDER BY o_orderkey) AS remarks FROM orders WHERE o_orderkey % 6 > 0 GROUP BY 1")
def star_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(' ', lpad(cast(o_custkey % 300 as string), 4, ' '), '  ', CASE WHEN o_orderkey % 4 = 0 THEN '     ' ELSE concat('D', cast(o_orderkey % 4 as string), '   ') END, CASE WHEN o_orderkey % 6 > 0 THEN concat('note ', cast(o_orderkey as string), '  ') ELSE '   ' END)"
    return lists.remarks(t(spark, sf_dir, "orders").selectExpr("o_orderkey AS line_no", f"{line} AS line")).select("hr", F.array_join("remarks", "|").alias("remarks"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 360 AS ra, o_orderkey % 180 - 90 AS de, (o_custkey % 120) / 10.0 AS vt FROM orders)
SELECT CAST(ra AS DOUBLE) AS ra, CAST(de AS DOUBLE) AS de, CAST(vt AS DOUBLE) AS vt FROM r WHERE vt <= 7.5 AND de < -9 AND k % 9 > 0
UNION ALL SELECT ra, de, vt FROM r WHERE vt <= 7.5 AND de < -9 AND k % 9 > 0 AND k % 2 = 0 AND k <= 17588""")
def bright_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main rows have their place in the mean columns or, every fourth, in the observed ones; every ninth has no magnitude."""
    ra, de, vt = "cast(o_orderkey % 360 as string)", "cast(o_orderkey % 180 - 90 as string)", "CASE WHEN o_orderkey % 9 > 0 THEN cast((o_custkey % 120) / 10.0D as string) ELSE '   ' END"
    mean = lambda x: f"CASE WHEN o_orderkey % 4 > 0 THEN {x} ELSE ' ' END"
    main = f"concat_ws('|', 'id', 'f', {mean(ra)}, {mean(de)}, array_join(array_repeat('.', 15), '|'), {vt}, array_join(array_repeat('.', 4), '|'), {ra}, {de}, 'end')"
    more = f"concat_ws('|', 'id', 'f', {ra}, {de}, array_join(array_repeat('.', 9), '|'), {vt}, 'end')"
    orders = t(spark, sf_dir, "orders")
    return lists.bright(orders.selectExpr(f"{main} AS line"), orders.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey AS line_no", f"{more} AS line"), -10.0)
