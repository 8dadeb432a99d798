"""Named queries over charts and reports. Their SQL is written from the rows, without the functions' expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import charts
from skyloom.plans.catalog import query, t
from skyloom.sources import reports


@query("""WITH r AS (SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE (o_custkey % 110) / 10.0 - 1 END AS DOUBLE) AS m, o_custkey % 110 - 10 AS tenths, o_orderkey % 9 = 0 OR o_custkey % 110 = 10 AS missing FROM orders)
SELECT id, round(CASE WHEN m > 6.2 - 0.6 / 2.2 THEN 0.6 ELSE 13.64 - 2.2 * m END + 1e-9, 4) AS plate, round(CASE WHEN missing OR tenths > 90 THEN 2.0 ELSE 20 - 2 * m END + 1e-9, 4) AS chart,
  CASE WHEN NOT missing AND tenths <= 70 THEN CAST(tenths AS VARCHAR) END AS tenths, CASE WHEN NOT missing AND tenths <= 70 THEN CASE WHEN id % 4 = 0 THEN 'Star ' || id || 'b' ELSE CAST(id AS VARCHAR) END END AS number FROM r""")
def chart_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes on plates and charts, labels by magnitude and by number; every ninth star has no magnitude (0)."""
    mag = "cast(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE (o_custkey % 110) / 10.0 - 1 END AS double) AS mag"
    name = "concat('Star ', cast(o_orderkey as string), CASE WHEN o_orderkey % 4 = 0 THEN 'b' ELSE '' END) AS name"
    rows = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", mag, name)
    m, r = F.col("mag"), lambda c: F.round(c + 1e-9, 4)
    return rows.select(
        "id", r(charts.size(m)).alias("plate"), r(charts.size(charts.known(m), charts.CHART)).alias("chart"),
        charts.label(F.col("name"), m, "mag").alias("tenths"), charts.label(F.col("name"), m, "number").alias("number"),
    )


@query("""WITH b AS (SELECT o_orderkey AS id, o_orderkey % 350 AS ra_lo, CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 350 + 355 ELSE o_orderkey % 350 + 20 END AS ra_hi, o_custkey % 170 - 90 AS dec_lo, o_custkey % 170 - 70 AS dec_hi FROM orders),
k AS (SELECT *, CASE WHEN dec_lo = -90 OR (id % 8 = 0 AND dec_hi < 0) THEN 's' WHEN dec_hi >= 90 OR (id % 8 = 0 AND dec_lo > 0) THEN 'n' ELSE 'x' END AS cap FROM b)
SELECT id, CAST(CASE cap WHEN 'x' THEN ra_lo - 5 ELSE 0 END AS DOUBLE) AS ra_min, CAST(CASE cap WHEN 'x' THEN ra_hi + 5 ELSE 360 END AS DOUBLE) AS ra_max,
  CAST(CASE WHEN cap = 's' OR dec_lo < -85 THEN -90 ELSE dec_lo - 5 END AS DOUBLE) AS dec_min, CAST(CASE WHEN cap = 'n' OR dec_hi > 85 THEN 90 ELSE dec_hi + 5 END AS DOUBLE) AS dec_max,
  CAST(CASE cap WHEN 'x' THEN (ra_lo + ra_hi) / 2.0 ELSE 0 END AS DOUBLE) AS center_ra, CAST(CASE cap WHEN 's' THEN -90 WHEN 'n' THEN 90 ELSE (dec_lo + dec_hi) / 2.0 END AS DOUBLE) AS center_dec FROM k""")
def chart_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of view around boxes; every eighth goes around a pole."""
    box = "o_orderkey AS id", "o_orderkey % 350 AS a", "CASE WHEN o_orderkey % 8 = 0 THEN 355 ELSE 20 END AS w", "cast(o_custkey % 170 - 90 AS double) AS d"
    rows = t(spark, sf_dir, "orders").selectExpr(*box)
    a = F.col("a").cast("double")
    return rows.select("id", charts.field_of_view(a, a + F.col("w"), F.col("d"), F.col("d") + 20).alias("f")).select("id", "f.*")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 4 THEN 'Var: R' || o_custkey || ' Sgr' WHEN 5 THEN 'Var: Var ' || o_custkey ELSE '' END AS note FROM orders")
def variable_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "cast(o_custkey as string)"
    field = f"CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Var' WHEN 2 THEN 'Var?' WHEN 3 THEN {n} WHEN 4 THEN concat('R', {n}, ' Sgr') ELSE concat('Var ', {n}) END AS v"
    return t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", field).select("id", charts.variable_note(F.col("v")).alias("note"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS seq, o_orderkey AS line_no, row_number() OVER (ORDER BY o_orderkey) || ') Warning: GC ' || o_custkey || ' is FAR from CD ' || o_orderkey % 1000 || ' (dist = ' || (o_orderkey % 200) || '.5 arcsec).' AS text FROM orders WHERE o_orderkey % 200 >= 120")
def warning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS line_no", "concat('GC ', cast(o_custkey as string)) AS source", "'CD' AS label", "o_orderkey % 1000 AS target", "o_orderkey % 200 + 0.5D AS dist")
    return reports.far(pairs, "line_no", 120.0)


@query("""SELECT o_orderkey AS line_no, CASE WHEN d >= -31 AND d <= -22 THEN 1 WHEN d >= -41 AND d < -31 THEN 2 WHEN d >= -51 AND d < -41 THEN 3 WHEN d >= -61 AND d < -51 THEN 4 WHEN d < -61 THEN 5 ELSE 0 END || ',' || printf('%.2f', CAST(v / 10.0 AS DOUBLE)) || ',' || printf('%.2f', CAST(c / 10.0 AS DOUBLE)) AS line
FROM (SELECT o_orderkey, -(o_custkey % 91) AS d, o_orderkey % 110 AS v, o_custkey % 100 AS c, o_orderkey % 200 AS dist FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 > 0) WHERE v > 0 AND dist <= 120""")
def fit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS line_no", "-(o_custkey % 91) AS decl", "(o_orderkey % 110) / 10.0D AS vmag", "(o_custkey % 100) / 10.0D AS mag", "cast(o_orderkey % 200 AS double) AS dist", "o_orderkey % 7 = 0 AS problem")
    return reports.fit_matrix(rows, "line_no", 120.0)


@query("SELECT o_orderkey AS index, lpad(CAST(o_orderkey AS VARCHAR), 8, ' ') || '  ' || lpad(printf('%.2f', CAST((o_custkey % 150) / 10.0 AS DOUBLE)), 6, ' ') || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '  ' || lpad(printf('%.1f', CAST(o_orderkey % 60 AS DOUBLE)), 8, ' ') || '  CD -' || o_custkey % 90 END AS line FROM orders")
def cross_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS index", "(o_custkey % 150) / 10.0D AS imag", "CASE WHEN o_orderkey % 3 > 0 THEN cast(o_orderkey % 60 AS double) END AS dist", "concat('CD -', cast(o_custkey % 90 as string)) AS ident")
    return reports.cross_lines(rows)


@query("""SELECT o_orderkey AS index, lpad(CAST(o_orderkey AS VARCHAR), 8, ' ') || CASE WHEN o_orderkey % 4 = 0 THEN '        ' ELSE '  ' || lpad(printf('%.1f', CAST(1 + (o_custkey % 90) / 10.0 AS DOUBLE)), 6, ' ') END || '  ' || lpad(printf('%.2f', CAST((o_custkey % 150) / 10.0 + 1 AS DOUBLE)), 8, ' ') || '  ' || lpad(printf('%.2f', CAST((o_custkey % 150) / 5.0 AS DOUBLE)), 8, ' ')
 || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '  ' || lpad(printf('%.2f', CAST((o_custkey % 150) / 2.0 AS DOUBLE)), 8, ' ') END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '  CD -' || o_custkey % 90 END AS line FROM orders""")
def estimate_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = "(o_custkey % 150)"
    rows = t(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS index", "CASE WHEN o_orderkey % 4 > 0 THEN 1 + (o_custkey % 90) / 10.0D END AS vmag", f"{x} / 10.0D + 1 AS const", f"{x} / 5.0D AS lin", f"CASE WHEN o_orderkey % 5 > 0 THEN {x} / 2.0D END AS quad",
        "CASE WHEN o_orderkey % 3 > 0 THEN concat('CD -', cast(o_custkey % 90 as string)) END AS ident",
    )
    return reports.estimate_lines(rows)


@query("""SELECT page, '[' || string_agg('{"decl":' || decl || ',"first":' || lo || ',"last":' || hi || '}', ',' ORDER BY decl DESC) || ']' AS json FROM (SELECT p_partkey // 50 AS page, -(p_partkey % 7) AS decl, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part GROUP BY ALL) GROUP BY page""")
def pages_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = t(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 50").alias("page"), F.expr("-(p_partkey % 7)").alias("decl")).agg(F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))
    return reports.page_json(entries)


@query("""SELECT 'figure ' || n.n_nationkey AS name, CAST(k AS INTEGER) AS nr, n.n_nationkey * 4 + k AS a, n.n_nationkey * 4 + k + 1 AS b, CAST(p.c_custkey % 360 AS DOUBLE) AS ra1, CAST(p.c_custkey % 90 AS DOUBLE) AS dec1, CAST(q.c_custkey % 360 AS DOUBLE) AS ra2, CAST(q.c_custkey % 90 AS DOUBLE) AS dec2
FROM nation n, range(3) AS r(k), customer p, customer q WHERE n.n_nationkey % 5 > 0 AND p.c_custkey = n.n_nationkey * 4 + k AND q.c_custkey = n.n_nationkey * 4 + k + 1 AND p.c_custkey % 9 > 0 AND q.c_custkey % 9 > 0""")
def figure_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between neighbouring stars of a figure; every fifth figure has none, every ninth star no number."""
    figures = t(spark, sf_dir, "nation").selectExpr("concat('figure ', cast(n_nationkey as string)) AS name", "CASE WHEN n_nationkey % 5 > 0 THEN transform(sequence(0, 2), k -> array(n_nationkey * 4 + k, n_nationkey * 4 + k + 1)) END AS lines")
    stars = t(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 9 > 0 THEN c_custkey END AS hip", "cast(c_custkey % 360 AS double) AS ra", "cast(c_custkey % 90 AS double) AS dec")
    return reports.segments(figures, stars)
