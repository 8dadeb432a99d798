"""Charts and reports on literal rows."""

from pyspark.sql import functions as F

from skyloom.functions import charts
from skyloom.sources import reports


def test_labels_and_notes(spark):
    rows = spark.createDataFrame([("CD -22 123", 6.34), ("CD -22 123", 0.0), ("alpha", -1.4), ("alpha", 7.1), (None, 3.0)], "name string, mag double")
    got = rows.select(*[charts.label(F.col("name"), F.col("mag"), m) for m in ("mag", "full", "number")]).collect()
    assert [tuple(x) for x in got] == [("63", "CD -22 123", "123"), (None, None, None), ("-14", "alpha", "alpha"), (None, None, None), ("30", None, None)]
    notes = spark.createDataFrame([("",), ("Var?",), ("12",), ("R Car",), (None,)], "v string").select(charts.variable_note(F.col("v"))).collect()
    assert [x[0] for x in notes] == ["", "", "", "Var: R Car", ""]


def test_running_number_over_stretches(spark):
    rows = spark.range(0, 5000, 7).repartition(5)
    got = sorted((x.id, x.n) for x in reports.numbered(rows, "id", "n", width=64).collect())
    assert got == [(x, i + 1) for i, x in enumerate(range(0, 5000, 7))]
    assert reports.numbered(rows.limit(0), "id", "n").count() == 0


def test_listings(spark, tmp_path):
    stars = spark.createDataFrame([(2, 8.25, None, None), (1, 10.5, 12.34, "CD -22 1")], "index long, imag double, dist double, ident string")
    reports.write_listing(reports.cross_lines(stars), reports.CROSS_HEADING, "index", str(tmp_path / "cross"))
    assert [x.value for x in spark.read.text(str(tmp_path / "cross")).collect()][:1] == [reports.CROSS_HEADING]
    assert {x.line for x in reports.cross_lines(stars).collect()} == {"       1   10.50      12.3  CD -22 1", "       2    8.25"}
    entries = spark.createDataFrame([(1, -23, 1, 5), (1, -22, 6, 9), (2, -22, 1, 1)], "page int, decl int, first int, last int")
    reports.write_pages(entries, str(tmp_path / "pages"))
    got = {x.page: x.value for x in spark.read.text(str(tmp_path / "pages")).collect()}
    assert got[1] == '[{"decl":-22,"first":6,"last":9},{"decl":-23,"first":1,"last":5}]' and len(got) == 2


def test_cache_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert reports.cached(spark, str(tmp_path / "cache"), build).count() == 3
    assert len(calls) == 1
