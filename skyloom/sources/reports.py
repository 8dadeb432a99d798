"""Reports and caches: numbered warnings, fixed-width listings, the fit's matrix, pages as JSON, segments of figures, a Parquet cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Declinations of the five printed volumes, from and to.
VOLUMES = ((-31, -22), (-41, -32), (-51, -42), (-61, -52), (-90, -62))
#: Pages of the five volumes.
VOLUME_PAGES = (605, 539, 503, 305, 400)
#: Headings of the two listings.
CROSS_HEADING = "    Index   imag   Distance Identification"
ESTIMATE_HEADING = "   Index    Vmag  ConstEst    LinEst   QuadEst  Identification"


def numbered(rows: DataFrame, order: str, name: str, width: int = 1 << 16) -> DataFrame:
    """A running number from 1 in the order of the distinct whole numbers in ``order``.

    Rows are numbered within stretches of ``width`` numbers; only the stretches' counts are added up in one place.
    """
    part = rows.withColumn("_part", F.floor(F.col(order) / width))
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return part.withColumn("_own", own).join(before, "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def far(pairs: DataFrame, order: str, limit: float) -> DataFrame:
    """seq and text for each of the pairs (source, label, target, dist, order) that are further apart than ``limit``, numbered in order."""
    rows = numbered(pairs.filter(F.col("dist") > limit), order, "seq")
    text = F.format_string("%d) Warning: %s is FAR from %s %d (dist = %.1f arcsec).", "seq", "source", "label", "target", "dist")
    return rows.select("seq", order, text.alias("text"))


def registers(stars: DataFrame, flagged: DataFrame, neighbours: bool) -> DataFrame:
    """seq, k, text: the register lines of the flagged stars (seq, index), then, if asked for, a heading and those of the stars before and behind.

    ``stars``: index (from 0, in file order), decl, number, hour, minute, second, arcminute, mag. A star's page follows from its place among its
    volume's stars. The lines wanted are joined by index, so no order is built over the stars.
    """
    v = stars.withColumn("v", volume(F.col("decl")))
    sizes = v.groupBy("v").agg(F.min("index").alias("from"), F.count(F.lit(1)).alias("size"))  # six rows at most
    pages = F.element_at(F.lit([0, *VOLUME_PAGES]), F.col("v") + 1)
    page = F.floor(pages * (F.col("index") - F.col("from")) / F.col("size"))
    line = F.format_string("     Register CD %d°%d (en %.0fh):  %.1f | %.0fm%.1fs | %.1f'     (pag. %d)", "decl", "number", *[F.col(c).cast("double") for c in ("hour", "mag", "minute", "second", "arcminute")], page)
    lines = v.join(F.broadcast(sizes), "v").select("index", line.alias("text"))
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).cast("long").alias("d")) for k, d in ([(0, 0), (2, -1), (3, 1)] if neighbours else [(0, 0)])])
    wanted = flagged.select("seq", F.col("index").alias("own"), F.inline(steps)).select("seq", "k", (F.col("own") + F.col("d")).alias("index"))
    out = wanted.join(lines, "index").select("seq", "k", "text")
    return out.unionByName(flagged.select("seq", F.lit(1).alias("k"), F.lit("   Neighbors:").alias("text"))) if neighbours else out


def volume(decl: Column) -> Column:
    """The number of the printed volume a declination belongs to; 0 outside."""
    out = F.lit(0)
    for i, (lo, hi) in enumerate(VOLUMES):
        out = F.when(decl.between(lo, hi), i + 1).otherwise(out)
    return out


def fit_matrix(stars: DataFrame, position: str, farthest: float) -> DataFrame:
    """Lines volume,vmag,mag of every third star (position, decl, vmag, mag, dist, problem) without problems and near its match."""
    good = ~F.col("problem") & (F.abs("vmag") >= 0.00001) & (F.col("dist") <= farthest)
    rows = stars.filter((F.col(position) % 3 == 0) & F.coalesce(good, F.lit(False)))
    return rows.select(position, F.format_string("%d,%.2f,%.2f", volume(F.col("decl")), "vmag", "mag").alias("line"))


def cross_lines(stars: DataFrame) -> DataFrame:
    """index and line of the cross listing for (index, imag, dist, ident); without a match the line ends after the magnitude."""
    short = F.format_string("%8d  %6.2f", "index", "imag")
    return stars.select("index", F.when(F.col("dist").isNull(), short).otherwise(F.concat(short, F.format_string("  %8.1f  %s", "dist", "ident"))).alias("line"))


def estimate_lines(stars: DataFrame) -> DataFrame:
    """index and line of the estimates for (index, vmag, const, lin, quad, ident); an unknown magnitude is blank, without a quadratic fit its field is left out."""
    vmag = F.when(F.col("vmag") > 0, F.format_string("  %6.1f", "vmag")).otherwise(" " * 8)
    quad = F.when(F.col("quad").isNull(), "").otherwise(F.format_string("  %8.2f", "quad"))
    ident = F.when(F.col("ident").isNull(), "").otherwise(F.concat(F.lit("  "), "ident"))
    return stars.select("index", F.concat(F.format_string("%8d", "index"), vmag, F.format_string("  %8.2f  %8.2f", "const", "lin"), quad, ident).alias("line"))


def write_listing(lines: DataFrame, heading: str, order: str, path: str) -> None:
    """Text files in order; the heading comes first in the first file."""
    top = lines.sparkSession.createDataFrame([(heading,)], "line string").select(F.lit(None).cast("long").alias(order), "line")
    top.unionByName(lines.select(F.col(order).cast("long").alias(order), "line")).orderBy(F.asc_nulls_first(order)).select("line").write.text(path)


def page_json(entries: DataFrame) -> DataFrame:
    """page and json: its entries (decl, first, last) as one array, by declination downwards."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("decl")).alias("o"), "decl", "first", "last")))
    return entries.groupBy("page").agg(F.to_json(F.transform(listed, lambda x: F.struct(x["decl"].alias("decl"), x["first"].alias("first"), x["last"].alias("last")))).alias("json"))


def write_pages(entries: DataFrame, path: str) -> None:
    """A folder for each page with one line of JSON."""
    page_json(entries).write.partitionBy("page").text(path)


def segments(figures: DataFrame, stars: DataFrame) -> DataFrame:
    """name and both ends' places for each pair of star numbers in ``lines`` of the figures; pairs with an unknown star are left out."""
    pairs = figures.select("name", F.posexplode("lines").alias("nr", "p")).select("name", "nr", F.get("p", 0).alias("a"), F.get("p", 1).alias("b"))
    end = lambda k, n: stars.filter("hip is not null").select(F.col("hip").alias(k), F.col("ra").alias(f"ra{n}"), F.col("dec").alias(f"dec{n}"))
    return pairs.join(end("a", 1), "a").join(end("b", 2), "b").select("name", "nr", "a", "b", "ra1", "dec1", "ra2", "dec2")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``; built and written first if it isn't there as a whole."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
