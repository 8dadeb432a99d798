"""Checks of transcribed pages: intervals, chains of numbers, magnitudes, neighbours. All by keys of a page; no global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators import ocr

#: Stars that a page plausibly has, the difference of magnitudes that counts, the least width of an interval for repairs.
PLAUSIBLE, TOLERANCE, REPAIR_WIDTH = (35, 80), 0.001, 150

#: Precession constants at an epoch and their yearly change, and tolerances.
PRECESSION_EPOCH, PRECESSION_M, PRECESSION_N = 1850.0, (3.07177, 0.000019), (20.0564, -0.000086)
RA_TOLERANCE, RA_GROWTH, DEC_TOLERANCE, NO_PRECESSION = 0.0099, 0.002, 0.099, 1e-8


def missing(stars: DataFrame) -> DataFrame:
    """page, num: numbers between a page's first and last that it doesn't have."""
    ends = stars.groupBy("page").agg(F.min("num").alias("a"), F.max("num").alias("b"))
    return ends.select("page", F.explode(F.sequence("a", "b")).alias("num")).join(stars.select("page", "num"), ["page", "num"], "left_anti")


def pages(stars: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row a page of (page, num, mag): its numbers, whether it follows on the page before, and magnitudes unlike ``catalogue``'s (num, mag)."""
    c = catalogue.select("num", F.col("mag").alias("want"), F.lit(True).alias("there"))
    rows = stars.join(c, "num", "left")
    wrong = F.col("want").isNotNull() & (F.col("mag").isNull() | (F.abs(F.col("mag") - F.col("want")) > TOLERANCE))
    out = rows.groupBy("page").agg(
        F.count(F.lit(1)).alias("n"), F.min("num").alias("first"), F.max("num").alias("last"), F.count_if(F.col("there").isNull()).alias("n_unknown"), F.count_if(wrong).alias("n_wrong")
    )
    before = out.select((F.col("page") + 1).alias("page"), F.col("last").alias("before"))
    out = out.join(before, "page", "left")
    gaps = (F.col("last") - F.col("first") + 1 - F.col("n")).alias("n_missing")
    return out.select("page", "n", "first", "last", gaps, (F.col("first") == F.col("before") + 1).alias("chained"), F.col("n").between(*PLAUSIBLE).alias("plausible"), "n_unknown", "n_wrong")


def placed(numbers: DataFrame, intervals: DataFrame, last_star: DataFrame | None = None) -> DataFrame:
    """(page, decl, kind, seq, n) with a verdict against ``intervals`` (page, place, decl, first, last); ``place`` is the order on the page.

    inside, moved (``at`` is the first other declination of the page whose interval holds it), repaired (``value`` is the
    only number of the interval that differs in one digit; wide intervals only), or outside. ``beyond``: over the
    declination's last star (``last_star``: decl, last_star); moved numbers and repaired ones aren't asked.
    ``ascending``: not less than the number before it in the list that it ends up in, where moved numbers stand behind the list's own.
    """
    sides = intervals.select("page", "decl", "place", "first", "last")
    own = numbers.join(sides, ["page", "decl"], "left")
    other = sides.select("page", F.col("decl").alias("o"), F.col("place").alias("p"), F.col("first").alias("f"), F.col("last").alias("l"))
    found = own.filter("not n between first and last").join(other, "page").filter("o <> decl and n between f and l")
    found = found.groupBy("page", "decl", "kind", "seq").agg(F.min_by("o", "p").alias("to"))
    rows = own.join(found, ["page", "decl", "kind", "seq"], "left").withColumn("text", F.col("n").cast("string"))
    fixed = F.when(F.col("last") - F.col("first") >= REPAIR_WIDTH, ocr.repair("text", "first", "last"))
    inside = F.coalesce(F.col("n").between(F.col("first"), F.col("last")), F.lit(True))
    verdict = F.when(inside, "inside").when(F.col("to").isNotNull(), "moved").when(fixed.isNotNull(), "repaired").otherwise("outside")
    rows = rows.withColumns({"verdict": verdict, "at": F.coalesce("to", "decl"), "value": F.when(verdict == "repaired", fixed).otherwise(F.col("n"))})
    limits = numbers.select("decl").limit(0).withColumn("last_star", F.lit(None).cast("long")) if last_star is None else last_star
    rows = rows.join(limits, "decl", "left").withColumn("beyond", F.coalesce(F.col("n") > F.col("last_star"), F.lit(False)) & F.col("verdict").isin("inside", "outside"))
    lists = Window.partitionBy("page", "at", "kind").orderBy(F.col("verdict") == "moved", "place", "seq")
    rows = rows.withColumn("ascending", F.coalesce(F.col("value") >= F.lag("value").over(lists), F.lit(True)))
    return rows.select("page", "decl", "kind", "seq", "n", "verdict", "at", "value", "beyond", "ascending")


def merged(readings: DataFrame) -> DataFrame:
    """page, decl, kind, n, runs, certain: the numbers of a list that several runs read, from ``readings`` (run, and the columns of placed()).

    A number is certain if two runs have it at that declination and none suspects it (repaired, outside or beyond there).
    """
    doubt = F.col("verdict").isin("repaired", "outside") | F.col("beyond")
    votes = readings.groupBy("page", F.col("at").alias("decl"), "kind", F.col("value").alias("n"))
    votes = votes.agg(F.count_distinct("run").alias("runs"), F.bool_or(doubt).alias("doubt"))
    return votes.select("page", "decl", "kind", "n", "runs", ((F.col("runs") >= 2) & ~F.col("doubt")).alias("certain"))


def merge_runs(numbers: DataFrame, ends: DataFrame, last_star: DataFrame | None = None) -> DataFrame:
    """Pages read several times, from raw numbers (run, page, decl, kind, seq, n) and intervals (run, page, place, decl, first, last) to merged().

    Each run is judged against its own intervals; numbers are moved and repaired before the votes.
    """
    reading = lambda df: df.withColumn("page", F.struct("page", "run")).drop("run")
    found = placed(reading(numbers), reading(ends), last_star)
    return merged(found.withColumn("run", F.col("page.run")).withColumn("page", F.col("page.page")))


def merged_ends(ends: DataFrame) -> DataFrame:
    """page, decl, first, last: of the runs' (run, page, decl, first, last) the ends that most runs read, the earliest run's on ties."""

    def most(column: str) -> DataFrame:
        votes = ends.filter(F.col(column).isNotNull()).groupBy("page", "decl", column).agg(F.count(F.lit(1)).alias("c"), F.min("run").alias("r"))
        return votes.groupBy("page", "decl").agg(F.max_by(column, F.struct("c", -F.col("r"))).alias(column))

    pages = ends.select("page", "decl").distinct()
    return pages.join(most("first"), ["page", "decl"], "left").join(most("last"), ["page", "decl"], "left")


def with_neighbours(rows: DataFrame, by: list[str], order: list[str], text: str, flagged: str) -> DataFrame:
    """The flagged rows with the ``text`` of the row before and behind in their group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"before": F.lag(text).over(w), "behind": F.lead(text).over(w)}).filter(flagged)


def precession_constants(epoch: float) -> tuple[float, float]:
    """m (seconds of time) and n (arcseconds) a year of Struve and Peters at an epoch, linear in it."""
    years = epoch - PRECESSION_EPOCH
    return PRECESSION_M[0] + PRECESSION_M[1] * years, PRECESSION_N[0] + PRECESSION_N[1] * years


def precessions(rows: DataFrame, epoch: float) -> DataFrame:
    """Printed yearly precessions (pre_ra, pre_dec; zero: none printed) against those that follow from ra and dec.

    Adds real_ra, real_dec, wrong_ra and wrong_dec. The tolerance of right ascension grows with the precession itself, as near the pole
    the formula of first order doesn't suffice.
    """
    m, n = precession_constants(epoch)
    rows = rows.withColumns({"real_ra": F.expr(f"{m!r}D + {n / 15!r}D * sin(radians(ra)) * tan(radians(dec))"), "real_dec": F.expr(f"{n!r}D * cos(radians(ra))")})
    grown = RA_TOLERANCE + RA_GROWTH * F.abs(F.col("pre_ra") - m)
    printed = lambda c: F.abs(F.col(c)) > NO_PRECESSION
    return rows.withColumns({"wrong_ra": printed("pre_ra") & (F.abs(F.col("pre_ra") - F.col("real_ra")) > grown), "wrong_dec": printed("pre_dec") & (F.abs(F.col("pre_dec") - F.col("real_dec")) > DEC_TOLERANCE)})
