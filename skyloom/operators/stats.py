"""Aggregates: RMSE and MAPE, histograms, weighted least squares in closed form; ordered folds; windows over file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.order import last_known


def rmse(x: str) -> Column:
    """Root mean square, NULL over no rows."""
    return F.sqrt(F.sum(F.col(x) * F.col(x)) / F.count(x))


def histogram(rows: DataFrame, x: str, y: str, least: int = 1) -> DataFrame:
    """Bins of tenths of x (0 to 199): mean of y and count; bins under ``least`` are dropped."""
    b = F.floor(F.col(x) * 10 + 0.5).cast("int")
    return rows.withColumn("bin", b).filter("bin between 0 and 199").groupBy("bin").agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def fit_line(points: DataFrame, x: str, y: str, w: str, by: list[str] = ()) -> DataFrame:
    """Weighted y = a + b x and y = x + c from sums; rows with six points or more."""
    s = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in {"w": w, "wx": f"{w}*{x}", "wy": f"{w}*{y}", "wxx": f"{w}*{x}*{x}", "wxy": f"{w}*{x}*{y}"}.items()]).filter("n > 5")
    slope = "(w*wxy - wx*wy) / nullif(w*wxx - wx*wx, 0)"
    return s.select(*by, "n", F.expr(slope).alias("slope"), F.expr(f"(wy - wx*({slope})) / w").alias("intercept"), F.expr("(wy - wx) / w").alias("offset"))


def fit_quadratic(points: DataFrame, x: str, y: str, w: str, by: list[str] = ()) -> DataFrame:
    """Weighted y = a + b t + c t^2 with t = x - mean(x): eight sums, then Cramer's rule in SQL."""
    mean = points.groupBy(*by).agg(F.avg(x).alias("_m"))
    p = (points.join(mean, by) if by else points.crossJoin(mean.limit(1))).withColumn("_t", F.col(x) - F.col("_m"))
    sums = {f"s{k}": f"{w}*pow(_t,{k})" for k in range(5)} | {f"r{k}": f"{w}*{y}*pow(_t,{k})" for k in range(3)}
    s = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("_m").alias("centre"), *[F.sum(F.expr(e)).alias(k) for k, e in sums.items()]).filter("n > 5")
    det = lambda m: f"({m[0]}*({m[4]}*{m[8]}-{m[5]}*{m[7]}) - {m[1]}*({m[3]}*{m[8]}-{m[5]}*{m[6]}) + {m[2]}*({m[3]}*{m[7]}-{m[4]}*{m[6]}))"
    base = ["s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4"]
    col = lambda k: [f"r{i // 3}" if i % 3 == k else v for i, v in enumerate(base)]
    return s.select(*by, "n", "centre", *[F.expr(f"{det(col(k))} / nullif({det(base)}, 0)").alias(c) for k, c in enumerate("abc")])


def ordered_fold(rows: DataFrame, key: str, order: str, fields: list[str], better: str) -> DataFrame:
    """Fold the rows of a key in order: ``better`` says, over structs c (current) and x (next), when x takes over.

    A key's rows must fit a task's memory; order.fold() streams them.
    """
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("a"))
    out = lists.withColumn("f", F.expr(f"aggregate(slice(a, 2, greatest(size(a) - 1, 0)), a[0], (c, x) -> CASE WHEN {better} THEN x ELSE c END)"))
    return out.select(key, F.col(f"f.{order}").alias(order), *[F.col(f"f.{c}").alias(c) for c in fields])


def carry_forward(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, **cut: int) -> DataFrame:
    """The latest known value up to each row; a key's rows run in stretches."""
    return last_known(rows, by, order, F.col(value), out, **cut)


def seen_before(rows: DataFrame, by: list[str], order: list[str], condition: Column, out: str, **cut: int) -> DataFrame:
    """Whether the condition held on an earlier row."""
    return last_known(rows, by, order, F.when(condition, F.lit(True)), out, False, **cut).withColumn(out, F.coalesce(out, F.lit(False)))


def run_visible(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """First and last of each run of equal values."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(out, ~(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lead(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull()))


def longest_chain(ranges: DataFrame, by: str) -> DataFrame:
    """The longest chain of ranges (lo, hi) in which each begins right behind the one before; the earliest on ties. A repeated range begins a chain of its own."""
    w = Window.partitionBy(by).orderBy("lo", "hi")
    start = F.when(F.col("lo") == F.lag("hi").over(w) + 1, 0).otherwise(1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    chains = ranges.withColumn("s", start).withColumn("chain", F.sum("s").over(upto)).groupBy(by, "chain").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
    return chains.groupBy(by).agg(F.max(F.struct("n", (-F.col("lo")).alias("m"), "lo", "hi")).alias("b")).select(by, "b.n", "b.lo", "b.hi")


def majority(votes: DataFrame, key: list[str], value: str, run: str) -> DataFrame:
    """The value most runs read, the first seen on ties; certain with two votes or more."""
    counted = votes.groupBy(*key, value).agg(F.count_distinct(run).alias("c"), F.min(run).alias("first"))
    best = counted.groupBy(*key).agg(F.max(F.struct("c", (-F.col("first")).alias("f"), value)).alias("b"))
    return best.select(*key, F.col(f"b.{value}").alias(value), F.col("b.c").alias("votes"), (F.col("b.c") >= 2).alias("certain"))
