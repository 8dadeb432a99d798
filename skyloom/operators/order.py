"""Rows in an order: numbers, and states carried along it, without one task that sees a whole key.

The order is cut into stretches at quantiles of its first column (a bounded number, found once, so every plan that uses them cuts
alike). Within a stretch a window does the work; one small row a key and stretch holds what the stretch leaves behind, a
second window over those gives each stretch what came before it, and a join brings it back. A key with all rows
runs in as many tasks as there are stretches; equal values of the first column stay together, and the
other columns of the order sort them inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stretches of an order.
STRETCHES = 64


def bounds(rows: DataFrame, order: str, stretches: int = STRETCHES) -> list[float]:
    """Ascending values that cut the order into at most so many stretches of about equal size."""
    cuts = [i / stretches for i in range(1, stretches)]
    found = rows.select(F.percentile_approx(order, F.array(*map(F.lit, cuts)), 10 * stretches)).first()[0] if cuts else None
    return sorted(set(found or []))


def stretch(order: str | Column, cuts: list) -> Column:
    """The stretch of a value: how many of ``cuts`` are not greater, by halving."""
    column = F.col(order) if isinstance(order, str) else order

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(cuts[mid]), half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, len(cuts))


def _cut(rows: DataFrame, order: list[str], stretches: int, cuts: list | None) -> DataFrame:
    return rows.withColumn("_s", stretch(order[0], bounds(rows, order[0], stretches) if cuts is None else cuts))


def numbered(rows: DataFrame, order: list[str], name: str = "line", by: list[str] = (), stretches: int = STRETCHES, cuts: list | None = None) -> DataFrame:
    """``rows`` with their number (from 1) in the order of their key (of the whole table without one); the order's columns tell its rows apart."""
    cut = _cut(rows, order, stretches, cuts).withColumn("_k", _key(by))
    own = F.row_number().over(Window.partitionBy("_k", "_s").orderBy(*order))
    done = _carried(cut, F.count(F.lit(1)), F.sum, own, lambda a, b: F.col(a) + F.coalesce(b, F.lit(0)))
    return done.withColumn(name, F.col("_in")).drop("_k", "_s", "_in")


def _carried(rows: DataFrame, state: Column, combine, own: Column, join) -> DataFrame:
    """``rows`` (with _k and _s) and _in: ``own`` of the row within its stretch, joined with what the key's stretches before leave."""
    states = rows.groupBy("_k", "_s").agg(state.alias("_state"))
    before = combine("_state").over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    states = states.select("_k", "_s", before.alias("_before"))
    return rows.withColumn("_own", own).join(states, ["_k", "_s"]).withColumn("_in", join("_own", "_before")).drop("_own", "_before")


def _key(by: list[str]) -> Column:
    """The key as one value, in which nulls are equal."""
    return F.struct(*by) if by else F.lit(0)


def last_known(rows: DataFrame, by: list[str], order: list[str], value: Column, out: str, inclusive: bool = True, stretches: int = STRETCHES, cuts: list | None = None) -> DataFrame:
    """``rows`` with the latest non-null ``value`` of the key up to each row (``inclusive``) or before it; null where none came."""
    return all_last_known(rows, by, order, {out: (value, inclusive)}, stretches, cuts)


def all_last_known(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[Column, bool]], stretches: int = STRETCHES, cuts: list | None = None) -> DataFrame:
    """last_known() of several values (column: value, inclusive) by one shuffle of the rows."""
    cut = _cut(rows, order, stretches, cuts).withColumns({"_k": _key(by), **{f"_v{i}": v for i, (v, _) in enumerate(values.values())}})
    sorted_ = Window.partitionBy("_k", "_s").orderBy(*order)
    own = [F.last(f"_v{i}", ignorenulls=True).over(sorted_.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)) for i, (_, inclusive) in enumerate(values.values())]
    left = [F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.struct(*order))).alias(f"_left{i}") for i in range(len(values))]
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    states = cut.groupBy("_k", "_s").agg(*left).select("_k", "_s", *[F.last(f"_left{i}", ignorenulls=True).over(earlier).alias(f"_before{i}") for i in range(len(values))])
    done = cut.select("*", *[w.alias(f"_own{i}") for i, w in enumerate(own)]).join(states, ["_k", "_s"])
    return done.select(*[c for c in rows.columns if c not in values], *[F.coalesce(f"_own{i}", f"_before{i}").alias(out) for i, out in enumerate(values)])


def least_before(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, stretches: int = STRETCHES, cuts: list | None = None) -> DataFrame:
    """``rows`` with the least ``value`` of the key before each row; null for its first."""
    cut = _cut(rows, order, stretches, cuts).withColumn("_k", _key(by))
    window = Window.partitionBy("_k", "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = _carried(cut, F.min(value), F.min, F.min(value).over(window), F.least)
    return done.withColumn(out, F.col("_in")).drop("_k", "_s", "_in")


def jumps(rows: DataFrame, by: list[str], order: list[str], number: str, counts: Column, most: int, start: int = 0, stretches: int = STRETCHES, cuts: list | None = None) -> DataFrame:
    """The rows for which ``counts`` holds and whose number is over ``most`` away from that of the row before for which it held (at first ``start``), with ``previous``.

    Rows for which it doesn't hold are neither judged nor remembered.
    """
    seen = last_known(rows, by, order, F.when(counts, F.col(number)), "previous", False, stretches, cuts)
    seen = seen.withColumn("previous", F.coalesce("previous", F.lit(start)))
    return seen.filter(counts & (F.abs(F.col(number) - F.col("previous")) > most))


def fold(rows: DataFrame, key: str, order: str, fields: list[str], better) -> DataFrame:
    """Fold the rows of each key in order: ``better(c, x)`` says, over dicts of ``fields`` of the current and the next row, when x takes over.

    For rules that aren't associative. Rows stream through sorted partitions; a task holds one Arrow batch and one row.
    A key with many rows takes one task's time, but not its memory.
    """
    names = [key, order, *[f for f in fields if f not in (key, order)]]
    kept = rows.select(*names)

    def run(batches):
        import pyarrow as pa

        best, schema = None, None
        for batch in batches:
            schema, done = batch.schema, []
            for x in batch.to_pylist():
                if best is not None and best[key] == x[key]:
                    best = x if better(best, x) else best
                else:
                    if best is not None:
                        done.append(best)
                    best = x
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if best is not None:
            yield pa.RecordBatch.from_pylist([best], schema)

    return kept.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, kept.schema)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` (from 1, files by their path) and ``value`` of text files: places within a split, and the splits' sums before it.

    A line's place in its split is the difference of generated ids, which count up along a split whatever task reads it.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    splits = read.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("_f", "_b", "_first", F.coalesce(before, F.lit(0)).alias("_before"))  # one row a split
    line = F.col("_i") - F.col("_first") + F.col("_before") + 1
    return read.join(offsets, ["_f", "_b"]).select(line.alias("line"), "value")
