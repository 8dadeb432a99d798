"""Sinks: cross tables, normalised tables, partitioned and routed output; readers for the delimited formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CROSS = "index1 string, index2 string, mag double, dist double"
NORMALISED = "name string, x double, y double, z double, mag double"
UNIDENTIFIED = "name string, x double, y double, z double"


def cross_rows(rows: DataFrame, targets: dict[str, str], mag: str) -> DataFrame:
    """One row for each target whose number is above 0: target, index2, mag with one decimal."""
    each = F.array(*[F.struct(F.lit(k).alias("target"), F.lit(k.upper()).alias("label"), F.col(c).cast("long").alias("number")) for k, c in targets.items()])
    out = rows.select(F.explode(each).alias("t"), F.format_string("%.1f", F.col(mag)).alias("mag")).filter("t.number > 0")
    return out.select("t.target", F.concat_ws(" ", "t.label", F.col("t.number").cast("string")).alias("index2"), "mag")


def write_cross(rows: DataFrame, path: str) -> None:
    """index1, index2, mag (one decimal), dist (two), with a header."""
    rows.select("index1", "index2", F.format_string("%.1f", "mag").alias("mag"), F.format_string("%.2f", "dist").alias("dist")).write.csv(path, header=True)


def read_cross(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CROSS)


def write_normalised(rows: DataFrame, path: str) -> None:
    rows.select("name", *[F.format_string("%.8f", c).alias(c) for c in "xyz"], F.format_string("%.1f", "mag").alias("mag")).write.csv(path, header=True)


def read_normalised(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of eight decimals are brought back to unit length."""
    rows = spark.read.csv(path, header=True, schema=NORMALISED)
    n = F.sqrt(F.expr("x*x + y*y + z*z"))
    return rows.withColumns({c: F.col(c) / n for c in "xyz"})


def read_unidentified(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=UNIDENTIFIED)


def write_ragged(rows: DataFrame, path: str) -> None:
    """Cross rows whose magnitude field is left out where it is unknown."""
    fields = F.concat_ws(",", "index1", "index2", F.format_string("%.1f", "mag"), F.format_string("%.2f", "dist"))
    short = F.concat_ws(",", "index1", "index2", F.format_string("%.2f", "dist"))
    rows.select(F.when(F.col("mag").isNull(), short).otherwise(fields).alias("value")).write.text(path)


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", ",")
    rows = spark.read.text(path)
    return rows.select(p[0].alias("index1"), p[1].alias("index2"), F.when(F.size(p) == 4, F.get(p, 2)).cast("double").alias("mag"), F.element_at(p, -1).cast("double").alias("dist"))


def write_volumes(rows: DataFrame, path: str, column: str = "volume") -> None:
    """A folder for each volume (or route)."""
    rows.write.partitionBy(column).csv(path, header=True)


def read_scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Headerless page files ``num, mag, ref``; the reference may hold commas, be empty or stand in parentheses."""
    lines = spark.read.text(path).withColumn("page", F.regexp_extract(F.input_file_name(), r"page(\d+)", 1).try_cast("int"))
    p = F.split("value", ",", 3)
    return lines.select("page", F.trim(p[0]).try_cast("int").alias("num"), F.trim(F.get(p, 1)).alias("mag"), F.trim(F.get(p, 2)).alias("ref")).filter("num is not null")


def read_scan_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages of nested entries; the page comes from the file name where it is absent."""
    schema = "page int, decl int, first int, last int, dpl array<int>, color array<int>, dpl_uncertain array<int>, color_uncertain array<int>, notes array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.withColumn("page", F.coalesce("page", F.regexp_extract(F.input_file_name(), r"page(\d+)", 1).try_cast("int")))


def read_number_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``NNN`` or ``NNN ?``: number and whether it is uncertain."""
    rows = spark.read.text(path)
    return rows.select(F.regexp_extract("value", r"^\s*(\d+)", 1).try_cast("int").alias("number"), F.col("value").contains("?").alias("uncertain")).filter("number is not null")
