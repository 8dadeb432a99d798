"""Fixed-width tables: layouts are data, compiled to column expressions; sentinels become NULL here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.order import numbered_lines


@dataclass(frozen=True)
class Field:
    """A field at a 1-based start; kind: text, int, digits (blank and & read as 0), decimal (int with ``divisor``)."""

    name: str
    start: int
    length: int
    kind: str = "text"
    divisor: float = 1.0


def slice_(value: Column | str, start: int, length: int) -> Column:
    """Characters from ``start`` on; past the end it is empty."""
    return F.substring(value, start, length)


def digits(value: Column | str, start: int, length: int) -> Column:
    """The slice with blanks and & read as 0, cut lines included."""
    return F.translate(F.rpad(slice_(value, start, length), length, " "), " &", "00")


def leading_int(text: Column) -> Column:
    """The number at the front of a text after blanks; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def compile_field(f: Field, value: str = "value") -> Column:
    if f.kind == "text":
        return F.trim(slice_(value, f.start, f.length)).alias(f.name)
    if f.kind == "int":
        return leading_int(slice_(value, f.start, f.length)).alias(f.name)
    return (leading_int(digits(value, f.start, f.length)) / F.lit(f.divisor)).alias(f.name) if f.divisor != 1 else leading_int(digits(value, f.start, f.length)).alias(f.name)


def hours(value: str, start: int) -> Column:
    """Right ascension in degrees: h, m and hundredths of s at ``start``."""
    h, m, s = (leading_int(digits(value, start + a, n)) for a, n in ((0, 2), (2, 2), (4, 4)))
    return (h + m / 60.0 + s / 360000.0) * 15.0


def degrees(value: str, start: int, divisor: int) -> Column:
    """Degrees without sign: d, m and seconds in units of 1 / divisor at ``start``."""
    width = 3 if divisor == 10 else 4
    d, m, s = (leading_int(digits(value, start + a, n)) for a, n in ((0, 2), (2, 2), (4, width)))
    return d + m / 60.0 + s / (3600.0 * divisor)


def parse(lines: DataFrame, layout: list[Field]) -> DataFrame:
    """All columns of ``lines`` with the fields of the layout."""
    return lines.select("*", *[compile_field(f) for f in layout])


#: Layouts of the mapping tables between catalogues.
MAPPINGS: dict[str, list[Field]] = {
    "map4005": [Field("zone", 2, 3, "int"), Field("number", 6, 5, "int"), Field("code", 12, 1), Field("target_zone", 15, 3, "int"), Field("target_number", 19, 5, "int"), Field("target_code", 25, 1)],
    "map4011": [Field("cpd_zone", 11, 3, "int"), Field("cpd_number", 15, 5, "int"), Field("cd_zone", 23, 3, "int"), Field("cd_number", 27, 5, "int")],
    "map4019": [Field("cd_zone", 1, 3, "int"), Field("cd_number", 4, 5, "int"), Field("cpd_zone", 12, 3, "int"), Field("cpd_number", 15, 5, "int")],
}


def scan(spark: SparkSession, path: str, mapping: str) -> DataFrame:
    """A mapping table by its layout, with line numbers."""
    return parse(numbered_lines(spark, path), MAPPINGS[mapping])


def mag_flag(mag: Column) -> Column:
    """ok, unknown (0) or variable (over 29.9)."""
    return F.when(F.abs(mag) < 1e-5, "unknown").when(mag > 29.9, "variable").otherwise("ok")


def known_mag(mag: Column) -> Column:
    """The magnitude, NULL where it is a sentinel."""
    return F.when((F.abs(mag) >= 1e-5) & (mag <= 29.9), mag)
