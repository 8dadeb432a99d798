"""The reference tables: what each line holds, which lines count, where a star is and at which equinox.

All of it is data, compiled to one projection and one filter. Positions stay in the table's own equinox; the
caller precesses them (functions/sky.precess).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.order import numbered
from skyloom.sources.fixed_width import Field, digits, leading_int, numbered_lines, parse, slice_

#: The faintest magnitude that isn't a code, and the codes.
FAINTEST, CODES = 12.1, {20.0: "nebula", 30.0: "variable", 40.0: "nova", 50.0: "cluster"}

Triple = tuple[tuple[int, int], tuple[int, int], tuple[int, int] | None, float]


@dataclass(frozen=True)
class Table:
    """``ra`` and ``dec``: (start, length) of the three parts and the divisor of the last one. ``side``: south, north, npd, spd, degrees, or the place of the sign."""

    epoch: float
    fields: list[Field] = field(default_factory=list)
    ra: Triple | None = None
    dec: Triple | None = None
    side: str | int = "south"
    keep: str = "true"
    exact: bool = True  #: blank digits read as 0; else numbers as they are printed, decimals included


def at(n: int) -> Triple:
    """h, m and hundredths of s from ``n`` on."""
    return ((n, 2), (n + 2, 2), (n + 4, 4), 100.0)


def dms(d: int, m: int, s: int, divisor: float = 10.0, width: int = 2) -> Triple:
    return ((d, width), (m, 2), (s, 3 if divisor == 10.0 else 4), divisor)


def _f(name: str, start: int, length: int, kind: str = "int", divisor: float = 1.0) -> Field:
    return Field(name, start, length, kind, divisor)


_ZONE = [_f("zone", 3, 3), _f("number", 6, 5), _f("supplement", 11, 1, "text"), _f("mag", 12, 4, "text")]
_THOME = lambda c: [_f("number", 1, 4 + c), _f("mag", 13 + c, 3, "decimal", 10.0), _f("pm_ra", 30 + c, 7, "text"), _f("pm_dec", 54 + c, 6, "text"), _f("ref_cat", 66 + c, 2, "text"), _f("ref_number", 68 + c, 5)]
_AGK = lambda mag, pos, num: [_f("agk", 8, 5), _f("mag", 13, mag, "text"), _f("number", num, 5, "text"), _f("mark", num + 5 if num != 60 else 66, 1, "text")]

#: Layouts, equinoxes and row rules of the reference tables.
TABLES: dict[str, Table] = {
    "ppm": Table(2000.0, [_f("ppm", 2, 6), _f("dm_sign", 10, 1, "text"), _f("dm_zone", 11, 2), _f("dm_number", 13, 5), _f("mag", 20, 4, "text"), _f("pm_ra", 56, 7, "text"), _f("pm_dec", 64, 6, "text"), _f("sao", 102, 6), _f("hd", 109, 6), _f("flag1", 127, 1, "text"), _f("flag2", 128, 1, "text"), _f("flag5", 131, 1, "text")], ((28, 2), (31, 2), (34, 6), 1.0), ((43, 2), (46, 2), (49, 5), 1.0), 42, exact=False),
    "cd": Table(1875.0, _ZONE, ((16, 2), (18, 2), (20, 4), 1.0), ((25, 2), (27, 4), None, 1.0), "south", "supplement <> 'D' AND coalesce(try_cast(mag AS double), 0) NOT IN (20, 40, 50)", exact=False),
    "bd": Table(1855.0, [_f("sign", 3, 1, "text"), _f("zone", 4, 2), *_ZONE[1:]], ((16, 2), (18, 2), (20, 4), 1.0), ((25, 2), (27, 4), None, 1.0), 24, "supplement NOT IN ('D', '*') AND coalesce(try_cast(mag AS double), 0) NOT IN (20, 40, 50)", exact=False),
    "sd": Table(1855.0, _ZONE, ((16, 2), (18, 2), (20, 4), 1.0), ((25, 2), (27, 6), None, 1.0), "south", "supplement = '' AND coalesce(try_cast(mag AS double), 0) NOT IN (20, 40, 50)", exact=False),
    "cpd": Table(1875.0, _ZONE, ((16, 2), (18, 2), (20, 4), 1.0), ((25, 2), (27, 6), None, 1.0), "south", "supplement = '' AND coalesce(try_cast(mag AS double), 0) NOT IN (20, 30)", exact=False),
    "gc": Table(1875.0, [_f("number", 1, 5), _f("observation", 6, 2), _f("mag", 8, 3, "decimal", 10.0), _f("mag_text", 8, 3, "text"), _f("type", 11, 1, "text"), _f("pm_ra", 24, 7, "text"), _f("pm_dec", 46, 6, "text")], at(16), dms(39, 41, 43), "south", "observation = 1"),
    "gc2": Table(1900.0, [_f("number", 8, 4), _f("observation", 12, 2), _f("mag", 14, 2), _f("mag_tenth", 16, 1), _f("sign", 44, 1, "text")], at(21), dms(45, 47, 49), "south", "observation <= 0 AND sign = '-'"),
    "weiss": Table(1850.0, [_f("weiss", 1, 5), _f("observation", 6, 1, "text"), _f("mag", 8, 2), _f("mag2", 10, 2), _f("oa", 49, 5)], at(13), dms(22, 24, 26), "south", "observation = '1' AND oa <> 0"),
    "lalande": Table(1800.0, [_f("number", 1, 5), _f("mag", 15, 2), _f("half", 17, 1, "text"), _f("ra_mark", 19, 1, "text"), _f("npd_mark", 32, 1, "text")], at(19), dms(32, 35, 37, width=3), "npd", "ra_mark <> '' AND npd_mark <> ''"),
    "stone1": Table(1880.0, [_f("number", 8, 5), _f("lacaille", 14, 4), _f("mag", 24, 1), _f("mag_tenth", 25, 1), _f("brisbane", 65, 4)], at(33)),
    "stone2": Table(1880.0, [_f("taylor", 49, 5)], None, dms(21, 24, 26, 100.0, 3), "npd"),
    "brisbane": Table(1825.0, [_f("number", 1, 4), _f("type", 20, 1, "text"), _f("mag", 21, 2), _f("mag2", 23, 2), _f("second_mark", 29, 1, "text"), _f("spd_mark", 55, 1, "text")], at(25), dms(50, 53, 55, width=3), "spd", "type <> 'N' AND second_mark <> '' AND spd_mark <> ''"),
    "taylor1": Table(1835.0, [_f("number", 7, 5), _f("ref_cat", 31, 3, "text"), _f("ref_number", 37, 5), _f("mag", 42, 2), _f("half", 44, 1, "text")], at(46)),
    "taylor2": Table(1835.0, [], None, dms(8, 10, 12, 100.0), 7),
    "usno": Table(1860.0, [_f("number", 1, 5), _f("double", 6, 1, "text"), _f("ref_cat", 19, 4, "text"), _f("ref_hour", 28, 2), _f("ref_number", 30, 5), _f("mag", 36, 3, "decimal", 10.0), _f("pm_ra", 54, 6, "text"), _f("pm_dec", 74, 5, "text")], at(40), dms(61, 63, 65), 60, "double = ''"),
    "gilliss": Table(1850.0, [_f("number", 1, 5), _f("double", 6, 1, "text"), _f("ref_cat", 15, 3, "text"), _f("ref_hour", 18, 2), _f("ref_number", 20, 5), _f("mag", 29, 3, "decimal", 10.0), _f("pm_ra", 41, 7, "text"), _f("pm_dec", 56, 5, "text")], at(33), dms(49, 51, 53), "south", "double = ''"),
    "gilliss1963": Table(1850.0, [_f("number", 1, 4), _f("ref_cat", 15, 3, "text"), _f("ref_number", 18, 5), _f("mag", 23, 2), _f("mag_tenth", 25, 1), _f("type", 26, 1, "text"), _f("second_mark", 31, 1, "text"), _f("dec_mark", 54, 1, "text")], at(27), dms(50, 52, 54), 49, "type <> 'N' AND second_mark RLIKE '[0-9]' AND dec_mark RLIKE '[0-9]'"),
    "thome1881": Table(1881.0, _THOME(0), at(20), dms(45, 47, 49)),
    "thome1882": Table(1882.0, _THOME(0), at(20), dms(45, 47, 49)),
    "thome1883": Table(1883.0, _THOME(-1), at(19), dms(44, 46, 48)),
    "thome1884": Table(1884.0, _THOME(-1), at(19), dms(44, 46, 48)),
    "wb": Table(1825.0, [_f("hour", 14, 2), _f("number", 6, 4), _f("mag", 10, 2), _f("mag2", 12, 2)], at(14), dms(31, 33, 35), 30),
    "oa_north": Table(1842.0, [_f("number", 1, 5), _f("mag", 6, 2), _f("mag2", 8, 2)], at(11), dms(20, 22, 24), "north"),
    "bac": Table(1850.0, [_f("number", 1, 4), _f("mag", 17, 1), _f("half", 18, 1, "text")], at(20), dms(48, 51, 53, width=3), "npd"),
    "agk_a": Table(1900.0, _AGK(2, 15, 57), at(15), dms(36, 38, 40), "south", "mark <> '-' AND number NOT LIKE '&%'"),
    "agk_b": Table(1900.0, _AGK(3, 16, 60), at(16), dms(37, 39, 41), "south", "mark <> '-' AND number NOT LIKE '&%'"),
    "agk_c": Table(1900.0, [*_AGK(2, 15, 59)[:3], _f("mark", 65, 1, "text")], at(15), dms(36, 38, 40), "south", "mark <> '-' AND number NOT LIKE '&%'"),
    "ua": Table(1875.0, [_f("flag", 1, 1, "text"), _f("gould", 3, 3), _f("constellation", 7, 3, "text"), _f("flamsteed", 11, 3, "text"), _f("bayer", 15, 8, "text"), _f("hd", 66, 6), _f("sao", 74, 6), _f("refs", 82, 17, "text"), _f("place", 101, 1, "text"), _f("mag", 120, 5, "text"), _f("type", 132, 3, "text")], ((100, 2), (103, 2), (106, 2), 1.0), ((111, 2), (114, 4), None, 1.0), 110, "place <> ''", exact=False),
    "bsc5": Table(2000.0, [_f("hr", 1, 4), _f("name", 5, 10, "text"), _f("hd", 26, 6), _f("sao", 32, 6), _f("ads", 45, 5, "text"), _f("variable", 52, 9, "text"), _f("place", 76, 2, "text"), _f("v", 103, 5, "text")], ((76, 2), (78, 2), (80, 4), 1.0), ((85, 2), (87, 2), (89, 2), 1.0), 84, "place <> ''", exact=False),
    "tycho2": Table(2000.0, [_f("tyc1", 1, 4), _f("tyc2", 6, 5), _f("tyc3", 12, 1), _f("pm_flag", 14, 1, "text"), _f("pm_ra", 42, 7, "text"), _f("pm_dec", 50, 7, "text"), _f("bt", 111, 6, "text"), _f("vt", 124, 6, "text"), _f("ra_deg", 153, 12, "text"), _f("dec_deg", 166, 12, "text"), _f("epoch_ra", 179, 4, "text"), _f("epoch_dec", 184, 4, "text")], side="degrees"),
    "tycho2_supplement": Table(2000.0, [_f("tyc1", 1, 4), _f("tyc2", 6, 5), _f("tyc3", 12, 1), _f("pm_flag", 14, 1, "text"), _f("ra_deg", 16, 12, "text"), _f("dec_deg", 29, 12, "text"), _f("pm_ra", 42, 7, "text"), _f("pm_dec", 50, 7, "text"), _f("bt", 84, 6, "text"), _f("vt", 97, 6, "text")], side="degrees"),
}


def _number(text: Column) -> Column:
    """The decimal number at the front of a text; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d*\.?\d+|[+-]?\d+)", 1).try_cast("double"), F.lit(0.0))


def _sum(value: str, parts: Triple, exact: bool) -> Column:
    """First + second / 60 + third / 3600."""
    out = F.lit(0.0)
    for place, scale in zip(parts[:3], (1.0, 60.0, 3600.0)):
        if place:
            last = place == parts[2]
            read = leading_int(digits(value, *place)).cast("double") if exact else _number(slice_(value, *place))
            out = out + read / (scale * (parts[3] if last else 1.0))
    return out


def stars(lines: DataFrame, name: str, value: str = "value") -> DataFrame:
    """The fields, ra and dec (degrees, equinox of the table) and epoch of the lines that count."""
    table = TABLES[name]
    out = parse(lines, table.fields).withColumn("epoch", F.lit(table.epoch))
    if table.side == "degrees":
        out = out.withColumns({"ra": F.col("ra_deg").try_cast("double"), "dec": F.col("dec_deg").try_cast("double")})
    else:
        if table.ra:
            out = out.withColumn("ra", _sum(value, table.ra, table.exact) * 15.0)
        if table.dec:
            size = _sum(value, table.dec, table.exact)
            sides = {"south": -size, "north": size, "npd": 90.0 - size, "spd": size - 90.0}
            out = out.withColumn("dec", sides[table.side] if isinstance(table.side, str) else F.when(slice_(value, table.side, 1) == "-", -size).otherwise(size))
    return out.filter(F.expr(table.keep))


def magnitude_code(mag: Column) -> Column:
    """What a printed magnitude over FAINTEST stands for: a code's name, or unknown, which no row should have; null for magnitudes."""
    code = F.lit("unknown")
    for value, name in CODES.items():
        code = F.when(F.abs(mag - value) < 0.1, name).otherwise(code)
    return F.when(mag > FAINTEST, code)


def ascending(stars: DataFrame, south: str, zone: str, line: str, name: str = "place") -> DataFrame:
    """``stars`` numbered from 0 by ascending zones, -1 and -0 before +0, and by their lines within one."""
    rank = F.when(F.col(south), -1 - F.abs(zone)).otherwise(F.abs(zone))
    keyed = stars.withColumn("_order", rank.cast("long") * (1 << 40) + F.col(line))
    return numbered(keyed, ["_order"], name).withColumn(name, F.col(name) - 1).drop("_order")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's file, with the line number of each star."""
    return stars(numbered_lines(spark, path), name)


def zipped(spark: SparkSession, first: str, second: str, names: tuple[str, str]) -> DataFrame:
    """Two files that describe the same stars line by line."""
    a = read(spark, first, names[0]).drop("value")
    return a.join(read(spark, second, names[1]).drop("value", "epoch"), "line")
