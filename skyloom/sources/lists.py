"""Line-oriented lists of designations and remarks: DataFrames of (line_no, line) to keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.order import last_known

#: Discovery lists in their order of rank, and the sign each is quoted with.
STRUVE_LISTS = {"STF": "Σ ", "STFA": "Σ I ", "STFB": "Σ II "}
#: Rows of the first supplement, and fields (from 0) of the main table and the supplement.
SUPPLEMENT_ROWS = 17588
MAIN_FIELDS = {"ra": (2, 24), "de": (3, 25), "vt": (19,)}
SUPPLEMENT_FIELDS = {"ra": (2,), "de": (3,), "vt": (13,)}

#: Gould's last number in the first part of Serpens.
LAST_OF_PART_A = 49


def gould(lines: DataFrame) -> DataFrame:
    """hd, gould: of the rows marked G, the first in the file for each HD number."""
    cut = lambda at, n: F.trim(F.substring("line", at, n))
    rows = lines.filter(F.col("line").startswith("G")).select("line_no", cut(2, 4).alias("gould"), cut(65, 7).alias("hd"))
    rows = rows.filter((F.col("gould") != "") & F.col("hd").rlike("^[0-9]+$"))
    return rows.groupBy("hd").agg(F.min_by("gould", "line_no").alias("gould"))


def struve(pairs: DataFrame) -> DataFrame:
    """sao, struve: of the pairs (wds_name, SAO) the designation of least rank and number for each SAO number."""
    pattern = r"^(STF[AB]?)\s+([0-9]+)"
    rows = pairs.select(F.col("SAO").cast("long").alias("sao"), F.regexp_extract("wds_name", pattern, 1).alias("list"), F.regexp_extract("wds_name", pattern, 2).try_cast("int").alias("num"))
    rank, sign = (F.create_map(*[F.lit(x) for i, (k, v) in enumerate(STRUVE_LISTS.items()) for x in (k, (i, v)[j])]) for j in (0, 1))
    best = rows.filter("sao is not null and num is not null").groupBy("sao").agg(F.min(F.struct(rank[F.col("list")].alias("rank"), "num", "list")).alias("b"))
    return best.select("sao", F.concat(sign[F.col("b.list")], F.col("b.num").cast("string")).alias("struve"))


def remarks(lines: DataFrame) -> DataFrame:
    """hr, remarks: the remarks of each star as an array in file order, category first where there is one."""
    rows = lines.filter(F.length("line") >= 13).select("line_no", F.trim(F.substring("line", 2, 4)).alias("hr"), F.trim(F.substring("line", 8, 4)).alias("cat"), F.rtrim(F.expr("substring(line, 13)")).alias("txt"))
    rows = rows.filter(F.col("hr").rlike("^[0-9]+$") & (F.col("txt") != ""))
    text = F.when(F.col("cat") != "", F.concat_ws(" ", "cat", "txt")).otherwise(F.col("txt"))
    listed = F.array_sort(F.collect_list(F.struct("line_no", text.alias("x"))))
    return rows.groupBy(F.col("hr").cast("int").alias("hr")).agg(F.transform(listed, lambda x: x["x"]).alias("remarks"))


def bright(main: DataFrame, supplement: DataFrame, north: float, faintest: float = 7.5) -> DataFrame:
    """ra, de, vt of the stars south of ``north`` + 1 that aren't fainter; fields are split at bars, blank ones fall back.

    Of the supplement (line_no from 1, as numbered_lines gives) the first SUPPLEMENT_ROWS lines count.
    """

    def part(lines: DataFrame, fields: dict[str, tuple[int, ...]]) -> DataFrame:
        cells = F.split("line", r"\|")
        value = lambda places: F.coalesce(*[F.nullif(F.trim(F.get(cells, F.lit(p))), F.lit("")) for p in places]).cast("double")
        return lines.select(*[value(p).alias(k) for k, p in fields.items()])

    both = part(main, MAIN_FIELDS).unionByName(part(supplement.filter(F.col("line_no") <= SUPPLEMENT_ROWS), SUPPLEMENT_FIELDS))
    return both.filter((F.col("vt") <= faintest) & F.col("ra").isNotNull() & (F.col("de") < north + 1.0))


def magnitude_standards(lines: DataFrame) -> DataFrame:
    """id, ra, dec, place: the rows of 17 fields or more whose first one begins with a number over 0; ids may end in a letter.

    The sign of the declination is that of the text, so -0 degrees are south; ``place`` is the printed form.
    """
    cells = F.split(F.regexp_replace("line", r"[\r\n].*$", ""), ",")
    number = lambda i, kind="int": F.coalesce(F.regexp_extract(F.get(cells, F.lit(i)), r"^\s*([+-]?\d+)" if kind == "int" else r"^\s*([+-]?\d+\.?\d*|[+-]?\.\d+)", 1).try_cast(kind), F.lit(0).cast(kind))
    south = F.get(cells, F.lit(5)).startswith("-")
    rows = lines.filter((F.size(cells) >= 17) & (number(0) > 0))
    h, m, s, d, dm = (n.alias(k) for n, k in ((number(2), "h"), (number(3), "m"), (number(4), "s"), (F.abs(number(5)), "d"), (number(6, "double"), "dm")))
    rows = rows.select("line_no", F.get(cells, F.lit(0)).alias("id"), h, m, s, south.alias("south"), d, dm)
    size = F.expr("d + dm / 60.0D")
    place = F.format_string("%02dh %02dm %02ds %s%02d°%04.1f'", "h", "m", "s", F.when(F.col("south"), "-").otherwise("+"), "d", "dm")
    return rows.select("line_no", "id", F.expr("(h + m / 60.0D + s / 3600.0D) * 15").alias("ra"), F.when(F.col("south"), -size).otherwise(size).alias("dec"), place.alias("place"))


def gould_designations(lines: DataFrame, **cut: int) -> DataFrame:
    """line_no, number, constellation, name of the lines that have a place: Gould's number and constellation where the line is marked G, else Annonymous.

    Serpens has two parts under one abbreviation: its stars belong to part a up to the first line with number LAST_OF_PART_A, then to b;
    a line's meaning depends on those before it, which order.last_known carries along.
    """
    cutout = lambda at, n: F.substring("line", at, n)
    marked = F.substring(F.rpad("line", 1, " "), 1, 1) == "G"
    rows = lines.filter(~cutout(101, 1).isin("", " ")).select("line_no", marked.alias("g"), F.coalesce(F.regexp_extract(cutout(3, 3), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)).alias("n"), F.regexp_replace(cutout(7, 3), " ", "").alias("c"))
    serpens = F.col("g") & F.col("c").startswith("Ser")
    rows = last_known(rows, [], ["line_no"], F.when(serpens & (F.col("n") == LAST_OF_PART_A), F.lit("b")), "part", False, **cut)
    cst = F.when(serpens, F.concat(F.lit("Ser"), F.coalesce("part", F.lit("a")))).otherwise(F.col("c"))
    return rows.select("line_no", F.when(F.col("g"), F.col("n")).otherwise(0).alias("number"), F.when(F.col("g"), cst).alias("constellation"), F.when(F.col("g"), F.concat(F.col("n").cast("string"), F.lit("G "), cst)).otherwise("Annonymous").alias("name"))
