"""Clean-up of transcribed text: references, numbers, single-digit repairs. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that are annotations; misread beginnings of a token; spellings of a reference's beginning.
ANNOTATION = r"^[a-z.…'’]+$"
MISREAD = ((r"^L[I1l]\.", "Ll."), (r"^0A\.", "OA."))
SPELLINGS = ((r"^Melb\.\s+I\.", "Melb.I."), (r"^O\.\s*A\.", "OA."), (r"^Z\.?\s*C\.", "ZC."), (r"^W\.?\s*B\.", "WB."))
#: Keywords of footnotes, whole or with the first letter cut off, and what may stand before their numbers.
FOOTNOTE = r"(?i)\b(Dpl|Color|pl|olor)\b[\s.:]*(?:N[ºo°]?\.?)?\s*(\d[\d\s,.]*)"


def squeeze(c: str) -> Column:
    """Runs of blanks become one; leading blanks go, a trailing one stays."""
    return F.ltrim(F.regexp_replace(c, " +", " "))


def _replaced(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        x = F.regexp_replace(x, F.lit(pattern), F.lit(to))
    return x


def clean(c: str) -> Column:
    """References put right: commas and blanks separate, annotations go, a blank follows each point, catalogues are spelled in one way; NULL is empty."""
    tokens = F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[,\s]+", " ")), " ")
    tokens = F.transform(F.filter(tokens, lambda x: ~x.rlike(ANNOTATION) & (x != "")), lambda x: _replaced(x, MISREAD))
    return F.trim(_replaced(F.regexp_replace(F.array_join(tokens, " "), r"\.(?=\S)", ". "), SPELLINGS))


def references(rows: DataFrame, ref: str, catalogues: dict[str, str]) -> DataFrame:
    """Usable references as (cat, num): not empty, no parenthesis, the catalogue by its prefix."""
    pattern = r"^([A-Za-z]+\.) *([0-9]+)$"
    prefix = F.regexp_extract(ref, pattern, 1)
    cat = F.lit(None).cast("string")
    for k, v in catalogues.items():
        cat = F.when(prefix == k, v).otherwise(cat)
    usable = rows.filter((F.col(ref) != "") & ~F.col(ref).contains("("))
    return usable.withColumns({"cat": cat, "num": F.regexp_extract(ref, pattern, 2).try_cast("long")})


def repair(text: str, lo: str, hi: str) -> Column:
    """The only number within [lo, hi] that differs in one digit (or none); NULL if there are more."""
    variants = F.expr(
        f"array_distinct(filter(flatten(transform(sequence(1, length({text})), i -> transform(sequence(0, 9), d -> "
        f"cast(concat(substring({text}, 1, i - 1), d, substring({text}, i + 1, length({text}))) AS int)))), n -> n BETWEEN {lo} AND {hi}))"
    )
    return F.when(F.size(variants) == 1, variants[0])


def numbers(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))


def footnotes(text: str, kind: str) -> Column:
    """The numbers right behind each keyword of ``kind``, dpl or color, as an array of text."""
    keys, runs = (F.regexp_extract_all(text, F.lit(FOOTNOTE), F.lit(k)) for k in (1, 2))
    mine = F.filter(F.arrays_zip(keys.alias("k"), runs.alias("r")), lambda x: F.lower(x["k"]).contains("pl") == (kind == "dpl"))
    return F.flatten(F.transform(mine, lambda x: F.regexp_extract_all(x["r"], F.lit("([0-9]+)"), F.lit(1))))


def plausible_span(text: str, limit: int, most: int) -> Column:
    """Width of the first range a-b if 1 <= a <= b <= limit and it isn't too wide."""
    a, b = (F.regexp_extract(text, "([0-9]+)-([0-9]+)", k).try_cast("int") for k in (1, 2))
    return F.when((a >= 1) & (a <= b) & (b <= limit) & (b - a <= most), b - a)
