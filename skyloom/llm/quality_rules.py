"""Quality rules with thresholds that the data set, by DataFrame functions only.

Fixed rules reject what is never wanted (the base). The other thresholds follow each language and source:
mergeable quantile sketches of the document statistics are built by grouped aggregation, and a document is
rejected where a statistic lies beyond an outer fence of its group, a far multiple of the spread between
the quartiles behind the upper one. Groups with few documents take the fence of their language, and those
of rare languages the one of all documents. The spread counts as SPREADS at least: a group whose quartiles are closer than that has its
fence REACH times that floor behind the upper one, which for statistics that most documents have none of is the same
fence everywhere. The thresholds are a small table that is joined with the documents' statistics (not their texts).

Cases: a null or blank text has no words and fails the base rules; null lang or source form groups of their
own; repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import common as C

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Relative accuracy of the quantile sketches: 1 / SKETCH.
SKETCH = 1000
#: Documents below which a group takes the fence of the level above.
MIN_GROUP = 200
#: A fence lies so many quartile distances behind the upper quartile.
REACH = 6.0
#: Statistics with a fence, and the least distance between the quartiles that counts.
SPREADS = {"symbol_share": 0.005, "dup_line_share": 0.06, "repeat_share": 0.05, "caps_share": 0.01, "word_length": 0.1}
#: Different repeated windows of a document beyond which their places are found by sorting.
MANY = 32
_NO_SPACE = r"[^\x20\x09-\x0D]"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, t and the counts of each document, over its whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_NO_SPACE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    windows = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    )
    # a hash of each window of three words; those that stand next to an equal one once sorted occur again
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("windows", windows).withColumn("unlike", F.size(F.array_distinct("windows")) == F.size("windows"))
    # a hash of each window of three words; those that stand next to an equal one once sorted occur again
    rows = rows.withColumn("ordered", F.when(F.col("unlike"), none).otherwise(F.sort_array("windows")))
    rows = rows.withColumn("again", F.array_distinct(F.filter("ordered", lambda h, i: (i > 0) & (h == F.get("ordered", i - 1)))))
    # their places: by look-up where few windows occur again, else by sorting hashes with their places
    many = F.size("again") > MANY
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(many, placed))
    beside = lambda x, k: (x["h"] == F.coalesce(F.get("placed", k - 1)["h"], F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(F.get("placed", k + 1)["h"], F.bitwise_not(x["h"])))
    by_sort = F.transform(F.filter("placed", beside), lambda x: x["i"])
    by_look_up = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: F.array_contains("again", F.get("windows", i)))
    places = F.when(F.size("again") == 0, F.array().cast("array<int>")).when(many, by_sort).otherwise(by_look_up)
    rows = rows.withColumn("places", places)
    covered = F.array_distinct(F.flatten(F.transform("places", lambda i: F.array(i, i + 1, i + 2))))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.xxhash64("text").alias("t"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_caps"),
    )


def judged(stats: DataFrame) -> DataFrame:
    """``stats`` with base_failed and kept."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    shares = {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "caps_share": F.col("n_caps") / F.greatest(F.col("word_chars"), F.lit(1)),
        "word_length": F.col("word_chars") / words,
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stats.select("*", failed.alias("base_failed"), *[v.alias(k) for k, v in shares.items()])
    # one pass: a grouping set for each level; the sketches merge, so partial aggregation bounds what is shuffled
    levels = rows.filter(~F.col("base_failed")).groupingSets([["lang", "source"], ["lang"], []], "lang", "source")
    fences = levels.agg(
        F.grouping_id("lang", "source").alias("level"),
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(k, F.array(F.lit(0.25), F.lit(0.75)), SKETCH).alias(k) for k in SPREADS],
    )
    fence = lambda k: (F.col(k)[1] + REACH * F.greatest(F.lit(SPREADS[k]), F.col(k)[1] - F.col(k)[0])).alias(f"f_{k}")
    fences = fences.filter((F.col("n") >= MIN_GROUP) | (F.col("level") == 3)).select("lang", "source", "level", *map(fence, SPREADS))
    out = rows
    for level, keys in ((0, ["lang", "source"]), (1, ["lang"]), (3, [])):
        part = fences.filter(F.col("level") == level).select(*[F.col(k).alias(f"k_{k}") for k in keys], F.struct(*[f"f_{k}" for k in SPREADS]).alias(f"l{level}"))
        if keys:
            on = None
            for k in keys:
                same = out[k].eqNullSafe(part[f"k_{k}"])
                on = same if on is None else on & same
            out = out.join(part, on, "left").drop(*[f"k_{k}" for k in keys])
        else:  # one row
            out = out.join(F.broadcast(part.limit(1)), how="left")
    best = F.coalesce("l0", "l1", "l3")
    beyond = F.lit(False)
    for k in SPREADS:
        beyond = beyond | F.coalesce(F.col(k) > best[f"f_{k}"], F.lit(False))
    return out.select(*rows.columns, (~F.col("base_failed") & ~beyond).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each document: its statistics, base_failed and kept."""
    return judged(C.shared_table(statistics(docs), "quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged."""
    bad = quality_rules(docs).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    on = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).eqNullSafe(bad["_t"]) & docs["doc_id"].cast("long").eqNullSafe(bad["_id"])
    return docs.join(bad, on, "left_anti")
