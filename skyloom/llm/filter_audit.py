"""What each filter of a chain removes, in every order, from one pass over the words.

Words are exploded and aggregated to (document, word), then to the document: its words and its different words. The other
filters' verdicts come from the text itself and from the table of equal texts; an outer join puts all of them
into one number, a bit a filter. One aggregation with a conditional count for each of the 2^k numbers (32 for
five filters) says everything about all k! orders: which documents a step removes depends on nothing but the bits.

Texts go through one shuffle, by document; both aggregations of words use it again. Rows alike in id and text are one document
there, with a count. Equal texts are told by 128 bits of hashes; their least id is joined back to SALTS parts, so
that a text with a third of all rows meets it in many tasks, and rows without an id are spread by their text.

Cases: a null text is empty and has no words; a null source is the empty part; a null doc_id is no document's earlier copy, has none and no labels;
of two rows equal in id and text neither is a copy of the other, and both count; labels of one id are
taken together (one that says 1 is enough); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import common as C

#: The filters, a letter each, in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SIGNS = "[#$%&*|]"
#: Parts of each group of equal texts.
SALTS = 16


def word_totals(docs: DataFrame) -> DataFrame:
    """key, t, words, uniques of each document (key: its id, null as 0; t: its text's hash) that has words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), text.alias("text")).withColumn("t", F.xxhash64("text"))
    once = keyed.groupBy("key", "t").agg(F.first("text").alias("text"))
    words = once.select("key", "t", F.explode(F.split("text", r"[ \t-\r]+")).alias("word")).filter("word <> ''")
    each = words.groupBy("key", "t", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("key", "t").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("uniques"))


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, t, rows (how many are alike) and a boolean column for each filter: whether the document fails it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITALS_PERCENT * F.length("text")
    hashes = [F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u")]
    rows = base.select("doc_id", "part", *hashes, capitals.alias("C"), F.col("text").rlike(SIGNS).alias("D"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows"))
    rows = C.shared_table(rows, "audit-rows", small=True)
    ids = rows.groupBy("t", "u").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    ids = ids.select("t", "u", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.coalesce(F.pmod("doc_id", F.lit(SALTS)), F.lit(0)).cast("int"))
    rows = salted.join(ids, ["t", "u", "salt"], "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(0))).join(word_totals(docs), ["key", "t"], "left")
    words, uniques = (F.coalesce(c, F.lit(0)) for c in ("words", "uniques"))
    few, same = words < MIN_WORDS, 100 * uniques < MIN_DISTINCT_PERCENT * words
    return rows.select("doc_id", "part", "t", "rows", few.alias("A"), same.alias("B"), "C", "D", "E")


def counts(flags: DataFrame, labels: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row a part: arrays all, good and toxic with the documents of each number of failed filters' bits."""
    said = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.groupBy("_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    failed = sum(F.col(c).cast("int") * (1 << i) for i, c in enumerate(names))
    rows = flags.select("doc_id", "part", "rows", failed.alias("failed"), F.coalesce("doc_id", "t").alias("_key"))
    rows = rows.join(said, (F.col("_key") == F.col("_id")) & F.col("doc_id").isNotNull(), "left")
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    numbers = range(1 << len(names))
    cells = [F.sum(F.when((F.col("failed") == m) & kind, F.col("rows")).otherwise(0)).alias(f"{k}{m}") for k, kind in kinds.items() for m in numbers]
    return rows.groupBy("part").agg(*cells).select("part", *[F.array(*[f"{k}{m}" for m in numbers]).alias(k) for k in kinds])


def audit(flags: DataFrame, labels: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, with the documents kept, removed, redundant, lost and the Shapley count."""
    orders = ["".join(p) for p in permutations(names)]
    k = len(names)
    n = F.col("_i")
    order = F.get(F.lit(orders), F.floor(n / k).cast("int"))
    rows = counts(flags, labels, names).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(orders) * k - 1))))
    rows = rows.withColumns({"filter_order": order, "step": (n % k + 1).cast("int")})
    bit = f"shiftleft(1, instr('{names}', substring(filter_order, %s, 1)) - 1)"
    rows = rows.withColumn("own", F.expr(bit % "step"))
    rows = rows.withColumn("before", F.expr(f"aggregate(sequence(1, {k}), 0, (s, i) -> s + IF(i < step, {bit % 'i'}, 0))"))

    def total(kind: str, condition: str, value: str = "1") -> Column:
        """The documents of those numbers m for which the condition holds, each times ``value``."""
        return F.expr(f"aggregate(sequence(0, {(1 << k) - 1}), 0L, (s, m) -> s + IF({condition}, get(`{kind}`, m) * ({value}), 0L))")

    fails, late = "(m & own) <> 0", "(m & before) <> 0"
    here = f"{fails} and not {late}"
    out = {
        "kept": total("all", "(m & (own | before)) = 0"), "removed": total("all", here), "redundant": total("all", f"{fails} and {late}"), "unique_fails": total("all", "m = own"),
        "good_lost": total("good", here), "toxic_lost": total("toxic", here), "shapley": total("all", fails, f"{len(orders)} div bit_count(m)"),
    }
    return rows.select("part", "filter_order", "step", *[v.alias(c) for c, v in out.items()])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the five filters over whole texts."""
    return audit(flagged(docs), labels)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS tx FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(tx, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(tx, '[^A-Z]', '', 'g')) > 2 * length(tx) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(tx, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY tx) THEN 16 ELSE 0 END AS failed
  FROM w),
l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS bad FROM labels GROUP BY doc_id),
x AS (SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS g, coalesce(sum(bad), 0) AS b FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
orders AS (SELECT p.name || q.name || r.name || s.name || u.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND p.bit | q.bit | r.bit | s.bit | u.bit = 31),
steps AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0) AS earlier FROM orders, (SELECT unnest(generate_series(1, 5)) AS i)),
c AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN failed & (own + earlier)::INT = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & own <> 0 AND failed & earlier::INT = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & own <> 0 AND failed & earlier::INT <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & own <> 0 AND failed & earlier::INT = 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & own <> 0 AND failed & earlier::INT = 0 THEN b ELSE 0 END) AS toxic_lost
  FROM x, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM c
"""
