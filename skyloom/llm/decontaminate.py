"""Benchmark decontamination by spaced-seed hashing.

A seed looks at the words under the ones of a fixed mask and ignores those under its zeros. A document is contaminated
by an item if MIN_WORDS aligned words or more (the whole item, if it is shorter), of which the first and last agree,
agree in at least MIN_AGREE of their positions. The masks are chosen so that every such overlap holds a seed that
agrees: however a quarter of 13 words or more is changed, one of MASKS fits somewhere between the changes (the tests
find the least number of changes that no seed survives, by dynamic programming). Items of fewer than MIN_WORDS words
have shorter masks of their own, for which the same holds.

1. The seeds of all items are a table, and a filter of 2^FILTER_BITS bits (8 MB whatever the benchmark's size) says which
   hashes occur in it. The filter is broadcast; it only saves rows.
2. The corpus is read once. Each document gives its seeds that pass the filter and, if it has any, its text.
3. Seeds of both sides are joined on the hash; a pair of seeds is a diagonal of a document and an item. Diagonals
   are made distinct by partial aggregation; items join them, and documents stream through them.
4. On each diagonal both texts are laid side by side and the best stretch is taken.

Words are runs of letters and digits, A-Z in lower case; punctuation doesn't count.

Cases: null or empty texts match nothing, nor do items of one or two words, which are common text; a null item_id or
doc_id stays null in the result; repeated documents and items each get their rows; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import common as C
from skyloom.plans.lineage import release

MIN_WORDS = 13
MIN_AGREE = 0.75
#: Fixed masks by the length of items: of MIN_WORDS words and more, of 9 to 12, of 3 to 8.
MASKS = ("10111", "110011")
MEDIUM_MASKS = ("111",)
SHORT_MASKS = ("11",)
ALL_MASKS = (*MASKS, *MEDIUM_MASKS, *SHORT_MASKS)
FILTER_BITS = 26
SCHEMA = "doc_id long, item_id long, n_words long, n_agree long, first_word long"
_GAP = np.ones(256, bool)
_GAP[list(b"abcdefghijklmnopqrstuvwxyz0123456789") + list(range(128, 256))] = False


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the n + 1 offsets of the rows' words."""
    data = C.LOWER[data]
    n = len(data)
    gap = np.ones(n + 1, bool)
    gap[:n] = _GAP[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(~gap & (np.concatenate(([True], gap[:-1])) | first))
    end = np.flatnonzero(~gap[:n] & (gap[1:] | first[1:])) + 1
    return C.word_hashes(data, start, end), np.searchsorted(start, offsets)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of n words."""
    return MASKS if n >= MIN_WORDS else MEDIUM_MASKS if n > 8 else SHORT_MASKS if n > 2 else ()


def seeds(w: np.ndarray, rows: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seeds that lie within a row, and the word where each starts."""
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, ALL_MASKS.index(mask) * 0xD1B54A32D192ED03 % (1 << 64), np.uint64)
    for j, kept in enumerate(mask):
        if kept == "1":
            total += w[j : j + n] * np.uint64(pow(C.BASE_A, j + 1, 1 << 64))
    ends = np.repeat(rows[1:], np.diff(rows))
    at = np.flatnonzero(np.arange(n) + len(mask) <= ends[:n])
    return C.mix(total[at]), at


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.buffers(batch.column("text"))
        key = batch.column("b").to_numpy()
        for lo, hi in C.steps(offsets):
            w, rows = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            row = np.repeat(np.arange(hi - lo), np.diff(rows))
            own = np.array([",".join(masks_of(n)) for n in np.diff(rows).tolist()])
            for k, mask in enumerate(ALL_MASKS):
                h, at = seeds(w, rows, mask)
                fits = np.array([mask in x.split(",") for x in own], bool)[row[at]]
                h, at = h[fits], at[fits]
                arrays = [C.signed(h), key[lo:hi][row[at]], at - rows[row[at]], np.full(len(h), k)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["h", "b", "q", "k"])


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for a hash."""
    return h >> np.uint64(64 - FILTER_BITS), (h >> np.uint64(64 - 2 * FILTER_BITS)) & np.uint64((1 << FILTER_BITS) - 1)


def _filter(table: DataFrame) -> np.ndarray:
    """The bits of all hashes; their number is FILTER_BITS' alone."""
    low = F.lit((1 << FILTER_BITS) - 1)
    places = F.array(F.shiftrightunsigned("h", 64 - FILTER_BITS), F.shiftrightunsigned("h", 64 - 2 * FILTER_BITS).bitwiseAND(low))
    each = table.select(F.explode(places).alias("p"))
    bits = each.groupBy(F.shiftrightunsigned("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    at = np.arange(len(h))
    for k in (0, 1):
        place = _places(h[at])[k]
        at = at[(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def longest(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(agreeing, words, first) of the best stretch of ``least`` words or more, its ends agreeing, in which MIN_AGREE agree."""
    at = np.flatnonzero(same)
    if not len(at):
        return None
    # more by (1 - MIN_AGREE) for a word that agrees, less by MIN_AGREE for one that doesn't; in quarters, so exact
    unit = round(4 * MIN_AGREE)
    total = np.concatenate(([0], np.cumsum(np.where(same, 4 - unit, -unit))))
    ahead = np.maximum.accumulate(total[at + 1][::-1])
    last = len(at) - 1 - np.searchsorted(ahead, total[at], "left")  # the farthest end that makes up for the beginning
    words, agree = at[last] + 1 - at, last - np.arange(len(at)) + 1
    fits = np.flatnonzero(words >= least)
    if not len(fits):
        return None
    k = fits[np.lexsort((at[fits], -words[fits], -agree[fits]))[0]]
    return int(agree[k]), int(words[k]), int(at[k])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's text comes before its items; the best stretch of each item's diagonals."""
    row, doc, w = None, None, np.zeros(0, np.uint64)
    for batch in batches:
        data, offsets = C.buffers(batch.column("text"))
        head = batch.column("b").is_null().to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        for i in range(batch.num_rows):
            mine, bounds = words(text := data[offsets[i] : offsets[i + 1]], np.array([0, len(text)]))
            r = batch.column("r")[i].as_py()
            if head[i]:
                row, doc, w = r, (batch.column("doc_id")[i].as_py(), batch.column("t")[i].as_py()), mine
                continue
            assert r == row, "candidates without their document"
            n, best = int(bounds[-1]), None
            for d in sorted(batch.column("shifts")[i].as_py()):
                lo, hi = max(0, d), min(len(w), n + d)
                found = longest(w[lo:hi] == mine[lo - d : hi - d], min(MIN_WORDS, n))
                if found:
                    agree, size, first = found
                    best = max(best or (0, 0, 0), (agree, size, -(lo + first)))
                    if agree == n:  # shifts ascend: no later one is better
                        break
            if best:
                out.append((doc[0], batch.column("item_id")[i].as_py(), best[1], best[0], -best[2], doc[1]))
        columns = list(zip(*out)) if out else [[] for _ in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "item_id", "n_words", "n_agree", "first_word", "t"])


def contaminated(docs: DataFrame, benchmark: DataFrame, with_key: bool = False) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, n_words, n_agree, first_word (and t with ``with_key``)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = C.shared_table(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"), F.monotonically_increasing_id().alias("b")), "benchmark-items")
    table = C.shared_table(items.select("b", "text").mapInArrow(_item_seeds, "h long, b long, q long, k long"), "benchmark-seeds")
    masks = [ALL_MASKS[x.k] for x in table.select("k").distinct().collect()]  # four at most
    bits = spark.sparkContext.broadcast(_filter(table))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filled, number = bits.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            for lo, hi in C.steps(offsets):
                w, rows = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row = np.repeat(np.arange(hi - lo), np.diff(rows))
                found = []
                for mask in masks:
                    h, at = seeds(w, rows, mask)
                    hit = _passes(filled, h)
                    found.append((h[hit], at[hit]))
                h, at = (np.concatenate(x) if found else np.zeros(0, k) for x, k in zip(zip(*found) if found else ((), ()), (np.uint64, np.int64)))
                if len(h):
                    own = row[at]
                    some = np.unique(own)
                    none = pa.nulls(len(h), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(number + own), pa.array(C.signed(h)), pa.array(at - rows[own]), none, none, pa.nulls(len(h), pa.string())], names=names)
                    take, none = pa.array(some + lo), pa.nulls(len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(number + some), none, none, *(batch.column(c).take(take) for c in ("doc_id", "t", "text"))], names=names)
                number += hi - lo

    names = ["r", "h", "p", "doc_id", "t", "text"]
    found = C.shared_table(C.keyed(docs).mapInArrow(hits, "r long, h long, p long, doc_id long, t long, text string"), "benchmark-hits")
    pairs = found.filter("h is not null").select("h", "r", "p").join(table, "h").groupBy("r", "b").agg(F.collect_set(F.col("p") - F.col("q")).alias("shifts"))
    none = F.lit(None).cast("long")
    pairs = pairs.join(items, "b").select("r", "b", none.alias("doc_id"), none.alias("t"), "text", "item_id", "shifts")
    heads = found.filter("h is null").select("r", none.alias("b"), "doc_id", "t", "text", none.alias("item_id"), F.lit(None).cast("array<bigint>").alias("shifts"))
    both = heads.unionByName(pairs).repartition("r").sortWithinPartitions(F.col("r"), F.col("b").asc_nulls_first())
    out = C.shared_table(both.mapInArrow(_verified, SCHEMA + ", t long"), "contaminated")
    for x in (found, table, items):
        release(x)
    return out if with_key else out.drop("t")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, unchanged."""
    bad = contaminated(docs, benchmark, with_key=True).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    on = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).eqNullSafe(bad["_t"]) & docs["doc_id"].cast("long").eqNullSafe(bad["_id"])
    return docs.join(bad, on, "left_anti")
