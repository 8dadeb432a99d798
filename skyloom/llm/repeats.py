"""Every window of W symbols that occurs again anywhere in a corpus, found exactly.

1. Anchors. Of the K-grams inside a window of W symbols the one with the least hash (the first one
   on ties) is the window's anchor. It depends on the window's content alone, so equal windows have
   equal anchors at equal places. The windows of one anchor are consecutive; they and the text they
   cover make one row, a *context*: about one for each W / 2 symbols.
2. Rows are counted by (anchor, context) with partial aggregation. A context found twice has all its
   windows repeated. An anchor with one context, found once, has none.
3. What is left are anchors with several different contexts, at least one of them found once: the
   edges of repeated text. One text of each such context is fetched and a solver (suffix sorting
   for bytes, factoring for words) decides window by window. Equal windows share their
   anchor, so the contexts of an anchor are solved together and no others are needed.
4. An anchor whose contexts may have more than HOT_SYMBOLS symbols isn't solved in one task. Its windows
   are hashed and counted as rows of their own, with partial aggregation, at any size.

Step 2 takes contexts for equal whose anchor and context hashes agree, step 4 windows whose two hashes agree: 128
bits each. Step 3 compares the symbols themselves (bytes, or words by their 64-bit hashes).

Each step's tables are dropped once the next step has its own, so disk holds one shuffle of the texts and
the rows of one step at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import common as C
from skyloom.plans.lineage import release, settle

#: Symbols of one anchor's contexts that a task may take; beyond, its windows become rows.
HOT_SYMBOLS = 1_500_000
#: Bytes of contexts that a solver gets at once, whole anchors apart.
SOLVE_BYTES = 800_000
#: Low bits of a packed (hash, place): the same for steps of any length, so equal windows choose equal anchors everywhere.
PLACE_BITS = np.uint64(32)
CONTEXT_SCHEMA = "h long, c long, od long, doc_id long, t long, s long"
SPAN_SCHEMA = "doc_id long, t long, lo long, hi long"


@dataclass(frozen=True)
class Kind:
    """What a symbol is, and the window and anchor lengths in symbols."""

    words: bool
    window: int
    gram: int

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The symbols of a step's rows, the n + 1 offsets of the rows, and word bounds."""
        if not self.words:
            return C.BYTE_SYMBOLS[data], offsets, ()
        start, end, rows = C.word_bounds(data, offsets)
        return C.word_hashes(data, start, end), rows, (start, end)


def contexts(sym: np.ndarray, offsets: np.ndarray, kind: Kind) -> dict[str, np.ndarray]:
    """The contexts of the rows: row number, anchor hash h, context hash c, first window s, od."""
    w_all, k = kind.window, kind.gram
    lengths = np.diff(offsets)
    rows = np.flatnonzero(lengths >= w_all)
    none = {x: np.zeros(0, np.int64) for x in ("row", "h", "c", "s", "od")}
    if not len(rows):
        return none
    a = C.Roll(sym, C.BASE_A)
    at = np.arange(len(sym) - k + 1)
    grams = a(at, at + k)
    keys = ((grams >> PLACE_BITS) << PLACE_BITS) | at.astype(np.uint64)
    width = w_all - k + 1
    least = _sliding_min(keys, width)
    counts = lengths[rows] - w_all + 1
    ends = np.cumsum(counts)
    row_of = np.repeat(rows, counts)
    starts = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(offsets[rows], counts)
    anchor = (least[starts] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row_of[1:] != row_of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    s, e, row, anchor = starts[first], starts[last], row_of[first], anchor[first]
    od = ((anchor - s) << 32) | (e - s)
    c = C.mix(C.Roll(sym, C.BASE_B)(s, e + w_all) + od.astype(np.uint64))
    return {"row": row, "h": C.signed(grams[anchor]), "c": C.signed(c), "s": s - offsets[row], "od": od}


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values; one value for each place (places near the end see fewer)."""
    n = len(x)
    blocks = -(-n // width)
    pad = np.full((blocks + 1) * width, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    grid = pad.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : n + width - 1])


def _emit(kind: Kind) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            ids, t = batch.column("doc_id"), batch.column("t")
            for lo, hi in C.steps(offsets):
                sym, rows, _ = kind.symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                x = contexts(sym, rows, kind)
                take = pa.array(x["row"] + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["h"]), pa.array(x["c"]), pa.array(x["od"]), ids.take(take), t.take(take), pa.array(x["s"])],
                    names=["h", "c", "od", "doc_id", "t", "s"],
                )

    return run


def _slices(kind: Kind) -> Callable:
    """Cut the wanted contexts out of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            want = batch.column("want")
            where, flat = want.value_lengths().to_numpy(zero_copy_only=False), want.flatten()
            ask = np.repeat(np.arange(len(want)), where)
            s, od = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("s", "od"))
            last = s + (od & 0xFFFFFFFF) + kind.window
            pieces = []
            cached, bounds = -1, ()
            for i, row in enumerate(ask.tolist()):
                base = offsets[row]
                if not kind.words:
                    pieces.append(data[base + s[i] : base + last[i]].tobytes())
                    continue
                if row != cached:
                    text = data[base : offsets[row + 1]]
                    cached, bounds = row, C.word_bounds(text, np.array([0, len(text)]))
                pieces.append(data[base + bounds[0][s[i]] : base + bounds[1][last[i] - 1]].tobytes())
            take = pa.array(ask)
            yield pa.RecordBatch.from_arrays(
                [flat.field("h"), flat.field("n"), flat.field("g"), pa.array(od), batch.column("doc_id").take(take), batch.column("t").take(take), pa.array(s), pa.array(pieces, pa.binary())],
                names=["h", "n", "g", "od", "doc_id", "t", "s", "piece"],
            )

    return run


def _solve(kind: Kind, solver: Callable) -> Callable:
    """Give the solver whole anchors, a bounded number of bytes at a time; rows come sorted by h."""

    def work(table: pa.Table) -> pa.RecordBatch:
        data, offsets = C.buffers(table.column("piece"))
        sym, rows, _ = kind.symbols(data, offsets)
        windows = (table.column("od").to_numpy() & 0xFFFFFFFF) + 1
        repeated = solver(data, sym, rows, windows, kind.window)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], repeated, [False])).astype(np.int8)))
        # a run of repeated windows never crosses rows: split it where rows begin
        begins = np.concatenate(([0], np.cumsum(windows)))
        lo, hi = edge[::2], edge[1::2]
        row_lo, row_hi = np.searchsorted(begins, lo, "right") - 1, np.searchsorted(begins, hi, "left") - 1
        many = row_hi - row_lo + 1
        row = np.repeat(row_lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        lo = np.maximum(np.repeat(lo, many), begins[row]) - begins[row]
        hi = np.minimum(np.repeat(hi, many), begins[row + 1]) - 1 - begins[row]
        once = table.column("n").to_numpy()[row] == 1
        row, lo, hi = row[once], lo[once], hi[once]
        s = table.column("s").to_numpy()[row]
        take = pa.array(row)
        ids, t = table.column("doc_id").combine_chunks().take(take), table.column("t").combine_chunks().take(take)
        return pa.RecordBatch.from_arrays([ids, t, pa.array(s + lo), pa.array(s + hi)], names=["doc_id", "t", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            cuts = np.flatnonzero(np.diff(h)) + 1
            if held and h[0] != held[-1].column("h")[-1].as_py():
                cuts = np.concatenate(([0], cuts))
            _, offsets = C.buffers(batch.column("piece"))
            done = 0
            for cut in cuts.tolist():
                if size + offsets[cut] - offsets[done] >= SOLVE_BYTES and (held or cut > done):
                    yield work(pa.Table.from_batches([*held, batch.slice(done, cut - done)]))
                    held, size, done = [], 0, cut
            held.append(batch.slice(done))
            size += int(offsets[-1] - offsets[done])
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _windows(kind: Kind) -> Callable:
    """The windows of very frequent anchors as rows: two hashes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffers(batch.column("piece"))
            for lo, hi in C.steps(offsets):
                sym, rows, _ = kind.symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                many = (batch.column("od").to_numpy()[lo:hi] & 0xFFFFFFFF) + 1
                row = np.repeat(np.arange(hi - lo), many)
                k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = rows[row] + k
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(C.signed(C.Roll(sym, b)(at, at + kind.window))) for b in (C.BASE_A, C.BASE_B)]
                    + [batch.column(x).take(take) for x in ("n", "doc_id", "t")]
                    + [pa.array(batch.column("s").to_numpy()[row + lo] + k)],
                    names=["a", "b", "n", "doc_id", "t", "lo"],
                )

    return run


def repeated_windows(docs: DataFrame, kind: Kind, solver: Callable, label: str) -> DataFrame:
    """doc_id, t, lo, hi: the windows that start at lo to hi occur again. ``docs`` comes from keyed()."""
    spark = docs.sparkSession
    rows = C.shared_table(docs.mapInArrow(_emit(kind), CONTEXT_SCHEMA), f"{label}-contexts")
    key = ["h", "c", "od"]
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "t", "s")).alias("r"))
    # the text of a context found twice is needed only beside one found once: its place is kept, its rows are done
    counted = C.shared_table(counted, f"{label}-counted")
    sure = rows.join(counted.filter("n > 1").select(*key), key, "left_semi")
    sure = sure.select("doc_id", "t", F.col("s").alias("lo"), (F.col("s") + F.col("od").bitwiseAND(F.lit(0xFFFFFFFF))).alias("hi"))
    sure = C.shared_table(sure, f"{label}-sure")
    release(rows)
    # contexts of an anchor and the least frequent of them, again with partial aggregation
    split = counted.groupBy("h").agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("least")).filter("g > 1 and least = 1").select("h", "g")
    wanted = counted.join(split, "h").select("r.doc_id", "r.t", F.struct(F.col("r.s").alias("s"), "od", "h", "n", "g").alias("w"))
    wanted = C.shared_table(wanted.groupBy("doc_id", "t").agg(F.collect_list("w").alias("want")), f"{label}-wanted")
    release(counted)
    d, w = docs.alias("d"), wanted.alias("w")
    pieces = d.join(w, F.col("d.t").eqNullSafe(F.col("w.t")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.doc_id", "d.t", "d.text", "w.want")
    pieces = pieces.mapInArrow(_slices(kind), "h long, n long, g long, od long, doc_id long, t long, s long, piece binary")
    settle(spark)
    pieces = C.shared_table(pieces, f"{label}-pieces")
    release(wanted)
    most = HOT_SYMBOLS // (2 * kind.window - kind.gram)
    few = pieces.filter(F.col("g") <= most).repartition("h").sortWithinPartitions("h")
    solved = few.mapInArrow(_solve(kind, solver), SPAN_SCHEMA)
    hot = pieces.filter(F.col("g") > most).mapInArrow(_windows(kind), "a long, b long, n long, doc_id long, t long, lo long")
    again = hot.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).filter("m > 1 or n > 1").select("a", "b")
    hot = hot.filter("n = 1").join(again, ["a", "b"], "left_semi").select("doc_id", "t", "lo", F.col("lo").alias("hi"))
    more = C.shared_table(solved.unionByName(hot), f"{label}-solved")
    release(pieces)
    settle(spark)
    return sure.unionByName(more)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with ``spans``, the different (lo, hi) of each row, which repeated rows share; null where there is none."""
    lists = spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    d, s = docs.alias("d"), lists.alias("s")
    on = F.col("d.t").eqNullSafe(F.col("s.t")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
    return d.join(s, on, "left").select("d.doc_id", "d.text", "s.spans")


def merged(spans: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal covered runs (start, end) of windows that start at lo to hi."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"] + window) for x in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
