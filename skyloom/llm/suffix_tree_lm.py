"""Language-model scores from a probabilistic suffix tree.

Tokens are words (A-Z in lower case) and one end for each text. The base score is a smoothed unigram of
tokens. The model reads a text as a stream of bytes, \\n\\n and then each token behind a space: a word is its bytes and
the space that closes it, the end is \\n. Each symbol's distribution depends on a context of up to DEPTH symbols before
it; the first HEAD symbols of a token look through the space into the word before (TAIL bytes of it), so a text's score
depends on the order of its words. A context stays in the tree if training has it at least MIN_COUNT times, whatever the size
of the corpus, and its distribution diverges from that of its suffix by more than MIN_DIVERGENCE nats over its
occurrences. The longest suffix in the tree is a symbol's state; distributions are smoothed with those of
the shorter states (Witten-Bell). The tree grows with the corpus, so it is never collected or broadcast: it is
a table, the probabilities of each depth come from those of the depth before by a join, and symbols look theirs
up by a join on context and symbol.

As in the base score, all words that training never saw are one token: the model gives it the share of
training tokens that are words seen once (Good-Turing), and spells the others with the rest.

So a token's score has two parts that repeat: the head,
by TAIL bytes before and HEAD symbols (a window), and the body, by the word. Both are counted by grouped
aggregation and scored once each; a step of texts keeps its words and windows by number, and only those numbers with
their counts and scores come back to it. No word is collected, however frequent.

Cases: a null or blank text is an end alone; a null doc_id counts as the text ''; repeated rows count as often
as they stand there; NUL bytes among the first HEAD symbols of a word add nothing; without training rows all counts are zero; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm import common as C
from skyloom.plans.lineage import release, settle

DEPTH = 6
TAIL = 2
#: Symbols of a token whose contexts reach beyond its opening; those behind see the word alone.
HEAD = 3
#: Occurrences of a context in training: an absolute count (one that occurs once can stay: its divergence decides,
#: which is summed over occurrences and so absolute, too). No share of the corpus is asked for.
MIN_COUNT = 1
MIN_DIVERGENCE = 8.0
#: Symbols: 256 bytes; the space closes a word and opens the next; the line feed ends a text and stands before it.
SYMBOLS = 256
#: Bytes of text that keep their words and windows together, and bytes that are cut into words at once.
STEP, CUT = 10_000_000, 1_000_000
_OPEN, _END = 32, 10
_END_HASH = np.uint64(C.BASE_B)
#: Added to the numbers of windows, which come after the words.
_WINDOWS = 1 << 30
PARTS = "kind int, w string, k long, step long, idx int, c long, header binary"
_SHORTER = "ctx & (shiftleft(1L, 8 * (d - 1)) - 1)"  # a context without its earliest byte


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, length, hash, document and the TAIL bytes before each token, ends of texts (empty slices) included."""
    out = []
    for lo, hi in C.steps(offsets, CUT):
        part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        s, e, rows = C.word_bounds(part, bounds)
        many = np.diff(rows)
        n, at = len(s) + len(many), np.arange(len(s)) + np.repeat(np.arange(len(many)), many)
        start, end, h = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, _END_HASH)
        start[at], end[at] = s, e
        if len(s):
            h[at] = C.word_hashes(part, s, e)
        before = np.full(n, _END << 8 | _END)
        follows = np.ones(n, bool)
        follows[rows[:-1] + np.arange(len(many))] = False
        p = np.flatnonzero(follows) - 1  # the tokens that have one behind them
        before[p + 1] = np.where(end[p] - start[p] > 1, part[end[p] - 2], _OPEN).astype(np.int64) << 8 | part[end[p] - 1]
        out.append((start + offsets[lo], (end - start).astype(np.int32), h, np.repeat(np.arange(lo, hi, dtype=np.int32), many + 1), before.astype(np.uint16)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _prefix(data: np.ndarray, start: np.ndarray, size: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """The first HEAD symbols of tokens, the closing one included, padded with zeros: one number each."""
    out = np.zeros(len(start), np.int64)
    padded = np.append(data, 0)
    for j in range(HEAD):
        symbol = np.where(j < size, padded[np.minimum(start + j, len(data))], np.where(j == size, np.where(is_end, _END, _OPEN), 0))
        out = out << 8 | symbol
    return out


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1])) + np.repeat(start - (ends - size), size)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each step a header (kind 2), a row for each of its words (kind 0) and one for each of its windows (kind 1)."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32

    def rows(kind: int, step: int, c: np.ndarray, w: pa.Array | None = None, k: np.ndarray | None = None, header: bytes | None = None) -> Iterator[pa.RecordBatch]:
        n = len(c)
        columns = [
            pa.array(np.full(n, kind, np.int32)), w if w is not None else pa.nulls(n, pa.string()), pa.array(k) if k is not None else pa.nulls(n, pa.int64()), pa.array(np.full(n, step)),
            pa.array(np.arange(n, dtype=np.int32)), pa.array(c.astype(np.int64)), pa.array([header], pa.binary()) if header else pa.nulls(n, pa.binary()),
        ]
        batch = pa.RecordBatch.from_arrays(columns, names=["kind", "w", "k", "step", "idx", "c", "header"])
        for a in range(0, n, 50_000):
            yield batch.slice(a, 50_000)

    for batch in batches:
        raw, offsets = C.buffers(batch.column("text"))
        ids, held = batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in C.steps(offsets, STEP):
            data, n = C.LOWER[raw[offsets[lo] : offsets[hi]]], hi - lo
            start, size, h, doc, before = tokens(data, offsets[lo : hi + 1] - offsets[lo])
            _, first, word = np.unique(h, return_index=True, return_inverse=True)
            start, size = start[first], size[first].astype(np.int64)
            del h
            prefix = _prefix(data, start, size, size == 0)
            order = np.argsort(prefix, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            word, prefix, start, size = rank[word], prefix[order], start[order], size[order]
            windows, window = np.unique(prefix[word] << 8 * TAIL | before, return_inverse=True)
            train = ~held[lo:hi][doc]
            # the step's tokens by word and window
            by = np.argsort(word * len(windows) + window)
            out = io.BytesIO()
            small = np.uint16 if n <= 1 << 16 else np.int32
            np.savez(out, ids=np.array(ids.slice(lo, n).fill_null(0)), none=np.array(ids.slice(lo, n).is_null().to_numpy(zero_copy_only=False)), held=held[lo:hi], per_word=np.bincount(word).astype(np.int32), shift=np.diff(window[by], prepend=0).astype(np.int32), doc=doc[by].astype(small))
            yield from rows(2, number, np.zeros(1, np.int64), header=out.getvalue())
            yield from rows(0, number, np.bincount(word[train], minlength=len(order)), w=_slices(data, start, size))
            yield from rows(1, number, np.bincount(window[train], minlength=len(windows)), k=windows)
            del word, window, windows, by, train, doc, before  # before the next step's
            number += 1


def _bodies(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the symbols of words behind the HEAD first, closings included: the depth of their longest context, words, contexts, symbols."""
    data, offsets = C.buffers(column)
    lengths = np.diff(offsets)
    sym = np.full(len(data) + 2 * len(lengths), _OPEN, np.uint64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    sym[np.arange(len(data)) + 2 * row + 1] = data
    begin = offsets[:-1] + 2 * np.arange(len(lengths))
    for depth in range(HEAD + 1, DEPTH + 1):
        # one place for each depth, and all that follow for the greatest
        more = np.maximum(lengths + 2 - depth, 0)
        more = more if depth == DEPTH else np.minimum(more, 1)
        word = np.repeat(np.arange(len(lengths)), more)
        place = np.repeat(begin + depth, more) + np.arange(len(word)) - np.repeat(np.cumsum(more) - more, more)
        key = np.zeros(len(place), np.uint64)
        for d in range(depth, 0, -1):
            key = key << np.uint64(8) | sym[place - d]
        yield depth, word, key, sym[place]


def _heads(k: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the HEAD places of windows: the depth of its longest context, which windows have it, contexts and symbols."""
    prefix, key = k.astype(np.uint64) >> np.uint64(8 * TAIL), k.astype(np.uint64) & np.uint64((1 << 8 * TAIL) - 1)
    key = key << np.uint64(8) | np.uint64(_OPEN)
    for j in range(HEAD):
        symbol = prefix >> np.uint64(8 * (HEAD - 1 - j)) & np.uint64(255)
        at = np.flatnonzero(symbol)
        depth = min(DEPTH, TAIL + 1 + j)
        yield depth, at, key[at] & _mask(depth), symbol[at]
        key = key << np.uint64(8) | symbol


def _mask(depth: int) -> np.uint64:
    return np.uint64((1 << 8 * depth) - 1)


def _grams(depth: int, key: np.ndarray, symbol: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of (context, symbol) for the longest contexts and all their suffixes."""
    packed = key << np.uint64(8) | symbol
    for d in range(depth, -1, -1):
        packed, inverse = np.unique(packed & _mask(d + 1), return_inverse=True)
        weights = np.bincount(inverse, weights, len(packed))
        arrays = [np.full(len(packed), d, np.int32), C.signed(packed >> np.uint64(8)), (packed & np.uint64(255)).astype(np.int32), weights.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["d", "ctx", "sym", "n"])


def _head_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.column("c").to_numpy().astype(float)
        for depth, at, key, symbol in _heads(batch.column("k").to_numpy()):
            yield from _grams(depth, key, symbol, c[at])


def _body_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 40_000):
            batch = whole.slice(a, 40_000)
            c = batch.column("c").to_numpy().astype(float)
            for depth, word, key, symbol in _bodies(batch.column("w")):
                yield from _grams(depth, key, symbol, c[word])


def _packed(depth: int, key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Depth, context and symbol in one number."""
    return C.signed(np.uint64(depth << 8 * DEPTH + 8) | key << np.uint64(8) | symbol)


def _head_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.column("k").to_numpy()
        for depth, at, key, symbol in _heads(k):
            yield pa.RecordBatch.from_arrays([pa.array(_packed(depth, key, symbol)), pa.array(k[at])], names=["k", "h"])


def _body_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 40_000):
            batch = whole.slice(a, 40_000)
            for depth, word, key, symbol in _bodies(batch.column("w")):
                yield pa.RecordBatch.from_arrays([pa.array(_packed(depth, key, symbol)), batch.column("h").take(pa.array(word))], names=["k", "h"])


def counted(words: DataFrame, windows: DataFrame) -> DataFrame:
    """d, ctx, sym, n: how often training has each symbol behind each context; 0 where only held-out texts have it."""
    gram = "d int, ctx long, sym int, n long"
    counts = windows.select("k", "c").mapInArrow(_head_grams, gram).unionByName(words.filter("c > 0").select("w", "c").mapInArrow(_body_grams, gram))
    return C.shared_table(counts.groupBy("d", "ctx", "sym").agg(F.sum("n").alias("n")), "tree-counts", by="d")


def tree(counts: DataFrame) -> list[DataFrame]:
    """By depth: ctx, sym, n, total, stays (whether the context is in the tree) and p, the smoothed probability.

    A context has SYMBOLS rows at most, so the windows over it are small whatever the corpus.
    """
    out: list[DataFrame] = []
    own = Window.partitionBy("ctx")
    for d in range(DEPTH + 1):
        rows = counts.filter(F.col("d") == d).select("ctx", "sym", "n", F.sum("n").over(own).alias("total"), F.count_if(F.col("n") > 0).over(own).alias("u"))
        if d:
            up = out[-1].select(F.col("ctx").alias("pctx"), "sym", F.col("n").alias("pn"), F.col("total").alias("ptotal"), F.col("p").alias("pp"))
            rows = rows.withColumn("pctx", F.expr(_SHORTER.replace("d - 1", str(d - 1)))).join(up.hint("shuffle_hash"), ["pctx", "sym"])
            gain = F.when(F.col("n") > 0, F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("pn") / F.col("ptotal"))))
            stays = (F.col("total") >= MIN_COUNT) & (F.coalesce(F.sum(gain).over(own), F.lit(0.0)) >= MIN_DIVERGENCE)
        else:
            rows, stays = rows.withColumn("pp", F.lit(1.0 / SYMBOLS)), F.lit(True)
        rows = rows.withColumn("stays", stays)
        p = F.when(F.col("stays"), (F.col("n") + F.col("u") * F.col("pp")) / (F.col("total") + F.col("u"))).otherwise(F.col("pp"))
        # without training nothing follows the empty context
        out.append(C.shared_table(rows.select("ctx", "sym", "n", "total", "stays", F.coalesce(p, F.col("pp")).alias("p")), "tree-depth"))
    return out


def _longest(depth: int, table: DataFrame) -> DataFrame:
    """k (as in _packed) and lp, the log10 probability of the symbol, where contexts of this depth are the longest."""
    if depth < DEPTH:  # the word before begins them, or the opening
        table = table.filter(f"{_OPEN} in (shiftright(ctx, {8 * (depth - TAIL - 1)}) & 255, shiftright(ctx, {8 * (depth - 1)}) & 255)")
    return table.select(F.expr(f"shiftleft({depth}L, {8 * DEPTH + 8}) | shiftleft(ctx, 8) | sym").alias("k"), F.log10("p").alias("lp"))


def token_scores(words: DataFrame, windows: DataFrame, new: float) -> tuple[DataFrame, DataFrame]:
    """(w, c, lp): of each word its count and what its body adds, or an unseen word's score; (k, lp): what each window adds."""
    each = words.withColumn("h", F.xxhash64("w"))
    counts = counted(words, windows)
    depths = tree(counts)
    release(counts)
    longest = reduce(DataFrame.unionByName, [_longest(d, depths[d]) for d in range(TAIL + 1, DEPTH + 1)])
    summed = lambda keys: keys.join(longest.hint("shuffle_hash"), "k").groupBy("h").agg(F.sum("lp").alias("lp"))
    bodies = summed(each.filter("c > 0").select("w", "h").mapInArrow(_body_keys, "k long, h long"))
    heads = summed(windows.select("k").mapInArrow(_head_keys, "k long, h long"))
    known = F.lit(float(np.log10(1 - new))) + F.coalesce(F.col("lp"), F.lit(0.0))
    lp = F.when(F.col("c") > 0, known).otherwise(F.lit(float(np.log10(new))))
    out = C.shared_table(each.join(bodies, "h", "left").select("w", "c", lp.alias("lp")), "lm-words-scored")
    heads = C.shared_table(heads.withColumnRenamed("h", "k"), "lm-windows-scored")
    for x in depths:
        release(x)
    return out, heads


def _summed(batches: Iterator[pa.RecordBatch], shift: float, total: int) -> Iterator[pa.RecordBatch]:
    """Steps come back whole and in order: the header, the words by number, the windows by number."""
    header, parts = None, []

    def flush() -> pa.RecordBatch:
        z = np.load(io.BytesIO(header))
        place, c, lp = (np.concatenate([x[i] for x in parts]) for i in range(3))
        words = int(np.searchsorted(place, _WINDOWS))
        word, window = np.repeat(np.arange(words), z["per_word"]), np.cumsum(z["shift"])
        known = c[:words] > 0
        score = lp[:words][word] + np.where(known[word], lp[words:][window], 0.0)
        n = len(z["ids"])
        add = lambda v: np.bincount(z["doc"], v, n)
        size = np.bincount(z["doc"], minlength=n)
        base = add(np.log10(c[:words] + 0.5)[word]) - size * shift
        arrays = [pa.array(z["ids"], pa.int64(), mask=z["none"]), pa.array(z["held"]), pa.array(size), pa.array(add(known[word].astype(float)).astype(np.int64)), pa.array(np.full(n, total)), pa.array(base), pa.array(add(score))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    for batch in batches:
        place = batch.column("place").to_numpy()
        heads = np.flatnonzero(place == -1).tolist()
        c, lp = batch.column("c").to_numpy(), batch.column("lp").to_numpy(zero_copy_only=False)
        at = 0
        for h in [*heads, batch.num_rows]:
            if h > at:
                parts.append((place[at:h], c[at:h], lp[at:h]))
            if h < batch.num_rows:
                if header is not None:
                    yield flush()
                header, parts, at = batch.column("header")[h].as_py(), [], h + 1
    if header is not None:
        yield flush()


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = C.keyed(docs).select("doc_id", "text", (F.crc32(key) % 5 == 1).alias("held_out"))
    parts = C.shared_table(rows.mapInArrow(_count, PARTS), "lm-steps")
    words = C.shared_table(parts.filter("kind = 0").groupBy("w").agg(F.sum("c").alias("c")), "lm-words")
    windows = C.shared_table(parts.filter("kind = 1").groupBy("k").agg(F.sum("c").alias("c")), "lm-windows")
    n, v, once = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    scored, heads = token_scores(words, windows, (once + 1) / (n + 2))
    release(words)
    release(windows)
    settle(docs.sparkSession)
    none = F.lit(None).cast("binary").alias("header")
    back = C.shared_table(parts.filter("kind = 0").select("w", "step", "idx").join(scored.hint("shuffle_hash"), "w").select("step", F.col("idx").alias("place"), "c", "lp"), "lm-words-back")
    more = parts.filter("kind = 1").select("k", "step", "idx").join(heads.hint("shuffle_hash"), "k").select("step", (F.col("idx") + _WINDOWS).alias("place"), F.lit(0).cast("long").alias("c"), "lp")
    more = C.shared_table(more, "lm-windows-back")
    release(scored)
    release(heads)
    settle(docs.sparkSession)
    first = parts.filter("kind = 2").select("step", F.lit(-1).alias("place"), "c", F.lit(0.0).alias("lp"), "header")
    shift = float(np.log10(n + 0.5 * (v + 1)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(batches, shift, n)

    together = first.unionByName(back.withColumn("header", none)).unionByName(more.withColumn("header", none)).repartition("step").sortWithinPartitions("step", "place")
    return together.mapInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
