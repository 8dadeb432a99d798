"""Groups of spelling variants: words one edit apart, found by merging the light subtrees of a trie.

The words (each with an end mark) form a trie. At every node the child with most words is heavy, the others are light, so a
word has at most log2(words) light edges on its path. For each light edge, and no other, the word is copied into the node's
errata tries: with its character replaced by the heavy one or by a wildcard, with its character skipped, and
with the heavy character put before it. Where a copy ends at a word, or two wildcard copies end together, the words
are one edit apart. Of two words that part at a node one at least leaves by a light edge, and an edit at a run of
equal characters is read at the run's last one, so each pair is found, and found once.

In Spark: nodes are hashes of prefixes, subtree sizes are a partial aggregation, heavy children are joined back to edges, copies are
joined with the words themselves. A hash that two prefixes share only makes more copies: words meet by their
strings. A wildcard group has one word a letter of the alphabet at most (ALPHABET), so its best two words serve all of it and
no pairs are listed. Nodes with HOT words or more (the root, common beginnings) are broadcast if there are at
most MAX_HOT of them, else left to the sort-merge join; all others are joined by hash.

Each word's form is the near word that is most frequent, if at least RATIO times as frequent as the word; roots follow
forms to the last by pointer jumping (counts double at each step, so chains are short), salted where a root is shared by many.

Cases: a null text has no words; a null doc_id counts as an empty string in the damage rule; repeated rows count twice; ties
go to the least word in code-point order; a text or a word of any length is read whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import common as C
from skyloom.plans.lineage import release

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: a-z and U+00C0 to U+00FF.
ALPHABET = 90
#: Words below a node from which it is broadcast, and how many such nodes may be.
HOT, MAX_HOT = 100_000, 20_000
SALTS = 16
#: Different words that a task counts before it sends them on.
HELD = 200_000
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: The lead byte of U+00C0 to U+00FF in UTF-8.
_LEAD = 0xC3


def _damaged(word: bytes, doc: int, rate: int) -> bytes:
    """``word`` without the character that its checksum in the document picks, for one of ``rate`` words."""
    h = zlib.crc32(word, doc)
    if h % rate:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _pieces(text: bytes, lo: int, hi: int) -> Iterator[bytes]:
    """``text[lo:hi]`` in pieces of about STEP_BYTES that end at a blank."""
    while lo < hi:
        end = hi if hi - lo <= C.STEP_BYTES else text.find(b" ", lo + C.STEP_BYTES, hi)
        end = hi if end < 0 else end
        yield text[lo:end]
        lo = end


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int = 0) -> DataFrame:
    """word, n: the runs of letters, A-Z in lower case. ``damage``: one word of a document in so many loses a character, as a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in C.steps(offsets):
                raw = C.LOWER[data[offsets[lo] : offsets[hi]]]
                lead = raw == _LEAD
                keep = _LETTER[raw] | lead
                keep[1:] |= lead[:-1]
                raw[~keep] = 32
                text, at = raw.tobytes(), (offsets[lo : hi + 1] - offsets[lo]).tolist()
                for i in range(hi - lo):
                    doc = zlib.crc32(b"" if ids[lo + i] is None else b"%d" % ids[lo + i])
                    doc = zlib.crc32(b":", doc)
                    for piece in _pieces(text, at[i], at[i + 1]):
                        for word, n in Counter(piece.split()).items():
                            if len(word) >= min_chars:
                                word = _damaged(word, doc, damage) if damage else word
                                if len(word) - word.count(_LEAD) >= min_chars:
                                    held[word] += n
                        if len(held) >= HELD:
                            yield sent()
        yield sent()

    counted = C.keyed(docs).select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _edges(words: DataFrame) -> DataFrame:
    """a, b (the word's hashes), node, p, ch: the edges of each word's path; the last one's ch is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            joined = "".join(w + "\0" for w in batch.column("word").to_pylist())
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            ends = np.flatnonzero(points == 0)
            starts = np.concatenate(([0], ends[:-1] + 1))
            row = np.repeat(np.arange(len(ends)), ends - starts + 1)
            place = np.arange(len(points))
            known, which = np.unique(points, return_inverse=True)
            symbols = C.mix((known.astype(np.uint64) + np.uint64(1)) * np.uint64(C.BASE_B))[which]
            node = C.signed(C.Roll(symbols, C.BASE_A)(starts[row], place))
            letters = pa.array([chr(c) if c else "" for c in known.tolist()])
            for lo in range(0, len(points), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                rows = pa.array(row[cut])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(rows), batch.column("b").take(rows), pa.array(node[cut]), pa.array((place - starts[row])[cut].astype(np.int32)), letters.take(pa.array(which[cut]))],
                    names=["a", "b", "node", "p", "ch"],
                )

    return words.select("a", "b", "word").mapInArrow(run, "a long, b long, node long, p int, ch string")


def _light(words: DataFrame) -> DataFrame:
    """a, b, p, heavy: each word's light edges, with the heavy character of the node that they leave."""
    edges = _edges(words)
    sizes = edges.groupBy("node", "ch").agg(F.count(F.lit(1)).alias("size"))
    nodes = sizes.groupBy("node").agg(F.max(F.struct("size", "ch")).alias("h"), F.count(F.lit(1)).alias("children"), F.sum("size").alias("size"))
    nodes = C.shared_table(nodes.filter("children > 1").select("node", F.col("h.ch").alias("heavy"), "size"), "spelling-nodes")
    hot = nodes.filter(F.col("size") >= HOT).select("node", "heavy")
    away = F.col("ch") != F.col("heavy")
    if 0 < hot.count() <= MAX_HOT:
        hot = F.broadcast(hot)
        rest = edges.join(hot, "node", "left_anti").join(nodes.filter(F.col("size") < HOT).select("node", "heavy"), "node")
        met = edges.join(hot, "node").filter(away).unionByName(rest.filter(away))
    else:
        met = edges.join(nodes.select("node", "heavy"), "node").filter(away)
    return met.select("a", "b", "p", "heavy")


def _copies() -> Column:
    """The errata copies (kind, copy) of ``word`` at its light edge ``p``; ``heavy`` is the node's heavy character."""
    return F.expr("""filter(array(
        IF(own <> '', struct('word' AS kind, concat(head, heavy, tail) AS copy), null),
        IF(own <> '', struct('wild' AS kind, concat(head, '\\0', tail) AS copy), null),
        IF(own <> '' AND substring(tail, 1, 1) <> own, struct('word' AS kind, concat(head, tail) AS copy), null),
        struct('word' AS kind, concat(head, heavy, own, tail) AS copy)), x -> x IS NOT NULL)""")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near (its words one edit away) and best (m, word: the most frequent of them, m = -n) for words (word, n) that have any."""
    hashed = C.shared_table(words.select("word", "n", F.xxhash64("word").alias("a"), F.xxhash64(F.lit(1), "word").alias("b")), "spelling-words")
    cut = {"head": "substring(word, 1, p)", "own": "substring(word, p + 1, 1)", "tail": "substring(word, p + 2)"}
    light = _light(hashed).join(hashed, ["a", "b"]).select("word", "n", "heavy", *[F.expr(e).alias(c) for c, e in cut.items()])
    copies = C.shared_table(light.select("word", "n", F.inline(_copies())), "spelling-copies", by="kind")
    other = hashed.select(F.col("word").alias("copy"), F.col("n").alias("other_n"))
    pairs = copies.filter("kind = 'word'").join(other, "copy")
    ends = F.array(*[F.struct(F.col(w).alias("word"), F.struct((-F.col(n)).alias("m"), F.col(o).alias("word")).alias("best")) for w, n, o in (("word", "other_n", "copy"), ("copy", "n", "word"))])
    direct = pairs.select(F.inline(ends)).withColumn("n_near", F.lit(1).cast("long"))
    groups = copies.filter("kind = 'wild'").groupBy("copy").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))).alias("g")).filter("size(g) > 1")
    wild = groups.select(F.expr("inline(transform(g, (x, i) -> struct(x.word AS word, g[IF(i = 0, 1, 0)] AS best, size(g) - 1L AS n_near)))"))
    return direct.unionByName(wild).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for (word, form): the end of the chain of forms, by pointer jumping."""
    now = C.shared_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"), salt)
        jumped = now.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(step, ["root", "salt"], "left")
        jumped = C.shared_table(jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        release(now)
        now = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row a word."""
    words = C.shared_table(vocabulary(docs, min_chars, min_count, damage), "spelling-vocabulary")
    near = words.join(near_words(words), "word", "left")
    clear = -F.col("best.m") >= ratio * F.col("n")
    form, form_n = F.when(clear, F.col("best.word")), F.when(clear, -F.col("best.m"))
    known = C.shared_table(near.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form_n.alias("form_n")), "spelling-forms")
    out = known.join(roots(known.filter("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
