"""Substring deduplication by relative Lempel-Ziv parsing over words.

Documents are factored greedily against the indexed reference blocks. The index, a suffix array of blocks, is
distributed by anchor (skyloom.llm.repeats): the blocks that can share a window with a document's block meet in
one bucket, so a block is factored against every block that could match. Each factor is the longest match at its
place; all windows inside a factor of the window length or more are duplicate. Windows that straddle a
factor's boundary are looked up in the index, because a block other than the factor's may hold them.

Blocks found twice, word by word, are one factor of whole length; they are found by counting their hashes before the
index is built. The blocks of anchors beyond HOT_SYMBOLS are cut into windows, which are counted.

Cases: a null text has no words; fewer words than a window are all kept; a row that repeats another row
is a copy of it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm import common as C
from skyloom.llm import repeats as R
from skyloom.llm.suffix_dedup import suffix_order

WINDOW_WORDS = 35
ANCHOR_WORDS = 6
KIND = R.Kind(words=True, window=WINDOW_WORDS, gram=ANCHOR_WORDS)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


class Index:
    """The suffix array of blocks, each closed by a symbol of its own, so that no match crosses a block's end."""

    def __init__(self, sym: np.ndarray, rows: np.ndarray) -> None:
        n_rows = len(rows) - 1
        self.row = np.repeat(np.arange(n_rows), np.diff(rows))
        text = np.empty(len(sym) + n_rows, np.int64)
        text[np.arange(len(sym)) + self.row] = np.unique(sym, return_inverse=True)[1] + 1
        text[rows[1:] + np.arange(n_rows)] = len(sym) + 1 + np.arange(n_rows)
        self.order = suffix_order(text, int(np.diff(rows).max()) + 1)
        self.rank = np.empty(len(text), np.int64)
        self.rank[self.order] = np.arange(len(text))
        self.text = np.append(text, 0)  # the last suffix ends; no symbol is 0
        self.asked = 0

    def longest(self, places: np.ndarray, most: int) -> np.ndarray:
        """How many symbols from each place on, up to ``most``, stand somewhere else in the blocks, too.

        The longest match of a place is with one of its two neighbours in the suffix array.
        """
        self.asked += len(places)
        places = places + self.row[places]
        at, best, end = self.rank[places], np.zeros(len(places), np.int64), len(self.text) - 1
        for step in (-1, 1):
            beside = at + step
            live = np.flatnonzero((beside >= 0) & (beside < len(self.order)))
            other = self.order[beside[live]]
            for k in range(most):
                same = self.text[np.minimum(places[live] + k, end)] == self.text[np.minimum(other + k, end)]
                live, other = live[same], other[same]
                if not len(live):
                    break
                best[live] = np.maximum(best[live], k + 1)
        return best


def parse(index: Index, rows: np.ndarray) -> np.ndarray:
    """Whether a factor begins at each place: every block is factored greedily, one factor of all blocks at a time.

    A factor is the longest match at its place, one symbol at least; only the places where factors begin are looked up.
    """
    begins = np.zeros(rows[-1] + 1, bool)
    begins[rows[-1]] = True
    at, ends = rows[:-1].copy(), rows[1:]
    most = int(np.diff(rows).max())
    while len(at):
        begins[at] = True
        at = at + np.maximum(index.longest(at, most), 1)
        at, ends = at[at < ends], ends[at < ends]
    return begins


def solve(data: np.ndarray, sym: np.ndarray, rows: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows of these blocks stand somewhere else, too.

    A window inside a factor does. One that holds a whole factor and a word behind it doesn't: had it a match, that factor
    would have been longer. What is left straddles one boundary and is looked up, because a block other than the factor's may hold it.
    """
    return decided(Index(sym, rows), rows, windows, length)


def decided(index: Index, rows: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    if not windows.sum():
        return np.zeros(0, bool)
    cuts = np.flatnonzero(parse(index, rows))
    before = np.cumsum(windows) - windows
    start = np.repeat(rows[:-1] - before, windows) + np.arange(windows.sum())
    first = np.searchsorted(cuts, start, "left")  # the first factor that begins in the window
    ends = cuts[np.minimum(first + 1, len(cuts) - 1)]  # where it ends
    begin = cuts[np.searchsorted(cuts, start, "right") - 1]  # the factor that the window begins in
    inside = start + length <= cuts[np.searchsorted(cuts, begin, "right")]
    whole = (cuts[np.minimum(first, len(cuts) - 1)] < start + length) & (ends < start + length)
    found = inside.copy()
    ask = np.flatnonzero(~inside & ~whole)
    found[ask] = index.longest(start[ask], length) >= length
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.buffers(batch.column("text"))
        spans = batch.column("spans")
        size, gone, digest, kept = [], [], [], []
        for i in range(batch.num_rows):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            cover = R.merged(spans[i].as_py(), WINDOW_WORDS) if spans[i].is_valid else []
            size.append(len(words))
            gone.append(sum(hi - lo for lo, hi in cover))
            for lo, hi in reversed(cover):
                del words[lo:hi]
            left = b" ".join(words)
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        arrays = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: word counts, the digest of the words that stay, and their text (``kept``)."""
    rows = C.keyed(docs)
    spans = R.repeated_windows(rows, KIND, solve, "substring")
    return R.with_spans(rows, spans).mapInArrow(_cut, SCHEMA)
