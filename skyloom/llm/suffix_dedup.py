"""Suffix-array deduplication: remove bytes of passages that occur twice or more.

The suffix array is built by the difference-cover algorithm: suffixes at places 1 and 2 modulo 3 are
sorted by their triples, triples get names, the names are sorted by recursion, the remaining suffixes
are sorted with those ranks and merged in; then adjacent prefixes are compared. A recursion level
triples the length that names stand for, and it ends when that exceeds the passage length.

The algorithm runs on the text that skyloom.llm.repeats leaves undecided, distributed by anchor: all
equal windows meet in one bucket, so every bucket has a suffix array of its own. (Sorting the triples
of the whole corpus writes more than 10 bytes a byte of text at each of the levels.)

Cases: a null text is empty; texts under the passage length keep all bytes; a row that repeats another
row is a copy of it, so both lose every byte that a passage covers; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm import common as C
from skyloom.llm import repeats as R

PASSAGE_BYTES = 400
ANCHOR_BYTES = 64
KIND = R.Kind(words=False, window=PASSAGE_BYTES, gram=ANCHOR_BYTES)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _bits(x: np.ndarray) -> int:
    return int(x.max()).bit_length() if len(x) else 1


def _sorted_by(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The stable order by (high, low); one sort of packed integers where they fit in 64 bits."""
    n = max(len(high) - 1, 1).bit_length()
    low_bits = _bits(low)
    if _bits(high) + low_bits + n > 63:
        return np.lexsort((low, high))
    packed = np.sort((((high << low_bits) | low) << n) | np.arange(len(high)))
    return packed & ((1 << n) - 1)


def _pairs(first: np.ndarray, second: np.ndarray, most: int) -> np.ndarray:
    """Values that order as (first, second) do; dense where the product wouldn't fit."""
    bits = most.bit_length()
    if 3 * bits <= 62:
        return (first << bits) | second
    order = np.lexsort((second, first))
    fresh = np.zeros(len(order), np.int64)
    fresh[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def suffix_order(x: np.ndarray, depth: int, stands_for: int = 1) -> np.ndarray:
    """Places of ``x`` (values of 1 and more) sorted by their suffixes, as far as ``depth`` original symbols.

    ``stands_for``: so many original symbols make one value of ``x``.
    """
    n = len(x)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: x[i:].tolist()), np.int64)
    t = np.concatenate((x.astype(np.int64), np.zeros(4, np.int64)))
    most = max(int(t.max()), n + 3)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    # sort the sampled triples and name them
    head = _pairs(t[sample], t[sample + 1], int(t.max()))
    if _bits(head) > 40:  # name the pairs, so that a pair and a symbol fit in one integer
        order = np.argsort(head)
        fresh = np.zeros(len(order), np.int64)
        fresh[1:] = head[order[1:]] != head[order[:-1]]
        head[order] = np.cumsum(fresh)
    tail = t[sample + 2]
    order = _sorted_by(head, tail)
    fresh = np.ones(len(order), np.int64)
    sorted_head, sorted_tail = head[order], tail[order]
    fresh[1:] = (sorted_head[1:] != sorted_head[:-1]) | (sorted_tail[1:] != sorted_tail[:-1])
    names = np.cumsum(fresh)
    s = sample[order]
    if names[-1] < len(s) and 3 * stands_for < depth:
        # recurse on the names, those of places 1 modulo 3 first
        text = np.empty(len(s), np.int64)
        text[order] = names
        s = sample[suffix_order(text, depth, 3 * stands_for)]
        names = np.arange(1, len(s) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[s] = names
    s = s[s < n]
    # the remaining suffixes: a symbol, then the rank of a sampled suffix
    rest = np.arange(0, n, 3)
    rest = rest[_sorted_by(t[rest], rank[rest + 1])]
    # merge: a sampled suffix and another are compared by one or two symbols and a rank
    shift = most.bit_length()
    third = s % 3
    s1, s2 = s[third == 1], s[third == 2]
    before1 = np.searchsorted((t[s1] << shift) | rank[s1 + 1], (t[rest] << shift) | rank[rest + 1])
    pairs = _pairs(np.concatenate((t[s2], t[rest])), np.concatenate((t[s2 + 1], t[rest + 1])), most)
    before2 = np.searchsorted((pairs[: len(s2)] << shift) | rank[s2 + 2], (pairs[len(s2) :] << shift) | rank[rest + 2])
    out = np.full(n, -1, np.int64)
    # names that ended at the depth have ties; within ties any order will do, but places stay apart
    out[np.arange(len(rest)) + np.maximum.accumulate(before1 + before2)] = rest
    out[out < 0] = s
    return out


def solve(data: np.ndarray, sym: np.ndarray, rows: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows of these contexts equal another window: neighbours in the suffix array."""
    n_all = int(windows.sum())
    begins = np.cumsum(windows) - windows
    place = np.repeat(rows[:-1] - begins, windows) + np.arange(n_all)
    number = np.full(len(data), -1, np.int64)
    number[place] = np.arange(n_all)
    order = suffix_order(data.astype(np.int64) + 1, length)
    order = order[number[order] >= 0]
    a = C.Roll(sym, C.BASE_A)
    prefix = a(order, order + length)
    near = np.flatnonzero(prefix[1:] == prefix[:-1])
    same = np.zeros(len(near), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    for lo in range(0, len(near), 4096):  # compare the adjacent prefixes byte by byte
        k = near[lo : lo + 4096]
        same[lo : lo + 4096] = (view[order[k]] == view[order[k + 1]]).all(1)
    out = np.zeros(n_all, bool)
    hit = near[same]
    out[number[order[hit]]] = True
    out[number[order[hit + 1]]] = True
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.buffers(batch.column("text"))
        spans = batch.column("spans")
        size, gone, runs, digest, kept = [], [], [], [], []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            cover = R.merged(spans[i].as_py(), PASSAGE_BYTES) if spans[i].is_valid else []
            parts, at = [], 0
            for lo, hi in cover:
                parts.append(text[at:lo])
                at = hi
            left = b"".join([*parts, text[at:]]) if cover else text
            size.append(len(text))
            gone.append(len(text) - len(left))
            runs.append(len(cover))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: sizes, the digest of the bytes that stay, and those bytes (``kept``)."""
    rows = C.keyed(docs)
    spans = R.repeated_windows(rows, KIND, solve, "suffix")
    return R.with_spans(rows, spans).mapInArrow(_cut, SCHEMA)
