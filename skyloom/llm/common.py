"""Shared pieces: text buffers as numpy arrays, rolling hashes, keys of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.plans.lineage import shared_table as shared_table

#: The six bytes that separate words: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised step works on (a longer document makes a longer step).
STEP_BYTES = 1_000_000
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and t, a hash of the text; (doc_id, t) names a row's content.

    Only these columns go on, so extra columns of any name do no harm. Rows that repeat another row
    share its key and get equal results.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n, skip = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, skip * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes together stay under ``limit``; one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 12), b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[base] = (out[0], out[1])
    return have


class Roll:
    """Polynomial hashes of any slice of a symbol array, from prefix sums modulo 2^64."""

    def __init__(self, symbols: np.ndarray, base: int) -> None:
        up, self.down = _powers(base, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


#: A random 64-bit value for each byte value, made by rule.
BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE_B))
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``, and n + 1 offsets of the rows' words. Words end at row ends."""
    n = len(data)
    gap = np.ones(n + 1, bool)
    gap[:n] = _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    solid = ~gap
    start = np.flatnonzero(solid & (np.concatenate(([True], gap[:-1])) | first))
    end = np.flatnonzero(solid[:n] & (gap[1:] | first[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return mix(Roll(BYTE_SYMBOLS[data], BASE_A)(start, end) + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
