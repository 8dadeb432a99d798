"""SimHash near-deduplication with multi-index hashing.

A fingerprint of 64 bits is cut into SEGMENTS parts. Two fingerprints that differ in at most DISTANCE bits
have a part that differs in at most DISTANCE // SEGMENTS bits, so each fingerprint enumerates the Hamming
ball of that radius around each of its parts, fetches the fingerprints in the table under those values, and
the whole distance is verified inside the join.

Only different fingerprints enter. In a group of near copies most links are redundant: each fingerprint is
first linked to the most frequent one under each of its exact parts, if near enough. The probes
then only look for links between different components of those, so no group emits all its pairs.

The number of parts follows from the number of different fingerprints (segments_for): few parts are long, so their
values are rarer and their balls larger. It changes what is looked up, never what is found.

Cases: a null or blank text has fingerprint zero and is linked like any other; a null doc_id gets a row and
the component's least id (null if no member has one); repeated rows get equal results; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import common as C
from skyloom.operators.components import components

SHINGLE_WORDS = 4
HASH_SEED = 42
DISTANCE = 4
#: Numbers of parts to choose from.
SEGMENTS = (2, 3, 4)


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> bytes:
    """The eight bytes, highest first: a bit is 1 where it is set in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    k = min(k, len(words))
    h = xxhash.xxh64_digest
    raw = b"".join([h(joined[a : b - 1], HASH_SEED) for a, b in zip(starts, ends[k - 1 :])])
    n = len(raw) // 8
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        bits = np.unpackbits(np.frombuffer(raw[8 * lo : 8 * (lo + 65536)], np.uint8)).reshape(-1, 64)
        votes += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return np.packbits(2 * votes > n).tobytes()


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, t, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            raw = b"".join([fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), k) for i in range(batch.num_rows)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=["doc_id", "t", "fp"])

    return C.keyed(docs).mapInArrow(run, "doc_id long, t long, fp long")


def _parts(segments: int) -> list[tuple[int, int]]:
    """(shift, bits) of each part."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(fp: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` of ``bits`` bits."""
    out = {0}
    for _ in range(radius):
        out |= {m ^ (1 << b) for m in out for b in range(bits)}
    return sorted(out)


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def segments_for(n: int, distance: int) -> int:
    """The number of parts that makes the fewest probes and look-ups for n different fingerprints spread evenly."""

    def work(segments: int) -> float:
        return sum(math.comb(bits, r) * (1 + n / 2**bits) for _, bits in _parts(segments) for r in range(distance // segments + 1))

    return min(SEGMENTS, key=work)


def linked(prints: DataFrame, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """fp, label: fingerprints with equal labels are connected by links of at most ``distance`` bits."""
    distinct = C.shared_table(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "simhash-distinct")
    segments = segments or segments_for(distinct.count(), distance)
    parts = _parts(segments)
    table = distinct.select("fp", "n", F.posexplode(F.array(*[_part(F.col("fp"), *p) for p in parts])).alias("s", "v"))
    hubs = table.groupBy("s", "v").agg(F.max(F.struct("n", "fp")).alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("s", "v", F.col("hub.fp").alias("hub"))
    first = table.join(hubs, ["s", "v"]).filter((F.col("fp") != F.col("hub")) & _near("fp", "hub", distance)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    labels = components(first, "simhash-hubs")
    nodes = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", F.coalesce("least", "fp").alias("label"))
    nodes = C.shared_table(nodes, "simhash-nodes")
    members = nodes.select("fp", "label", F.posexplode(F.array(*[_part(F.col("fp"), *p) for p in parts])).alias("s", "v"))
    radius = distance // segments
    balls = F.array(*[F.array(*[F.lit(m).cast("long") for m in _ball(bits, radius)]) for _, bits in parts])
    probes = members.select(F.col("fp").alias("p"), F.col("label").alias("q"), "s", F.explode(F.transform(F.get(balls, F.col("s")), lambda m: m.bitwiseXOR(F.col("v")))).alias("v"))
    found = probes.join(members, ["s", "v"]).filter((F.col("q") < F.col("label")) & _near("p", "fp", distance))
    merged = components(found.select(F.col("q").alias("a"), F.col("label").alias("b")), "simhash-links")
    return nodes.join(merged, nodes["label"] == merged["node"], "left").select("fp", F.coalesce("least", "label").alias("label"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """doc_id, t, fingerprint (16 hexadecimal digits), component_id and label, the component's key."""
    prints = C.shared_table(fingerprints(docs, k), "simhash-prints")
    labels = C.shared_table(linked(prints, distance, segments), "simhash-labels")
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(labels, "fp")
    ids = each.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = C.shared_table(ids, "simhash-ids")
    known = labels.join(ids, "label").select("fp", "label", "component_id")
    out = prints.join(known, "fp")
    return out.select("doc_id", "t", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "label")


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the least doc_id (nulls last) stays, unchanged."""
    found = near_duplicates(docs, **options)
    i, t, n = C.free(docs, "_id", "_t", "_n")
    rows = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("r"))
    win = rows.select(F.col("r.doc_id").alias("w_id"), F.col("r.t").alias("w_t"))
    counted = found.groupBy(F.col("doc_id").alias("c_id"), F.col("t").alias("c_t")).agg(F.count(F.lit(1)).alias(n))
    win = win.join(counted, F.expr("w_id <=> c_id and w_t = c_t")).select(F.col("w_id").alias(i), F.col("w_t").alias(t), n)
    on = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).eqNullSafe(win[t]) & docs["doc_id"].cast("long").eqNullSafe(win[i])
    kept = C.shared_table(docs.join(win, on).select(*[docs[c] for c in docs.columns], win[t], win[n]), "simhash-kept")
    single = kept.filter(F.col(n) == 1).drop(t, n)
    return single.unionByName(kept.filter(F.col(n) > 1).dropDuplicates(["doc_id", t]).drop(t, n))
