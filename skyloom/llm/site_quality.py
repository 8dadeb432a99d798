"""Quality classification by hierarchical empirical Bayes.

1. A document classifier: log odds of the words and shapes of a document (naive Bayes over features
   that speak clearly), fitted on at most TRAIN_ROWS labelled documents.
2. Hosts and paths: the documents' probabilities are summed by (host, path) with partial aggregation, and those
   sums again by host and over all. The prior strength of each level is estimated from the spread between
   its sites (moments of a beta-binomial), so sparse sites shrink towards their host, and hosts towards
   the global rate.
3. A document's posterior combines its own evidence with the posterior rate of its path.

Two rates go through this: low quality and toxicity. A document is kept if neither is likelier than not.

Cases: null or empty texts have no evidence and take their path's rate; null hosts and paths are groups of their
own; labels without a document or with nulls are ignored, and repeated labels count once (the worst); without
labels nothing is rejected; repeated rows get equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import common as C
from skyloom.llm.decontaminate import words as plain_words

#: Labelled rows that the document classifier is fitted on: those of least hash, so any share of the corpus; near copies among them are left out.
TRAIN_ROWS = 20_000
#: Jaccard similarity of three-word windows from which a training text is a near copy.
NEAR = 0.8
FEATURE_BITS = 22
#: A feature speaks if it is in so many labelled texts, its likelihood-ratio statistic (G, chi-squared with one degree
#: of freedom) is this large and so are its log odds: words that near copies of one text share seldom get there.
MIN_DOCUMENTS = 8
MIN_GAIN = 32.0
MIN_ODDS = 2.5
#: Bounds of one feature's and of a document's log odds.
MOST = 6.0
CLIP = 12.0
SITES = ("quality", "toxic")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the distinct feature numbers of each row."""
    n = len(offsets) - 1
    w, rows = plain_words(data, offsets)
    row = np.repeat(np.arange(n), np.diff(rows))
    start, end, raw_rows = C.word_bounds(data, offsets)
    raw = np.diff(raw_rows)
    raw_row = np.repeat(np.arange(n), raw)
    if len(start):
        last = data[end - 1]
        letter = (data >= 65) & (data <= 90)
        small = (data >= 97) & (data <= 122)
        ups, downs = (np.concatenate(([0], np.cumsum(x))) for x in (letter, small))
        caps = (ups[end] - ups[start] >= 2) & (downs[end] - downs[start] == 0)
        odd = ~(((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)) | (last >= 128) | np.isin(last, np.frombuffer(b".,;:!?\"')", np.uint8)))
        loud = (last == 33) & (end - start > 1) & (data[np.maximum(end - 2, 0)] == 33)
        same = np.zeros(len(w), bool)
        same[1:] = (w[1:] == w[:-1]) & (row[1:] == row[:-1])
        shares = [np.bincount(raw_row, x, n) / np.maximum(raw, 1) for x in (caps, odd, loud)]
        shares.append(np.bincount(row, same, n) / np.maximum(np.diff(rows), 1))
    else:
        shares = [np.zeros(n)] * 4
    f = (w >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    shape_row, shape = [], []
    for k, x in enumerate(shares):
        level = np.searchsorted([0.02, 0.1, 0.3], x)
        at = np.flatnonzero((level > 0) & (np.diff(offsets) > 0))
        shape_row.append(at)
        shape.append((1 << FEATURE_BITS) + 8 * k + level[at])
    pairs = np.unique((np.concatenate((row, *shape_row)) << (FEATURE_BITS + 2)) | np.concatenate((f, *shape)))
    return pairs >> (FEATURE_BITS + 2), pairs & ((1 << (FEATURE_BITS + 2)) - 1)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by feature and label, added up in each step."""
    for batch in batches:
        data, offsets = C.buffers(batch.column("text"))
        label = batch.column("label").to_numpy()
        for lo, hi in C.steps(offsets, 8_000_000):
            row, f = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            key, n = np.unique(f * 4 + label[lo:hi][row], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // 4), pa.array(key % 4), pa.array(n)], names=["f", "label", "n"])


def _windows(text: str) -> set[int]:
    words = text.split()
    return {hash(tuple(words[i : i + 3])) for i in range(max(len(words) - 2, 1))}


def _alike(texts: DataFrame) -> DataFrame:
    """Sorts each group of equal sketches by doc_id and leaves out what is NEAR the same as one that it keeps."""

    def run(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=lambda i: (table["doc_id"][i].as_py(), table["text"][i].as_py()))
        keep: list[int] = []
        kept: list[set[int]] = []
        for i in order:
            w = _windows(table["text"][i].as_py())
            if not any(len(w & x) >= NEAR * len(w | x) for x in kept):
                keep.append(i)
                kept.append(w)
        return table.take(pa.array(keep, pa.int64())).select(["doc_id", "text", "label"])

    return texts.groupBy("s1", "s2", "s3").applyInArrow(run, "doc_id long, text string, label long")


def _one_of_each(texts: DataFrame) -> DataFrame:
    """Training texts without copies and near copies, whose words would count again and again.

    A text goes only if all three sketches (least, greatest and least rehash of its three-word windows) are those of a
    text of lesser doc_id that stays and the Jaccard similarity of their windows is NEAR at least.
    """
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    out = texts.withColumn("w", words).withColumn("w", windows)
    out = out.withColumns({"s1": F.array_min("w"), "s2": F.array_max("w"), "s3": F.array_min(F.transform("w", lambda h: F.xxhash64(h)))})
    return _alike(out.select("doc_id", "text", "label", "s1", "s2", "s3"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Speaking features (sorted), their log odds of low quality and of toxicity, and the two rates."""
    ids = labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int") + 2 * (F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bit_or(bad).cast("long").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # a documented bound, so it can be broadcast
    # written once, so that features and totals count the same sample
    texts = C.shared_table(_one_of_each(C.keyed(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")), "site-sample")
    train = C.shared_table(texts.select("text", "label").mapInArrow(_train, "f long, label long, n long").groupBy("f").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("label").bitwiseAND(1 << k) > 0, F.col("n")).otherwise(0)).alias(f"b{k}") for k in (0, 1)]
    ), "site-features")
    size = texts.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label").bitwiseAND(1 << k) > 0).alias(f"b{k}") for k in (0, 1)]
    ).first()
    if not size.n:
        return np.zeros(0, np.int64), np.zeros((0, 2)), (0.0, 0.0)
    odds, speaks = [], F.lit(False)
    for k in (0, 1):
        total = size[f"b{k}"]
        a, b = F.col(f"b{k}") + 0.5, F.col("n") - F.col(f"b{k}") + 0.5
        log = F.log(a / (total + 1)) - F.log(b / (size.n - total + 1))
        p, n, bad = total / size.n, F.col("n"), F.col(f"b{k}")
        part = lambda x, share: F.when(x > 0, x * F.log(x / (n * max(share, 1e-9)))).otherwise(0.0)
        clear = (2 * (part(bad, p) + part(n - bad, 1 - p)) >= MIN_GAIN) & (F.abs(log) >= MIN_ODDS) & F.lit(0 < total < size.n)
        odds.append(F.when(clear, F.greatest(F.lit(-MOST), F.least(F.lit(MOST), log))).otherwise(0.0).alias(f"o{k}"))
        speaks = speaks | clear
    got = train.filter((F.col("n") >= MIN_DOCUMENTS) & speaks).select("f", *odds).orderBy("f").toArrow()
    weights = np.stack([got.column(x).to_numpy() for x in ("o0", "o1")], 1) if got.num_rows else np.zeros((0, 2))
    rate = tuple((size[f"b{k}"] + 0.5) / (size.n + 1) if size[f"b{k}"] else 0.0 for k in (0, 1))
    return (got.column("f").to_numpy() if got.num_rows else np.zeros(0, np.int64)), weights, rate


def _logit(p: float) -> float:
    return math.log(p / (1 - p)) if 0 < p < 1 else -CLIP


def _score(model: tuple) -> Callable:
    known, weights, _ = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            for lo, hi in C.steps(offsets):
                out = np.zeros((hi - lo, 2))
                if len(known):
                    row, f = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    at = np.minimum(np.searchsorted(known, f), len(known) - 1)
                    hit = known[at] == f
                    for k in (0, 1):
                        # a word that is merely usual says little against a clear sign: evidence against counts up to CLIP / 4
                        v = weights[at[hit], k]
                        up, down = (np.bincount(row[hit], x, hi - lo) for x in (np.maximum(v, 0), np.minimum(v, 0)))
                        out[:, k] = np.clip(up + np.maximum(down, -CLIP / 4), -CLIP, CLIP)
                cut = lambda c: batch.column(c).slice(lo, hi - lo)  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([cut("doc_id"), cut("host"), cut("path"), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["doc_id", "host", "path", "e0", "e1"])

    return run


def _strength(sites: DataFrame, k: int, rate: Column) -> float:
    """Pseudo-documents of the level above: how alike its sites' rates are, by moments."""
    x = sites.agg(
        F.sum(F.col("n")).alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("m"),
        F.sum(F.col("n") * F.pow(F.col(f"s{k}") / F.col("n") - rate, 2)).alias("q"), F.sum(rate * (1 - rate) * F.col("n")).alias("v"),
    ).first()
    if not x.n or x.m < 2 or not x.v:
        return 1000.0
    within = x.v / x.n
    between = (x.q - (x.m - 1) * within) / max(x.n - x.nn / x.n, 1e-9)
    return float(min(1e4, max(1.0, within / between - 1))) if between > 0 else 1e4


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, p_low_quality and p_toxic (posterior probabilities), evidence_quality, evidence_toxic, kept."""
    model = fit(docs, labels)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    each = C.shared_table(rows.mapInArrow(_score(model), "doc_id long, host string, path string, e0 double, e1 double"), "site-evidence")
    prior = [_logit(r) for r in model[2]]
    p = [1 / (1 + F.exp(-(F.col(f"e{k}") + prior[k]))) for k in (0, 1)]
    paths = C.shared_table(each.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p[k]).alias(f"s{k}") for k in (0, 1)]), "site-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(x).alias(x) for x in ("n", "s0", "s1")])
    total = hosts.agg(*[F.sum(x).alias(x) for x in ("n", "s0", "s1")]).first()
    rate = [(total[f"s{k}"] + 1e-3) / (total.n + 2e-3) if total.n else 0.5 for k in (0, 1)]
    strength = [_strength(hosts, k, F.lit(rate[k])) for k in (0, 1)]
    up = hosts.select(F.col("host").alias("h"), *[((F.col(f"s{k}") + strength[k] * rate[k]) / (F.col("n") + strength[k])).alias(f"m{k}") for k in (0, 1)])
    joined = C.shared_table(paths.join(up, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "site-posteriors")
    inner = [_strength(joined, k, F.col(f"m{k}")) for k in (0, 1)]
    post = joined.select(F.col("host").alias("h"), F.col("path").alias("q"), *[((F.col(f"s{k}") + inner[k] * F.col(f"m{k}")) / (F.col("n") + inner[k])).alias(f"r{k}") for k in (0, 1)])
    out = each.join(post, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    odds = [F.col(f"e{k}") + F.log(F.greatest(F.col(f"r{k}"), F.lit(1e-6)) / F.greatest(1 - F.col(f"r{k}"), F.lit(1e-6))) for k in (0, 1)]
    final = [1 / (1 + F.exp(-x)) if model[2][k] else F.lit(0.0) for k, x in enumerate(odds)]
    return out.select(
        "doc_id", "host", "path", final[0].alias("p_low_quality"), final[1].alias("p_toxic"), F.col("e0").alias("evidence_quality"), F.col("e1").alias("evidence_toxic"),
        ((final[0] < 0.5) & (final[1] < 0.5)).alias("kept"),
    )
