"""Personal data by weak supervision.

Four kinds have fixed definitions (the base): email, ip, card, phone. Other candidates, tokens with a
digit or behind a cue, whole values behind a word that names a credential (up to a blank or the closing quote, whatever their
characters, of any length if a colon or equals sign stands between) and account numbers in groups of four, get votes of several labelers: patterns,
gazetteers (countries with the length of their account numbers, unissued number ranges, stand-ins for real
values, words) and contexts. A vote is for one of three classes: plain, ``secret`` or ``ident``. An
expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each
pattern's class probabilities without any labels; these are the soft labels of a span classifier (naive
Bayes over a fixed number of features of a candidate and its surroundings). The class that it finds
likeliest is the span's kind; plain ones are dropped and base spans stay.

The corpus is read once: spans, votes and features go to a small table. The driver sees the counts of vote patterns (at
most PATTERNS) and, for each feature, the classes' soft counts (FEATURES x 3), which Spark sums as whole numbers.

Cases: a null or empty text has no spans; repeated rows get equal results; an empty table gives no rows;
other columns are ignored. Scans are linear in the text, long runs of one character included.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import common as C

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "ident")
FEATURES = 512
CLASSES = ("plain", *ADDED_KINDS)
LABELERS = 9
#: A vote is 0 for none or 1 + the class.
PATTERNS = 4**LABELERS
#: Labelers that see something personal without telling the two classes apart: a separator before, quotes around.
GENERIC = (6, 7)
GAZETTEER = 2
EM_ROUNDS = 60
#: Candidates' worth of the overall feature rates in each class of the classifier.
SMOOTHING = 2.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]+")
#: Cues: a colon or equals sign, and words of the gazetteer, before a value.
CUE = re.compile(r"[=:][ \"']*")
NAMED = re.compile(r"(?<![A-Za-z_])[A-Za-z_]+(?=[ \"':=])")
#: What parts a credential's name from its value, and what may follow a value in prose.
PARTING = " \"':="
TRAILING = ".,;:)]}>"
SPACE = re.compile(r"[ \t-\r]")
#: Parts of one that a soft label is counted in, so that sums don't depend on their order.
PARTS = 1_000_000
TOKEN_RUN = re.compile(r"[A-Za-z0-9_+/-]+")
DIGITS = frozenset("0123456789")
#: Characters of a token; shorter ones count only as a credential's value.
LEAST = 6
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")

#: Formats of keys that services publish.
KEY_FORMATS = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}")
IDENT_FORMATS = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
#: An account number written in groups of four.
GROUPED = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Countries and the length of their international account numbers.
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Stand-ins for real values.
STAND_INS = re.compile(r"(?i)x{6,}.*|0{6,}|123456(?:7890?)?|changeme|change_me|example.*|placeholder|redacted|your[-_].*|undefined")
#: Words that name credentials, and those that name documents of a person.
SECRET_WORDS = frozenset("password passwd pwd passphrase secret token apikey api_key key credential credentials auth bearer".split())
IDENT_WORDS = frozenset("ssn iban passport account social security insurance national identity tax".split())
#: Words before numbers that aren't personal.
PLAIN_WORDS = frozenset("version figure table section chapter page year line step volume number no license licence".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed kinds, leftmost and non-overlapping each, by kind and start."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, int, list[int]]]:
    """(start, end, vote pattern, features) of account numbers in groups, of credentials' values and of tokens of LEAST characters or more that hold a digit or stand behind a cue."""
    groups = []
    for m in GROUPED.finditer(text):
        if ACCOUNT_LENGTHS.get(m.group()[:2]) == len(m.group().replace(" ", "")):
            groups.append(m.span())
    values = _outside(_values(text), groups)
    busy: list[list[int]] = []  # disjoint, ascending
    for lo, hi in sorted([(lo, hi) for _, lo, hi in taken]):
        if busy and lo < busy[-1][1]:
            busy[-1][1] = max(busy[-1][1], hi)
        else:
            busy.append([lo, hi])
    out, j = [], 0
    for lo, hi in sorted(groups + values + _tokens(text, sorted(groups + values))):
        while j < len(busy) and busy[j][1] <= lo:
            j += 1
        if j == len(busy) or busy[j][0] >= hi:
            out.append(_vote(text, lo, hi))
    return out


def _outside(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those ``spans`` that touch none of ``others``; both ascending and disjoint."""
    out, j = [], 0
    for lo, hi in spans:
        while j < len(others) and others[j][1] <= lo:
            j += 1
        if j == len(others) or others[j][0] >= hi:
            out.append((lo, hi))
    return out


def _values(text: str) -> list[tuple[int, int]]:
    """The values behind words that name credentials, disjoint and ascending; those of plain token characters after a mere blank are left to _tokens."""
    out, done = [], 0
    for m in NAMED.finditer(text):
        if m.start() < done or m.group().lower() not in SECRET_WORDS:
            continue
        lo = m.end()
        while lo < len(text) and text[lo] in PARTING:
            lo += 1
        between = text[m.end() : lo]
        quote = between[-1] if between[-1] in "\"'" else ""
        end = SPACE.search(text, lo)
        hi = end.start() if end else len(text)
        close = text.find(quote, lo, hi) if quote else -1
        hi = close if close >= 0 else hi
        while close < 0 and hi > lo and text[hi - 1] in TRAILING:
            hi -= 1
        separated = ":" in between or "=" in between
        if hi > lo and (separated or hi - lo >= LEAST and any(c in DIGITS or c not in TOKEN for c in text[lo:hi])):
            out.append((lo, hi))
            done = hi
    return out


def _tokens(text: str, groups: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The tokens with a digit or behind a cue, outside of ``groups``."""
    cued = {m.end() for m in CUE.finditer(text)}
    for m in NAMED.finditer(text):
        if m.group().lower() in SECRET_WORDS:
            at = m.end()
            while at < len(text) and text[at] in PARTING:
                at += 1
            cued.add(at)
    out, done, g = [], 0, 0
    for at in sorted({m.start() for m in DIGIT.finditer(text)} | cued):
        while g < len(groups) and groups[g][0] <= at:
            done = max(done, groups[g][1])
            g += 1
        if at < done:
            continue
        lo = at
        while lo > done and text[lo - 1] in TOKEN:
            lo -= 1
        m = TOKEN_RUN.match(text, at)
        hi = m.end() if m else at
        if g < len(groups) and groups[g][0] < hi:
            continue  # the token is where a group begins
        done = max(done, hi)
        if hi - lo >= LEAST:
            out.append((lo, hi))
    return out


def account(token: str) -> bool:
    """Whether an international account number has its country's length and check digits."""
    if ACCOUNT_LENGTHS.get(token[:2]) != len(token) or not token.isascii() or not token.isalnum() or not token[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in token[4:] + token[:4])) % 97 == 1


def _vote(text: str, lo: int, hi: int) -> tuple[int, int, int, list[int]]:
    token, before, after = text[lo:hi].replace(" ", ""), text[max(0, lo - 40) : lo], text[hi : hi + 1]
    words = re.findall(r"[a-z_]+", before.lower())
    last = words[-1] if words else ""
    near = before.rstrip(" \"'")[-1:]
    digits = sum(c in "0123456789" for c in token)
    counts = Counter(token)
    entropy = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())
    hexed = all(c in "0123456789abcdefABCDEF-" for c in token)
    ident = IDENT_FORMATS.fullmatch(token) is not None
    # of numbers 3-2-4 the ranges 000, 666 and 9xx, the group 00 and the serial 0000 were never issued
    issued = ident and (account(token) if token[0].isalpha() else token[:3] not in ("000", "666") and token[0] != "9" and token[4:6] != "00" and token[7:] != "0000")
    none, plain, secret, known = range(4)
    votes = [
        secret if KEY_FORMATS.fullmatch(token) else none,
        known if ident else none,
        known if issued else plain if ident or STAND_INS.fullmatch(token) else none,
        secret if hexed and len(token) >= 16 and digits < len(token) and not ident else none,
        none if ident else secret if len(token) >= 12 and entropy >= 3.0 and 0 < digits < len(token) else plain if entropy < 2.2 or digits == len(token) else none,
        secret if last in SECRET_WORDS else known if last in IDENT_WORDS else plain if last in PLAIN_WORDS else none,
        secret if near and near in "=:" else none,
        secret if before[-1:] in "\"'" and before and after == before[-1:] else none,
        plain if len(token) < 10 and not (last in SECRET_WORDS and near and near in "=:") else none,
    ]
    pattern = 0
    for v in votes:
        pattern = pattern * 4 + v
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", token))))[:6]
    raw = [f"shape={shape}", f"len={min(len(token) // 4, 12)}", f"entropy={int(entropy * 2)}", f"digits={int(4 * digits / len(token))}", f"last={last[:12]}", f"near={near}", f"hex={hexed}", f"after={after}", f"format={ident}{issued}"]
    features = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % FEATURES for x in raw]
    return (lo, hi, pattern, features)


def reliabilities(counts: dict[int, int]) -> dict[int, list[float]]:
    """Probabilities of the three classes for candidates of each vote pattern, by expectation-maximisation."""
    patterns = sorted(counts)
    votes = np.array([[p // 4 ** (LABELERS - 1 - j) % 4 for j in range(LABELERS)] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    special = [j for j in range(LABELERS) if j not in GENERIC]
    against = (votes == 1).sum(1)
    generic = (votes[:, GENERIC] == 2).sum(1)
    secret, ident = ((votes[:, special] == v).sum(1) for v in (2, 3))
    # an ident needs a labeler that names it, and is none if the gazetteer knows that it can't have been issued
    never = (ident == 0) | (votes[:, GAZETTEER] == 1)

    def normal(log: np.ndarray) -> np.ndarray:
        q = np.exp(np.clip(log - log.max(1, keepdims=True), -50, 0))
        q[:, 2][never] = 0
        return q / q.sum(1, keepdims=True)

    # the start: the votes for a class, less those against it
    p = normal(np.stack([np.zeros(len(n)), 2.0 * (secret + generic - against - ident) - 1.0, 2.0 * (ident + generic - against - secret) - 1.0], 1))
    for _ in range(EM_ROUNDS):
        log = np.log((n @ p + 1) / (n.sum() + 3)) + np.zeros((len(n), 3))
        for k in range(3):
            for j in range(LABELERS):
                # a labeler that speaks is right more often than not: its pseudo-counts say so
                table = np.array([4.0, 0.5, 0.5, 0.5])
                table[2 if j in GENERIC and k else 1 + k] = 2.0
                np.add.at(table, votes[:, j], n * p[:, k])
                log[:, k] += np.log(table / table.sum())[votes[:, j]]
        new = normal(log)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return dict(zip(patterns, p.tolist()))


def classifier(seen: np.ndarray, soft: dict[int, list[float]], counts: dict[int, int]) -> list[tuple[float, list[float]]]:
    """For secret and ident, each against plain: bias and a weight for each feature, by naive Bayes; ``seen`` has the soft counts of each class and feature.

    Each class is smoothed with the feature rates of all candidates, so a class that nearly nothing is in says nothing by its rare features.
    """
    mass = np.array([soft[p] for p in counts]).T @ np.array(list(counts.values()), float)
    rate = (seen.sum(0) + 1) / (mass.sum() + 2)
    log = np.log((seen + SMOOTHING * rate) / (mass[:, None] + SMOOTHING))
    return [(math.log((mass[k] + 1) / (mass[0] + 1)), (log[k] - log[0]).tolist()) for k in (1, 2)]


_CANDIDATE = "array<struct<lo:int,hi:int,pattern:int,features:array<int>>>"
_SPAN = "array<struct<kind:string,lo:int,hi:int>>"


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.buffers(batch.column("text"))
        base, more = [], []
        for i in range(batch.num_rows):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            spans = base_spans(text := raw.decode())
            base.append([{"kind": k, "lo": a, "hi": b} for k, a, b in spans])
            more.append([{"lo": a, "hi": b, "pattern": p, "features": f} for a, b, p, f in candidates(text, spans)])
        span = pa.struct([("kind", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])
        cand = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(cand))], names=["doc_id", "t", "base", "more"])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, t and two lists of (kind, lo, hi): ``base`` and ``added``, in code points."""
    found = C.shared_table(C.keyed(docs).mapInArrow(_label, f"doc_id long, t long, base {_SPAN}, more {_CANDIDATE}"), "pii")
    each = found.select(F.explode("more").alias("c"))
    counts = {r.p: r.n for r in each.groupBy(F.col("c.pattern").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return found.select("doc_id", "t", "base", F.expr(f"cast(array() as {_SPAN})").alias("added"))
    soft = reliabilities(counts)
    shares = found.sparkSession.createDataFrame([(p, *[round(x * PARTS) for x in q]) for p, q in soft.items()], "p int, " + ", ".join(f"{k} long" for k in CLASSES))
    # at most PATTERNS rows
    said = each.select(F.col("c.pattern").alias("p"), F.explode("c.features").alias("f")).join(F.broadcast(shares), "p")
    seen = np.zeros((len(CLASSES), FEATURES))
    for r in said.groupBy("f").agg(*[F.sum(k).alias(k) for k in CLASSES]).collect():
        seen[:, r.f] = [r[k] / PARTS for k in CLASSES]
    model = classifier(seen, soft, counts)

    def odds(c: F.Column, bias: float, weights: list[float]) -> F.Column:
        w = F.array(*map(F.lit, weights))
        return F.aggregate(c["features"], F.lit(bias), lambda total, f: total + F.get(w, f))

    def kind(c: F.Column) -> F.Column:
        secret, ident = (odds(c, *x) for x in model)
        return F.when(F.greatest(secret, ident) <= 0, CLASSES[0]).when(secret >= ident, CLASSES[1]).otherwise(CLASSES[2])

    named = F.transform("more", lambda c: F.struct(kind(c).alias("kind"), c["lo"].alias("lo"), c["hi"].alias("hi")))
    added = F.filter(named, lambda c: c["kind"] != CLASSES[0])
    return found.select("doc_id", "t", "base", added.alias("added"))


def report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text; by kind in its fixed order, then start."""

    def listed(spans: F.Column) -> F.Column:
        order = lambda k: F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate((*BASE_KINDS, *ADDED_KINDS)) for x in (n, i)]), k)
        keys = F.array_sort(F.transform(spans, lambda s: F.struct(order(s["kind"]).alias("k"), s["lo"].alias("lo"), s["hi"].alias("hi"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(keys, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = listed(F.col("base"))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(base, 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with every span of ``text`` replaced by its kind in brackets; a null text stays null."""

    i, t, added = C.free(docs, "_id", "_t", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column(added).to_pylist()
            for row, found in enumerate(spans):
                if found and texts[row] is not None:
                    out, at, text = [], 0, texts[row]
                    for s in sorted(found, key=lambda s: (s["lo"], -s["hi"])):
                        if s["lo"] >= at:
                            out += [text[at : s["lo"]], f"[{s['kind']}]"]
                        at = max(at, s["hi"])  # of overlapping spans all characters go
                    texts[row] = "".join([*out, text[at:]])
            keep = [n for n in batch.schema.names if n != added]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in keep], names=keep)

    found = detect(docs).filter(F.size("base") + F.size("added") > 0).select(F.col("doc_id").alias(i), F.col("t").alias(t), F.concat("base", "added").alias(added)).dropDuplicates([i, t])
    on = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).eqNullSafe(found[t]) & docs["doc_id"].cast("long").eqNullSafe(found[i])
    joined = docs.join(found, on, "left").select(*[docs[c] for c in docs.columns], found[added])
    return joined.mapInArrow(run, docs.schema)
