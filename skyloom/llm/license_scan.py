"""License scans: ordered signature rules over the words of whole texts, behind a keyword prefilter.

A step of texts becomes one buffer of words (a-z in lower case, maximal runs of letters, digits and non-ASCII bytes) with a blank
behind each. An Aho-Corasick automaton finds the rules' keywords in one pass; a rule's regex (license_rules) runs only
within REACH bytes of one of its keywords, whatever the text's length. Of the matches those stand that lie in no
match of a stronger rank, nor in a longer one of their own; of equal ones the first rule's. That is one sweep over the matches by
start with the furthest end of each rank, so a text of nothing but licenses takes no longer for each match. Rules
without a label (a license denied or only compared with) hide what they hold and are left out themselves.

Everything happens within the rows: no shuffle, and memory for a batch of texts and their matches.

Cases: a null text is empty and has no words; a null doc_id gets a row; repeated rows get equal results; very long texts are
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import common as C
from skyloom.llm.license_rules import REACH, Rule, all_rules

#: Phrases that count wherever their words stand, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The weight of a phrase that no rule confirms.
PHRASE_WEIGHT = 0.6
#: Keywords held at once.
HELD = 100_000
_WORD = np.ones(256, bool)
_WORD[:48] = _WORD[58:97] = _WORD[123:128] = False

#: label, rule, the first word and the word behind the last.
Match = tuple[str, int, int, int]


def standing(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The matches (start, end, rank, rule) that no other hides, by start."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for a, b, rank, rule in matches:
        best[a, b] = min(best.get((a, b), (rank, rule)), (rank, rule))
    out, furthest = [], {}
    for (a, b), (rank, rule) in sorted(best.items(), key=lambda x: (x[0][0], -x[0][1])):
        if not any(r <= rank and end >= b for r, end in furthest.items()):
            out.append((a, b, rank, rule))
        furthest[rank] = max(furthest.get(rank, 0), b)
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of all rows, each with a blank behind it and each row with a line feed; the n + 1 offsets of the rows in that."""
    ends = offsets[1:]
    raw = np.insert(C.LOWER[data], np.repeat(ends - offsets[0], 2), np.tile(np.array([32, 10], np.uint8), len(ends)))
    stops = ends - offsets[0] + 2 * np.arange(len(ends)) + 1
    word = _WORD[raw]
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[stops] = True
    raw[~word] = 32
    raw[stops] = 10
    return raw[keep].tobytes(), np.concatenate(([0], np.cumsum(keep)[stops]))


class Scanner:
    """The rules, ready to run in a task; regexes are compiled when a keyword first asks for them."""

    def __init__(self, rules: list[Rule], phrases: dict[str, str]) -> None:
        self.rules, self.compiled = rules, {}
        self.phrases = [(p, label) for p, label in phrases.items()]
        asks: dict[str, tuple[list[int], list[int]]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:
                asks.setdefault(k, ([], []))[0].append(i)
        for i, (p, _) in enumerate(self.phrases):
            asks.setdefault(p + " ", ([], []))[1].append(i)
        self.automaton = ahocorasick.Automaton()
        for k, found in asks.items():
            self.automaton.add_word(k, (len(k), *found))
        self.automaton.make_automaton()

    def pattern(self, rule: int) -> re.Pattern[bytes]:
        if rule not in self.compiled:
            self.compiled[rule] = re.compile(rb"(?<![^ \n])(?:" + self.rules[rule].pattern.encode() + rb")(?= )")
        return self.compiled[rule]

    def hits(self, text: bytes, rows: np.ndarray) -> Iterator[tuple[int, int, tuple[int, list[int], list[int]]]]:
        """Row, last byte and what it asks for, of each keyword's place."""
        found = self.automaton.iter(text.decode("latin-1"))
        while block := list(islice(found, HELD)):
            at = np.searchsorted(rows, np.array([end for end, _ in block]), "right") - 1
            yield from ((row, *hit) for row, hit in zip(at.tolist(), block))

    def scan(self, text: bytes, rows: np.ndarray) -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[tuple[int, int, int, int]]]]:
        """By row: the places (start byte, phrase), and the matches (start byte, end byte, rank, rule)."""
        places: dict[int, list[tuple[int, int]]] = {}
        windows: dict[tuple[int, int], list[list[int]]] = {}
        for row, end, (size, rules, phrases) in self.hits(text, rows):
            start = end + 1 - size
            for p in phrases:
                if start == 0 or text[start - 1] in b" \n":
                    places.setdefault(row, []).append((start, p))
            if rules:
                lo, hi = max(start - REACH, int(rows[row])), min(end + 1 + REACH, int(rows[row + 1]))
                for r in rules:
                    spans = windows.setdefault((row, r), [])
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(hi, spans[-1][1])
                    else:
                        spans.append([lo, hi])
        matches: dict[int, list[tuple[int, int, int, int]]] = {}
        for (row, r), spans in windows.items():
            for lo, hi in spans:
                matches.setdefault(row, []).extend((*m.span(), self.rules[r].rank, r) for m in self.pattern(r).finditer(text, lo, hi))
        return places, matches


def scan(docs: DataFrame, rules: list[Rule] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, t, n_words, places (label, word) of the phrases and found (label, rule, first, last word, text) of the rules."""
    rules, phrases = all_rules() if rules is None else rules, PHRASES if phrases is None else phrases
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    found = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("weight", pa.float64()), ("first", pa.int64()), ("last", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, phrases)
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            for lo, hi in C.steps(offsets):
                text, rows = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                before = np.searchsorted(blanks, rows)
                places, matches = scanner.scan(text, rows)

                def word(byte: int, row: int) -> int:
                    return int(np.searchsorted(blanks, byte) - before[row])

                seen = [[{"label": scanner.phrases[p][1], "word": word(a, i)} for a, p in places.get(i, [])] for i in range(hi - lo)]
                stand = [
                    [
                        {"label": rules[r].label, "rule": r, "weight": rules[r].weight, "first": word(a, i), "last": word(b - 1, i), "text": text[a:b].decode()}
                        for a, b, _, r in standing(matches.get(i, []))
                        if rules[r].label
                    ]
                    for i in range(hi - lo)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("t").slice(lo, hi - lo), pa.array(np.diff(before).astype(np.int64)), pa.array(seen, pa.list_(place)), pa.array(stand, pa.list_(found))],
                    names=["doc_id", "t", "n_words", "places", "found"],
                )

    schema = "doc_id long, t long, n_words long, places array<struct<label: string, word: long>>, found array<struct<label: string, rule: int, weight: double, first: long, last: long, text: string>>"
    return C.keyed(docs).mapInArrow(run, schema)


def report(scanned: DataFrame) -> DataFrame:
    """One row a document: counts and places of the phrases, both kinds of labels, and a score from the best weight of each label."""
    words = F.transform("places", lambda x: x["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    weights = F.concat(F.transform("places", lambda x: F.struct(x["label"].alias("label"), F.lit(PHRASE_WEIGHT).alias("weight"))), F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["weight"].alias("weight"))))
    rows = scanned.withColumns({"_base": base, "_all": weights})
    rows = rows.withColumn("_labels", F.array_sort(F.array_distinct(F.transform("_all", lambda x: x["label"]))))
    best = lambda label: F.array_max(F.transform(F.filter("_all", lambda y: y["label"] == label), lambda y: y["weight"]))
    score = 1 - F.aggregate("_labels", F.lit(1.0), lambda s, x: s * (1 - best(x)))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"), F.array_join("_labels", ",").alias("labels"), score.alias("score"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """report() of all rules and phrases."""
    return report(scan(docs))
