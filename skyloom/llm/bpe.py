"""BPE encoding and decoding with forced boundaries.

A pair of adjacent bytes that occurs inside no token of the vocabulary can't be joined by any merge, so
it marks a certain cut: the fragments on both sides are encoded independently and their ids joined end to
end. White space and the pre-tokenizer's borders are such cuts too. The new fragments of a step are merged
together, on arrays: each round joins, in every fragment, all places of its pair of least rank. Fragments repeat, so
each worker keeps the chunks it has encoded lately; the memory for that is bounded by KEPT_CHUNKS.

The vocabulary file is the JSON of the tokenizers library for word-end BPE; its path is a parameter and
every executor reads it there. The library itself isn't used: tests hold the results against it.

Cases: a null or blank text has no tokens and decodes to an empty text; repeated rows get equal results;
special tokens written in a text become their ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skyloom.llm import common as C

#: White-space-delimited chunks of text that a worker keeps encoded (two generations of this many).
KEPT_CHUNKS = 250_000
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class Bpe(dict):
    """Encoded chunks by their UTF-8 bytes: (ids as little-endian uint32, decoded text as UTF-8)."""

    #: Above all ids, and above all ranks.
    SIDE, NONE = 1 << 31, 1 << 60

    def __init__(self, path: str) -> None:
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            raw = [byte_of[c] for c in token.removesuffix(self.end)]
            self.inside[raw[:-1], raw[1:]] = True
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White_Space of Unicode, which the library's \s is, without the control characters \x1c to \x1f
        self.pieces = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.first, self.last = (np.array([self.vocab[c + e] for c in self.letters]) for e in ("", self.end))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([self.vocab[x] * self.SIDE + self.vocab[y] for x, y in pairs])
        self.rank = np.argsort(key, kind="stable")
        self.key = key[self.rank]
        self.joined = np.array([self.vocab[x + y] for x, y in pairs])
        self.words = {t: (i.to_bytes(4, "little"), t.encode()) for t, i in self.special.items()}
        self.shown = {i: t.encode() for i, t in self.names.items()}
        self.known: dict[str, tuple[bytes, bytes]] = {}  # by piece
        self.old: dict[bytes, tuple[bytes, bytes]] = {}

    def need(self, chunks: set[bytes]) -> None:
        """Have all of ``chunks`` encoded."""
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > KEPT_CHUNKS:
            self.old = dict(self)
            self.clear()
            new = list(chunks)
        fresh = {}
        for c in new:
            found = self.old.get(c)
            if found is None:
                fresh[c] = self.pieces_of(c.decode())
            else:
                self[c] = found
        if len(self.known) > KEPT_CHUNKS:
            self.known.clear()
        self.learn({p for parts in fresh.values() for p in parts if p not in self.known and p not in self.words})
        for c, parts in fresh.items():
            found = [self.words.get(p) or self.known[p] for p in parts]
            self[c] = found[0] if len(found) == 1 else (b"".join([x[0] for x in found]), b" ".join([x[1] for x in found]))

    def pieces_of(self, chunk: str) -> list[str]:
        """What the pre-tokenizer makes of a chunk; special tokens stay whole."""
        if "<" not in chunk:
            return self._plain(chunk)
        out: list[str] = []
        for part in self.specials.split(chunk):
            out += [part] if part in self.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        text = text.lower()
        return [text] if text.isalpha() else self.pieces.findall(text)

    def learn(self, pieces: Iterable[str]) -> None:
        """Cut the pieces between bytes that no token has side by side, encode the fragments, join their ids."""
        pieces = list(pieces)
        if not pieces:
            return
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.inside[data[:-1], data[1:]]
        cut[ends[:-1]] = True
        symbols = self.first[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        starts = np.flatnonzero(cut)
        ids, sizes = self.merge(symbols, starts)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, np.concatenate(([0], ends)))].tolist()
        packed, listed, shown = ids.astype("<u4").tobytes(), ids.tolist(), self.shown
        for p, a, b in zip(pieces, bounds, bounds[1:]):
            self.known[p] = packed[4 * a : 4 * b], b" ".join([shown[i] for i in listed[a:b]])

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.SIDE + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], self.NONE)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All fragments' ids end to end, and how many each has; merges of least rank first, left to right."""
        n = len(starts)
        owner = np.zeros(len(symbols), np.int64)
        owner[starts] = 1
        owner = np.cumsum(owner) - 1
        rank = np.full(len(symbols), self.NONE)
        rank[:-1] = self.ranks_of(symbols[:-1], symbols[1:])
        rank[:-1][owner[1:] != owner[:-1]] = self.NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(symbols))))
            over = best == self.NONE
            if over.any():
                done.append((owner[over], symbols[over]))
                go = ~over
                symbols, owner, rank, best = symbols[go], owner[go], rank[go], best[go]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            # places side by side overlap: of such a run the first, third, ... are joined
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.joined[rank[at]]
            rank[at] = rank[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            # the pairs that the joined symbols are part of
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(symbols)]
                left = left[owner[left] == owner[left + 1]]
                rank[left] = self.ranks_of(symbols[left], symbols[left + 1])
            rank[at[at + 1 == len(symbols)]] = self.NONE
            last = at[at + 1 < len(symbols)]
            rank[last[owner[last] != owner[last + 1]]] = self.NONE
        owners, symbols = (np.concatenate(x) for x in zip(*done))
        return symbols[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=n)

    def encode_chunk(self, chunk: str) -> list[int]:
        self.need({chunk.encode()})
        return np.frombuffer(self[chunk.encode()][0], "<u4").tolist()


def bpe(path: str) -> Bpe:
    """The worker's encoder, the latest of at most two files.

    It is kept on the interpreter: functions pickled by value get new module globals in each task.
    """
    kept: dict[str, Bpe] = sys.__dict__.setdefault("_skyloom_bpe", {})
    if path not in kept:
        if len(kept) > 1:
            kept.pop(next(iter(kept)))
        kept[path] = Bpe(path)
    return kept[path]


def encode(docs: DataFrame, path: str, digests_only: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless ``digests_only``, ids and decoded.

    ids are little-endian unsigned 32-bit integers in a binary column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = bpe(path)
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            for lo, hi in C.steps(offsets):
                ids, decoded = [], []
                lists = [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(lo, hi)]
                chunks.need(set().union(*lists))
                for words in lists:
                    found = [chunks[x] for x in words]
                    ids.append(b"".join([x[0] for x in found]))
                    decoded.append(b" ".join([x[1] for x in found if x[1]]))
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                arrays = [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(decoded)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if not digests_only:
                    arrays += [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return C.keyed(docs).drop("t").mapInArrow(run, DIGESTS if digests_only else DIGESTS + ", ids binary, decoded string")
