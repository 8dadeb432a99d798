"""Own BPE against the tokenizers library, by text and by table."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from skyloom.llm.bpe import Bpe, encode

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "  \t\n", "Hello world", "it's WE'LL I'd 'S 'sa ''s", "a<|endoftext|>b <|startoftext|><|endoftext|> <|ENDOFTEXT|> <|endof",
    "ΑΣ ΣΑΣ İstanbul Straße ǅ ﬁ Ⅷ ½ 123 ٣٤ 你好 \U0001f600\U0001f468‍\U0001f469", "é ́x á̧ 가 Å", "a\x1cb \x1d\x1e x\x85y   z w　v​q ﻿",
    "\x00\x01\x7f a\x0bb", "x" * 3000, "!" * 500, "ab" * 700, "the" * 400, "Élève çà où naïve", "İİ", "word," * 50, "힣ᆨ", "Ω ẞ ͅ Ϊ́",
]


def more():
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzéèñßöABCÉ0123456789'.,!?-_<|> \n\t́你Ж "
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 400))) for _ in range(150)]


def test_like_the_library(spark):
    lib, texts = Tokenizer.from_file(PATH), TEXTS + more()
    own = Bpe(PATH)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = {}
    for x in encode(docs.selectExpr("doc_id", "text", "1 ids", "2 t").repartition(4), PATH).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert len(got[1]) == 3 and len(got[None]) == 1
    for i, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        x = got[i][0]
        assert bytes(x.ids) == raw, text
        assert (x.n_tokens, x.ids_sha256, x.decoded, x.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), decoded, hashlib.sha256(decoded.encode()).hexdigest())
    assert own.inside.mean() < 0.9  # there are forced boundaries
    assert encode(docs.limit(0), PATH).collect() == []


def test_fragments_join_to_the_whole():
    own, lib = Bpe(PATH), Tokenizer.from_file(PATH)
    r = random.Random(9)
    for _ in range(500):
        word = "".join(r.choice("aehnostüéx") for _ in range(r.randint(1, 24)))
        assert own.encode_chunk(word) == lib.encode(word, add_special_tokens=False).ids
