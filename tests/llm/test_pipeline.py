"""The pipeline's stages on planted documents: what must go goes, clean documents stay."""

import random

import corpus_pipeline as P
import pytest
from tokenizers import Tokenizer

from skyloom.llm.queries import TOKENIZER


@pytest.fixture
def planted(spark, tmp_path):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdeginorst") for _ in range(r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bench = [text(40) for _ in range(10)]
    rows, kind = [], {}
    for i in range(400):
        t, k = text(r.randint(80, 200)), "clean"
        if i % 20 == 1:
            t, k = text(10), "junk"
        elif i % 20 == 2:
            t, k = rows[i - 2][1], "copy"
        elif i % 20 == 3:
            words = t.split(" ")
            words[40:40] = bench[i % 10].split(" ")
            t, k = " ".join(words), "leak"
        elif i % 20 == 4:
            t += f" kim.{i}@mail.example.com"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        kind[i] = k
    rows += [(900, None, None, None, None), (None, text(90), "en", "s1", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict((x[0], x[1]) for x in rows), kind


def test_run(spark, planted):
    sf_dir, texts, kind = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    want = {i for i, k in kind.items() if k == "clean"} | {None}
    assert {x.doc_id for x in docs.collect()} == want
    got = {x.doc_id: x for x in P.run(spark, sf_dir).collect()}
    assert set(got) == want
    lib = Tokenizer.from_file(TOKENIZER)
    for i, x in got.items():
        ids = lib.encode(texts[i].replace(f"kim.{i}@mail.example.com", "[email]"), add_special_tokens=False).ids
        assert bytes(x.ids) == b"".join(n.to_bytes(4, "little") for n in ids) and x.n_tokens == len(ids)


def test_odd_rows(spark, tmp_path):
    """Nulls, blanks, repeated rows, a very long text and columns that stages use themselves."""
    r = random.Random(31)
    vocabulary = ["".join(r.choice("abcdeginorst") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    good = [text(120) for _ in range(6)]
    rows = [(i, t, None if i == 2 else "en", None if i == 3 else "s") for i, t in enumerate(good)] + [(1, good[1], "en", "s")] * 3
    rows += [(None, good[4], None, None), (None, None, None, None), (7, "", "en", "s"), (8, " \n\t", "en", "s"), (9, text(60_000), "en", "s")]
    columns = "doc_id long, text string, lang string, source string, t long, fp string, label int, kept string, spans int, n long, _id long, item_id long"
    docs = spark.createDataFrame([(*x, 1, "f", 2, "k", 3, 4, 5, 6) for x in rows], columns)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    kept = sorted((x.doc_id, x.text, x.label, x.kept, x._id) for x in now.collect())
    assert kept == sorted((i, t, 2, "k", 5) for i, t in [*enumerate(good), (9, rows[-1][1])])
    assert sorted(x.doc_id for x in P.run(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4, 5, 9]
    none = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{none}/benchmark.parquet")
    assert P.run(spark, none).collect() == []
