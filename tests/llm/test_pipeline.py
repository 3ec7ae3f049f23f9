"""The pipeline on a small corpus with planted cases, stage by stage against slow versions."""

import random

import pytest
import sentencepiece

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from motionlake.llm.queries import ORACLES, QUERIES, piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(7)
    words = ["w%d" % k for k in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, prose(25)) for k in range(10)]
    docs, toxic = [], {}
    for i in range(300):
        text = prose(r.choice([20, 60, 150]))
        if i % 6 == 0:
            text += " zorgilen " + r.choice(["vroxy", "zorgil"])
        docs.append([i, text])
        toxic[i] = int(i % 6 == 0)
    for k, i in enumerate(range(1000, 1010)):  # exact and near copies
        docs.append([i, docs[k * 7 + 1][1] if k % 2 else docs[k * 7 + 1][1] + " tail"])
    for k, i in enumerate(range(2000, 2005)):  # benchmark passages
        docs.append([i, prose(30) + " " + items[k][1] + " " + prose(30)])
    docs += [[3000, prose(10) + " password=abcdefgh12345678 " + prose(10)], [3001, None], [3002, ""]]
    path = tmp_path_factory.mktemp("data")
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs, toxic


def test_stages(spark, corpus, tmp_path):
    path, docs, toxic = corpus
    at = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, path).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert at.columns == COLUMNS
        seen.append({r.doc_id: r for r in at.collect()})
    ids = [set(s) for s in seen]
    assert set(d[0] for d in docs) - ids[0] >= {i for i, y in toxic.items() if y} and ids[0] >= {i for i, y in toxic.items() if not y}
    assert ids[0] - ids[1] >= {i for i in range(1000, 1010) if (i - 1000) * 7 + 1 in ids[0]} and {3001, 3002} <= ids[1]
    assert ids[1] - ids[2] == {2000, 2001, 2002, 2003, 2004}
    assert ids[3] == ids[2] == ids[4] and "[REDACTED]" in seen[3][3000].text and seen[3][3000].n_chars == len(seen[3][3000].text)
    assert all(seen[3][i].text == seen[2][i].text for i in ids[3] - {3000})
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for i in sorted(ids[4])[::9]:
        assert seen[4][i].ids == library.encode(seen[3][i].text or "") and seen[4][i].n_tokens == len(seen[4][i].ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()} == ids[4]


def test_stages_take_odd_tables(spark, corpus):
    """Nulls anywhere, repeated rows, very long texts, columns of clashing names, and no rows at all."""
    path, _, _ = corpus
    odd = [
        (1, None, None, None, None, "x", 1, None), (2, "", "en", "s", 0, None, None, [1]), (2, "", "en", "s", 0, None, None, [1]), (None, "w1 w2 w3 w4 w5 w6", None, "s", 9, "y", 2, []),
        (5, "w9 " * 90000 + "password=abcdefgh12345678", "en", None, 270000, "z", 3, None), (6, " \n\t ", "en", "s", 4, "x", 4, None), (7, "w7 w8 w9 é \u2581 \x00 w1", "de", "s", 20, "x", 5, None), (7, "w7 w8 w9 é \u2581 \x00 w1", "de", "s", 20, "x", 5, None),
    ]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, id string, score long, spans array<int>")
    for rows in (docs, docs.limit(0)):
        count = rows.count()
        for name, stage in corpus_pipeline.STAGES[:4]:
            found = stage(spark, rows, path)
            assert found.columns == docs.columns and found.count() == count, name
        assert corpus_pipeline.STAGES[4][1](spark, rows, path).count() == count
    clean = corpus_pipeline.STAGES[3][1](spark, docs, path).where("doc_id = 5").first()
    assert clean.text == "w9 " * 90000 + "[REDACTED]" and clean.n_chars == len(clean.text)


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 10 and corpus_pipeline.ORACLE_SQL is None
