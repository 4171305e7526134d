import random
import zlib

from llm_helpers import clashing, documents
from pyspark.sql import functions as F

from claimweave.llm import language_id as L

STEMS = {"aa": ["bar", "kol", "mun"], "bb": ["schei", "tzu", "gra"], "cc": ["éau", "oix", "que"]}


def made(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(spark, n=300):
    rng = random.Random(1)
    langs = [rng.choice(list(STEMS)) for _ in range(n)]
    return documents(spark, [made(rng, lang, 30) for lang in langs], langs=langs), langs


def test_held_out_and_unseen_words(spark):
    docs, langs = corpus(spark)
    model = L.train(L.training_rows(docs))
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, lang in enumerate(langs))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    unseen = [("barkolmunbarkolmun", "aa"), ("Scheitzugraschei!", "bb"), ("éauoixqueéauoix 12", "cc")]
    assert [model.predict(t, {})[0] for t, _ in unseen] == [lang for _, lang in unseen]
    assert "barkolmunbarkolmun" not in model.words


def test_backoff_takes_the_longest_known_length():
    import numpy as np

    model = L.Model(["x", "y"], {}, np.zeros((0, 2)), {"<ab": 0, "c": 1, "ab": 2}, np.log([[0.9, 0.1], [0.1, 0.9], [0.5, 0.5]]))
    assert np.allclose(model.unseen("abc"), np.log([0.9, 0.1]))
    assert np.allclose(model.unseen("zc"), np.log([0.1, 0.9]))
    assert model.unseen("zzz") is None


def test_labels_are_never_inputs_of_a_prediction(spark):
    docs, _ = corpus(spark)
    model = L.train(L.training_rows(docs))
    other = docs.withColumns({"lang": F.lit("bb"), "source": F.lit("?"), "doc_id": F.col("doc_id") + 1000})
    one = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, model).collect()}
    assert {r.doc_id - 1000: (r.lang_pred, r.score) for r in L.identify(other, model).collect()} == one


def test_edges(spark):
    docs, _ = corpus(spark)
    model = L.train(L.training_rows(docs))
    texts = [None, "", "12 .. ½ Ⅷ\n", "bar", "kol " * 200_000]
    df = clashing(documents(spark, texts))
    rows = L.identify(df.unionByName(df), model).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in rows if r.doc_id < 3} <= {(0, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (2, "aa", 0.0)}
    assert {(r.doc_id, r.lang_pred) for r in rows if r.doc_id != 2} == {(0, "und"), (1, "und"), (3, "aa"), (4, "aa")} and len(rows) == 10
    empty = L.train(L.training_rows(docs.filter(F.lit(False))))
    assert {(r.lang_pred, r.score) for r in L.identify(df, empty).collect()} == {("und", 0.0)}
    assert L.identify(df.filter(F.lit(False)), model).count() == 0
    assert L.identify(spark.createDataFrame([(None, "bar")], "doc_id long, text string"), model).first().doc_id is None


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in L.op3_language_id(spark, sf).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_every_short_piece_of_a_word_is_counted(spark):
    df = spark.createDataFrame([("abcab", "x", 1)], "text string, lang string, order long")
    model = L.train(df)
    marked = "<abcab>"
    assert set(model.grams) == {marked[i : i + n] for n in range(1, 5) for i in range(len(marked) - n + 1)}
