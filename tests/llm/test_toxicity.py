import random

import numpy as np
from llm_helpers import clashing, documents, prose
from pyspark.sql import functions as F

from claimweave.llm import toxicity as X


def corpus(spark, n=500):
    rng = random.Random(5)
    stems = ["zork", "bliff", "quamp"]
    texts, labels = [], []
    for i in range(n):
        words, bad = prose(rng, rng.randrange(20, 120), 2000), i % 6 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "s", "ed", "ing"]))
        texts.append(" ".join(words))
        labels.append((i, 1, int(bad)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_labels_and_misspellings(spark):
    docs, labels, truth = corpus(spark)
    model = X.train(docs, labels)
    got = {r.doc_id: r for r in X.scores(docs, model).collect()}
    out = [(got[i], t) for i, _, t in truth if got[i].held_out]
    assert sum(r.predicted == t for r, t in out) >= 0.95 * len(out)
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in got.values())
    clean = docs.first().text if truth[0][2] == 0 else docs.collect()[1].text
    plain, spelt = model.scores([clean, clean + " zorkx zorky bliffen quampo"], {})
    assert plain < 0.5 < spelt


def test_embeddings_give_the_margins():
    rng = np.random.default_rng(0)
    bags = [(i % 2, np.array([i % 2, 2 + i % 5, 9]), np.array([0.5, 0.3, 0.2])) for i in range(60)]
    model = X.fit(bags, 16, steps=100)
    assert np.allclose(model.margin(), model.embeddings @ (model.weights[:, 1] - model.weights[:, 0]))
    bag = lambda b: float(model.margin()[b[1]] @ b[2] + model.bias[1] - model.bias[0])
    assert all((bag(b) > 0) == (b[0] == 1) for b in bags) and rng is not None


def test_subwords_are_the_word_and_its_pieces():
    words = ["a", "abc", "épée", "abcabc", "x" * 300]
    at, sizes = X.subwords(words, 1 << 40)
    assert sizes.tolist() == [1 + sum(max(0, len(w) + 3 - n) for n in (3, 4, 5)) for w in words]
    ends = np.cumsum(sizes)
    parts = [at[e - s : e] for e, s in zip(ends, sizes, strict=True)]
    alone = [X.subwords([w], 1 << 40)[0] for w in words]
    assert all((a == b).all() for a, b in zip(parts, alone, strict=True))
    # <ab, abc, bc> and their like: "abc" and "abcabc" share the first piece and "abc"
    assert len(set(parts[1]) & set(parts[3])) >= 3 and len(set(parts[4])) < 20


def test_a_small_cache_changes_nothing(monkeypatch):
    model = X.Model(np.zeros((1 << 10, 1), np.float32), np.ones((1, 2)), np.zeros(2), np.random.default_rng(1).normal(size=1 << 10))
    texts = ["one two three", None, "two four " * 9, "five"]
    want = model.scores(texts, {})
    monkeypatch.setattr(X, "CACHED", 2)
    assert [s for t in texts for s in model.scores([t], {})] == want


def test_labels_are_no_inputs_of_a_score_and_the_held_out_are_not_learned(spark):
    docs, labels, _ = corpus(spark)
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    one = {r.doc_id: r.score for r in X.scores(docs, X.train(docs, labels)).collect()}
    two = {r.doc_id: r.score for r in X.scores(docs, X.train(docs, flipped)).collect()}
    assert one == two


def test_edges(spark):
    docs, labels, _ = corpus(spark)
    model = X.train(docs, labels)
    texts = [None, "", "  ", "zork", "w1 w2 " * 100_000]
    df = clashing(documents(spark, texts))
    rows = X.scores(df.unionByName(df), model).collect()
    by_id = {r.doc_id: r.score for r in rows}
    assert len(rows) == 10 and by_id[0] == by_id[1] == by_id[2] and 0 <= min(by_id.values()) and max(by_id.values()) <= 1
    none = labels.limit(0)
    assert {r.score for r in X.scores(df, X.train(docs, none)).collect()} == {0.5}
    only = labels.filter("toxic = 0")
    assert all(r.predicted == 0 for r in X.scores(df, X.train(docs, only)).collect())
    assert X.scores(df.filter(F.lit(False)), model).count() == 0
    kept = X.drop_toxic(docs.unionByName(spark.createDataFrame([(None, "w1 w2", None, None, None)], docs.schema)), labels)
    assert kept.columns == docs.columns and kept.filter("doc_id IS NULL").count() == 1


def test_repeated_and_null_labels(spark):
    docs, labels, _ = corpus(spark, 120)
    more = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None)], labels.schema))
    one = {r.doc_id: r.score for r in X.scores(docs, X.train(docs, labels)).collect()}
    assert {r.doc_id: r.score for r in X.scores(docs, X.train(docs, more)).collect()} == one
