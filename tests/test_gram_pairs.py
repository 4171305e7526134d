"""Pairs of neighbours are made for the words that need them, without a list or a struct for each word."""

from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.operators import bias as B
from claimweave.operators.tfidf import with_bigrams


def test_words_and_bigrams(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "a", "b"],)], "w array<string>")
    found = [r[0] for r in df.select(with_bigrams(F.col("w"))).collect()]
    assert found == [[], ["a"], ["a", "b", "a b"], ["a", "b", "a", "b", "a b", "b a", "a b"]]
    assert found == [r[0] for r in df.select(F.concat("w", T.ngrams(F.col("w"), 2))).collect()]


def test_only_tokens_that_matter_are_paired(spark):
    by = {c: [] for c in [*B.TOKEN_CATEGORIES, "loaded"]}
    by |= {"left": ["green deal", "b"], "right": ["deal b"], "positive": ["good"], "exaggeration": ["very"], "subjective": ["think"]}
    docs = [("think green deal b very good green x deal good",), ("deal",), ("",)]
    base = spark.createDataFrame(docs, "_full string").withColumn("_tokens", T.tokenize("_full"))
    found = B._count_inline(base, by)
    names = ["_left", "_left_pairs", "_right_pairs", "_positive", "_more_positive", "_subjective", "_more_subjective"]
    assert [tuple(r) for r in found.select(names).collect()] == [(1, 1, 1, 2, 1, 1, 0), (0,) * 7, (0,) * 7]
    assert "_pairs" not in found.columns
