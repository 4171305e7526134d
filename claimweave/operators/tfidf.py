"""TF-IDF with smoothed idf, fitted on one split and applied to all."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.scale import cut_lineage, fits_broadcast


def accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    accented, plain = [], []
    for code in range(0xC0, 0x180):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(code):
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


def strip_accents(c: Column) -> Column:
    return F.translate(c, *accent_table())


def grams(c: Column | str) -> Column:
    """Words of two or more characters and their bigrams, accents stripped."""
    found = T.find_all(strip_accents(F.lower(T.text_of(c))), T.WORD_PATTERN)
    return F.filter(found, lambda w: F.length(w) >= 2)


def with_bigrams(words: Column) -> Column:
    """The words, then each joined with the next one; no list is made for a pair."""
    after = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    return F.concat(words, F.array_compact(F.zip_with(words, after, lambda a, b: F.concat(a, F.lit(" "), b))))


def document_frequency(
    docs: DataFrame,
    text_col: str = "text",
    min_df: int = 5,
    max_df: float = 0.7,
    max_features: int = 5000,
) -> DataFrame:
    """Vocabulary (term, df, tf, n_docs): the most frequent terms that are neither rare nor everywhere.

    Counts go through one aggregate by term with map-side combine; the document
    frequency comes from the distinct grams of each row, so no (document, term) pair
    is shuffled.
    """
    n_docs = docs.count()
    prepared = docs.select(grams(text_col).alias("_words"))
    prepared = prepared.select(with_bigrams(F.col("_words")).alias("_grams"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = F.concat(
        F.transform("_grams", lambda g: F.struct(g.alias("term"), one.alias("tf"), zero.alias("df"))),
        F.transform(F.array_distinct("_grams"), lambda g: F.struct(g.alias("term"), zero.alias("tf"), one.alias("df"))),
    )
    exploded = prepared.select(F.inline_outer(rows)).filter(F.col("term").isNotNull())
    counts = exploded.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    kept = counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    top = kept.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    return top.withColumn("n_docs", F.lit(n_docs).cast("long"))


def idf() -> Column:
    return F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1


def tfidf_transform(docs: DataFrame, vocabulary: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Long rows (id, term, tfidf), L2-normalised per document.

    Grams outside the vocabulary are dropped before anything moves; the rest moves once, by id, and
    is counted and normalised there.  The vocabulary is written once, and broadcast if a count proves it small.
    """
    vocab = cut_lineage(vocabulary.select("term", idf().alias("_idf")))
    vocab = F.broadcast(vocab) if fits_broadcast(vocab) else vocab
    prepared = docs.select(id_col, grams(text_col).alias("_words"))
    # outer: an inner explode gets a filter on the array's size, for which the grams are made twice
    rows = prepared.select(id_col, F.explode_outer(with_bigrams(F.col("_words"))).alias("term"))
    known = rows.join(vocab, "term").repartition(id_col)
    weights = known.groupBy(id_col, "term").agg((F.count(F.lit(1)) * F.first("_idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return weights.select(id_col, "term", (F.col("_w") / norm).alias("tfidf"))


def tfidf(
    docs: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    split_col: str = "split",
    fit_on: str = "train",
    **limits,
) -> DataFrame:
    vocabulary = document_frequency(docs.filter(F.col(split_col) == fit_on), text_col, **limits)
    return tfidf_transform(docs, vocabulary, id_col, text_col)
