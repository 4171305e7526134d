"""Language identification by words, backing off to ever shorter character n-grams for unseen ones."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import held_out, query, stored, table

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
CACHED = 200_000


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    def unseen(self, word: str) -> np.ndarray | None:
        """Mean n-gram log frequencies at the longest length that has a known n-gram; None where none has."""
        marked = f"<{word}>"
        for size in range(min(LONGEST, len(marked)), 0, -1):
            at = [g for i in range(len(marked) - size + 1) if (g := self.grams.get(marked[i : i + size])) is not None]
            if at:
                return self.gram_scores[at].mean(axis=0)
        return None

    def predict(self, text: str | None, cache: dict[str, np.ndarray | None]) -> tuple[str, float]:
        """Language and posterior probability; unknown and 0 for a text without letters or a model without languages."""
        low = (text or "").lower()
        if not self.languages or not any(map(str.isalpha, low)):
            return UNKNOWN, 0.0
        known, counts, total = [], [], np.zeros(len(self.languages))
        for word, n in Counter(WORD.findall(low)).items():
            if (row := self.words.get(word)) is not None:
                known.append(row)
                counts.append(n)
                continue
            if word not in cache:
                if len(cache) >= CACHED:
                    cache.clear()
                cache[word] = self.unseen(word)
            if (scores := cache[word]) is not None:
                total += n * scores
        if known:
            total += np.asarray(counts, float) @ self.word_scores[known]
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _frequencies(rows: list, languages: list[str], smoothing: float) -> tuple[dict[str, int], np.ndarray]:
    """Index and smoothed log frequency per language of every (item, lang, n)."""
    place = {lang: i for i, lang in enumerate(languages)}
    index: dict[str, int] = {}
    for item, _, _ in rows:
        index.setdefault(item, len(index))
    counts = np.full((len(index), len(languages)), smoothing)
    for item, lang, n in rows:
        counts[index[item], place[lang]] += n
    return index, np.log(counts / counts.sum(axis=0)).astype(np.float32) if len(index) else counts


def train(
    labelled: DataFrame,
    sample_docs: int = 6_000,
    max_words: int = 100_000,
    max_grams: int = 100_000,
    smoothing: float = 0.2,
) -> Model:
    """A model from rows (text, lang, order); rows with a null in any of them are left out.

    The sample is the ``sample_docs`` rows with the smallest ``order``, read as whole texts.  Words and
    n-grams are counted by Spark; the most frequent ``max_words`` (item, language) pairs of
    either kind, seen twice at least for words, make the model.  These three bounds limit what goes to the driver.
    """
    rows = labelled.dropna(subset=["text", "lang", "order"])
    # the orders alone are ranked, so no text moves for it; of rows that tie at the cut, all are read
    last = rows.select("order").orderBy("order").limit(sample_docs).agg(F.max("order")).first()[0]
    sample = rows.filter(F.col("order") <= F.lit(last))
    words = sample.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("item"))
    words = stored(words.groupBy("item", "lang").agg(F.count(F.lit(1)).alias("n")))
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    top = words.filter("n > 1").orderBy(F.desc("n"), "item", "lang").limit(max_words).select("item", "lang", "n").collect()
    marked = words.select("lang", "n", F.concat(F.lit("<"), "item", F.lit(">")).alias("w"))

    def pieces(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("w") - size + 1)
        cut = F.transform(starts, lambda i: F.substring("w", i, F.lit(size)))
        return F.when(F.length("w") >= size, cut).otherwise(F.array().cast("array<string>"))

    every = F.concat(*[pieces(size) for size in range(1, LONGEST + 1)])
    grams = marked.select("lang", "n", F.explode(every).alias("item")).groupBy("item", "lang").agg(F.sum("n").alias("n"))
    best = grams.orderBy(F.desc("n"), "item", "lang").limit(max_grams).select("item", "lang", "n").collect()
    return Model(languages, *_frequencies(top, languages, smoothing), *_frequencies(best, languages, smoothing))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, by its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if no row was
    labelled.  Ties go to the language that sorts first.  Repeated rows get equal results, null ids and
    further columns change nothing.  One scan; the model is bounded by its training parameters.
    """
    spark: SparkSession = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    shared = spark.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("_i"), held_out(F.col(id_col)).alias("_h"), F.col(text_col).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, np.ndarray | None] = {}
        for batch in batches:
            found = [shared.value.predict(t, cache) for t in batch["_t"]]
            yield pd.DataFrame({"_i": batch["_i"], "held_out": batch["_h"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    out = slim.mapInPandas(run, f"_i {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("_i", id_col)


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fifth, with an order that doesn't follow the ids."""
    return docs.filter(~held_out(F.col("doc_id"))).select("text", "lang", F.xxhash64("doc_id").alias("order"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(training_rows(docs)))
