"""Toxicity scores from averaged subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from claimweave.llm.common import held_out, query, stored, table

WORD = re.compile(r"\w+")
SHORTEST, LONGEST = 3, 5
CACHED = 500_000
TEXTS_AT_ONCE = 200
PRIME, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Embeddings (buckets x dim) and the softmax over them; ``margins`` is the embeddings times the class difference."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    margins: np.ndarray | None = None

    def margin(self) -> np.ndarray:
        if self.margins is None:
            self.margins = self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])
        return self.margins

    def learn(self, words: list[str], cache: dict[str, float]) -> None:
        """Puts the mean margin of each word's subwords into the cache."""
        if words:
            at, sizes = subwords(words, len(self.embeddings))
            sums = np.add.reduceat(self.margin()[at].astype(float), np.cumsum(sizes) - sizes)
            cache.update(zip(words, (sums / sizes).tolist(), strict=True))

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> list[float]:
        """Probabilities of class 1; the bias alone for a text without words."""
        bags = [Counter(WORD.findall((t or "").lower())) for t in texts]
        fresh = {w for bag in bags for w in bag if w not in cache}
        if len(cache) + len(fresh) > CACHED:
            cache.clear()
            fresh = {w for bag in bags for w in bag}
        self.learn(sorted(fresh), cache)
        shift, out = float(self.bias[1] - self.bias[0]), []
        for bag in bags:
            total = sum(n * cache[w] for w, n in bag.items()) / max(1, sum(bag.values()))
            out.append(float(1 / (1 + np.exp(-np.clip(total + shift, -500, 500)))))
        return out


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every marked word and of its character n-grams, word after word, and how many each word has.

    All words are hashed at once: a polynomial over the code points of each n-gram, then mixed.
    """
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    power = np.cumprod(np.full(LONGEST, PRIME, np.uint64))
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weights = np.cumprod(np.full(int(sizes.max()), PRIME, np.uint64))
    hashed = [np.add.reduceat(codes * weights[place], np.cumsum(sizes) - sizes)]
    rows = [np.arange(len(words))]
    for n in range(SHORTEST, LONGEST + 1):
        starts = np.flatnonzero(left >= n)
        value = np.full(len(starts), n, np.uint64)
        for i in range(n):
            value += codes[starts + i] * power[i]
        hashed.append(value)
        rows.append(word[starts])
    value, row = np.concatenate(hashed), np.concatenate(rows)
    value = (value ^ (value >> np.uint64(29))) * MIX
    at = ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return at[order], np.bincount(row, minlength=len(words))


def features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A text as a bag: each word the mean of its subwords, the text the mean of its words."""
    words = Counter(WORD.findall((text or "").lower()))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    at, sizes = subwords(list(words), buckets)
    share = np.array(list(words.values())) / sum(words.values())
    found, where = np.unique(at, return_inverse=True)
    return found, np.bincount(where, np.repeat(share / sizes, sizes))


def sampled(docs: DataFrame, labels: DataFrame, each: int, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, weights) of the whole texts of at most ``each`` documents of either label.

    Chosen by a hash of the id among the labelled ids outside the held-out fifth; an id labelled both
    ways counts as 1.  Ids are chosen before any text is read, so the join sends out at most twice ``each`` ids.
    """
    given = labels.select("doc_id", F.col("toxic").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    given = given.filter(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [given.filter(F.col("label") == label).orderBy(*order).limit(each) for label in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("label", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [features(t, buckets) for t in batch["text"]]
            at = [b[0].astype(np.int32).tobytes() for b in bags]
            yield pd.DataFrame({"label": batch["label"], "at": at, "weight": [b[1].astype(np.float32).tobytes() for b in bags]})

    bags = stored(rows.mapInPandas(run, "label int, at binary, weight binary"))
    return [(r.label, np.frombuffer(r.at, np.int32), np.frombuffer(r.weight, np.float32)) for r in bags.toLocalIterator()]


def fit(
    bags: list[tuple[int, np.ndarray, np.ndarray]],
    buckets: int,
    dim: int = 8,
    steps: int = 400,
    entering: int = 2_000,
    penalty: float = 0.3,
) -> Model:
    """Embeddings and softmax trained together by proximal gradient steps, both labels weighing the same.

    A text has thousands of subwords and the sample few thousand texts, so plain training remembers the
    texts.  Three things make it generalise: buckets are scaled to unit deviation (a rare stem counts
    as much as a common ending), those in under one text of 125 (three at least) stay out, and a group
    penalty on each embedding, a share of the largest first gradient, holds at zero what the labels don't call for.
    Only the ``entering`` buckets with the largest first gradient take part.
    """
    rng = np.random.default_rng(7)
    weights, bias = rng.normal(0, 1 / np.sqrt(2 * dim), (dim, 2)), np.zeros(2)
    embeddings = np.zeros((buckets, dim), np.float32)
    labels = np.array([b[0] for b in bags], int)
    n, share = len(bags), np.bincount(labels, minlength=2)
    if n == 0 or share.min() == 0:
        return Model(embeddings, weights, np.log(share + 1.0))
    each = 1 / (2 * share[labels])
    start = (0.5 - labels) * each
    # sums by bucket, a text at a time: only entries of chosen buckets are ever put together
    seen, total, squares, pulled = (np.zeros(buckets) for _ in range(4))
    for (_, at, weight), r in zip(bags, start, strict=True):
        seen[at] += 1
        total[at] += weight
        squares[at] += weight.astype(float) ** 2
        pulled[at] += weight * r
    mean = total / n
    deviation = np.sqrt(np.maximum(squares / n - mean**2, 0))
    common = (seen >= max(3, n // 125)) & (deviation > 0)
    scale = np.where(common, 1 / np.where(common, deviation, 1), 0)
    pull = np.abs(pulled * scale - mean * scale * start.sum())
    chosen = np.argsort(-pull, kind="stable")[:entering]
    chosen = chosen[pull[chosen] > 0]
    if len(chosen) == 0:
        return Model(embeddings, weights, bias)
    place = np.full(buckets, -1)
    place[chosen] = np.arange(len(chosen))
    used = [place[b[1]] >= 0 for b in bags]
    docs = np.repeat(np.arange(n), [u.sum() for u in used])
    at = np.concatenate([place[b[1][u]] for b, u in zip(bags, used, strict=True)])
    x = np.concatenate([b[2][u] * scale[b[1][u]] for b, u in zip(bags, used, strict=True)])
    middle, held = mean[chosen] * scale[chosen], penalty * pull.max()

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(docs, x * v[at], n) - middle @ v

    def backward(r: np.ndarray) -> np.ndarray:
        return np.bincount(at, x * r[docs], len(chosen)) - middle * r.sum()

    # the steepest curvature bounds the step
    direction, curve = rng.normal(size=len(chosen)), 1.0
    for _ in range(20):
        direction = backward(each * forward(direction))
        curve = float(np.linalg.norm(direction))
        direction = direction / max(curve, 1e-12)
    part = np.zeros((len(chosen), dim))
    for _ in range(steps):
        rate = 1 / (0.5 * curve * (weights**2).sum() + 1e-9)
        logits = np.stack([forward(part @ weights[:, k]) for k in (0, 1)], axis=1) + bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        residual = (odds / odds.sum(axis=1, keepdims=True) - np.eye(2)[labels]) * each[:, None]
        spread = np.stack([backward(residual[:, k]) for k in (0, 1)], axis=1)
        pulled = part.T @ spread
        part = part - rate * (spread @ weights.T)
        size = np.linalg.norm(part, axis=1, keepdims=True)
        part = part * np.maximum(0, 1 - rate * held / np.maximum(size, 1e-12))
        weights = weights - 0.1 * pulled
        bias = bias - residual.sum(axis=0)
    embeddings[chosen] = part * scale[chosen, None]
    return Model(embeddings, weights, bias - middle @ part @ weights)


def train(docs: DataFrame, labels: DataFrame, each: int = 1_500, buckets: int = 1 << 18) -> Model:
    """A model from labels (doc_id, toxic); ``each`` bounds the sample of either label, ``buckets`` the model."""
    return fit(sampled(docs, labels, each, buckets), buckets)


def _shared(spark: SparkSession, model: Model):
    """The model as a broadcast value, less what only training needs."""
    model.margin()
    slim_model = Model(np.empty((len(model.embeddings), 0), np.float32), np.empty((0, 2)), model.bias, model.margins.astype(np.float32))
    return spark.sparkContext.broadcast(slim_model)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row by its whole text; an empty or null text has the score of no words.

    Repeated rows get equal scores, null ids and further columns change nothing, no rows give no rows.
    Without labelled rows all scores are a half; with one label only, its share with one added to both counts.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = _shared(docs.sparkSession, model)
    slim = docs.select(F.col(id_col).alias("_i"), held_out(F.col(id_col)).alias("_h"), F.col(text_col).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for batch in batches:
            texts = list(batch["_t"])
            found = np.array([s for i in range(0, len(texts), TEXTS_AT_ONCE) for s in shared.value.scores(texts[i : i + TEXTS_AT_ONCE], cache)], float)
            yield pd.DataFrame({"_i": batch["_i"], "held_out": batch["_h"], "score": found, "predicted": (found >= 0.5).astype(np.int32)})

    out = slim.mapInPandas(run, f"_i {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("_i", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text is not predicted toxic, columns as they came; a null or empty text stays."""
    shared = _shared(docs.sparkSession, train(docs, labels))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for batch in batches:
            texts = list(batch)
            found = [s for i in range(0, len(texts), TEXTS_AT_ONCE) for s in shared.value.scores(texts[i : i + TEXTS_AT_ONCE], cache)]
            yield pd.Series(np.array(found, float) < 0.5)

    clean = F.pandas_udf(run, "boolean", PandasUDFType.SCALAR_ITER)
    return docs.filter(clean(F.col("text")))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
