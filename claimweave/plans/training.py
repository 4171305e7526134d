"""Training sets, the classifier and its evaluation with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.functions import text as T
from claimweave.operators import metrics as M
from claimweave.operators.evidence import rank_evidence, relevant_only
from claimweave.operators.features import fill_nan, linguistic_features
from claimweave.operators.sampling import augment_minority, oversample_minority, standardize_labels, stratified_split
from claimweave.operators.tfidf import document_frequency, grams, idf, tfidf_transform
from claimweave.scale import cut_lineage
from claimweave.sources.corpora import preprocess_corpus
from claimweave.sources.store import write_feature_store


@dataclass
class TrainingSet:
    rows: DataFrame
    features: DataFrame
    vocabulary: DataFrame
    tfidf: DataFrame
    oversampled: DataFrame
    augmented: DataFrame


def build_training_set(corpus: DataFrame, lexicon: DataFrame, path: str | None = None, seed: int = 42, **limits) -> TrainingSet:
    """Clean, featurise, label, split, balance and vectorise a corpus; optionally write the store.

    The split rows are written once and every part is made from them, so ids and splits are the same in all parts.
    """
    rows = cut_lineage(stratified_split(standardize_labels(preprocess_corpus(cut_lineage(corpus))), seed=seed))
    keep = ["split", "binary_label"]
    features = linguistic_features(rows, lexicon, keep=keep).select("id", *fixed.FEATURE_COLUMNS, *keep)
    train = rows.filter(F.col("split") == "train")
    vocabulary = document_frequency(train, "combined_text", **limits)
    vectors = tfidf_transform(rows, vocabulary, "id", "combined_text")
    train_labels = features.filter(F.col("split") == "train")
    minority = train.filter(F.col("binary_label") == minority_label(train))
    out = TrainingSet(
        rows,
        features,
        vocabulary,
        vectors,
        oversample_minority(train_labels, seed=seed),
        augment_minority(minority.select("id", "combined_text", "binary_label"), text_col="combined_text", seed=seed),
    )
    if path:
        metadata = rows.select("id", "title", "text", "label", "source", "dataset_source", "split")
        write_feature_store(out.features, out.tfidf, path, metadata)
    return out


def minority_label(df: DataFrame, label_col: str = "binary_label") -> int:
    row = df.agg(F.count_if(F.col(label_col) == 0).alias("n0"), F.count_if(F.col(label_col) == 1).alias("n1")).head()
    return 0 if row["n0"] < row["n1"] else 1


def vectorizer(vocabulary: DataFrame) -> PipelineModel:
    """TF-IDF of a gram column as sparse vectors, in the JVM.

    All of the vocabulary takes part; its size is bounded by ``max_features`` of ``document_frequency``.
    """
    terms = vocabulary.select("term", idf().alias("idf")).orderBy("term").collect()
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in terms], inputCol="grams", outputCol="counts")
    weights = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in terms]), inputCol="counts", outputCol="weighted"
    )
    return PipelineModel(stages=[counts, weights, Normalizer(p=2.0, inputCol="weighted", outputCol="tfidf_vector")])


def assemble(
    rows: DataFrame,
    vectors: PipelineModel,
    text_col: str = "combined_text",
    embedding_col: str | None = None,
    columns: list[str] = fixed.FEATURE_COLUMNS,
) -> DataFrame:
    """Column ``features``: embedding, TF-IDF and the linguistic features; NaN and null count 0."""
    filled = fill_nan(rows, columns, [embedding_col] if embedding_col else None)
    found = filled.withColumn("_words", grams(text_col))
    found = found.withColumn("grams", F.concat("_words", T.ngrams(F.col("_words"), 2))).drop("_words")
    out = vectors.transform(found).drop("grams", "counts", "weighted")
    inputs = ["tfidf_vector", *columns]
    if embedding_col:
        out = out.withColumn("embedding_vector", array_to_vector(embedding_col))
        inputs = ["embedding_vector", *inputs]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(out)


def train_classifier(
    assembled: DataFrame,
    name: str = "base",
    label_col: str = "binary_label",
    penalties: tuple[float, ...] = (1.0, 0.1, 0.01),
    max_iter: int = 50,
):
    """Fits one model per penalty on the train split and keeps the best on validation.

    Returns the model and the history (model, epoch, train_accuracy, val_accuracy, val_loss).
    """
    train = assembled.filter(F.col("split") == "train")
    fitted, history = [], None
    for epoch, penalty in enumerate(penalties, start=1):
        lr = LogisticRegression(
            featuresCol="features", labelCol=label_col, regParam=penalty, maxIter=max_iter, standardization=True
        )
        model = lr.fit(train)
        fitted.append(model)
        scored = predictions(assembled.filter(F.col("split") != "test"), model, name, label_col)
        accuracy = M.classification_metrics(scored, ["split"]).select("split", "accuracy")
        table = accuracy.join(M.bce_loss(scored, ["split"]), "split")
        row = table.agg(
            F.max(F.when(F.col("split") == "train", F.col("accuracy"))).alias("train_accuracy"),
            F.max(F.when(F.col("split") == "train", F.col("bce"))).alias("train_loss"),
            F.max(F.when(F.col("split") == "val", F.col("accuracy"))).alias("val_accuracy"),
            F.max(F.when(F.col("split") == "val", F.col("bce"))).alias("val_loss"),
        ).select(F.lit(name).alias("model"), F.lit(epoch).alias("epoch"), "*")
        history = row if history is None else history.unionByName(row)
    measured = history.collect()  # one row per penalty
    history = assembled.sparkSession.createDataFrame(measured, history.schema)
    best = M.best_epoch(history).head()["best_epoch"]
    return fitted[best - 1], history


def predictions(assembled: DataFrame, model, name: str, label_col: str = "binary_label") -> DataFrame:
    """Scored rows (id, model, split, label, prob)."""
    prob = vector_to_array("probability")[1]
    return model.transform(assembled).select(
        "id", F.lit(name).alias("model"), "split", F.col(label_col).alias("label"), prob.alias("prob")
    )


def claim_texts(claims: DataFrame, scored: DataFrame, evidence: DataFrame, id_col: str = "claim_id") -> DataFrame:
    """Model input per claim: the claim and up to 5000 characters of its three best relevant articles."""
    top = rank_evidence(relevant_only(scored), 3, id_col).select(id_col, "ord", "rank")
    texts = top.join(evidence.select(id_col, "ord", "title", "text"), [id_col, "ord"])
    piece = F.concat(T.text_of("title"), F.lit(". "), T.text_of("text"), F.lit(" "))
    joined = texts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("x")))).alias("_p"))
    best = F.array_join(F.transform("_p", lambda s: s["x"]), "")
    out = claims.join(joined, id_col, "left")
    text = F.concat(F.col("claim"), F.lit(" "), F.substring(F.coalesce(best, F.lit("")), 1, 5000))
    return out.select(id_col, text.alias("model_text"))


def score_claims(texts: DataFrame, vectors: PipelineModel, model, embedding_size: int = 0, id_col: str = "claim_id") -> DataFrame:
    """Probability of each claim text; the linguistic features are zero, as is an absent embedding."""
    zero = texts.withColumns({c: F.lit(0.0) for c in fixed.FEATURE_COLUMNS})
    embedding = None
    if embedding_size:
        zero = zero.withColumn("embedding", F.array_repeat(F.lit(0.0), embedding_size))
        embedding = "embedding"
    assembled = assemble(zero, vectors, "model_text", embedding)
    return model.transform(assembled).select(id_col, vector_to_array("probability")[1].alias("probability"))
