"""Evaluation of scored rows (model, split, label, prob) and of training histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.features import ratio
from claimweave.scale import cut_lineage, lookup_join, running_totals

ROC_BUCKETS = 128
METRICS = ["accuracy", "precision", "recall", "f1"]


def predicted(prob: str = "prob", threshold: float = 0.5) -> Column:
    return (F.col(prob) > threshold).cast("int")


def _cells(preds: DataFrame, keys: list[str]) -> DataFrame:
    y, p = F.col("label"), predicted()
    return preds.groupBy(*keys).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def classification_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, precision, recall and F1 per key; a zero denominator gives 0."""
    c = _cells(preds, keys)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        *keys,
        (tp + fp + tn + fn).alias("n"),
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_matrix(preds: DataFrame, keys: list[str]) -> DataFrame:
    """All four (label, pred) cells per key, also the empty ones."""
    cells = _cells(preds, keys)
    rows = F.array(
        *[
            F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(name).alias("n"))
            for y, p, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return cells.select(*keys, F.inline(rows))


def bce_loss(preds: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("prob")))
    y = F.col("label")
    return preds.groupBy(*keys).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"))


def compare_models(preds: DataFrame, model_col: str = "model") -> DataFrame:
    """Long table (model, metric, value) of the four metrics and the loss."""
    table = classification_metrics(preds, [model_col]).join(bce_loss(preds, [model_col]), model_col)
    return table.unpivot([model_col], [*METRICS, "bce"], "metric", "value")


def best_epoch(history: DataFrame, model_col: str = "model") -> DataFrame:
    """First epoch with the highest validation accuracy."""
    order = F.struct("val_accuracy", (-F.col("epoch")).alias("e"))
    return history.groupBy(model_col).agg(
        F.max_by("epoch", order).alias("best_epoch"), F.max("val_accuracy").alias("best_accuracy")
    )


def best_so_far(history: DataFrame, model_col: str = "model") -> DataFrame:
    """Best validation accuracy before each epoch and whether the epoch beats it (it starts at 0)."""
    before = Window.partitionBy(model_col).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max("val_accuracy").over(before), F.lit(0.0)), F.lit(0.0))
    return history.withColumn("best_before", best).withColumn("is_best", F.col("val_accuracy") > F.col("best_before"))


def roc_curve(preds: DataFrame, model_col: str = "model") -> DataFrame:
    """One point per distinct threshold: (model, threshold, tpr, fpr) and the counts behind it.

    Equal probabilities are merged before the shuffle.  The running sums go over
    buckets between quantiles of each model's own thresholds, so no model is sorted in one task however close its scores lie.
    """
    points = preds.groupBy(model_col, F.col("prob").alias("threshold")).agg(
        F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg")
    )
    points = cut_lineage(points)
    quantiles = [i / ROC_BUCKETS for i in range(1, ROC_BUCKETS)]
    cuts = points.groupBy(model_col).agg(F.percentile_approx("threshold", quantiles, 10 * ROC_BUCKETS).alias("_cuts"))
    # a row for each model
    points = lookup_join(points, cuts, [model_col], "left")
    above = F.size(F.filter("_cuts", lambda c: c > F.col("threshold")))
    points = points.withColumn("_bucket", F.coalesce(above, F.lit(0))).drop("_cuts")
    out = running_totals(points, [model_col], "_bucket", [F.desc("threshold")], ["pos", "neg"])
    return out.select(
        model_col,
        "threshold",
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
        ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        "pos",
        "neg",
        "cum_pos",
        "cum_neg",
        "total_pos",
        "total_neg",
    )


def auc(preds: DataFrame, model_col: str = "model") -> DataFrame:
    """Area under the ROC points by trapezoids; each point knows the one before it from its own counts."""
    curve = roc_curve(preds, model_col)
    area = F.col("neg") * (2 * F.col("cum_pos") - F.col("pos"))
    total = 2.0 * F.col("total_pos") * F.col("total_neg")
    return curve.groupBy(model_col).agg(ratio(F.sum(area), F.max(total)).alias("auc"))
