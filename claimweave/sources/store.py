"""Sinks of the pipelines and the feature store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed


def verification_records(df: DataFrame) -> DataFrame:
    """Nested record per claim from the columns of ``plans.verify.verify_claims``."""
    return df.select(
        "claim_id",
        "claim",
        "source",
        F.col("matches").alias("evidence"),
        F.struct("verification_score", "explanation", "kg_verification").alias("fact_check_results"),
        F.struct("bias_score", "political_leaning", "bias_indicators").alias("bias_analysis"),
        F.struct(
            "verdict", "trust_score", "confidence", F.col("decision_explanation").alias("explanation"), "contributing_factors"
        ).alias("decision"),
        F.col("checked_at").alias("timestamp"),
        F.struct("mode", F.col("use_kg").alias("knowledge_graph_enabled")).alias("configuration"),
        F.to_date("checked_at").alias("dt"),
    )


def write_verifications(df: DataFrame, path: str, mode: str = "append") -> None:
    verification_records(df).write.mode(mode).partitionBy("dt").json(path)


def render_reports(df: DataFrame) -> DataFrame:
    """Plain-text report per claim; ``checked_at`` is the time stated on it."""

    def number(c: str) -> Column:
        return F.when(F.col(c) != 0, F.format_string("%.4f", F.col(c))).otherwise("N/A")

    report = F.concat_ws(
        "\n",
        F.lit("VERIFICATION REPORT"),
        F.concat(F.lit("Generated: "), F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss")),
        F.lit(""),
        F.lit("CLAIM ANALYZED:"),
        F.coalesce("claim", F.lit("Unknown claim")),
        F.lit(""),
        F.concat(F.lit("VERDICT: "), F.coalesce("verdict", F.lit("Unknown"))),
        F.concat(F.lit("CONFIDENCE: "), F.format_string("%.1f", F.coalesce("confidence", F.lit(0.0))), F.lit("%")),
        F.lit(""),
        F.lit("ANALYSIS SUMMARY:"),
        F.concat(F.lit("- News Articles Retrieved: "), F.coalesce("n_articles", F.lit(0))),
        F.concat(F.lit("- Fact Check Score: "), number("verification_score")),
        F.concat(F.lit("- Bias Score: "), number("bias_score")),
        F.lit(""),
        F.lit("EXPLANATION:"),
        F.coalesce("decision_explanation", F.lit("No detailed explanation available")),
    )
    return df.select("claim_id", report.alias("report"))


def write_reports(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    render_reports(df).select("report").write.mode(mode).option("lineSep", "\n---\n").text(path)


def write_feature_store(
    features: DataFrame, tfidf: DataFrame, path: str, metadata: DataFrame | None = None,
    vectors: DataFrame | None = None, mode: str = "overwrite",
) -> None:
    """Features (id, split, 16 features, label), TF-IDF rows, metadata and vectors, each partitioned by split."""
    splits = features.select("id", "split")
    features.write.mode(mode).partitionBy("split").parquet(f"{path}/features")
    for name, part in (("tfidf", tfidf), ("metadata", metadata), ("vectors", vectors)):
        if part is not None:
            named = part if "split" in part.columns else part.join(splits, "id")
            named.write.mode(mode).partitionBy("split").parquet(f"{path}/{name}")


def read_feature_store(spark: SparkSession, path: str, split: str | None = None) -> dict[str, DataFrame]:
    out = {}
    for name in ("features", "tfidf", "metadata", "vectors"):
        try:
            part = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # the part was not written
        out[name] = part.filter(F.col("split") == split) if split else part
    return out


def validate_feature_store(features: DataFrame, vectors: DataFrame) -> DataFrame:
    """Labels and vectors per split and whether they match."""
    counted = features.join(vectors.select("id", F.lit(True).alias("_v")).distinct(), "id", "left")
    out = counted.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("binary_label").alias("n_labels"),
        F.count("_v").alias("n_vectors"),
    )
    return out.withColumn("matching", (F.col("n_labels") == F.col("n_vectors")) & (F.col("n_rows") == F.col("n_labels")))


def present_features(features: DataFrame, wanted: list[str] = fixed.FEATURE_COLUMNS) -> tuple[list[str], list[str]]:
    """The feature columns that exist and the ones that are missing."""
    have = [c for c in wanted if c in features.columns]
    return have, [c for c in wanted if c not in features.columns]


def write_model_comparison(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).option("header", True).csv(path)
