"""Claim and article verification as one declarative job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.functions import text as T
from claimweave.operators import evidence as E
from claimweave.operators import knowledge as K
from claimweave.operators import retrieval as R
from claimweave.operators import verdict as V
from claimweave.operators.bias import score_bias
from claimweave.operators.entities import flat_entities, typed_entities
from claimweave.scale import written
from claimweave.sources.postings import PostingsIndex


@dataclass
class Tables:
    """Inputs of the verification beside the claims.

    With an ``index`` of the articles (``sources.postings.PostingsIndex``) evidence comes from it, and ``articles`` may be left out.
    """

    articles: DataFrame | None
    lexicon: DataFrame
    sources: DataFrame
    asof: Column | str
    entities: DataFrame | None = None
    attributes: DataFrame | None = None
    triples: DataFrame | None = None
    responses: DataFrame | None = None
    probabilities: DataFrame | None = None
    index: PostingsIndex | None = None
    credible: list[str] = field(default_factory=lambda: list(fixed.CREDIBLE_SOURCES))


Step = Callable[[DataFrame, Tables], DataFrame]
STEPS: dict[str, Step] = {}


def register_step(name: str, fn: Step) -> None:
    """Adds a step or replaces one of retrieve, check, bias and decide."""
    STEPS[name] = fn


def map_model(df: DataFrame, fn, schema: str) -> DataFrame:
    """Hook for an own vectorised model: ``fn`` maps an iterator of pandas frames."""
    return df.mapInPandas(fn, schema)


def mode_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.MODES, "mode string, use_kg boolean, kg_timeout double, article_cap int")


def with_mode(df: DataFrame, mode: str = "balanced") -> DataFrame:
    """Adds the settings of each row's mode (three-row table)."""
    if "mode" not in df.columns:
        df = df.withColumn("mode", F.lit(mode))
    return df.join(F.broadcast(mode_params(df.sparkSession)), "mode", "left")


def route_modes(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims whose mode has settings, and the others with a reason."""
    known = F.col("article_cap").isNotNull()
    return claims.filter(known), claims.filter(~known).withColumn("reject_reason", F.lit("unknown mode"))


def reject_reason(claim: Column) -> Column:
    return F.when(claim == "", "empty").when(F.length(claim) > fixed.MAX_CLAIM_CHARS, "too long")


def route_claims(claims: DataFrame, text_col: str = "claim") -> tuple[DataFrame, DataFrame]:
    """Trimmed claims that can be worked on, and the rejected ones with a reason."""
    trimmed = claims.withColumn(text_col, T.strip(T.text_of(text_col)))
    routed = trimmed.withColumn("reject_reason", reject_reason(F.col(text_col)))
    good = routed.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, routed.filter(F.col("reject_reason").isNotNull())


def route_articles(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles with a title or a text, and the empty rest."""
    empty = (T.strip(T.text_of("title")) == "") & (T.strip(T.text_of("text")) == "")
    return articles.filter(~empty), articles.filter(empty)


def retrieve(claims: DataFrame, tables: Tables) -> DataFrame:
    """Evidence of each claim, capped by its mode."""
    queries = R.search_queries(claims).select("claim_id", "search_query", "article_cap")
    prepared = E.prepared_lists(claims)
    return R.gather_evidence(queries, tables.articles, tables.asof, cap_col="article_cap", index=tables.index, prepared=prepared)


def knowledge(claims: DataFrame, tables: Tables) -> DataFrame | None:
    """First fact about a claim's entities that the knowledge tables confirm."""
    if tables.triples is None or tables.entities is None or tables.attributes is None:
        return None
    asked = claims.filter("use_kg")
    typed = typed_entities(asked, "claim_id", "claim").select("claim_id", flat_entities().alias("entities"))
    pairs = K.entity_pairs(typed)
    verified = K.verify_triples(pairs, tables.entities, tables.attributes, tables.triples)
    return K.first_verified(pairs, verified)


def check(claims: DataFrame, tables: Tables, evidence: DataFrame) -> DataFrame:
    # the texts are read for the scores once; what is written out is slim, and titles many claims share cost little
    scored = written(E.score_evidence(claims.select("claim_id", "claim"), evidence))
    return E.check_facts(claims, scored, knowledge(claims, tables), credible=tables.credible, probabilities=tables.probabilities)


def bias(claims: DataFrame, tables: Tables) -> DataFrame:
    docs = claims.select("claim_id", F.lit("").alias("title"), F.col("claim").alias("text"), "source")
    return score_bias(docs, tables.lexicon, tables.sources, "claim_id").drop("source")


def decide(claims: DataFrame, tables: Tables) -> DataFrame:
    return V.final_result(V.decide(claims, tables.responses))


def verify_claims(
    claims: DataFrame, tables: Tables, mode: str = "balanced", checked_at: Column | None = None
) -> DataFrame:
    """The whole pipeline, one row per claim.

    ``claims`` is (claim_id, claim, source[, mode]).  Rejected claims stay in the result with
    their reason and no verdict; no row stops the job.
    """
    good, rejected = route_claims(claims)
    good, unknown = route_modes(with_mode(good, mode))
    columns = ["claim_id", "claim", "source", "reject_reason"]
    rejected = rejected.select(*columns).unionByName(unknown.select(*columns))
    found = STEPS.get("retrieve", retrieve)(good, tables)
    facts = STEPS["check"](good, tables) if "check" in STEPS else check(good, tables, found)
    biased = STEPS.get("bias", bias)(good, tables)
    n_articles = found.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_articles"), F.count("article_id").alias("n_real_articles")
    )
    joined = facts.join(biased, "claim_id", "left").join(n_articles, "claim_id", "left")
    decided = STEPS.get("decide", decide)(joined, tables)
    done = F.lit("complete")
    out = decided.withColumns(
        {
            "checked_at": F.current_timestamp() if checked_at is None else checked_at,
            "retrieval_status": F.when(F.col("n_real_articles") > 0, done).otherwise("placeholder"),
            "check_status": F.when(F.col("verification_score").isNotNull(), done).otherwise("error"),
            "bias_status": F.when(F.col("bias_score").isNotNull(), done).otherwise("error"),
            "decision_status": F.when(F.col("verdict").isNotNull(), done).otherwise("error"),
        }
    )
    return out.unionByName(
        rejected, allowMissingColumns=True
    )


def verify_articles(articles: DataFrame, tables: Tables, mode: str = "balanced") -> DataFrame:
    """Each article's title verified as a claim, joined with the bias of the full article."""
    good, _ = route_articles(articles)
    claims = good.select(F.col("article_id").alias("claim_id"), F.col("title").alias("claim"), "source")
    checked = verify_claims(claims, tables, mode).withColumnRenamed("claim_id", "article_id").drop("source")
    scored = score_bias(good, tables.lexicon, tables.sources, "article_id").select(
        "article_id", F.col("bias_score").alias("article_bias_score"), F.col("bias_indicators").alias("article_indicators")
    )
    kept = good.select("article_id", F.col("title").alias("article_title"), T.truncate("text", 500).alias("article_text"), "source")
    return kept.join(checked, "article_id", "left").join(scored, "article_id", "left")
