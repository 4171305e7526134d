"""Relevance of articles to claims and the heuristic fact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.functions import text as T

MIN_RELEVANCE = 0.05


def claim_phrases(c: Column | str) -> Column:
    """Short sentences (3 to 12 words) and adjacent token pairs of more than one character each."""

    def of_sentence(s: Column) -> Column:
        tokens = T.tokenize_cased(s)
        n_words = F.size(T.words(s))
        whole = F.filter(F.array(s), lambda x: (n_words >= 3) & (n_words <= 12))
        after = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
        pairs = F.zip_with(
            tokens, after, lambda a, b: F.when((F.length(a) > 1) & (F.length(b) > 1), F.concat(a, F.lit(" "), b))
        )
        return F.concat(whole, F.filter(pairs, lambda p: p.isNotNull()))

    return F.flatten(F.transform(T.sentences(c), of_sentence))


def _short_sentences(c: Column | str) -> Column:
    """The sentences among ``claim_phrases``."""
    return F.filter(T.sentences(c), lambda s: F.size(T.words(s)).between(3, 12))


def _token_runs(c: Column | str) -> Column:
    """The token pairs among ``claim_phrases`` as one text: tokens of a sentence joined by spaces, empty in place of those of one character.

    No token has a space, so ``_pairs_of`` gets the pairs back after a split.
    """
    long = F.transform(T.sentences(c), lambda s: F.transform(T.tokenize_cased(s), lambda t: F.when(F.length(t) > 1, t).otherwise("")))
    return F.array_join(F.transform(long, lambda ts: F.array_join(ts, " ")), "  ")


def _edge(a: Column, b: Column) -> Column:
    return F.concat(F.substring(a, -2, 2), F.lit(" "), F.substring(b, 1, 2))


def _edges(text: Column) -> Column:
    """What stands right around the spaces of a text: the two characters on either side."""
    pieces = F.split(text, " ")
    return F.array_distinct(F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda a, b: F.coalesce(_edge(a, b), F.lit(""))))


def _pairs_of(tokens: Column) -> Column:
    """The token pairs of split runs, with the characters around their space."""
    after = F.slice(tokens, F.lit(2), F.size(tokens))
    pair = lambda a, b: F.struct(F.concat(a, F.lit(" "), b).alias("phrase"), _edge(a, b).alias("edge"))
    pairs = F.zip_with(tokens, after, lambda a, b: F.when((a != "") & (b != ""), pair(a, b)))
    return F.filter(pairs, lambda p: p.isNotNull())


def prepare_claims(claims: DataFrame, id_col: str = "claim_id", text_col: str = "claim") -> DataFrame:
    return claims.select(
        id_col,
        F.array_distinct(T.tokenize(text_col)).alias("claim_tokens"),
        F.transform(claim_phrases(text_col), lambda p: F.lower(p)).alias("phrases"),
    )


def prepared_lists(claims: DataFrame, id_col: str = "claim_id", text_col: str = "claim") -> DataFrame:
    """What ``prepare_claims`` gives, with one row an id: a list, as an id may come more than once.

    These lists move once for each article of a claim, so tokens and pairs are packed into texts, which are a third of the
    arrays' size; ``unpacked`` splits them again.
    """
    packed = F.struct(
        F.array_join(F.array_distinct(T.tokenize(text_col)), " ").alias("token_text"),
        F.transform(_short_sentences(text_col), lambda s: F.lower(s)).alias("sentences"),
        F.lower(_token_runs(text_col)).alias("runs"),
    )
    return claims.select(id_col, packed.alias("_p")).groupBy(id_col).agg(F.collect_list("_p").alias("prepared"))


def unpacked(met: DataFrame) -> DataFrame:
    """``claim_tokens`` and ``phrases`` of rows with the columns of a packed claim; the order of phrases makes no difference.

    Beside an article with ``edges`` a pair is left out if the two characters before and after its space are
    nowhere around a space of the text: the text can't hold the pair, whose tokens have two characters or more.
    """
    met = met.withColumn("claim_tokens", F.filter(F.split("token_text", " "), lambda t: t != "")).withColumn("_run", F.split("runs", " "))
    met = met.withColumn("_pairs", _pairs_of(F.col("_run")))
    pairs = F.col("_pairs")
    if "edges" in met.columns:
        met = met.withColumn("_here", F.array_intersect("edges", "_pairs.edge"))
        # asked for twice, or Spark would put it inside the filter and work it out for each pair
        none = F.slice(pairs, 1, 0)
        pairs = F.when(F.size("_here") > 0, F.filter(pairs, lambda p: F.array_contains("_here", p["edge"]))).otherwise(none)
    met = met.withColumn("phrases", F.concat("sentences", F.transform(pairs, lambda p: p["phrase"])))
    return met.drop("token_text", "sentences", "runs", "_run", "_pairs", "_here")


def with_article_words(
    articles: DataFrame,
    confirming: list[str] = fixed.CONFIRMING_TERMS,
    denying: list[str] = fixed.DENYING_TERMS,
    edges: bool = False,
) -> DataFrame:
    """Adds what ``score_evidence`` needs of each article's title and text, with ``edges`` also what rules out most pairs of tokens."""
    full = F.lower(F.concat(T.text_of("title"), F.lit(" "), T.text_of("text")))
    # the filter drops no token: it makes Spark cut a text before a join that repeats it, not for each row the join gives
    tokens = F.filter(F.array_distinct(T.tokenize("full_text")), lambda t: t != "")
    out = _with_flags(articles.withColumn("full_text", full).withColumn("article_tokens", tokens), confirming, denying)
    return out.withColumn("edges", _edges(F.col("full_text"))) if edges else out


def _with_flags(articles: DataFrame, confirming: list[str], denying: list[str]) -> DataFrame:
    found = {"confirms": confirming, "denies": denying}
    return articles.withColumns({c: T.contains_any(F.col("full_text"), terms) for c, terms in found.items()})


def word_overlap() -> Column:
    both = (F.size("claim_tokens") > 0) & (F.size("article_tokens") > 0)
    # Spark puts the second list into a set: the short one
    shared = F.size(F.array_intersect("article_tokens", "claim_tokens"))
    return F.when(both, shared / F.size("claim_tokens")).otherwise(F.lit(0.0))


def phrase_match() -> Column:
    # five phrases give the full score, no more are looked for
    def count(n: Column, p: Column) -> Column:
        return F.when((n < 5) & F.col("full_text").contains(p), n + 1).otherwise(n)

    return F.least(F.lit(1.0), 0.2 * F.aggregate("phrases", F.lit(0), count))


def relevance(overlap: Column, phrase: Column, semantic: Column | None = None) -> Column:
    lexical = 0.7 * overlap + 0.3 * phrase
    if semantic is None:
        return lexical
    return F.when(semantic > 0, 0.4 * overlap + 0.4 * semantic + 0.2 * phrase).otherwise(lexical)


def score_evidence(
    claims: DataFrame,
    evidence: DataFrame,
    id_col: str = "claim_id",
    text_col: str = "claim",
    confirming: list[str] = fixed.CONFIRMING_TERMS,
    denying: list[str] = fixed.DENYING_TERMS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Overlap, phrase match and relevance of every (claim, article) row of ``evidence``.

    ``evidence`` carries title, text, source and ord.  The result is slim: the text
    stays behind, only the flags the fact check needs go on.  Evidence gathered with ``prepared`` has the
    claims at its articles and the words of both already.
    """
    semantic = F.col("semantic") if "semantic" in evidence.columns else None
    extra = [c for c in (["semantic"] if semantic is not None else []) + (keep or [])]
    if "prepared" in evidence.columns:
        slim = [c for c in evidence.columns if c not in ("prepared", "text")]
        met = unpacked(evidence.select(*slim, F.inline("prepared")))
        if (confirming, denying) != (fixed.CONFIRMING_TERMS, fixed.DENYING_TERMS):
            met = _with_flags(met, confirming, denying)
    else:
        met = with_article_words(evidence, confirming, denying).join(prepare_claims(claims, id_col, text_col), id_col)
    prepared = met.withColumn("overlap", word_overlap()).withColumn("phrase_score", phrase_match())
    return prepared.select(
        id_col,
        "article_id",
        "ord",
        "title",
        "source",
        *extra,
        "overlap",
        "phrase_score",
        relevance(F.col("overlap"), F.col("phrase_score"), semantic).alias("relevance"),
        "confirms",
        "denies",
    )


def relevant_only(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("relevance") > MIN_RELEVANCE)


def rank_evidence(scored: DataFrame, k: int, id_col: str = "claim_id") -> DataFrame:
    """The k most relevant rows per claim, ties in input order."""
    order = Window.partitionBy(id_col).orderBy(F.desc("relevance"), "ord")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def is_credible(source: Column, credible: list[str] = fixed.CREDIBLE_SOURCES) -> Column:
    return T.contains_any(F.lower(T.text_of(source)), credible)


def evidence_profile(
    scored: DataFrame, id_col: str = "claim_id", credible: list[str] = fixed.CREDIBLE_SOURCES
) -> DataFrame:
    r = F.col("relevance")
    return scored.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_evidence"),
        F.count_if(r > 0.5).alias("n_high"),
        F.count_if((r >= 0.3) & (r <= 0.5)).alias("n_medium"),
        F.bool_or(is_credible(F.col("source"), credible)).alias("credible"),
    )


def top_evidence(scored: DataFrame, id_col: str = "claim_id") -> DataFrame:
    """Contradiction among the best five, consensus weight and list of the best three, per claim."""
    top = rank_evidence(scored, 5, id_col)
    best = F.col("rank") <= 3
    item = F.struct(
        "rank", "article_id", "title", F.coalesce("source", F.lit("Unknown source")).alias("source"), "relevance"
    )
    return top.groupBy(id_col).agg(
        (F.bool_or("confirms") & F.bool_or("denies")).alias("contradiction"),
        F.sum(F.when(best, F.col("relevance"))).alias("top_relevance"),
        F.array_sort(F.collect_list(F.when(best, item))).alias("matches"),
    )


def consensus(score: Column) -> Column:
    """Blend with the relevance-weighted share of the best three, which is always one."""
    return F.when((F.col("n_evidence") >= 3) & (F.col("top_relevance") > 0), (score + 1) / 2).otherwise(score)


def heuristic_score() -> Column:
    """Score from the columns of ``evidence_profile`` and ``top_evidence``."""
    high, medium, n = F.col("n_high"), F.col("n_medium"), F.col("n_evidence")
    step = (
        F.when(high >= 3, 0.3)
        .when(high >= 2, 0.2)
        .when(high >= 1, 0.15)
        .when(medium >= 3, 0.1)
        .when(medium >= 1, 0.05)
        .when(n <= 1, -0.05)
        .otherwise(0.0)
    )
    score = 0.5 + step + F.when(F.col("credible"), 0.1).otherwise(0.0)
    score = F.when(F.col("contradiction"), 0.5).otherwise(consensus(score))
    return F.when(n == 0, 0.4).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def combine_kg(model: Column, kg: Column) -> Column:
    return F.when(kg > 0, 0.7 * kg + 0.3 * model).otherwise(model)


def explanation() -> Column:
    """Text built from verification_score, n_evidence, matches and the confirmed fact (null if none)."""
    s = F.col("verification_score")
    band = (
        F.when(s >= 0.8, "highly likely to be true")
        .when(s >= 0.6, "somewhat likely to be true")
        .when(s >= 0.4, "uncertain")
        .when(s >= 0.2, "somewhat likely to be false")
        .otherwise("highly likely to be false")
    )

    def line(m: Column) -> Column:
        degree = (
            F.when(m["relevance"] > 0.7, "highly relevant")
            .when(m["relevance"] > 0.4, "moderately relevant")
            .otherwise("somewhat relevant")
        )
        return F.concat(F.lit("Source "), m["rank"], F.lit(": "), m["source"], F.lit(" ("), degree, F.lit("). "))

    found = F.concat(
        F.lit("Found "),
        F.col("n_evidence"),
        F.lit(" relevant sources. "),
        F.array_join(F.transform("matches", line), ""),
    )
    fact = F.concat(
        F.lit("Knowledge graph verification: 1 out of 1 facts were verified. Confirmed: "), F.col("kg_fact"), F.lit(". ")
    )
    closing = (
        F.when((s >= 0.8) | (s <= 0.2), "This assessment has high confidence based on the available evidence.")
        .when(
            (s >= 0.4) & (s <= 0.6),
            "This assessment has low confidence due to limited or contradictory evidence.",
        )
        .otherwise("This assessment has moderate confidence based on the available evidence.")
    )
    return F.concat(
        F.lit("This claim is "),
        band,
        F.lit(". "),
        F.when(F.col("n_evidence") > 0, found).otherwise("No relevant evidence sources were found. "),
        F.coalesce(fact, F.lit("")),
        closing,
    )


def check_facts(
    claims: DataFrame,
    scored: DataFrame,
    kg: DataFrame | None = None,
    id_col: str = "claim_id",
    text_col: str = "claim",
    credible: list[str] = fixed.CREDIBLE_SOURCES,
    probabilities: DataFrame | None = None,
) -> DataFrame:
    """Fact-check result, one row per claim.

    ``scored`` is the output of ``score_evidence``; ``kg`` holds (claim, kg_score, kg_fact) of
    the claims a knowledge fact confirms.  ``probabilities`` (claim, probability), as
    ``score_claims`` gives them, take the place of the heuristic score where there is one.
    """
    relevant = relevant_only(scored)
    out = claims.join(evidence_profile(relevant, id_col, credible), id_col, "left")
    out = out.join(top_evidence(relevant, id_col), id_col, "left")
    out = out.withColumns(
        {
            "n_evidence": F.coalesce("n_evidence", F.lit(0)),
            "n_high": F.coalesce("n_high", F.lit(0)),
            "n_medium": F.coalesce("n_medium", F.lit(0)),
            "credible": F.coalesce("credible", F.lit(False)),
            "contradiction": F.coalesce("contradiction", F.lit(False)),
        }
    )
    if kg is None:
        out = out.withColumns({"kg_score": F.lit(0.0), "kg_fact": F.lit(None).cast("string")})
    else:
        out = out.join(kg.select(id_col, "kg_score", "kg_fact"), id_col, "left")
        out = out.withColumn("kg_score", F.coalesce("kg_score", F.lit(0.0)))
    empty = F.coalesce(F.col(text_col), F.lit("")) == ""
    model = heuristic_score()
    if probabilities is not None:
        given = probabilities.select(id_col, F.col("probability").alias("_given"))
        out = out.join(given, id_col, "left")
        model = F.coalesce("_given", model)
    out = out.withColumn("model_score", model).drop("_given").withColumn(
        "verification_score",
        F.when(empty, 0.0).otherwise(combine_kg(F.col("model_score"), F.col("kg_score"))),
    )
    return out.withColumn(
        "explanation", F.when(empty, "No claim provided for verification").otherwise(explanation())
    ).withColumn("kg_verification", ~empty & (F.col("kg_score") > 0))


def evidence_stats(evidence: DataFrame, id_col: str = "claim_id") -> DataFrame:
    """Articles and distinct sources per claim; an article without source counts by its host."""
    host = F.substring_index(T.url_domain("url"), ":", 1)
    source = F.when(F.coalesce("source", F.lit("")) != "", F.col("source")).otherwise(host)
    return evidence.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_articles"), F.count_distinct(source).alias("n_sources")
    )
