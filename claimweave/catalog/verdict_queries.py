"""Decisions, prompts, stored answers, reports and the whole pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimweave.catalog.base import (
    ARTICLES_CTE, ASOF, CLAIMS_CTE, LEXICON_CTE, SOURCES_CTE, articles, claims, planted_lexicon, planted_sources, query,
    rounded, sql_spaces, strings, table, with_ctes,
)
from claimweave.catalog.bias_queries import CITED, ENTITIES_CTE, SCORES_CTE, SENTIMENT_CTE
from claimweave.catalog.evidence_queries import (
    CANDIDATES_CTE, CAPPED_CTE, CHECKING, EVIDENCE_CTE, QUERY_CTE, _checked, _evidence, _scored, facts_ctes, scored_ctes,
)
from claimweave.catalog.knowledge_queries import KG_CTE, MATCH_CTE, RESOLVED_CTE, TYPED_CTE, VERIFIED_CTE, knowledge_tables
from claimweave.catalog.lexicon_queries import LEANING_CTE
from claimweave.functions import fixed_values as fixed
from claimweave.operators import evidence as E
from claimweave.operators import verdict as V
from claimweave.plans import verify as P
from claimweave.plans.training import claim_texts
from claimweave.scale import cut_lineage, shared_folder
from claimweave.sources.store import render_reports
from claimweave.sources.store import write_verifications as store_verifications

# scores between 0 and 1 of every document, by digest
SCORES = "('0x' || substr(md5('{0}' || doc_id), 1, 3))::INT / 4095.0::DOUBLE"
RULED = """CASE WHEN adj >= 0.75 THEN 'true' WHEN adj >= 0.55 THEN 'mostly true' WHEN adj >= 0.35 THEN 'partially true' WHEN adj >= 0.15 THEN 'mostly false' ELSE 'false' END"""
WHY = f"""CASE WHEN v >= 0.7 AND b <= 0.3 THEN '{fixed.RULE_SUPPORTED}'
  WHEN v >= 0.7 THEN '{fixed.RULE_SUPPORTED_BIASED}'
  WHEN v >= 0.4 THEN '{fixed.RULE_MIXED}'
  ELSE '{fixed.RULE_CONTRADICTED}' END ||
  CASE WHEN b >= 0.7 THEN '{fixed.RULE_STRONG_BIAS}' WHEN b >= 0.4 THEN '{fixed.RULE_MODERATE_BIAS}' ELSE '' END"""
DOC_SCORES = f"""
s AS (SELECT doc_id, text, CASE WHEN doc_id % 17 = 0 THEN 0.5 ELSE {SCORES.format('v')} END AS v, CASE WHEN doc_id % 19 = 0 THEN 0.5 ELSE {SCORES.format('b')} END AS b FROM documents),
r AS (SELECT *, v * (1 - b * 0.3::DOUBLE) AS adj FROM s)
"""


def document_scores(spark, sf_dir):
    """Documents with a verification and a bias score; some of each are missing."""

    def score(tag: str):
        digest = F.md5(F.concat(F.lit(tag), F.col("doc_id").cast("string")))
        return F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") / 4095.0

    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.when(F.pmod("doc_id", F.lit(17)) != 0, score("v")).alias("verification_score"),
        F.when(F.pmod("doc_id", F.lit(19)) != 0, score("b")).alias("bias_score"),
    )


@query(
    "rule_verdict",
    with_ctes(DOC_SCORES) + f" SELECT doc_id, {RULED} AS verdict, round(adj, 6) AS trust_score, {WHY} AS decision_explanation FROM r",
)
def rule_verdict(spark, sf_dir):
    out = V.rule_verdict(document_scores(spark, sf_dir))
    return rounded(out.select("doc_id", "verdict", "trust_score", "decision_explanation"))


@query(
    "verdict_badge",
    with_ctes(DOC_SCORES)
    + f""", n AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'Likely True' WHEN 1 THEN 'mixed' ELSE {RULED} END AS verdict, adj * CASE WHEN doc_id % 3 = 0 THEN 150 ELSE 1 END AS t FROM r)
    SELECT doc_id, CASE WHEN lower(verdict) IN ('true', 'likely true') THEN 'true' WHEN lower(verdict) IN ('false', 'likely false') THEN 'false'
      WHEN lower(verdict) IN ('mixed', 'partially true') THEN 'mixed' ELSE 'analyzing' END AS badge,
      CASE WHEN lower(verdict) IN ('true', 'likely true') THEN 'Likely True' WHEN lower(verdict) IN ('false', 'likely false') THEN 'Likely False'
      WHEN lower(verdict) IN ('mixed', 'partially true') THEN 'Mixed/Partial' ELSE 'Inconclusive' END AS label,
      floor(greatest(0, least(100, CASE WHEN t <= 1 THEN t * 100 ELSE t END)) + 0.5)::BIGINT AS trust_percent FROM n""",
)
def verdict_badge(spark, sf_dir):
    out = V.rule_verdict(document_scores(spark, sf_dir))
    turn = F.pmod("doc_id", F.lit(5))
    verdict = F.when(turn == 0, "Likely True").when(turn == 1, "mixed").otherwise(F.col("verdict"))
    score = F.col("trust_score") * F.when(F.pmod("doc_id", F.lit(3)) == 0, 150).otherwise(1)
    return out.select(
        "doc_id",
        V.verdict_badge(verdict).alias("badge"),
        V.badge_text(verdict).alias("label"),
        V.trust_percent(score).alias("trust_percent"),
    )


@query(
    "final_result",
    with_ctes(DOC_SCORES)
    + f""" SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'unknown' ELSE {RULED} END AS verdict, round(CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE adj END, 6) AS trust_score,
      round(CASE WHEN doc_id % 8 = 0 THEN 77.0 ELSE CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE adj END * 100 END, 4) AS confidence,
      CASE WHEN doc_id % 9 = 0 THEN 'No explanation provided' ELSE {WHY} END AS decision_explanation FROM r""",
)
def final_result(spark, sf_dir):
    out = V.rule_verdict(document_scores(spark, sf_dir))

    def unless(n: int, c: str):
        return F.when(F.pmod("doc_id", F.lit(n)) != 0, F.col(c))

    out = out.withColumns(
        {
            "verdict": unless(6, "verdict"),
            "trust_score": unless(7, "trust_score"),
            "decision_explanation": unless(9, "decision_explanation"),
            "confidence": F.when(F.pmod("doc_id", F.lit(8)) == 0, 77.0),
        }
    )
    out = V.final_result(out).withColumn("confidence", F.round("confidence", 4))
    return rounded(out.select("doc_id", "verdict", "trust_score", "confidence", "decision_explanation"))


# --- stored answers: six kinds by document -----------------------------------------------------------
GIVEN = ["true", "Mostly True", "PARTIALLY TRUE", "unverified", "mostly false", "FALSE", "nonsense"]


def answers(spark, sf_dir):
    """A stored answer per document: two JSON forms, broken JSON, headings with bullets or commas, free text."""
    given = F.get(F.array(*[F.lit(g) for g in GIVEN]), F.pmod("doc_id", F.lit(7)).cast("int"))
    number = F.concat(F.lit("0."), F.lpad(F.pmod("doc_id", F.lit(100)).cast("string"), 2, "0"))
    big = F.pmod("doc_id", F.lit(5)).cast("string")
    pick = F.pmod("doc_id", F.lit(6))
    fence = F.concat(
        F.lit('Here it is:\n```json\n{"verdict": "'), given, F.lit('", "trust_score": '), F.when(pick == 0, number).otherwise(big),
        F.lit(', "explanation": "Because '), F.col("source"), F.lit(' says so", "contributing_factors": ["a", "b"]}\n```\nDone.'),
    )
    headed = F.concat(
        F.lit("VERDICT: "), F.when(given == "nonsense", "who knows").otherwise(given), F.lit("\nTRUST_SCORE: "), number,
        F.lit("\nEXPLANATION: it is\nlike that \nCONTRIBUTING_FACTORS:"),
    )
    response = (
        F.when(pick.isin(0, 1), fence)
        .when(pick == 2, "```json\n{broken\n```")
        .when(pick == 3, F.concat(headed, F.lit("\n- first one\n* second\n")))
        .when(pick == 4, F.concat(headed, F.lit(" alpha, beta; gamma")))
        .otherwise(F.col("source"))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("claim_id"), F.col("source").alias("claim"), response.alias("response")
    )


ANSWERS_CTE = f"""
given AS (SELECT doc_id, source, text, doc_id % 6 AS pick, {strings(GIVEN)}[doc_id % 7 + 1] AS g, (doc_id % 100) / 100.0::DOUBLE AS score FROM documents),
parsed AS (
  SELECT doc_id AS claim_id,
    CASE WHEN pick IN (0, 1) THEN CASE WHEN g = 'nonsense' THEN 'unverified' ELSE lower(g) END
      WHEN pick IN (3, 4) THEN CASE WHEN g = 'nonsense' THEN 'unverified' ELSE lower(g) END ELSE 'unverified' END AS verdict,
    CASE WHEN pick IN (0, 3, 4) THEN score WHEN pick = 1 THEN least(1, doc_id % 5)::DOUBLE ELSE 0.5 END AS trust_score,
    CASE WHEN pick IN (0, 1) THEN 'Because ' || source || ' says so'
      WHEN pick = 2 THEN 'Could not determine veracity of claim: ''' || source || '''. The LLM response could not be properly parsed.'
      WHEN pick IN (3, 4) THEN 'it is' || chr(10) || 'like that' ELSE 'Could not determine explanation from LLM response.' END AS decision_explanation,
    CASE WHEN pick IN (0, 1) THEN 'a|b' WHEN pick = 2 THEN 'Insufficient evidence|Processing error' WHEN pick = 3 THEN 'first one|second'
      WHEN pick = 4 THEN 'alpha|beta|gamma' ELSE 'Based on evidence analysis|Source credibility|Fact-checking results' END AS contributing_factors
  FROM given)
"""


@query(
    "parse_responses",
    with_ctes(ANSWERS_CTE) + " SELECT claim_id, verdict, round(trust_score, 6) AS trust_score, decision_explanation, contributing_factors FROM parsed",
)
def parse_responses(spark, sf_dir):
    out = V.parse_responses(answers(spark, sf_dir))
    return rounded(out.withColumn("contributing_factors", F.array_join("contributing_factors", "|")))


@query(
    "decide",
    with_ctes(DOC_SCORES, ANSWERS_CTE)
    + f""" SELECT doc_id AS claim_id, CASE WHEN doc_id % 4 <> 1 THEN p.verdict ELSE {RULED} END AS verdict,
      round(CASE WHEN doc_id % 4 <> 1 THEN p.trust_score ELSE adj END, 6) AS trust_score,
      CASE WHEN doc_id % 4 <> 1 THEN 'response' ELSE 'rule' END AS decided_by FROM r JOIN parsed p ON claim_id = doc_id""",
)
def decide(spark, sf_dir):
    """Three of four documents have a stored answer."""
    scores = document_scores(spark, sf_dir).withColumnRenamed("doc_id", "claim_id")
    given = answers(spark, sf_dir).filter(F.pmod("claim_id", F.lit(4)) != 1).select("claim_id", "response")
    stored = scores.drop("text").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("source").alias("claim")), "claim_id")
    return rounded(V.decide(stored, given).select("claim_id", "verdict", "trust_score", "decided_by"))


# --- prompts and reports -------------------------------------------------------------------------------
INDICATORS = ["Uses loaded phrases", "Uses hedging language", "Contains subjective language", "Shows left-leaning political terms", "x", "never shown"]


def _judged(spark, sf_dir, scored):
    """Fact-check results with a bias score and indicators that go by the claim id."""
    facts = _checked(spark, sf_dir, scored)
    return facts.withColumns(
        {
            "bias_score": F.pmod("claim_id", F.lit(100)) / 100.0,
            "bias_indicators": F.slice(F.array(*[F.lit(i) for i in INDICATORS]), F.lit(1), F.pmod("claim_id", F.lit(7)).cast("int")),
        }
    )


@query(
    "build_prompts",
    with_ctes(*CHECKING)
    + f""", bodies AS (SELECT r.claim_id, r.rank, e.title, e.source, e.text FROM ranked r JOIN capped e USING (claim_id, ord) WHERE rank <= 5),
    quoted AS (SELECT claim_id, string_agg('ARTICLE ' || rank || ':' || chr(10) || 'Title: ' || title || chr(10) || 'Source: ' || source || chr(10) || 'Excerpt: '
      || substr(text, 1, 300) || '...' || chr(10) || chr(10), '' ORDER BY rank) AS q FROM bodies GROUP BY claim_id)
    SELECT claim_id, md5(claim || '#' || source || '#' || coalesce(q, 'No evidence articles available.') || '#' || printf('%.2f', verification_score) || '#' || explanation
      || '#' || printf('%.2f', claim_id % 100 / 100.0::DOUBLE) || '#' || CASE WHEN claim_id % 7 = 0 THEN 'None detected' ELSE
        array_to_string(list_transform(({strings(INDICATORS)}[1:least(5, claim_id % 7)]), lambda i: '- ' || i), chr(10)) END) AS digest
    FROM explained LEFT JOIN quoted USING (claim_id)""",
)
def build_prompts(spark, sf_dir):
    """Digest of the parts of each prompt that vary."""
    evidence = _evidence(spark, sf_dir)
    scored = cut_lineage(_scored(spark, sf_dir, evidence))
    ranked = E.rank_evidence(E.relevant_only(scored), 5).select("claim_id", "ord", "rank")
    quoted = ranked.join(evidence.select("claim_id", "ord", "title", "source", "text"), ["claim_id", "ord"])
    prompts = V.build_prompts(_judged(spark, sf_dir, scored), quoted)
    parts = F.regexp_extract
    pattern = (
        r'(?s)## CLAIM:\n"(.*)"\nSource: ([^\n]*)\n\n## EVIDENCE ARTICLES:\n(.*)\n\n## FACT-CHECKING RESULTS:\nVerification Score: (\S+) .*?\n'
        r"Explanation: (.*)\n\n## BIAS ANALYSIS:\nBias Score: (\S+) .*?\nBias Indicators:\n(.*)\n\n## YOUR TASK:"
    )
    pieces = [parts("prompt", pattern, i) for i in range(1, 8)]
    return prompts.select("claim_id", F.md5(F.concat_ws("#", *pieces)).alias("digest"))


@query(
    "render_reports",
    with_ctes(DOC_SCORES)
    + f""" SELECT doc_id AS claim_id, 'VERIFICATION REPORT' || chr(10) || 'Generated: 2024-02-15 00:00:00' || chr(10) || chr(10) || 'CLAIM ANALYZED:' || chr(10) || text || chr(10) || chr(10)
      || 'VERDICT: ' || {RULED} || chr(10) || 'CONFIDENCE: ' || printf('%.1f', adj * 100) || '%' || chr(10) || chr(10) || 'ANALYSIS SUMMARY:' || chr(10)
      || '- News Articles Retrieved: ' || doc_id % 9 || chr(10) || '- Fact Check Score: ' || CASE WHEN doc_id % 17 = 0 OR v = 0 THEN 'N/A' ELSE printf('%.4f', v) END || chr(10)
      || '- Bias Score: ' || CASE WHEN doc_id % 19 = 0 OR b = 0 THEN 'N/A' ELSE printf('%.4f', b) END || chr(10) || chr(10) || 'EXPLANATION:' || chr(10) || {WHY} AS report FROM r""",
)
def reports(spark, sf_dir):
    out = V.final_result(V.rule_verdict(document_scores(spark, sf_dir)))
    out = out.withColumns({"n_articles": F.pmod("doc_id", F.lit(9)), "checked_at": F.lit(ASOF).cast("timestamp")})
    return render_reports(out.withColumnsRenamed({"doc_id": "claim_id", "text": "claim"}))


@query(
    "claim_texts",
    with_ctes(*CHECKING)
    + """, t AS (SELECT r.claim_id, string_agg(e.title || '. ' || e.text || ' ', '' ORDER BY rank) AS x FROM ranked r JOIN capped e USING (claim_id, ord) WHERE rank <= 3 GROUP BY r.claim_id)
    SELECT claim_id, md5(claim || ' ' || substr(coalesce(x, ''), 1, 5000)) AS model_text FROM claims LEFT JOIN t USING (claim_id)""",
)
def model_texts(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    out = claim_texts(claims(spark, sf_dir), _scored(spark, sf_dir, evidence), evidence)
    return out.select("claim_id", F.md5("model_text").alias("model_text"))


# --- whole pipelines ----------------------------------------------------------------------------------------
CITED_DEFAULT = " + ".join(
    f"(length(full_text) - length(replace(full_text, '{p}', ''))) // {len(p)}" for p in fixed.CITATION_PATTERNS
)
CLAIM_DOCS_CTE = f"""
bias_docs AS MATERIALIZED (
  SELECT claim_id AS doc_id, '' AS title, claim AS text, source, '' AS ctitle, ' ' || lower({sql_spaces('claim')}) AS full_text FROM claims)
"""
BIAS_OF_CLAIMS = [
    LEXICON_CTE, SOURCES_CTE, CLAIM_DOCS_CTE, ENTITIES_CTE, SENTIMENT_CTE, LEANING_CTE, SCORES_CTE.replace(CITED, CITED_DEFAULT),
]


def pipeline(claims_cte: str, cap: int) -> str:
    return with_ctes(
        claims_cte, ARTICLES_CTE, QUERY_CTE, CANDIDATES_CTE, EVIDENCE_CTE, CAPPED_CTE.format(cap),
        scored_ctes(fixed.CONFIRMING_TERMS, fixed.DENYING_TERMS), facts_ctes(fixed.CREDIBLE_SOURCES), *BIAS_OF_CLAIMS,
        "found_n AS (SELECT claim_id, count(*) AS n_articles FROM capped GROUP BY claim_id)",
        """r AS (SELECT e.claim_id, n_articles, n_evidence, e.verification_score::DOUBLE AS v, i.bias_score::DOUBLE AS b, i.political_leaning, e.explanation,
          e.verification_score::DOUBLE * (1 - i.bias_score::DOUBLE * 0.3::DOUBLE) AS adj
          FROM explained e JOIN indicated i ON i.doc_id = e.claim_id JOIN found_n USING (claim_id))""",
    )


def tables(spark, sf_dir) -> P.Tables:
    return P.Tables(articles(spark, sf_dir), planted_lexicon(spark, sf_dir), planted_sources(spark, sf_dir), ASOF)


@query(
    "verify_claims",
    pipeline(CLAIMS_CTE, 8)
    + f""" SELECT claim_id, n_articles, n_evidence, round(v, 6) AS verification_score, round(b, 6) AS bias_score, political_leaning, {RULED} AS verdict,
      round(adj, 6) AS trust_score, round(adj * 100, 4) AS confidence, explanation, {WHY} AS decision_explanation FROM r""",
)
def verify_claims(spark, sf_dir):
    out = P.verify_claims(claims(spark, sf_dir), tables(spark, sf_dir), "balanced")
    columns = [
        "claim_id", "n_articles", "n_evidence", "verification_score", "bias_score", "political_leaning", "verdict", "trust_score",
        "confidence", "explanation", "decision_explanation",
    ]
    return rounded(out.select(*columns).withColumn("confidence", F.round("confidence", 4)))


TITLES_CTE = r"""
all_titles AS (SELECT doc_id AS claim_id, regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g') AS claim, source FROM documents),
claims AS (SELECT * FROM all_titles WHERE claim <> '' AND length(claim) <= 1000)
"""


ARTICLE_BIAS = with_ctes(
    ARTICLES_CTE, LEXICON_CTE, SOURCES_CTE,
    f"""bias_docs AS MATERIALIZED (
      SELECT article_id AS doc_id, title, text, source, lower({sql_spaces('title')}) AS ctitle, lower({sql_spaces('title')}) || ' ' || lower({sql_spaces('text')}) AS full_text FROM articles)""",
    ENTITIES_CTE, SENTIMENT_CTE, LEANING_CTE, SCORES_CTE.replace(CITED, CITED_DEFAULT),
) + " SELECT doc_id, bias_score, bias_indicators FROM indicated"


@query(
    "verify_articles",
    pipeline(TITLES_CTE, 5)
    + f""" SELECT a.claim_id AS article_id, n_articles, round(v, 6) AS verification_score, round(b, 6) AS bias_score, CASE WHEN r.claim_id IS NOT NULL THEN {RULED} END AS verdict,
      round(adj, 6) AS trust_score, CASE WHEN a.claim = '' THEN 'empty' WHEN length(a.claim) > 1000 THEN 'too long' END AS reject_reason,
      round(w.bias_score, 6) AS article_bias_score, w.bias_indicators AS article_indicators,
      md5(CASE WHEN length(d.text) > 500 THEN substr(d.text, 1, 500) || '...' ELSE d.text END) AS article_text
    FROM all_titles a LEFT JOIN r ON r.claim_id = a.claim_id JOIN documents d ON d.doc_id = a.claim_id LEFT JOIN ({ARTICLE_BIAS}) w ON w.doc_id = a.claim_id
    WHERE regexp_matches(d.text, '\\S')""",
)
def verify_articles(spark, sf_dir):
    out = P.verify_articles(articles(spark, sf_dir), tables(spark, sf_dir), "fast")
    out = out.withColumns({"article_indicators": F.array_join("article_indicators", "; "), "article_text": F.md5("article_text")})
    return rounded(
        out.select(
            "article_id", "n_articles", "verification_score", "bias_score", "verdict", "trust_score", "reject_reason", "article_bias_score", "article_indicators", "article_text"
        )
    )


@query(
    "write_verifications",
    with_ctes(DOC_SCORES)
    + f""" SELECT doc_id AS claim_id, md5(text) AS claim, round(v, 6) AS verification_score, round(b, 6) AS bias_score, {RULED} AS verdict, round(adj, 6) AS trust_score,
      {WHY} AS explanation, CASE doc_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' ELSE 'accurate' END AS mode, doc_id % 3 <> 0 AS knowledge_graph_enabled,
      '2024-02-' || lpad((doc_id % 20 + 1)::VARCHAR, 2, '0') AS dt, doc_id % 4 AS n_evidence FROM r WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0""",
)
def write_verifications(spark, sf_dir):
    """Every document with both scores as a verification, written as nested records by day and read back."""
    scored = document_scores(spark, sf_dir).filter("verification_score IS NOT NULL AND bias_score IS NOT NULL")
    decided = V.final_result(V.rule_verdict(scored)).withColumnsRenamed({"doc_id": "claim_id", "text": "claim"})
    turn, n = F.pmod("claim_id", F.lit(3)), F.pmod("claim_id", F.lit(4)).cast("int")
    match = F.struct(F.lit(1).alias("rank"), F.lit("a title").alias("title"), F.lit(0.5).alias("relevance"))
    day = F.concat(F.lit("2024-02-"), F.lpad((F.pmod("claim_id", F.lit(20)) + 1).cast("string"), 2, "0"), F.lit(" 10:00:00"))
    verified = decided.withColumns(
        {
            "source": F.lit("s"), "matches": F.array_repeat(match, n), "explanation": F.lit("why"), "kg_verification": F.lit(False),
            "political_leaning": F.lit("center"), "bias_indicators": F.array(F.lit("x")), "checked_at": day.cast("timestamp"),
            "mode": F.when(turn == 0, "fast").when(turn == 1, "balanced").otherwise("accurate"), "use_kg": turn != 0,
        }
    )
    folder = f"{shared_folder(spark)}/verifications-{uuid.uuid4().hex}"
    store_verifications(verified, folder)
    schema = (
        "claim_id long, claim string, evidence array<struct<rank: int>>, fact_check_results struct<verification_score: double>, bias_analysis struct<bias_score: double>, "
        "decision struct<verdict: string, trust_score: double, explanation: string>, configuration struct<mode: string, knowledge_graph_enabled: boolean>, dt string"
    )
    back = spark.read.schema(schema).json(folder)
    return rounded(
        back.select(
            "claim_id", F.md5("claim").alias("claim"), "fact_check_results.verification_score", "bias_analysis.bias_score", "decision.verdict", "decision.trust_score",
            "decision.explanation", "configuration.mode", "configuration.knowledge_graph_enabled", "dt", F.size("evidence").cast("long").alias("n_evidence"),
        )
    )


# --- everything on: knowledge tables, stored answers, claims that are turned away ---------------------------
NAMING_CTE = """
asked AS (
  SELECT item_id AS claim_id, CASE item_id % 20 WHEN 7 THEN '  ' WHEN 11 THEN repeat('long ', 250) ELSE
      text || ' and ' || s_name || ' of ' || CASE WHEN item_id % 3 = 0 THEN n_name ELSE substr(n_name, 1, 1) || lower(substr(n_name, 2)) END END AS claim,
    'www.src' || (item_id % 20) || '.com' AS source
  FROM benchmark JOIN supplier ON s_suppkey = item_id % (SELECT max(s_suppkey) FROM supplier) + 1 JOIN nation ON s_nationkey = n_nationkey),
claims AS (SELECT claim_id, trim(claim) AS claim, source FROM asked WHERE trim(claim) <> '' AND length(trim(claim)) <= 1000)
"""


def _renamed(cte: str) -> str:
    """The knowledge CTEs beside those of the evidence, which have facts of their own."""
    return cte.replace("facts AS (", "kg_facts AS (").replace("FROM facts f", "FROM kg_facts f")


FULL_SQL = (
    pipeline(NAMING_CTE, 8)
    + ", "
    + ", ".join(
        c.strip()
        for c in (
            TYPED_CTE.replace(TYPED_CTE.split("\n")[1], "texts AS (SELECT claim_id AS doc_id, claim AS x FROM claims),"),
            """flat AS (
              SELECT doc_id AS claim_id, list(entity ORDER BY o) AS e FROM (SELECT doc_id, entity, min(ord * 1000000 + pos) AS o FROM entity_rows GROUP BY doc_id, entity)
              GROUP BY doc_id),
            entity_pairs AS (
              SELECT claim_id, (pair * 2 + rel) AS attempt, e[i] AS subject, e[j] AS object, ['related to', 'involves'][rel + 1] AS predicate FROM (
                SELECT claim_id, e, unnest([0, 1, 2]) AS pair, unnest([1, 1, 2]) AS i, unnest([2, 3, 3]) AS j FROM flat WHERE len(e) >= 3
                UNION ALL SELECT claim_id, e, 0, 1, 2 FROM flat WHERE len(e) = 2), (SELECT unnest([0, 1]) AS rel))""",
            KG_CTE.replace("requests AS (", "other_requests AS ("),
            "requests AS (SELECT DISTINCT subject, predicate, object FROM entity_pairs)",
            RESOLVED_CTE,
            _renamed(MATCH_CTE),
            _renamed(VERIFIED_CTE),
            """kg AS (
              SELECT claim_id, min_by(confidence, attempt)::DOUBLE AS kg_score, min_by(subject || ' ' || predicate || ' ' || object, attempt) AS kg_fact
              FROM entity_pairs JOIN verified USING (subject, predicate, object) WHERE confidence > 0 GROUP BY claim_id)""",
            ANSWERS_CTE.replace("source, text, doc_id", "source, doc_id"),
        )
    )
    + f""",
full0 AS (
  SELECT r.claim_id, n_articles, n_evidence, b, coalesce(kg_score, 0) AS kg_score, kg_fact,
    CASE WHEN kg_score > 0 THEN 0.7::DOUBLE * kg_score + 0.3::DOUBLE * r.v ELSE r.v END AS v FROM r LEFT JOIN kg USING (claim_id)),
full1 AS (SELECT *, v * (1 - b * 0.3::DOUBLE) AS adj FROM full0),
real_articles AS (SELECT claim_id, count(article_id) AS n FROM capped GROUP BY claim_id),
full2 AS (
  SELECT f.*, CASE WHEN p.claim_id IS NOT NULL THEN p.verdict ELSE {RULED} END AS verdict, CASE WHEN p.claim_id IS NOT NULL THEN p.trust_score ELSE adj END AS trust_score,
    CASE WHEN p.claim_id IS NOT NULL THEN 'response' ELSE 'rule' END AS decided_by,
    CASE WHEN p.claim_id IS NULL THEN {WHY}
      WHEN f.claim_id % 6 = 2 THEN 'Could not determine veracity of claim: ''' || c.claim || '''. The LLM response could not be properly parsed.'
      ELSE p.decision_explanation END AS decision_explanation
  FROM full1 f JOIN claims c USING (claim_id) LEFT JOIN (SELECT * FROM parsed WHERE claim_id % 4 = 1) p ON p.claim_id = f.claim_id)
SELECT a.claim_id, CASE WHEN trim(a.claim) = '' THEN 'empty' WHEN length(trim(a.claim)) > 1000 THEN 'too long' END AS reject_reason,
  n_articles, n_evidence, round(kg_score, 6) AS kg_score, kg_fact, kg_score > 0 AS kg_verification, round(v, 6) AS verification_score, round(b, 6) AS bias_score,
  verdict, round(trust_score, 6) AS trust_score, decided_by, decision_explanation,
  CASE WHEN f.claim_id IS NULL THEN NULL WHEN n > 0 THEN 'complete' ELSE 'placeholder' END AS retrieval_status,
  CASE WHEN f.claim_id IS NOT NULL THEN 'complete' END AS check_status, CASE WHEN f.claim_id IS NOT NULL THEN 'complete' END AS bias_status,
  CASE WHEN f.claim_id IS NOT NULL THEN 'complete' END AS decision_status
FROM asked a LEFT JOIN full2 f ON f.claim_id = a.claim_id LEFT JOIN real_articles q ON q.claim_id = a.claim_id"""
)


def naming_claims(spark, sf_dir):
    """The claims, each naming a supplier and its nation (every third in capitals); some blank, some too long."""
    suppliers = table(spark, sf_dir, "supplier")
    last = suppliers.agg(F.max("s_suppkey")).first()[0]
    named = suppliers.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    n = F.col("item_id")
    nation = F.when(F.pmod(n, F.lit(3)) == 0, F.col("n_name")).otherwise(F.concat(F.substring("n_name", 1, 1), F.lower(F.expr("substr(n_name, 2)"))))
    turn = F.pmod(n, F.lit(20))
    text = F.when(turn == 7, "  ").when(turn == 11, F.repeat(F.lit("long "), 250)).otherwise(F.concat("text", F.lit(" and "), "s_name", F.lit(" of "), nation))
    source = F.concat(F.lit("www.src"), turn, F.lit(".com"))
    rows = table(spark, sf_dir, "benchmark").withColumn("s_suppkey", F.pmod(n, F.lit(last)) + 1).join(named, "s_suppkey")
    return rows.select(n.alias("claim_id"), text.alias("claim"), source.alias("source"))


@query("verify_claims_with_everything", FULL_SQL)
def verify_claims_with_everything(spark, sf_dir):
    """The whole pipeline with knowledge about suppliers and customers, stored answers for every fourth claim, and claims that are turned away."""
    _, entities, attributes, triples = knowledge_tables(spark, sf_dir)
    given = tables(spark, sf_dir)
    given.entities, given.attributes, given.triples = entities, attributes, triples
    given.responses = answers(spark, sf_dir).filter(F.pmod("claim_id", F.lit(4)) == 1).select("claim_id", "response")
    out = P.verify_claims(naming_claims(spark, sf_dir), given, "balanced")
    return rounded(
        out.select(
            "claim_id", "reject_reason", "n_articles", "n_evidence", "kg_score", "kg_fact", "kg_verification", "verification_score", "bias_score", "verdict", "trust_score",
            "decided_by", "decision_explanation", "retrieval_status", "check_status", "bias_status", "decision_status",
        )
    )
