"""Bias components of all documents, with planted capitals so that entities occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.catalog.base import (
    LEXICON_CTE, SOURCES_CTE, planted_lexicon, planted_sources, query, rounded, sql_capitals, sql_doubled, sql_ratio,
    sql_sentences, sql_spaces, sql_tokens, sql_words, table, with_capitals, with_ctes,
)
from claimweave.catalog.lexicon_queries import LEANING_CTE
from claimweave.operators import bias
from claimweave.operators.entities import with_bias_entities

CITATIONS = ["stated", "said", "source", "nd the", "tion of"]
EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
TOKEN_CATEGORIES = ["left", "right", "positive", "negative", "subjective", "exaggeration", "hedging", "conspiracy", "loaded"]
WIDE = ", ".join(f"bool_or(category = '{c}') AS is_{c}" for c in TOKEN_CATEGORIES)
CITED = " + ".join(f"(length(full_text) - length(replace(full_text, '{p}', ''))) // {len(p)}" for p in CITATIONS)

DOCS_CTE = f"""
bias_docs AS MATERIALIZED (
  SELECT doc_id, title, text, 'www.' || source || '.com' AS source,
    lower({sql_spaces('title')}) AS ctitle, lower({sql_spaces('title')}) || ' ' || lower({sql_spaces('text')}) AS full_text
  FROM (SELECT doc_id, source, {sql_capitals('split_part(text, chr(10), 1)')} AS title, {sql_capitals('text')} AS text FROM documents))
"""


def sql_entity(pattern: str) -> str:
    """Bounded matches on the doubled text, brought back to single separators."""
    doubled = pattern.replace(" ", "  ")
    found = f"regexp_extract_all(dd, '{EDGE_L}({doubled}){EDGE_R}', 1)"
    return f"list_transform({found}, lambda e: replace(e, '  ', ' '))"


ENTITIES_CTE = f"""
found AS (
  SELECT doc_id, {sql_entity('[A-Z][a-z]+ (?:[A-Z][a-z]+ )?[A-Z][a-z]+')} AS person,
    {sql_entity('[A-Z][A-Za-z]+ (?:Company|Corporation|Inc|Ltd|LLC|University|College|Association|Foundation)')} AS org,
    {sql_entity('United States|United Kingdom|Russia|China|Germany|France|[A-Z][a-z]+ (?:City|County|State)')} AS gpe,
    {sql_entity('[A-Z][a-z]+(?: [A-Z][a-z]+)+')} AS caps
  FROM (SELECT doc_id, {sql_doubled("title || ' ' || text")} AS dd FROM bias_docs)),
entities AS (
  SELECT doc_id, 'PERSON' AS etype, unnest(person) AS entity FROM found
  UNION ALL SELECT doc_id, 'ORG', unnest(org) FROM found
  UNION ALL SELECT doc_id, 'GPE', unnest(gpe) FROM found
  UNION ALL SELECT doc_id, 'OTHER', unnest(list_distinct(list_filter(caps, lambda c: NOT list_contains(person || org || gpe, c)))) FROM found)
"""

SENTIMENT_CTE = f"""
sents AS (SELECT doc_id, unnest({sql_sentences('full_text')}) AS sent, generate_subscripts({sql_sentences('full_text')}, 1) AS pos FROM bias_docs),
sent_hits AS (
  SELECT doc_id, pos, count(*) FILTER (category = 'positive') AS p, count(*) FILTER (category = 'negative') AS n
  FROM (SELECT doc_id, pos, unnest({sql_tokens('sent')}) AS tok FROM sents) JOIN lexicon ON tok = term GROUP BY doc_id, pos),
entity_sent AS (
  SELECT e.doc_id, e.entity, coalesce(sum(p), 0) AS p, coalesce(sum(n), 0) AS n
  FROM (SELECT DISTINCT doc_id, entity FROM entities) e
  JOIN sents s ON e.doc_id = s.doc_id AND contains(s.sent, lower(e.entity))
  LEFT JOIN sent_hits h ON h.doc_id = s.doc_id AND h.pos = s.pos GROUP BY e.doc_id, e.entity),
entity_sentiment AS (SELECT doc_id, entity, {sql_ratio('p - n', '(p + n)')} AS sentiment FROM entity_sent),
entity_bias AS (
  SELECT doc_id, count(*) AS n_entities,
    CASE WHEN count(*) >= 2 THEN least(1.0, 2 * sqrt(greatest(var_pop(sentiment), 0.0))) ELSE 0.0 END AS entity_bias
  FROM entity_sentiment GROUP BY doc_id)
"""

SCORES_CTE = f"""
wide AS (SELECT term, {WIDE} FROM lexicon GROUP BY term),
bt AS MATERIALIZED (SELECT doc_id, {sql_tokens('full_text')} AS toks, {sql_words('full_text')} AS ws FROM bias_docs),
tk AS (SELECT doc_id, unnest(toks) AS tok, unnest(list_prepend(NULL, toks[1:len(toks) - 1])) AS prev FROM bt),
hits AS (
  SELECT doc_id, count(*) FILTER (w.is_left) + 2 * count(*) FILTER (b.is_left) AS l,
    count(*) FILTER (w.is_right) + 2 * count(*) FILTER (b.is_right) AS r,
    count(*) FILTER (w.is_positive) + count(*) FILTER (w.is_positive AND x.is_exaggeration) AS pos,
    count(*) FILTER (w.is_negative) + count(*) FILTER (w.is_negative AND NOT w.is_positive AND x.is_exaggeration) AS neg,
    count(*) FILTER (w.is_subjective) + count(*) FILTER (w.is_subjective AND prev IS NOT NULL) AS subj,
    count(*) FILTER (w.is_hedging) AS hedg, count(*) FILTER (w.is_exaggeration) AS exag,
    count(*) FILTER (w.is_conspiracy) AS consp
  FROM tk LEFT JOIN wide w ON w.term = tok LEFT JOIN wide x ON x.term = prev LEFT JOIN wide b ON b.term = prev || ' ' || tok
  GROUP BY doc_id),
phr AS (
  SELECT doc_id, count(*) FILTER (category = 'left') AS pl, count(*) FILTER (category = 'right') AS pr,
    count(*) FILTER (category = 'conspiracy') AS pc
  FROM bias_docs JOIN lexicon ON category IN ('left', 'right', 'conspiracy') AND contains(term, ' ') AND contains(full_text, term)
  GROUP BY doc_id),
loaded_single AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM bt) JOIN wide ON w = term AND is_loaded GROUP BY doc_id),
loaded_multi AS (
  SELECT doc_id, sum(len(regexp_extract_all(dd, '{EDGE_L}' || replace(term, ' ', '  ') || '{EDGE_R}'))) AS n
  FROM (SELECT doc_id, full_text, {sql_doubled('full_text')} AS dd FROM bias_docs)
  JOIN lexicon ON category = 'loaded' AND contains(term, ' ') AND contains(full_text, term) GROUP BY doc_id),
bait AS (
  SELECT doc_id, sum(CASE WHEN contains(ctitle, term) THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END) AS c
  FROM bias_docs JOIN lexicon ON category = 'clickbait' AND contains(full_text, term) GROUP BY doc_id),
comp0 AS (
  SELECT d.doc_id, d.source, len(toks) AS n, coalesce(source_leaning, 'unknown') AS source_leaning,
    CASE source_leaning WHEN 'left' THEN 0.7 WHEN 'right' THEN 0.7 WHEN 'center' THEN 0.2 ELSE 0.0 END::DOUBLE AS source_strength,
    coalesce(l, 0) + 2 * coalesce(pl, 0) + CASE WHEN source_leaning = 'left' THEN 3 ELSE 0 END AS left_count,
    coalesce(r, 0) + 2 * coalesce(pr, 0) + CASE WHEN source_leaning = 'right' THEN 3 ELSE 0 END AS right_count,
    coalesce(pos, 0) AS positive_count, coalesce(neg, 0) AS negative_count, coalesce(subj, 0) AS subj, coalesce(hedg, 0) AS hedg,
    coalesce(exag, 0) AS exag, coalesce(consp, 0) + 2 * coalesce(pc, 0) AS consp,
    coalesce(ls.n, 0) + 2 * coalesce(lm.n, 0) AS loaded, coalesce(c, 0) AS bait, {CITED} AS cited,
    coalesce(entity_bias, 0.0) AS entity_bias, coalesce(n_entities, 0) AS n_entities
  FROM bias_docs d JOIN bt USING (doc_id) LEFT JOIN leaning USING (source) LEFT JOIN hits USING (doc_id) LEFT JOIN phr USING (doc_id)
  LEFT JOIN loaded_single ls USING (doc_id) LEFT JOIN loaded_multi lm USING (doc_id) LEFT JOIN bait USING (doc_id)
  LEFT JOIN entity_bias USING (doc_id)),
comp AS (
  SELECT *,
    CASE WHEN left_count + right_count = 0 THEN 'center' WHEN left_count / (left_count + right_count)::DOUBLE > 0.6 THEN 'left'
      WHEN left_count / (left_count + right_count)::DOUBLE < 0.4 THEN 'right' ELSE 'center' END AS political_leaning,
    least(1.0, {sql_ratio('left_count + right_count', 'n')} * 20) AS political_bias,
    {sql_ratio('positive_count - negative_count', '(positive_count + negative_count)')} AS sentiment_score,
    least(1.0, {sql_ratio('subj', 'n')} * 20) AS subjectivity_score,
    least(1.0, {sql_ratio('hedg', 'n')} * 25) AS hedging_score,
    least(1.0, {sql_ratio('exag', 'n')} * 25) AS exaggeration_score,
    least(1.0, loaded / greatest(5.0, n / 30.0)::DOUBLE) AS loaded_phrase_score,
    least(1.0, bait) AS clickbait_score,
    least(1.0, cited / greatest(1.0, n / 100.0)::DOUBLE) AS citation_density,
    least(1.0, consp / greatest(10.0, n / 10.0)::DOUBLE) AS conspiracy_score
  FROM comp0),
bias_scored AS (
  SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, greatest(0.0,
    (0.25 * political_bias + 0.20 * subjectivity_score + 0.15 * abs(sentiment_score) + 0.15 * exaggeration_score
      + 0.10 * loaded_phrase_score + 0.10 * clickbait_score + 0.05 * (1 - citation_density))
    * CASE WHEN entity_bias > 0.3 THEN 1 + 0.2 * entity_bias ELSE 1.0 END
    * CASE WHEN conspiracy_score > 0.3 THEN 1 + 0.3 * conspiracy_score ELSE 1.0 END)) END AS bias_score
  FROM comp),
indicated AS (
  SELECT *, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_filter([
    CASE WHEN political_bias > 0.2 AND political_leaning <> 'center' THEN 'Shows ' || political_leaning || '-leaning political terms' END,
    CASE WHEN source_leaning <> 'unknown' AND source_strength > 0.3 THEN 'Source (' || source || ') has known ' || source_leaning || '-leaning bias' END,
    CASE WHEN sentiment_score > 0.2 THEN 'Uses positive loaded language' WHEN sentiment_score < -0.2 THEN 'Uses negative loaded language' END,
    CASE WHEN subjectivity_score > 0.2 THEN 'Contains subjective language' END,
    CASE WHEN hedging_score > 0.2 THEN 'Uses hedging language' END,
    CASE WHEN exaggeration_score > 0.2 THEN 'Uses exaggerated language' END,
    CASE WHEN clickbait_score > 0.2 THEN 'Contains clickbait language' END,
    CASE WHEN citation_density < 0.3 AND n > 50 THEN 'Lacks sufficient citations or sources' END,
    CASE WHEN entity_bias > 0.3 AND n_entities >= 2 THEN 'Shows contrasting sentiment toward different entities' END,
    CASE WHEN loaded_phrase_score > 0.2 THEN 'Uses loaded phrases' END,
    CASE WHEN conspiracy_score > 0.2 THEN 'Contains conspiracy-related language' END], lambda m: m IS NOT NULL), '; ') END AS bias_indicators
  FROM bias_scored)
"""
BIAS_SQL = with_ctes(LEXICON_CTE, SOURCES_CTE, DOCS_CTE, ENTITIES_CTE, SENTIMENT_CTE, LEANING_CTE, SCORES_CTE)


def bias_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        with_capitals(F.substring_index("text", "\n", 1)).alias("title"),
        with_capitals("text").alias("text"),
        F.concat(F.lit("www."), "source", F.lit(".com")).alias("source"),
    )


def scored(spark, sf_dir):
    out = bias.score_bias(
        bias_docs(spark, sf_dir),
        planted_lexicon(spark, sf_dir),
        planted_sources(spark, sf_dir),
        citation_patterns=CITATIONS,
    )
    return rounded(out.withColumn("bias_indicators", F.array_join("bias_indicators", "; ")))


VIEWS = {
    "political_bias": ["political_leaning", "political_bias", "left_count", "right_count"],
    "sentiment": ["sentiment_score", "positive_count", "negative_count"],
    "loaded_phrases": ["loaded_phrase_score"],
    "subjectivity": ["subjectivity_score"],
    "hedging": ["hedging_score"],
    "exaggeration": ["exaggeration_score"],
    "clickbait": ["clickbait_score"],
    "citation_density": ["citation_density"],
    "conspiracy": ["conspiracy_score"],
    "bias_score": ["bias_score"],
    "bias_indicators": ["bias_indicators"],
    "score_bias": [
        "source", "bias_score", "political_leaning", "political_bias", "left_count", "right_count", "subjectivity_score",
        "sentiment_score", "positive_count", "negative_count", "exaggeration_score", "hedging_score",
        "loaded_phrase_score", "clickbait_score", "citation_density", "entity_bias", "n_entities", "conspiracy_score",
        "source_leaning", "source_strength", "bias_indicators",
    ],
}
FLOATS = {
    "political_bias", "sentiment_score", "loaded_phrase_score", "subjectivity_score", "hedging_score", "exaggeration_score",
    "clickbait_score", "citation_density", "conspiracy_score", "bias_score", "entity_bias",
}
COUNTS = {"left_count", "right_count", "positive_count", "negative_count", "n_entities"}


def _column(c: str) -> str:
    if c in FLOATS:
        return f"round({c}::DOUBLE, 6) AS {c}"
    return f"{c}::BIGINT AS {c}" if c in COUNTS else c


def _register(name: str, columns: list[str]) -> None:
    @query(name, f"{BIAS_SQL} SELECT doc_id, {', '.join(_column(c) for c in columns)} FROM indicated")
    def view(spark, sf_dir):
        return scored(spark, sf_dir).select("doc_id", *columns)


for _name, _columns in VIEWS.items():
    _register(_name, _columns)


@query(
    "bias_entities",
    with_ctes(DOCS_CTE, ENTITIES_CTE) + " SELECT doc_id, etype, entity, count(*) AS n FROM entities GROUP BY ALL",
)
def bias_entity_counts(spark, sf_dir):
    full = F.concat("title", F.lit(" "), "text")
    docs = bias_docs(spark, sf_dir).select("doc_id", full.alias("cased"))
    # the outer form: a filter on the array's size would be pushed to the scan with all patterns and capitals in it, several times over
    rows = with_bias_entities(docs, F.col("cased")).select("doc_id", F.inline_outer("bias_entities")).filter(F.col("entity").isNotNull())
    return rows.groupBy("doc_id", "etype", "entity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "entity_sentiment",
    with_ctes(LEXICON_CTE, DOCS_CTE, ENTITIES_CTE, SENTIMENT_CTE)
    + " SELECT doc_id, entity, round(sentiment, 6) AS sentiment FROM entity_sentiment",
)
def entity_sentiment(spark, sf_dir):
    return rounded(bias.entity_sentiment(bias_docs(spark, sf_dir), planted_lexicon(spark, sf_dir)))


@query(
    "entity_bias",
    with_ctes(LEXICON_CTE, DOCS_CTE, ENTITIES_CTE, SENTIMENT_CTE)
    + " SELECT doc_id, n_entities, round(entity_bias, 6) AS entity_bias FROM entity_bias",
)
def entity_bias(spark, sf_dir):
    return rounded(bias.entity_bias(bias.entity_sentiment(bias_docs(spark, sf_dir), planted_lexicon(spark, sf_dir))))
