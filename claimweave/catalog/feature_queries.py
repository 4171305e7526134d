"""Training features of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.catalog.base import (
    LEXICON_CTE, planted_lexicon, query, rounded, sql_ratio, sql_sentences, sql_tokens, sql_words, table, with_ctes,
)
from claimweave.operators import features

PHRASES = ["the and", "of the", "in the", "and the"]
CATEGORIES = features.CATEGORIES


def _hits(name: str, tokens: str) -> str:
    counts = ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in CATEGORIES)
    return f"""{name} AS (SELECT doc_id, {counts} FROM (SELECT doc_id, unnest({tokens}) AS tok FROM d)
      JOIN lexicon ON tok = term GROUP BY doc_id)"""


PHRASE_SUM = " + ".join(f"contains(lower(title), '{p}')::INT" for p in PHRASES)
LENGTHS = f"list_transform(sents, lambda s: len({sql_tokens('s')}))"
FEATURES_CTE = with_ctes(
    LEXICON_CTE,
    f"""d AS MATERIALIZED (
      SELECT doc_id, title, text, {sql_tokens('title')} AS ttoks, {sql_tokens('text')} AS toks, {sql_sentences('text')} AS sents
      FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title, text FROM documents))""",
    _hits("th", "ttoks"),
    _hits("bh", "toks"),
    rf"""s AS (SELECT doc_id, title, text, len(toks) AS n, len(ttoks) AS nt, len(sents) AS ns, toks,
      {PHRASE_SUM} AS phrases, {LENGTHS} AS lens,
      list_filter(toks, lambda t: regexp_matches(t, '^[\p{{L}}\p{{N}}_]')) AS spoken FROM d)""",
    """y AS (SELECT *, len(spoken) AS nw, list_sum(list_transform(spoken,
      lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))))) AS syll FROM s)""",
    """r AS (SELECT y.*, """
    + ", ".join(f"coalesce(bh.{c}, 0) AS {c}, coalesce(th.{c}, 0) AS t_{c}" for c in CATEGORIES)
    + """ FROM y LEFT JOIN bh USING (doc_id) LEFT JOIN th USING (doc_id))""",
    f"""features AS (SELECT doc_id,
      length(text)::DOUBLE AS text_length, len({sql_words('text')})::DOUBLE AS word_count,
      length(title)::DOUBLE AS title_length, len({sql_words('title')})::DOUBLE AS title_word_count,
      round({sql_ratio('positive - negative', '(positive + negative)')}, 6) AS sentiment_score,
      round({sql_ratio('subjective', 'n')}, 6) AS subjectivity_score,
      round(CASE WHEN nt > 0 THEN (t_clickbait + 2 * phrases) / (nt + 0.1)::DOUBLE ELSE 0.0 END, 6) AS clickbait_score,
      round({sql_ratio('emotional', 'n')}, 6) AS emotional_score,
      round({sql_ratio('exaggeration', 'n')}, 6) AS exaggeration_score,
      round(CASE WHEN length(text) >= 20 AND ns > 1 THEN least(1.0, list_aggregate(lens, 'var_pop') / 100) ELSE 0.0 END, 6)
        AS inconsistency_score,
      round({sql_ratio("length(array_to_string(toks, ''))", 'n')}, 6) AS avg_word_length,
      round({sql_ratio('n', 'ns')}, 6) AS avg_sentence_length,
      round(CASE WHEN length(text) > 100 AND nw > 0 AND ns > 0 THEN 0.39::DOUBLE * nw / ns + 11.8::DOUBLE * syll / nw - 15.59 ELSE 0.0 END, 6)
        AS readability_score,
      round({sql_ratio('len(list_distinct(toks))', 'n')}, 6) AS unique_word_ratio,
      round({sql_ratio('t_positive - t_negative', '(t_positive + t_negative)')}, 6) AS title_sentiment_score,
      round({sql_ratio('t_subjective', 'nt')}, 6) AS title_subjectivity_score,
      round(abs({sql_ratio('t_positive - t_negative', '(t_positive + t_negative)')}
        - {sql_ratio('positive - negative', '(positive + negative)')}), 6) AS sentiment_discrepancy,
      0.5::DOUBLE AS source_credibility FROM r)""",
)


def all_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")
    found = features.linguistic_features(
        docs, planted_lexicon(spark, sf_dir), "doc_id", "title", "text", None, clickbait_phrases=PHRASES
    )
    return rounded(found)


VIEWS = {
    "linguistic_features": [
        "text_length", "word_count", "sentiment_score", "subjectivity_score", "clickbait_score", "emotional_score",
        "exaggeration_score", "inconsistency_score", "avg_word_length", "avg_sentence_length", "readability_score",
        "unique_word_ratio", "title_sentiment_score", "title_subjectivity_score", "sentiment_discrepancy",
        "source_credibility",
    ],
    "sentiment_score": ["sentiment_score", "title_sentiment_score"],
    "subjectivity_score": ["subjectivity_score", "title_subjectivity_score"],
    "clickbait_score": ["clickbait_score"],
    "emotional_score": ["emotional_score"],
    "exaggeration_score": ["exaggeration_score"],
    "complexity": ["avg_word_length", "avg_sentence_length", "readability_score", "unique_word_ratio"],
    "inconsistency": ["inconsistency_score"],
    "length_features": ["text_length", "word_count", "title_length", "title_word_count"],
    "sentiment_discrepancy": ["sentiment_discrepancy"],
}


def _register(name: str, columns: list[str]) -> None:
    @query(name, f"{FEATURES_CTE} SELECT doc_id, {', '.join(columns)} FROM features")
    def view(spark, sf_dir):
        return all_features(spark, sf_dir).select("doc_id", *columns)


for _name, _columns in VIEWS.items():
    _register(_name, _columns)


@query(
    "sentence_length_variance",
    f"""WITH s AS (SELECT doc_id, {sql_sentences('text')} AS sents FROM documents),
    l AS (SELECT doc_id, {LENGTHS} AS lens FROM s)
    SELECT doc_id, len(lens)::BIGINT AS n_sentences, round(coalesce(list_aggregate(lens, 'var_pop'), 0), 6) AS length_variance FROM l""",
)
def sentence_length_variance(spark, sf_dir):
    return rounded(features.sentence_length_variance(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(
    "source_credibility",
    """WITH c AS (SELECT o_custkey,
      count(*) FILTER (o_orderpriority LIKE '1%') AS a, count(*) FILTER (o_orderpriority LIKE '2%') AS b,
      count(*) FILTER (o_orderpriority LIKE '3%') AS c, count(*) FILTER (o_orderpriority LIKE '4%') AS d,
      count(*) FILTER (o_orderpriority LIKE '5%') AS e FROM orders GROUP BY o_custkey)
    SELECT o_custkey, round((a + b) / greatest(a + b + c + d + e, 1)::DOUBLE, 6) AS source_credibility FROM c""",
)
def source_credibility(spark, sf_dir):
    """Each customer as a speaker, the order priorities as the five kinds of past statements."""
    kinds = [F.count_if(F.col("o_orderpriority").startswith(str(i))).alias(f"k{i}") for i in range(1, 6)]
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*kinds)
    return rounded(counts.select("o_custkey", features.source_credibility("k1", "k2", "k3", "k4", "k5").alias("source_credibility")))


@query(
    "fill_nan",
    """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN 0.0 ELSE value END AS value,
      CASE WHEN event_id % 7 IN (0, 1) THEN 0.0 ELSE value END + 1.0 AS vector_sum FROM events""",
)
def fill_nan(spark, sf_dir):
    """Every seventh value is null and the one after it NaN before the filling."""
    events = with_gaps(table(spark, sf_dir, "events"))
    events = events.withColumn("vector", F.array(F.col("value"), F.lit(1.0), F.lit(float("nan"))))
    filled = features.fill_nan(events, ["value"], ["vector"])
    return filled.select("event_id", "value", F.aggregate("vector", F.lit(0.0), lambda a, v: a + v).alias("vector_sum"))


def with_gaps(events):
    turn = F.pmod("event_id", F.lit(7))
    return events.withColumn("value", F.when(turn == 0, None).when(turn == 1, float("nan")).otherwise(F.col("value")))


@query(
    "count_nan",
    "SELECT 'value' AS column_name, count(*) FILTER (event_id % 7 IN (0, 1)) AS n_filled FROM events "
    "UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL) FROM events",
)
def count_nan(spark, sf_dir):
    return features.count_nan(with_gaps(table(spark, sf_dir, "events")), ["value", "user_id"])
