"""Lexicon tables, lexicon and phrase hits, publisher leaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimweave.catalog.base import (
    LEXICON_CTE, SOURCES_CTE, planted_lexicon, planted_sources, query, sql_tokens, strings, table, with_ctes,
)
from claimweave.catalog.text_queries import sql_source
from claimweave.functions import fixed_values as fixed
from claimweave.operators import bias, lexical
from claimweave.scale import shared_folder
from claimweave.sources import lexicons

TOKENS_CTE = f"doc_tokens AS (SELECT doc_id, unnest({sql_tokens('text')}) AS tok FROM documents)"


@query(
    "lexicon_hits",
    with_ctes(LEXICON_CTE, TOKENS_CTE)
    + """ SELECT doc_id, category, count(*) AS hits FROM doc_tokens JOIN lexicon ON tok = term GROUP BY doc_id, category""",
)
def lexicon_hits(spark, sf_dir):
    return lexical.lexicon_hits(table(spark, sf_dir, "documents"), planted_lexicon(spark, sf_dir))


@query(
    "phrase_hits",
    with_ctes(LEXICON_CTE)
    + """ SELECT doc_id, category, term FROM documents JOIN lexicon ON contains(term, ' ') AND contains(lower(text), term)""",
)
def phrase_hits(spark, sf_dir):
    return lexical.phrase_hits(table(spark, sf_dir, "documents"), planted_lexicon(spark, sf_dir))


DEFAULTS = {
    "positive": fixed.TRAIN_POSITIVE,
    "negative": fixed.TRAIN_NEGATIVE,
    "subjective": fixed.TRAIN_SUBJECTIVE,
    "clickbait": fixed.TRAIN_CLICKBAIT,
    "emotional": fixed.TRAIN_EMOTIONAL,
    "exaggeration": list(dict.fromkeys(fixed.TRAIN_EXAGGERATION)),
}
DEFAULT_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS category, unnest({strings(terms)}) AS term" for c, terms in DEFAULTS.items())


@query(
    "default_lexicon",
    with_ctes(f"lexicon AS ({DEFAULT_ROWS})", TOKENS_CTE)
    + """, n AS (SELECT category, count(*) AS n_terms FROM lexicon GROUP BY category),
    h AS (SELECT category, count(*) AS hits, count(DISTINCT doc_id) AS n_docs FROM doc_tokens JOIN lexicon ON tok = term GROUP BY category)
    SELECT category, n_terms, coalesce(hits, 0) AS hits, coalesce(n_docs, 0) AS n_docs FROM n LEFT JOIN h USING (category)""",
)
def default_lexicon(spark, sf_dir):
    """Size of each default training category and its hits in all documents."""
    lexicon = lexicons.training_lexicon(spark)
    hits = lexical.lexicon_hits(table(spark, sf_dir, "documents"), lexicon)
    per_category = hits.groupBy("category").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("n_docs"))
    out = lexicons.lexicon_stats(lexicon).join(per_category, "category", "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"hits": F.coalesce("hits", zero), "n_docs": F.coalesce("n_docs", zero)})


@query(
    "lexicon_stats",
    with_ctes(LEXICON_CTE) + " SELECT category, count(DISTINCT term) AS n_terms FROM lexicon GROUP BY category",
)
def lexicon_stats(spark, sf_dir):
    return lexicons.lexicon_stats(planted_lexicon(spark, sf_dir))


BIAS_LISTS = {
    "left": fixed.LEFT_TERMS, "right": fixed.RIGHT_TERMS, "positive": fixed.POSITIVE_WORDS, "negative": fixed.NEGATIVE_WORDS,
    "subjective": fixed.SUBJECTIVE_WORDS, "exaggeration": fixed.EXAGGERATION_WORDS, "hedging": fixed.HEDGING_WORDS,
    "loaded": fixed.LOADED_PHRASES, "clickbait": fixed.CLICKBAIT_PHRASES,
}
BIAS_VALUES = " UNION ALL ".join(f"SELECT '{c}' AS category, unnest({strings(list(dict.fromkeys(v)))}) AS term" for c, v in BIAS_LISTS.items())


@query(
    "bias_lexicon",
    f"""WITH lists AS ({BIAS_VALUES}), {TOKENS_CTE.strip()}
    SELECT category, term, count(DISTINCT doc_id) AS n_docs FROM lists LEFT JOIN doc_tokens ON tok = term GROUP BY ALL""",
)
def bias_lexicon(spark, sf_dir):
    """Every term of the built-in bias lists, with the number of documents that have it as a token."""
    from claimweave.functions import text as T

    lists = lexicons.default_lexicon(spark).filter(F.col("category").isin(list(BIAS_LISTS)))
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.array_distinct(T.tokenize("text"))).alias("term"))
    counts = tokens.groupBy("term").agg(F.count_distinct("doc_id").alias("n_docs"))
    out = lists.join(counts, "term", "left")
    return out.select("category", "term", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"))


MERGED = """, fresh AS (
  SELECT DISTINCT CASE WHEN substr(md5(tok), 3, 1) < '8' THEN 'positive' ELSE 'negative' END AS category, tok AS term
  FROM doc_tokens WHERE regexp_matches(tok, '^[a-z]+$'))"""


def fresh_terms(spark, sf_dir):
    """Further terms: all plain tokens of all documents, on a side by their digest."""
    from claimweave.functions import text as T

    tokens = table(spark, sf_dir, "documents").select(F.explode(T.tokenize("text")).alias("term")).distinct()
    digest = F.md5("term")
    chosen = tokens.filter(F.col("term").rlike("^[a-z]+$"))
    side = F.when(F.substring(digest, 3, 1) < "8", "positive").otherwise("negative")
    return chosen.select(side.alias("category"), "term")


@query(
    "merge_lexicons",
    with_ctes(LEXICON_CTE, TOKENS_CTE)
    + MERGED
    + " SELECT category, term FROM lexicon UNION SELECT category, term FROM fresh",
)
def merge_lexicons(spark, sf_dir):
    return lexicons.merge_lexicons(planted_lexicon(spark, sf_dir), fresh_terms(spark, sf_dir))


@query(
    "categorize_terms",
    with_ctes(LEXICON_CTE, TOKENS_CTE)
    + MERGED
    + """, m AS (
      SELECT f.term, count(*) FILTER (l.category = 'left') AS l, count(*) FILTER (l.category = 'right') AS r
      FROM (SELECT DISTINCT term FROM fresh) f JOIN lexicon l
        ON l.category IN ('left', 'right') AND (contains(f.term, l.term) OR contains(l.term, f.term)) GROUP BY f.term)
    SELECT CASE WHEN l > r THEN 'left' ELSE 'right' END AS category, term FROM m WHERE l <> r""",
)
def categorize_terms(spark, sf_dir):
    return lexicons.categorize_terms(fresh_terms(spark, sf_dir).select("term"), planted_lexicon(spark, sf_dir))


LEANING_CTE = f"""
leaning AS (
  SELECT source, min_by(s.leaning, s.ord) AS source_leaning FROM (
    SELECT source, {sql_source('source')} AS bare FROM (SELECT DISTINCT source FROM bias_docs)) d
  JOIN sources s ON bare <> '' AND (contains(bare, s.name) OR contains(s.name, bare)) GROUP BY source)
"""


@query(
    "source_leaning",
    with_ctes(SOURCES_CTE, "bias_docs AS (SELECT 'www.' || source || '.com' AS source FROM documents)", LEANING_CTE)
    + """ SELECT source, source_leaning, CASE source_leaning WHEN 'center' THEN 0.2 ELSE 0.7 END::DOUBLE AS source_strength FROM leaning""",
)
def source_leaning(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("www."), "source", F.lit(".com")).alias("source"))
    return bias.source_leaning(docs, planted_sources(spark, sf_dir))


POLARITIES = ["positive", "negative", "both", "neutral"]


@query(
    "read_mpqa",
    f"""WITH ws AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark),
    clues AS (SELECT w, {strings(POLARITIES)}[('0x' || substr(md5(w), 2, 1))::INT % 4 + 1] AS p FROM ws)
    SELECT 'subjective' AS category, w AS term FROM clues
    UNION SELECT 'positive', w FROM clues WHERE p IN ('positive', 'both') UNION SELECT 'negative', w FROM clues WHERE p IN ('negative', 'both')""",
)
def read_mpqa(spark, sf_dir):
    """Every word of the test items as a clue line, with notes and blank lines between, written and read."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).distinct()
    digest = F.md5(F.lower("w"))
    polarity = F.get(F.array(*[F.lit(p) for p in POLARITIES]), F.pmod(F.conv(F.substring(digest, 2, 1), 16, 10).cast("int"), F.lit(4)))
    kind = F.when(F.substring(digest, 1, 1) < "8", "strongsubj").otherwise("weaksubj")
    clue = F.concat(F.lit("type="), kind, F.lit(" len=1 word1="), "w", F.lit(" pos1=anypos stemmed1=n priorpolarity="), polarity)
    folder = f"{shared_folder(spark)}/clues-{uuid.uuid4().hex}"
    words.select(F.explode(F.array(clue, F.lit("# a note"), F.lit(""))).alias("value")).write.text(folder)
    return lexicons.read_mpqa(spark, folder)
