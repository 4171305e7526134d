"""Search terms, candidate articles, evidence scoring and fact checks: claims against all documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimweave.catalog.base import (
    ARTICLES_CTE, ASOF, CLAIMS_CTE, FEEDS, WORD, articles, claims, query, rounded, sql_capitals, sql_sentences, sql_tokens,
    sql_words, strings, table, with_capitals, with_ctes,
)
from claimweave.functions import fixed_values as fixed
from claimweave.operators import evidence as E
from claimweave.operators import retrieval as R
from claimweave.operators.entities import capitalized_entities, simple_entities
from claimweave.plans.verify import route_claims, with_mode
from claimweave.scale import cut_lineage, shared_folder
from claimweave.sources.postings import PostingsIndex

STOP = strings(fixed.STOPWORDS)
CONFIRM, DENY, CREDIBLE = ["and the", "tion of"], ["of the", "ing the"], ["src1", "src7"]
LEAD = r"(?:^|[^\p{L}\p{N}_])"


def content(expr: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({expr}), '{WORD}'), "
        f"lambda w: regexp_matches(w, '^[a-z]') AND length(w) > 2 AND NOT list_contains({STOP}, w))"
    )


def frequency_ctes(source: str, id_col: str, text_col: str) -> str:
    return f"""
kw AS (SELECT {id_col}, {content(text_col)} AS w FROM {source}),
grams AS (
  SELECT {id_col}, 1 AS n, w AS g FROM kw
  UNION ALL SELECT {id_col}, 2, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) FROM kw
  UNION ALL SELECT {id_col}, 3, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) FROM kw),
gram_rows AS (SELECT {id_col}, n, unnest(g) AS term, generate_subscripts(g, 1) AS pos FROM grams),
freq AS (
  SELECT *, row_number() OVER (PARTITION BY {id_col}, n ORDER BY freq DESC, first_pos) AS rank FROM (
    SELECT {id_col}, n, term, count(*) AS freq, min(pos) - 1 AS first_pos FROM gram_rows GROUP BY {id_col}, n, term))"""


TERMS_CTE = f"""
{frequency_ctes('claims', 'claim_id', 'claim')},
lists AS (
  SELECT claim_id, coalesce(list(term ORDER BY rank) FILTER (n = 1 AND rank <= 15), []) AS one,
    coalesce(list(term ORDER BY rank) FILTER (n = 2 AND rank <= 4), []) AS two,
    coalesce(list(term ORDER BY rank) FILTER (n = 3 AND rank <= 2), []) AS three FROM freq GROUP BY claim_id),
with_two AS (
  SELECT claim_id, one, list_reduce(list_transform(two, lambda x: [x]),
    lambda acc, b: CASE WHEN len(list_filter(acc, lambda c: contains(c, b[1]))) > 0 THEN acc ELSE acc || b END, three) AS chosen FROM lists),
key_terms AS (
  SELECT claim_id, list_reduce(list_transform(one, lambda x: [x]),
    lambda acc, b: CASE WHEN len(acc) >= 8 OR len(list_filter(acc, lambda c: contains(c, b[1]))) > 0 THEN acc ELSE acc || b END, chosen) AS key_terms
  FROM with_two)
"""
def sql_capital_runs(expr: str) -> str:
    runs = rf"regexp_extract_all({expr}, '{LEAD}([A-Z][a-z]*(?:\s+[A-Z][a-z]*)*)', 1)"
    return f"list_filter({runs}, lambda e: length(e) > 2 AND NOT list_contains({STOP}, lower(e)))"


QUERY_CTE = f"""
{TERMS_CTE.strip()},
queries AS (
  SELECT claim_id, claim, array_to_string((ents || list_filter(kt, lambda t: NOT list_contains(ents, t)))[1:5], ' ') AS search_query
  FROM (SELECT c.claim_id, claim, {sql_capital_runs('claim')} AS ents, coalesce(key_terms, []) AS kt
        FROM claims c LEFT JOIN key_terms USING (claim_id)))
"""
CANDIDATES_CTE = f"""
query_words AS (SELECT DISTINCT claim_id, unnest(regexp_extract_all(lower(search_query), '{WORD}')) AS word FROM queries),
eligible AS (
  SELECT * FROM articles WHERE lang = 'en' AND (source_api <> 'newsapi' OR published_s >= 1705363200)
    AND (source_api <> 'mediastack' OR category NOT IN ('general', 'sports'))),
article_words AS (
  SELECT article_id, source_api, published_s, unnest(list_distinct(regexp_extract_all(lower(title || ' ' || text), '{WORD}'))) AS word FROM eligible),
candidates AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY claim_id, source_api ORDER BY published_s DESC, article_id) AS feed_rank
    FROM (SELECT DISTINCT claim_id, article_id, source_api, published_s FROM query_words JOIN article_words USING (word)))
  WHERE feed_rank <= CASE source_api WHEN 'newsapi' THEN 20 ELSE 10 END)
"""
JACCARD = (
    "(CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / "
    "(len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE ELSE 0.0 END)"
)
TITLED_CTE = f"""
titled AS (
  SELECT c.claim_id, c.article_id, c.feed_rank, list_position({strings(list(fixed.FEED_ORDER))}, c.source_api) - 1 AS feed, url,
    list_distinct({sql_words('lower(title)')}) AS words FROM candidates c JOIN articles a USING (article_id))
"""
KEPT_CTE = f"""
{TITLED_CTE.strip()},
folded AS (
  SELECT claim_id, list_reduce(
    list([{{'feed': feed, 'rank': feed_rank, 'id': article_id, 'url': url, 'words': words}}] ORDER BY feed, feed_rank, article_id),
    lambda acc, a: CASE WHEN a[1].feed > 0 AND len(list_filter(acc, lambda k:
        (a[1].url <> '' AND k.url = a[1].url) OR {JACCARD.format('k.words', 'a[1].words')} > 0.8)) > 0 THEN acc ELSE acc || a END) AS kept
  FROM titled GROUP BY claim_id),
kept AS (
  SELECT claim_id, x.id AS article_id, ord FROM (
    SELECT claim_id, unnest(kept) AS x, generate_subscripts(kept, 1) - 1 AS ord FROM folded))
"""
EVIDENCE_CTE = f"""
{KEPT_CTE.strip()},
evidence AS (
  SELECT k.claim_id, k.ord, k.article_id, a.title, a.text, a.source, a.url, a.source_api FROM kept k JOIN articles a USING (article_id)
  UNION ALL
  SELECT claim_id, 0, NULL, 'Information about ' || search_query,
    'This is a mock article generated because no real articles were found for the query: ' || search_query, 'System Generated', '', 'mock'
  FROM queries WHERE claim_id NOT IN (SELECT claim_id FROM kept))
"""
CAPPED_CTE = """
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ord) AS rn FROM evidence) WHERE rn <= {0})
"""


def any_of(expr: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in terms) + ")"


def phrase_ctes(source: str) -> str:
    return f"""
claim_sents AS (SELECT claim_id, unnest({sql_sentences('claim')}) AS s FROM {source}),
claim_phrases AS (
  SELECT claim_id, s AS phrase FROM claim_sents WHERE len({sql_words('s')}) BETWEEN 3 AND 12
  UNION ALL
  SELECT claim_id, p FROM (
    SELECT claim_id, unnest(list_transform(range(1, len(t)), lambda i: CASE WHEN length(t[i]) > 1 AND length(t[i + 1]) > 1 THEN t[i] || ' ' || t[i + 1] END)) AS p
    FROM (SELECT claim_id, {sql_tokens('s', False)} AS t FROM claim_sents)) WHERE p IS NOT NULL)"""


def scored_ctes(confirm: list[str], deny: list[str]) -> str:
    return f"""
{phrase_ctes('claims').strip()},
sides AS (
  SELECT e.*, lower(e.title || ' ' || e.text) AS full_text, list_distinct({sql_tokens('c.claim')}) AS ct,
    list_distinct({sql_tokens("e.title || ' ' || e.text")}) AS atoks
  FROM capped e JOIN claims c USING (claim_id)),
phrase_n AS (
  SELECT s.claim_id, s.ord, count(*) AS n FROM sides s JOIN claim_phrases p ON p.claim_id = s.claim_id AND contains(s.full_text, lower(p.phrase))
  GROUP BY s.claim_id, s.ord),
scored AS (
  SELECT claim_id, article_id, ord, title, source,
    (CASE WHEN len(ct) > 0 AND len(atoks) > 0 THEN len(list_intersect(ct, atoks)) / len(ct)::DOUBLE ELSE 0.0 END) AS overlap,
    least(1.0::DOUBLE, 0.2::DOUBLE * coalesce(n, 0)) AS phrase_score,
    0.7::DOUBLE * overlap + 0.3::DOUBLE * phrase_score AS relevance,
    {any_of('full_text', confirm)} AS confirms, {any_of('full_text', deny)} AS denies
  FROM sides LEFT JOIN phrase_n USING (claim_id, ord)),
relevant AS (SELECT * FROM scored WHERE relevance > 0.05),
ranked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY relevance DESC, ord) AS rank FROM relevant)"""


def facts_ctes(credible: list[str]) -> str:
    s = "verification_score"
    return f"""
profile AS (
  SELECT claim_id, count(*) AS n_evidence, count(*) FILTER (relevance > 0.5) AS n_high,
    count(*) FILTER (relevance >= 0.3 AND relevance <= 0.5) AS n_medium, bool_or({any_of('lower(source)', credible)}) AS credible
  FROM relevant GROUP BY claim_id),
top5 AS (
  SELECT claim_id, bool_or(confirms) AND bool_or(denies) AS contradiction, sum(relevance) FILTER (rank <= 3) AS top_relevance,
    string_agg('Source ' || rank || ': ' || source || ' (' || CASE WHEN relevance > 0.7 THEN 'highly relevant'
      WHEN relevance > 0.4 THEN 'moderately relevant' ELSE 'somewhat relevant' END || '). ', '' ORDER BY rank) FILTER (rank <= 3) AS lines
  FROM ranked WHERE rank <= 5 GROUP BY claim_id),
facts0 AS (
  SELECT c.claim_id, c.claim, c.source, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium,
    coalesce(credible, false) AS credible, coalesce(contradiction, false) AS contradiction, coalesce(top_relevance, 0) AS top_relevance,
    coalesce(lines, '') AS lines FROM claims c LEFT JOIN profile USING (claim_id) LEFT JOIN top5 USING (claim_id)),
facts1 AS (
  SELECT *, 0.5::DOUBLE + CASE WHEN n_high >= 3 THEN 0.3 WHEN n_high >= 2 THEN 0.2 WHEN n_high >= 1 THEN 0.15 WHEN n_medium >= 3 THEN 0.1
      WHEN n_medium >= 1 THEN 0.05 WHEN n_evidence <= 1 THEN -0.05 ELSE 0.0 END + CASE WHEN credible THEN 0.1 ELSE 0.0 END AS base FROM facts0),
facts AS (
  SELECT *, CASE WHEN n_evidence = 0 THEN 0.4 ELSE least(1.0, greatest(0.0, CASE WHEN contradiction THEN 0.5
      WHEN n_evidence >= 3 AND top_relevance > 0 THEN (base + 1) / 2 ELSE base END)) END AS {s} FROM facts1),
explained AS (
  SELECT *, 'This claim is ' || CASE WHEN {s} >= 0.8 THEN 'highly likely to be true' WHEN {s} >= 0.6 THEN 'somewhat likely to be true'
      WHEN {s} >= 0.4 THEN 'uncertain' WHEN {s} >= 0.2 THEN 'somewhat likely to be false' ELSE 'highly likely to be false' END || '. ' ||
    CASE WHEN n_evidence > 0 THEN 'Found ' || n_evidence || ' relevant sources. ' || lines ELSE 'No relevant evidence sources were found. ' END ||
    CASE WHEN {s} >= 0.8 OR {s} <= 0.2 THEN 'This assessment has high confidence based on the available evidence.'
      WHEN {s} >= 0.4 AND {s} <= 0.6 THEN 'This assessment has low confidence due to limited or contradictory evidence.'
      ELSE 'This assessment has moderate confidence based on the available evidence.' END AS explanation FROM facts)"""


RETRIEVAL = [CLAIMS_CTE, ARTICLES_CTE, QUERY_CTE, CANDIDATES_CTE]
SCORING = [*RETRIEVAL, EVIDENCE_CTE, CAPPED_CTE.format(15), scored_ctes(CONFIRM, DENY)]
CHECKING = [*SCORING, facts_ctes(CREDIBLE)]


@query(
    "term_frequency",
    with_ctes(frequency_ctes("documents", "doc_id", "text"))
    + """ SELECT doc_id, n, term, freq, first_pos, rank FROM freq WHERE rank <= CASE n WHEN 1 THEN 15 WHEN 2 THEN 8 ELSE 4 END""",
)
def term_frequency(spark, sf_dir):
    top = R.term_frequency(table(spark, sf_dir, "documents"), {1: 15, 2: 8, 3: 4}, "doc_id", "text")
    return top.select("doc_id", "n", "term", "freq", "first_pos", "rank")


@query(
    "key_terms",
    with_ctes(CLAIMS_CTE, TERMS_CTE) + " SELECT claim_id, array_to_string(key_terms, '|') AS key_terms FROM key_terms",
)
def key_terms(spark, sf_dir):
    return R.key_terms(claims(spark, sf_dir)).select("claim_id", F.array_join("key_terms", "|").alias("key_terms"))


@query(
    "capitalized_entities",
    f"""WITH c AS (SELECT doc_id, {sql_capitals('text')} AS x FROM documents)
    SELECT doc_id, array_to_string({sql_capital_runs('x')}, '|') AS entities FROM c""",
)
def capitalized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", with_capitals("text").alias("x"))
    return docs.select("doc_id", F.array_join(capitalized_entities("x"), "|").alias("entities"))


@query(
    "simple_entities",
    f"""WITH c AS (SELECT doc_id, regexp_replace({sql_capitals('text')}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS x FROM documents)
    SELECT doc_id, array_to_string(regexp_extract_all(x, '{LEAD}([A-Z][a-z]+)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '|') AS entities FROM c""",
)
def simple(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", with_capitals("text").alias("x"))
    return docs.select("doc_id", F.array_join(simple_entities("x"), "|").alias("entities"))


@query("search_queries", with_ctes(CLAIMS_CTE, QUERY_CTE) + " SELECT claim_id, search_query FROM queries")
def search_queries(spark, sf_dir):
    return R.search_queries(claims(spark, sf_dir)).select("claim_id", "search_query")


def _queries(spark, sf_dir):
    return R.search_queries(claims(spark, sf_dir)).select("claim_id", "search_query")


@query(
    "select_candidates",
    with_ctes(*RETRIEVAL) + " SELECT claim_id, article_id, source_api, feed_rank FROM candidates",
)
def select_candidates(spark, sf_dir):
    found = R.select_candidates(_queries(spark, sf_dir), articles(spark, sf_dir), ASOF)
    return found.select("claim_id", "article_id", "source_api", "feed_rank")


def _indexed(spark, sf_dir) -> PostingsIndex:
    """All articles in an index, an addition for each feed, merged on the way."""
    index = PostingsIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", buckets=16, max_segments=2)
    for feed in FEEDS:
        index.add(articles(spark, sf_dir).filter(F.col("source_api") == feed), feed)
    return index


@query(
    "indexed_candidates",
    with_ctes(*RETRIEVAL) + " SELECT claim_id, article_id, source_api, feed_rank FROM candidates",
)
def indexed_candidates(spark, sf_dir):
    found = R.select_candidates(_queries(spark, sf_dir), None, ASOF, index=_indexed(spark, sf_dir))
    return found.select("claim_id", "article_id", "source_api", "feed_rank")


@query(
    "similar_titles",
    with_ctes(*RETRIEVAL, TITLED_CTE)
    + f""" SELECT claim_id, article_a, article_b, round(similarity, 6) AS similarity FROM (
      SELECT a.claim_id, a.article_id AS article_a, b.article_id AS article_b, {JACCARD.format('a.words', 'b.words')} AS similarity
      FROM titled a JOIN titled b ON a.claim_id = b.claim_id AND a.article_id < b.article_id) WHERE similarity > 0.8""",
)
def similar_titles(spark, sf_dir):
    stored = articles(spark, sf_dir)
    found = R.select_candidates(_queries(spark, sf_dir), stored, ASOF).select("claim_id", "article_id")
    return rounded(R.similar_titles(found.join(stored.select("article_id", "title"), "article_id")))


@query("dedup_articles", with_ctes(*RETRIEVAL, KEPT_CTE) + " SELECT claim_id, article_id, ord FROM kept")
def dedup_articles(spark, sf_dir):
    stored = articles(spark, sf_dir)
    found = R.select_candidates(_queries(spark, sf_dir), stored, ASOF)
    return R.dedup_articles(found.join(stored.select("article_id", "title", "url"), "article_id"))


@query(
    "drop_known_urls",
    with_ctes(ARTICLES_CTE)
    + """ SELECT article_id, url FROM articles a WHERE source_api <> 'newsapi'
      AND NOT EXISTS (SELECT 1 FROM articles b WHERE b.source_api = 'newsapi' AND b.url <> '' AND b.url = a.url)""",
)
def drop_known_urls(spark, sf_dir):
    stored = articles(spark, sf_dir).select("article_id", "url", "source_api")
    new, known = stored.filter("source_api <> 'newsapi'"), stored.filter("source_api = 'newsapi'")
    return R.drop_known_urls(new, known).select("article_id", "url")


@query(
    "gather_evidence",
    with_ctes(*RETRIEVAL, EVIDENCE_CTE) + " SELECT claim_id, ord, article_id, title, source, url, source_api FROM evidence",
)
def gather_evidence(spark, sf_dir):
    found = R.gather_evidence(_queries(spark, sf_dir), articles(spark, sf_dir), ASOF)
    return found.select("claim_id", "ord", "article_id", "title", "source", "url", "source_api")


@query(
    "indexed_evidence",
    with_ctes(*RETRIEVAL, EVIDENCE_CTE) + " SELECT claim_id, ord, article_id, title, source, url, source_api, md5(text) AS text_md5 FROM evidence",
)
def indexed_evidence(spark, sf_dir):
    found = R.gather_evidence(_queries(spark, sf_dir), None, ASOF, index=_indexed(spark, sf_dir))
    return found.select("claim_id", "ord", "article_id", "title", "source", "url", "source_api", F.md5("text").alias("text_md5"))


@query(
    "cap_evidence",
    with_ctes(*RETRIEVAL, EVIDENCE_CTE, CAPPED_CTE.format(5)) + " SELECT claim_id, ord, article_id FROM capped",
)
def cap_evidence(spark, sf_dir):
    found = R.gather_evidence(_queries(spark, sf_dir), articles(spark, sf_dir), ASOF)
    return R.cap_evidence(found, 5).select("claim_id", "ord", "article_id")


@query(
    "cap_evidence_by_row",
    with_ctes(*RETRIEVAL, EVIDENCE_CTE)
    + """ SELECT claim_id, ord, article_id FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ord) AS rn FROM evidence)
      WHERE rn <= claim_id % 40""",
)
def cap_evidence_by_row(spark, sf_dir):
    """Caps of 0 to 39, a number of its own for each claim."""
    found = R.gather_evidence(_queries(spark, sf_dir), articles(spark, sf_dir), ASOF)
    return R.cap_evidence(found, F.pmod("claim_id", F.lit(40))).select("claim_id", "ord", "article_id")


@query(
    "mode_params",
    """SELECT item_id AS claim_id, mode, mode <> 'fast' AS use_kg, CASE mode WHEN 'fast' THEN 3.0 WHEN 'balanced' THEN 6.0 ELSE 12.0 END::DOUBLE AS kg_timeout,
      CASE mode WHEN 'fast' THEN 5 WHEN 'balanced' THEN 8 ELSE 15 END AS article_cap
    FROM (SELECT item_id, ['fast', 'balanced', 'accurate'][item_id % 3 + 1] AS mode FROM benchmark)""",
)
def modes(spark, sf_dir):
    """Every claim with the settings of a mode that goes by its id."""
    names = F.array(*[F.lit(m[0]) for m in fixed.MODES])
    rows = claims(spark, sf_dir).select("claim_id", F.get(names, F.pmod("claim_id", F.lit(3)).cast("int")).alias("mode"))
    return with_mode(rows).select("claim_id", "mode", "use_kg", "kg_timeout", "article_cap")


@query(
    "route_claims",
    r"""WITH c AS (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 5 = 4 THEN '  ' ELSE text || text END, '^\s+|\s+$', '', 'g') AS claim FROM conversations)
    SELECT conv_id, turn, CASE WHEN claim = '' THEN 'empty' WHEN length(claim) > 1000 THEN 'too long' ELSE 'ok' END AS reason,
      length(claim) AS n_chars FROM c""",
)
def routed_claims(spark, sf_dir):
    text = F.when(F.pmod("turn", F.lit(5)) == 4, "  ").otherwise(F.concat("text", "text"))
    good, bad = route_claims(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("claim")))
    every = good.withColumn("reject_reason", F.lit("ok")).unionByName(bad)
    length = F.length("claim").cast("long").alias("n_chars")
    return every.select("conv_id", "turn", F.col("reject_reason").alias("reason"), length)


@query(
    "route_articles",
    r"""SELECT article_id, regexp_replace(title, '^\s+|\s+$', '', 'g') = '' AND regexp_replace(text, '^\s+|\s+$', '', 'g') = '' AS rejected FROM (
      SELECT doc_id AS article_id, CASE WHEN doc_id % 4 = 1 THEN '' ELSE split_part(text, chr(10), 1) END AS title,
        CASE WHEN doc_id % 8 = 1 THEN ' ' ELSE text END AS text FROM documents)""",
)
def routed_articles(spark, sf_dir):
    from claimweave.plans.verify import route_articles

    docs = table(spark, sf_dir, "documents")
    title = F.when(F.pmod("doc_id", F.lit(4)) == 1, "").otherwise(F.substring_index("text", "\n", 1))
    text = F.when(F.pmod("doc_id", F.lit(8)) == 1, " ").otherwise(F.col("text"))
    good, bad = route_articles(docs.select(F.col("doc_id").alias("article_id"), title.alias("title"), text.alias("text")))
    flagged = good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))
    return flagged.select("article_id", "rejected")


def _evidence(spark, sf_dir):
    return R.cap_evidence(R.gather_evidence(_queries(spark, sf_dir), articles(spark, sf_dir), ASOF), 15)


def _scored(spark, sf_dir, evidence=None):
    evidence = _evidence(spark, sf_dir) if evidence is None else evidence
    return E.score_evidence(claims(spark, sf_dir), evidence, confirming=CONFIRM, denying=DENY)


@query(
    "claim_phrases",
    with_ctes(CLAIMS_CTE, phrase_ctes("claims")) + " SELECT claim_id, phrase, count(*) AS n FROM claim_phrases GROUP BY ALL",
)
def claim_phrases(spark, sf_dir):
    rows = claims(spark, sf_dir).select("claim_id", F.explode(E.claim_phrases("claim")).alias("phrase"))
    return rows.groupBy("claim_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


SCORE_VIEWS = {
    "claim_article_overlap": "round(overlap, 6) AS overlap",
    "phrase_match": "round(phrase_score, 6) AS phrase_score",
    "relevance": "round(relevance, 6) AS relevance",
}


def _register(name: str, column: str) -> None:
    @query(name, with_ctes(*SCORING) + f" SELECT claim_id, ord, article_id, {column} FROM scored")
    def view(spark, sf_dir):
        return rounded(_scored(spark, sf_dir).select("claim_id", "ord", "article_id", column.split(" AS ")[1]))


for _name, _column in SCORE_VIEWS.items():
    _register(_name, _column)


@query(
    "semantic_relevance",
    with_ctes(*SCORING)
    + """ SELECT claim_id, ord, round(CASE WHEN semantic > 0 THEN 0.4::DOUBLE * overlap + 0.4::DOUBLE * semantic + 0.2::DOUBLE * phrase_score
        ELSE relevance END, 6) AS relevance
      FROM (SELECT *, (coalesce(article_id, 0) % 5) / 5.0::DOUBLE AS semantic FROM scored)""",
)
def semantic_relevance(spark, sf_dir):
    semantic = F.pmod(F.coalesce("article_id", F.lit(0)), F.lit(5)) / 5.0
    scored = E.score_evidence(claims(spark, sf_dir), _evidence(spark, sf_dir).withColumn("semantic", semantic))
    return rounded(scored.select("claim_id", "ord", "relevance"))


@query(
    "relevant_only",
    with_ctes(*SCORING) + " SELECT claim_id, ord, article_id FROM relevant",
)
def relevant_only(spark, sf_dir):
    return E.relevant_only(_scored(spark, sf_dir)).select("claim_id", "ord", "article_id")


@query("rank_evidence", with_ctes(*SCORING) + " SELECT claim_id, article_id, rank FROM ranked WHERE rank <= 5")
def rank_evidence(spark, sf_dir):
    return E.rank_evidence(E.relevant_only(_scored(spark, sf_dir)), 5).select("claim_id", "article_id", "rank")


@query(
    "top_evidence",
    with_ctes(*SCORING)
    + " SELECT claim_id, string_agg(coalesce(article_id::VARCHAR, ''), ',' ORDER BY rank) AS best_articles FROM ranked WHERE rank <= 3 GROUP BY claim_id",
)
def top_evidence(spark, sf_dir):
    top = E.top_evidence(E.relevant_only(_scored(spark, sf_dir)))
    ids = F.transform("matches", lambda m: F.coalesce(m["article_id"].cast("string"), F.lit("")))
    return top.select("claim_id", F.array_join(ids, ",").alias("best_articles"))


@query(
    "evidence_profile",
    with_ctes(*CHECKING) + " SELECT claim_id, n_evidence, n_high, n_medium, credible FROM profile",
)
def evidence_profile(spark, sf_dir):
    return E.evidence_profile(E.relevant_only(_scored(spark, sf_dir)), credible=CREDIBLE)


@query("contradiction", with_ctes(*CHECKING) + " SELECT claim_id, contradiction FROM top5")
def contradiction(spark, sf_dir):
    return E.top_evidence(E.relevant_only(_scored(spark, sf_dir))).select("claim_id", "contradiction")


@query(
    "consensus",
    with_ctes(*CHECKING)
    + """ SELECT claim_id, round(CASE WHEN n_evidence >= 3 AND top_relevance > 0 THEN (base + 1) / 2 ELSE base END, 6) AS blended FROM facts1""",
)
def consensus(spark, sf_dir):
    out = _checked(spark, sf_dir)
    high, medium, n = F.col("n_high"), F.col("n_medium"), F.col("n_evidence")
    step = F.when(high >= 3, 0.3).when(high >= 2, 0.2).when(high >= 1, 0.15)
    step = step.when(medium >= 3, 0.1).when(medium >= 1, 0.05).when(n <= 1, -0.05).otherwise(0.0)
    base = 0.5 + step + F.when(F.col("credible"), 0.1).otherwise(0.0)
    return rounded(out.select("claim_id", E.consensus(base).alias("blended")))


def _checked(spark, sf_dir, scored=None):
    scored = cut_lineage(_scored(spark, sf_dir)) if scored is None else scored
    return E.check_facts(claims(spark, sf_dir), scored, credible=CREDIBLE)


@query(
    "heuristic_score",
    with_ctes(*CHECKING) + " SELECT claim_id, round(verification_score::DOUBLE, 6) AS model_score FROM facts",
)
def heuristic_score(spark, sf_dir):
    return rounded(_checked(spark, sf_dir).select("claim_id", "model_score"))


@query(
    "combine_kg",
    with_ctes(*CHECKING)
    + """ SELECT claim_id, round(CASE WHEN kg > 0 THEN 0.7::DOUBLE * kg + 0.3::DOUBLE * v ELSE v END, 6) AS combined
      FROM (SELECT claim_id, verification_score::DOUBLE AS v, [0.0, 0.5, 0.7, 0.9][claim_id % 4 + 1]::DOUBLE AS kg FROM facts)""",
)
def combine_kg(spark, sf_dir):
    kg = F.get(F.array(*[F.lit(x) for x in (0.0, 0.5, 0.7, 0.9)]), F.pmod("claim_id", F.lit(4)).cast("int"))
    return rounded(_checked(spark, sf_dir).select("claim_id", E.combine_kg(F.col("model_score"), kg).alias("combined")))


@query("explanation", with_ctes(*CHECKING) + " SELECT claim_id, explanation FROM explained")
def explanation(spark, sf_dir):
    return _checked(spark, sf_dir).select("claim_id", "explanation")


@query(
    "check_facts",
    with_ctes(*CHECKING)
    + """ SELECT claim_id, round(verification_score::DOUBLE, 6) AS verification_score, n_evidence, contradiction, explanation,
      false AS kg_verification FROM explained""",
)
def check_facts(spark, sf_dir):
    columns = ["claim_id", "verification_score", "n_evidence", "contradiction", "explanation", "kg_verification"]
    return rounded(_checked(spark, sf_dir).select(*columns))


GIVEN_CTE = """
given AS (
  SELECT claim_id, n_evidence, explanation, CASE WHEN claim_id % 3 = 0 THEN (claim_id % 10) / 10.0::DOUBLE ELSE verification_score::DOUBLE END AS model,
    CASE WHEN claim_id % 4 = 1 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS kg FROM explained)
"""


@query(
    "check_facts_given_scores",
    with_ctes(*CHECKING, GIVEN_CTE)
    + """ SELECT claim_id, n_evidence, round(model, 6) AS model_score, round(CASE WHEN kg > 0 THEN 0.7::DOUBLE * kg + 0.3::DOUBLE * model ELSE model END, 6) AS verification_score,
      kg > 0 AS kg_verification,
      CASE WHEN kg > 0 THEN 'Knowledge graph verification: 1 out of 1 facts were verified. Confirmed: fact ' || claim_id || '. ' ELSE '' END AS knowledge FROM given""",
)
def check_facts_given_scores(spark, sf_dir):
    """A model's probability for every third claim and a confirmed fact for every fourth."""
    asked = claims(spark, sf_dir)
    turn = lambda n: F.pmod("claim_id", F.lit(n))
    probabilities = asked.filter(turn(3) == 0).select("claim_id", (turn(10) / 10.0).alias("probability"))
    facts = F.concat(F.lit("fact "), F.col("claim_id").cast("string"))
    kg = asked.filter(turn(4) == 1).select("claim_id", F.lit(0.9).alias("kg_score"), facts.alias("kg_fact"))
    out = E.check_facts(asked, cut_lineage(_scored(spark, sf_dir)), kg, credible=CREDIBLE, probabilities=probabilities)
    said = F.regexp_extract("explanation", r"Knowledge graph verification: .*? Confirmed: .*?\. ", 0)
    return rounded(out.select("claim_id", "n_evidence", "model_score", "verification_score", "kg_verification", said.alias("knowledge")))


@query(
    "evidence_stats",
    with_ctes(*RETRIEVAL, EVIDENCE_CTE)
    + """ SELECT claim_id, count(*) AS n_articles, count(DISTINCT CASE WHEN src <> '' THEN src ELSE string_split(url, '/')[3] END) AS n_sources
      FROM (SELECT claim_id, url, CASE WHEN ord % 4 = 1 THEN '' ELSE source END AS src FROM evidence) GROUP BY claim_id""",
)
def evidence_stats(spark, sf_dir):
    found = R.gather_evidence(_queries(spark, sf_dir), articles(spark, sf_dir), ASOF)
    return E.evidence_stats(found.withColumn("source", F.when(F.pmod("ord", F.lit(4)) == 1, "").otherwise(F.col("source"))))


