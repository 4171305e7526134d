"""Text preparation, token sets and column functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.catalog.base import (
    query, rounded, sql_sentences, sql_spaces, sql_strip, sql_tokens, sql_words, strings, table,
)
from claimweave.functions import fixed_values as fixed
from claimweave.functions import text as T


def sql_clean(expr: str) -> str:
    out = rf"regexp_replace({expr}, 'http\S+|www\S+', '', 'g')"
    out = f"regexp_replace({out}, '<.*?>', '', 'g')"
    out = rf"""regexp_replace({out}, '[^\p{{L}}\p{{M}}\p{{N}}_\s.,!?"''\-:]', '', 'g')"""
    out = rf"regexp_replace({out}, '\p{{Nd}}+', ' ', 'g')"
    return sql_spaces(out)


def sql_expand(expr: str) -> str:
    out = f"lower({expr})"
    for short, full in fixed.CONTRACTIONS:
        quoted = short.replace("'", "''")
        out = f"replace({out}, '{quoted}', '{full}')"
    return out


def sql_no_stops(expr: str) -> str:
    kept = f"list_filter({sql_tokens(expr, False)}, lambda t: NOT list_contains({strings(fixed.STOPWORDS)}, lower(t)))"
    return f"array_to_string({kept}, ' ')"


def sql_preprocess(expr: str) -> str:
    return f"array_to_string({sql_sentences(sql_expand(sql_clean(expr)))}, ' ')"


@query("clean_markup", f"SELECT page_id, {sql_clean('html')} AS cleaned FROM pages")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_markup("html").alias("cleaned"))


PLANTED = "replace(replace(replace(text, ' of ', ' can''t '), ' and ', '''s '), ' in ', ' we''ll ')"


def planted_contractions():
    out = F.replace(F.col("text"), F.lit(" of "), F.lit(" can't "))
    out = F.replace(out, F.lit(" and "), F.lit("'s "))
    return F.replace(out, F.lit(" in "), F.lit(" we'll "))


@query("expand_contractions", f"SELECT doc_id, {sql_expand(PLANTED)} AS expanded FROM documents")
def expand_contractions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.expand_contractions(planted_contractions()).alias("expanded"))


@query("remove_stopwords", f"SELECT doc_id, {sql_no_stops('text')} AS kept FROM documents")
def remove_stopwords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.remove_stopwords("text").alias("kept"))


@query(
    "preprocess_text",
    f"""WITH c AS (SELECT doc_id, {sql_preprocess(PLANTED)} AS clean_text FROM documents)
    SELECT doc_id, clean_text, CASE WHEN len({sql_words('clean_text')}) > 50
      THEN {sql_no_stops('clean_text')} END AS clean_text_no_stops FROM c""",
)
def preprocess_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.preprocess_text(planted_contractions()).alias("clean_text"))
    long = F.size(T.words("clean_text")) > 50
    return docs.withColumn("clean_text_no_stops", F.when(long, T.remove_stopwords("clean_text")))


@query("normalize_ws", f"SELECT doc_id, lower({sql_spaces('text')}) AS normal FROM documents")
def normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_ws("text").alias("normal"))


@query(
    "tokenize",
    f"""SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n_tokens,
      md5(array_to_string({sql_tokens('text')}, ' ')) AS digest FROM documents""",
)
def tokenize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    "sentences",
    f"""SELECT doc_id, len({sql_sentences('text')})::BIGINT AS n_sentences,
      md5(array_to_string({sql_sentences('text')}, '|')) AS digest FROM documents""",
)
def sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


def sql_ngrams(tokens: str, n: int) -> str:
    parts = " || ' ' || ".join(f"{tokens}[i + {k}]" if k else f"{tokens}[i]" for k in range(n))
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {parts})"


@query(
    "adjacent_ngrams",
    f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents),
    g AS (SELECT doc_id, {sql_ngrams('toks', 2)} AS two, {sql_ngrams('toks', 3)} AS three FROM t)
    SELECT doc_id, len(two)::BIGINT AS n_bigrams, md5(array_to_string(two, '|')) AS bigrams,
      len(three)::BIGINT AS n_trigrams, md5(array_to_string(three, '|')) AS trigrams FROM g""",
)
def adjacent_ngrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokenize("text").alias("t"))
    docs = docs.withColumns({"two": T.ngrams(F.col("t"), 2), "three": T.ngrams(F.col("t"), 3)})
    return docs.select(
        "doc_id",
        F.size("two").cast("long").alias("n_bigrams"),
        F.md5(F.array_join("two", "|")).alias("bigrams"),
        F.size("three").cast("long").alias("n_trigrams"),
        F.md5(F.array_join("three", "|")).alias("trigrams"),
    )


CUTS = (150, 300, 500, 1000, 2000)


@query(
    "truncate_text",
    "SELECT doc_id, "
    + ", ".join(f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END AS cut_{n}" for n in CUTS)
    + ", substr(text, 1, 300) || '...' AS excerpt, substr(text, 1, 5000) AS model_text FROM documents",
)
def truncate_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cuts = [T.truncate("text", n).alias(f"cut_{n}") for n in CUTS]
    return docs.select(
        "doc_id",
        *cuts,
        T.truncate("text", 300, always=True).alias("excerpt"),
        F.substring("text", 1, 5000).alias("model_text"),
    )


def sql_source(expr: str) -> str:
    out = f"lower({sql_strip(expr)})"
    out = rf"regexp_replace({out}, '^[a-z][a-z0-9+.\-]*://', '')"
    out = f"split_part({out}, '/', 1)"
    for p in (r"^www\.", r"^news\.", r"^blog\.", r"\.com$", r"\.org$", r"\.net$", r"\.co\.uk$", r"\.gov$", r"\.edu$"):
        out = f"regexp_replace({out}, '{p}', '')"
    return out


@query(
    "normalize_source",
    f"""SELECT page_id, {sql_source('url')} AS from_url,
      {sql_source("'WWW.News.' || split_part(url, '/', 3)")} AS from_host FROM pages""",
)
def normalize_source(spark, sf_dir):
    host = F.concat(F.lit("WWW.News."), T.url_domain("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.normalize_source("url").alias("from_url"), T.normalize_source(host).alias("from_host")
    )


@query("url_domain", "SELECT page_id, string_split(url, '/')[3] AS domain FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_domain("url").alias("domain"))


@query(
    "cache_key",
    "SELECT key, count(*) AS n FROM (SELECT 'query_' || replace(lower(split_part(text, chr(10), 1)), ' ', '_') AS key "
    "FROM documents) GROUP BY key",
)
def cache_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(T.cache_key("query_", F.substring_index("text", "\n", 1)).alias("key"))
    return docs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


TURNS = f"""turns AS (
  SELECT a.conv_id, a.turn, {sql_words('lower(a.text)')} AS x, {sql_words('lower(b.text)')} AS y,
    list_distinct({sql_words('lower(a.text)')}) AS dx, list_distinct({sql_words('lower(b.text)')}) AS dy,
    a.text AS ta, b.text AS tb
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""


def turns(spark, sf_dir):
    """Each turn with the next one of its conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("ta"))
    following = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumns({"tb": F.lead("ta").over(following), "tn": F.lead("turn").over(following)})
    return rows.filter(F.col("tn") == F.col("turn") + 1).drop("tn")


@query(
    "jaccard_words",
    f"""WITH {TURNS} SELECT conv_id, turn,
      round(CASE WHEN len(dx) > 0 AND len(dy) > 0 THEN
        len(list_intersect(dx, dy)) / (len(dx) + len(dy) - len(list_intersect(dx, dy)))::DOUBLE ELSE 0.0 END, 6) AS similarity
    FROM turns""",
)
def jaccard_words(spark, sf_dir):
    return rounded(turns(spark, sf_dir).select("conv_id", "turn", T.jaccard_words("ta", "tb").alias("similarity")))


@query(
    "token_sets",
    f"""WITH {TURNS} SELECT conv_id, turn, len(list_intersect(dx, dy))::BIGINT AS n_common,
      (len(dx) + len(dy) - len(list_intersect(dx, dy)))::BIGINT AS n_either FROM turns""",
)
def token_sets(spark, sf_dir):
    x, y = T.words(F.lower("ta")), T.words(F.lower("tb"))
    return turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.size(F.array_intersect(x, y)).cast("long").alias("n_common"),
        F.size(F.array_union(x, y)).cast("long").alias("n_either"),
    )


@query(
    "distinct_in_order",
    f"""WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS tok, generate_subscripts({sql_tokens('text')}, 1) AS pos FROM documents),
    f AS (SELECT doc_id, tok, min(pos) AS pos FROM t GROUP BY ALL)
    SELECT doc_id, count(*) AS n_distinct, md5(string_agg(tok, ' ' ORDER BY pos)) AS digest FROM f GROUP BY doc_id""",
)
def distinct_in_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.tokenize("text")).alias("t"))
    docs = docs.filter(F.size("t") > 0)
    return docs.select("doc_id", F.size("t").cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


def sql_similar(a: str, b: str) -> str:
    x, y = sql_strip(f"lower({a})"), sql_strip(f"lower({b})")
    wx, wy = f"list_distinct({sql_words(f'lower({a})')})", f"list_distinct({sql_words(f'lower({b})')})"
    return (
        f"({x} = {y} OR contains({x}, {y}) OR contains({y}, {x}) OR "
        f"len(list_intersect({wx}, {wy})) >= least(len({wx}), len({wy})) / 2.0)"
    )


@query(
    "entities_similar",
    f"WITH {TURNS} SELECT conv_id, turn, {sql_similar('ta', 'tb')} AS similar FROM turns",
)
def entities_similar(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", T.entities_similar(F.col("ta"), F.col("tb")).alias("similar"))


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(
    "semantic_similarity",
    f"""SELECT a.vec_id, round(({DOT.format('a.embedding', 'b.embedding')}
      / (sqrt({DOT.format('a.embedding', 'a.embedding')}) * sqrt({DOT.format('b.embedding', 'b.embedding')})) + 1) / 2, 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""",
)
def semantic_similarity(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return rounded(a.join(b, "vec_id").select("vec_id", T.semantic_similarity("x", "y").alias("similarity")))


