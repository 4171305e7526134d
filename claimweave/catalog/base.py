"""Registry of queries with their SQL, and the inputs both sides derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.scale import settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is the same result in DuckDB."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded; the order of a floating-point sum is not fixed."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as its files are split."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL snippets -------------------------------------------------------------------------
TOKEN = T.TOKEN_PATTERN.replace("'", "''")
WORD = T.WORD_PATTERN
SENTENCE = T.SENTENCE_PATTERN


def strings(values: list[str]) -> str:
    """SQL list literal."""
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[])"


def sql_tokens(expr: str, lower: bool = True) -> str:
    return f"regexp_extract_all({'lower(' + expr + ')' if lower else expr}, '{TOKEN}')"


def sql_words(expr: str) -> str:
    return rf"regexp_extract_all({expr}, '\S+')"


def sql_strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def sql_spaces(expr: str) -> str:
    return sql_strip(rf"regexp_replace({expr}, '\s+', ' ', 'g')")


def sql_sentences(expr: str) -> str:
    parts = f"list_transform(regexp_extract_all({expr}, '{SENTENCE}'), lambda s: {sql_strip('s')})"
    return f"list_filter({parts}, lambda s: s <> '')"


def sql_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN ({a}) / ({b})::DOUBLE ELSE 0.0 END)"


def sql_doubled(expr: str) -> str:
    """Every non-word character twice, so that two bounded matches never share a separator."""
    return rf"regexp_replace({expr}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


# --- planted lexicon: terms of the claims, put into categories by digest --------------------
CATEGORIES = [
    "left", "right", "positive", "negative", "subjective", "exaggeration", "hedging", "loaded",
    "clickbait", "conspiracy", "emotional",
]

LEXICON_CTE = f"""
lex_tokens AS (
  SELECT item_id, {sql_tokens('text')} AS toks FROM benchmark),
lex_terms AS (
  SELECT DISTINCT t AS term FROM (
    SELECT unnest(toks) AS t FROM lex_tokens
    UNION ALL
    SELECT unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM lex_tokens)
  WHERE regexp_matches(t, '^[a-z]+( [a-z]+)?$') AND length(t) > 1 AND (NOT contains(t, ' ') OR substr(md5(t), 5, 1) = '0')),
lexicon AS (
  SELECT DISTINCT category, term FROM (
    SELECT term, {strings(CATEGORIES)}[(('0x' || substr(md5(term), 1, 2))::INT // 2) + 1] AS category FROM lex_terms
    UNION ALL
    SELECT term, {strings(CATEGORIES)}[(('0x' || substr(md5(term), 3, 2))::INT // 2) + 1] FROM lex_terms)
  WHERE category IS NOT NULL)
"""


def _category(term: Column, at: int) -> Column:
    value = F.conv(F.substring(F.md5(term), at, 2), 16, 10).cast("int")
    return F.get(F.array(*[F.lit(c) for c in CATEGORIES]), F.floor(value / 2).cast("int"))


def planted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "benchmark").select(T.tokenize("text").alias("toks"))
    terms = tokens.select(F.explode(F.concat("toks", T.ngrams(F.col("toks"), 2))).alias("term")).distinct()
    terms = terms.filter(F.col("term").rlike("^[a-z]+( [a-z]+)?$") & (F.length("term") > 1))
    terms = terms.filter(~F.col("term").contains(" ") | (F.substring(F.md5("term"), 5, 1) == "0"))
    both = F.array_distinct(F.array_compact(F.array(_category(F.col("term"), 1), _category(F.col("term"), 3))))
    return settle(terms.select(F.explode(both).alias("category"), "term"))[0]


# --- planted publishers: names of the documents' sources by digest -----------------------------
SOURCES_CTE = """
sources AS (
  SELECT leaning, name, side * 1000000 + substr(name, 4)::BIGINT AS ord FROM (
    SELECT source AS name,
      CASE WHEN substr(md5(source), 1, 1) < '5' THEN 0 WHEN substr(md5(source), 1, 1) < 'a' THEN 1
           WHEN substr(md5(source), 1, 1) < 'd' THEN 2 END AS side,
      CASE WHEN substr(md5(source), 1, 1) < '5' THEN 'left' WHEN substr(md5(source), 1, 1) < 'a' THEN 'right'
           WHEN substr(md5(source), 1, 1) < 'd' THEN 'center' END AS leaning
    FROM (SELECT DISTINCT source FROM documents))
  WHERE leaning IS NOT NULL)
"""


def planted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    digit = F.substring(F.md5("name"), 1, 1)
    side = F.when(digit < "5", 0).when(digit < "a", 1).when(digit < "d", 2)
    leaning = F.when(digit < "5", "left").when(digit < "a", "right").when(digit < "d", "center")
    out = names.select(
        leaning.alias("leaning"), "name", (side * 1_000_000 + F.expr("substr(name, 4)").cast("long")).alias("ord")
    )
    return out.filter(F.col("leaning").isNotNull())


# --- articles: the documents with the fields of a feed ---------------------------------------------
ASOF = "2024-02-15"
CATEGORY_NAMES = ["general", "sports", "business", "health"]
FEEDS = ["newsapi", "gnews", "mediastack"]

ARTICLES_CTE = f"""
articles AS (
  SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, text, lang, source,
    CASE WHEN doc_id % 10 = 3 THEN ''
         ELSE 'http://' || source || '.example.com/' || substr(md5(split_part(text, chr(10), 1)), 1, 6) END AS url,
    1704067200 + (doc_id * 7919) % 60 * 86400 + doc_id % 86400 AS published_s,
    {strings(FEEDS)}[doc_id % 3 + 1] AS source_api,
    {strings(CATEGORY_NAMES)}[doc_id // 3 % 4 + 1] AS category
  FROM documents)
"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    url = F.concat(F.lit("http://"), F.col("source"), F.lit(".example.com/"), F.substring(F.md5(title), 1, 6))
    seconds = F.lit(1704067200) + F.pmod(F.col("doc_id") * 7919, F.lit(60)) * 86400 + F.pmod("doc_id", F.lit(86400))
    feed = F.get(F.array(*[F.lit(f) for f in FEEDS]), F.pmod("doc_id", F.lit(3)).cast("int"))
    category = F.get(
        F.array(*[F.lit(c) for c in CATEGORY_NAMES]), F.pmod(F.floor(F.col("doc_id") / 3), F.lit(4)).cast("int")
    )
    return docs.select(
        F.col("doc_id").alias("article_id"),
        title.alias("title"),
        "text",
        "lang",
        "source",
        F.when(F.pmod("doc_id", F.lit(10)) == 3, "").otherwise(url).alias("url"),
        F.timestamp_seconds(seconds).alias("published_at"),
        feed.alias("source_api"),
        category.alias("category"),
    )


CLAIMS_CTE = "claims AS (SELECT item_id AS claim_id, text AS claim, 'www.src' || (item_id % 20) || '.com' AS source FROM benchmark)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("www.src"), F.pmod("item_id", F.lit(20)), F.lit(".com"))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("claim_id"), F.col("text").alias("claim"), source.alias("source")
    )


# --- documents with planted capitals, so that entity patterns find something -----------------------
def sql_capitals(expr: str) -> str:
    word = "CASE WHEN substr(w, 1, 1) BETWEEN 'a' AND 'z' AND substr(md5(w), 1, 1) < '4' THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END"
    return f"array_to_string(list_transform({sql_words(expr)}, lambda w: {word}), ' ')"


def with_capitals(c: Column | str) -> Column:
    def capital(w: Column) -> Column:
        raised = F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
        chosen = F.substring(w, 1, 1).between("a", "z") & (F.substring(F.md5(w), 1, 1) < "4")
        return F.when(chosen, raised).otherwise(w)

    return F.array_join(F.transform(T.words(c), capital), " ")
