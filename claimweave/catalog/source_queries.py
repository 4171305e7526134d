"""Feed payloads, stored pages and request rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.catalog.base import query, sql_spaces, table
from claimweave.sources import feeds, pages
from claimweave.streaming import jobs

TITLE = "split_part(text, chr(10), 1)"
STAMP = "'2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00Z'"


def _item(newsapi: bool = False, media: bool = False):
    docs_title = F.when(F.pmod("doc_id", F.lit(9)) != 4, F.substring_index("text", "\n", 1))
    url = F.when(F.pmod("doc_id", F.lit(7)) != 2, F.concat(F.lit("http://x.org/"), F.col("doc_id").cast("string")))
    # NewsAPI has the first line as description and the rest as content, the others the whole text
    first = F.substring_index("text", "\n", 1)
    described = F.when(F.pmod("doc_id", F.lit(5)) != 1, first if newsapi else F.col("text"))
    named = F.when(F.pmod("doc_id", F.lit(4)) != 3, F.col("source"))
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.pmod("doc_id", F.lit(28)) + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z"))
    fields = [docs_title.alias("title"), described.alias("description"), url.alias("url")]
    if newsapi:
        fields.append(F.when(F.pmod("doc_id", F.lit(3)) != 0, F.substring("text", F.length(first) + 2, F.length("text"))).alias("content"))
    if media:
        return F.struct(*fields, stamp.alias("published_at"), named.alias("source"))
    return F.struct(*fields, stamp.alias("publishedAt"), F.struct(named.alias("name")).alias("source"))


def _payloads(spark, sf_dir, field: str, newsapi: bool = False, media: bool = False):
    item = _item(newsapi, media)
    status = F.when(F.pmod("doc_id", F.lit(11)) == 5, "error").otherwise("ok")
    body = F.to_json(F.struct(status.alias("status"), F.array(item).alias(field)))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("payload"))


def _seconds(df):
    return df.withColumn("published_at", F.unix_timestamp("published_at"))


def _sql(default: str, api: str, text: str, where: str) -> str:
    return f"""SELECT doc_id, CASE WHEN doc_id % 9 <> 4 THEN {TITLE} ELSE '' END AS title, {text} AS text,
      CASE WHEN doc_id % 4 <> 3 THEN source ELSE '{default}' END AS source,
      CASE WHEN doc_id % 7 <> 2 THEN 'http://x.org/' || doc_id ELSE '' END AS url,
      1704103200 + doc_id % 28 * 86400 AS published_at, '{api}' AS source_api FROM documents {where}"""


DESCRIBED = "CASE WHEN doc_id % 5 <> 1 THEN text ELSE '' END"
FIRST = f"CASE WHEN doc_id % 5 <> 1 THEN {TITLE} ELSE '' END"
CONTENT = f"substr(text, length({TITLE}) + 2)"
NEWS_WHERE = f"WHERE doc_id % 11 <> 5 AND doc_id % 9 <> 4 AND {TITLE} <> '' AND doc_id % 7 <> 2"


@query(
    "normalize_newsapi",
    _sql("NewsAPI", "newsapi", f"{FIRST} || CASE WHEN doc_id % 3 <> 0 AND {CONTENT} <> '' THEN ' ' || {CONTENT} ELSE '' END", NEWS_WHERE),
)
def normalize_newsapi(spark, sf_dir):
    return _seconds(feeds.normalize_newsapi(_payloads(spark, sf_dir, "articles", newsapi=True)))


@query("normalize_gnews", _sql("GNews", "gnews", DESCRIBED, ""))
def normalize_gnews(spark, sf_dir):
    return _seconds(feeds.normalize_gnews(_payloads(spark, sf_dir, "articles")))


@query("normalize_mediastack", _sql("MediaStack", "mediastack", DESCRIBED, ""))
def normalize_mediastack(spark, sf_dir):
    return _seconds(feeds.normalize_mediastack(_payloads(spark, sf_dir, "data", media=True)))


HREFS = r"""regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']*)["'']', 1)"""


@query(
    "extract_links",
    f"""WITH h AS (SELECT page_id, unnest({HREFS}) AS h, generate_subscripts({HREFS}, 1) AS p FROM pages),
    d AS (SELECT page_id, h, min(p) AS p FROM h WHERE starts_with(h, '/') AND NOT contains(h, 'google') GROUP BY page_id, h)
    SELECT page_id, pos, link FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS pos, h AS link FROM d) WHERE pos < 5""",
)
def extract_links(spark, sf_dir):
    return pages.extract_links(table(spark, sf_dir, "pages"), "/")


@query(
    "extract_search_links",
    f"""WITH h AS (SELECT page_id, unnest({HREFS}) AS h, generate_subscripts({HREFS}, 1) AS p FROM pages),
    d AS (SELECT page_id, 'http://x.org' || split_part(h, '&', 1) AS h, min(p) AS p FROM h WHERE starts_with(h, '/') AND NOT contains(h, 'google') GROUP BY ALL)
    SELECT page_id, pos, link FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS pos, h AS link FROM d) WHERE pos < 5""",
)
def extract_search_links(spark, sf_dir):
    """The pages' own links rewritten to the form of a search result."""
    html = F.regexp_replace("html", 'href="(/[^"]*)"', 'href="/url?q=http://x.org$1&sa=U"')
    return pages.extract_links(table(spark, sf_dir, "pages").withColumn("html", html))


def sql_decoded(expr: str) -> str:
    for entity, char in pages.ENTITIES:
        quoted = char.replace("'", "''")
        expr = f"replace({expr}, '{entity}', '{quoted}')"
    return expr


def sql_body() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("head", "script", "style", "nav", "footer"):
        out = rf"regexp_replace({out}, '(?s)<{tag}[\s>].*?</{tag}>', ' ', 'g')"
    return sql_spaces(sql_decoded(f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"))


PAGE_TITLE = sql_spaces(sql_decoded("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))
PAGES_CTE = f"""WITH p AS (SELECT page_id, url, {PAGE_TITLE} AS title, {sql_body()} AS full_text, string_split(url, '/')[3] AS source FROM pages)"""


@query(
    "extract_article_text",
    PAGES_CTE
    + " SELECT page_id, url, title, full_text, CASE WHEN length(full_text) > 2000 THEN substr(full_text, 1, 2000) || '...' ELSE full_text END AS text, source FROM p",
)
def extract_article_text(spark, sf_dir):
    return pages.extract_article_text(table(spark, sf_dir, "pages"))


@query(
    "fill_articles",
    PAGES_CTE
    + """, a AS (SELECT doc_id AS article_id, text, CASE WHEN doc_id % 10 <> 3 THEN u.url ELSE '' END AS url
      FROM documents LEFT JOIN pages u ON u.page_id = doc_id),
    f AS (SELECT url, min_by(CASE WHEN length(full_text) > 2000 THEN substr(full_text, 1, 2000) || '...' ELSE full_text END, page_id) AS t,
      min_by(full_text, page_id) AS ft FROM p WHERE full_text <> '' GROUP BY url)
    SELECT article_id, CASE WHEN f.t IS NOT NULL AND length(text) <= 1000 THEN md5(ft) END AS full_text,
      md5(CASE WHEN f.t IS NOT NULL AND length(text) <= 1000 THEN f.t ELSE text END) AS text FROM a LEFT JOIN f USING (url)""",
)
def fill_articles(spark, sf_dir):
    stored = table(spark, sf_dir, "pages")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    docs = docs.join(stored.select(F.col("page_id").alias("article_id"), "url"), "article_id", "left")
    docs = docs.withColumn("url", F.when(F.pmod("article_id", F.lit(10)) != 3, F.col("url")).otherwise(""))
    out = pages.fill_articles(docs, pages.extract_article_text(stored))
    return out.select("article_id", F.md5("full_text").alias("full_text"), F.md5("text").alias("text"))


@query(
    "suppress_repeats",
    """WITH RECURSIVE ev AS (SELECT DISTINCT user_id % 50 AS k, ts FROM events),
    answered AS (
      SELECT k, min(ts) AS ts FROM ev GROUP BY k
      UNION ALL
      SELECT a.k, min(e.ts) FROM answered a JOIN ev e ON e.k = a.k AND e.ts >= a.ts + INTERVAL 6 HOUR GROUP BY a.k)
    SELECT 'query_user_' || k AS query_key, epoch_us(ts)::BIGINT AS at FROM answered""",
)
def suppress_repeats(spark, sf_dir):
    """Requests of users in fifty groups, a group answered again after six hours."""
    text = F.concat(F.lit("User "), F.pmod("user_id", F.lit(50)).cast("string"))
    requests = table(spark, sf_dir, "events").select(text.alias("query"), "ts")
    out = jobs.suppress_repeats(requests, within="6 hours")
    return out.select("query_key", F.unix_micros("ts").alias("at"))


@query(
    "rate_flags",
    """SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) AS n_requests, count(*) > 2 AS over_limit
    FROM events GROUP BY user_id, date_trunc('hour', ts)""",
)
def rate_flags(spark, sf_dir):
    out = jobs.rate_flags(table(spark, sf_dir, "events"), per="1 hour", limit=2)
    return out.withColumn("window_start", F.unix_timestamp("window_start"))
