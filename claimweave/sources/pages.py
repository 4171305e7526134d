"""Links and article text out of stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text as T

ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
SEARCH_PREFIX = "/url?q="


def extract_links(
    pages: DataFrame, prefix: str = SEARCH_PREFIX, id_col: str = "page_id", html_col: str = "html", most: int = 5
) -> DataFrame:
    """The first distinct links with a prefix, in page order.

    With the search prefix the target is cut out of the link and must be an outside
    address; any other prefix takes the link as it is.
    """
    hrefs = T.find_all(T.text_of(html_col), r"""<a\s[^>]*?href=["']([^"']*)["']""", 1)
    hrefs = F.filter(hrefs, lambda h: h.startswith(prefix) & ~h.contains("google"))
    if prefix == SEARCH_PREFIX:
        cut = F.transform(hrefs, lambda h: F.substring_index(F.replace(h, F.lit(prefix), F.lit("")), "&", 1))
        hrefs = F.filter(cut, lambda u: u.startswith("http"))
    links = F.slice(F.array_distinct(hrefs), 1, most)
    return pages.select(id_col, F.posexplode(links).alias("pos", "link"))


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def page_title(c: Column | str) -> Column:
    return T.collapse_spaces(decode_entities(F.regexp_extract(T.text_of(c), r"(?s)<title[^>]*>(.*?)</title>", 1)))


def page_text(c: Column | str) -> Column:
    """Readable text of a page: scripts, styles, navigation, comments and tags removed."""
    out = F.regexp_replace(T.text_of(c), r"(?s)<!--.*?-->", " ")
    for tag in ("head", "script", "style", "nav", "footer"):
        out = F.regexp_replace(out, rf"(?s)<{tag}[\s>].*?</{tag}>", " ")
    return T.collapse_spaces(decode_entities(F.regexp_replace(out, r"<[^>]*>", " ")))


def extract_article_text(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", limit: int = 2000
) -> DataFrame:
    full = page_text(html_col)
    out = pages.select(id_col, url_col, page_title(html_col).alias("title"), full.alias("full_text"))
    return out.withColumns({"text": T.truncate("full_text", limit), "source": T.url_domain(url_col)})


def fill_articles(articles: DataFrame, extracted: DataFrame, url_col: str = "url") -> DataFrame:
    """Replaces the text of articles with a URL and at most 1000 characters by the page text, where there is one."""
    found = extracted.filter(F.col("full_text") != "").groupBy(url_col).agg(
        F.min_by(F.struct("text", "full_text"), "page_id").alias("_page")
    )
    short = (F.coalesce(url_col, F.lit("")) != "") & (F.length(T.text_of("text")) <= 1000)
    # what can't be filled goes around the join, so articles without a URL never meet under one key
    rest = articles.filter(~short).withColumn("full_text", F.lit(None).cast("string"))
    out = articles.filter(short).join(found, url_col, "left").select(*articles.columns, "_page")
    use = F.col("_page").isNotNull()
    filled = out.withColumns(
        {"full_text": F.when(use, F.col("_page.full_text")), "text": F.when(use, F.col("_page.text")).otherwise(F.col("text"))}
    ).drop("_page")
    return filled.unionByName(rest)
