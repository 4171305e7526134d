"""Article payloads of the three news feeds, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMED = "struct<name:string>"
NEWSAPI_SCHEMA = (
    "status string, articles array<struct<title:string, description:string, content:string, url:string, "
    f"publishedAt:string, source:{NAMED}>>"
)
GNEWS_SCHEMA = f"articles array<struct<title:string, description:string, url:string, publishedAt:string, source:{NAMED}>>"
MEDIASTACK_SCHEMA = "data array<struct<title:string, description:string, url:string, published_at:string, source:string>>"


def _articles(payloads: DataFrame, schema: str, field: str, payload_col: str) -> DataFrame:
    keep = [c for c in payloads.columns if c != payload_col]
    parsed = payloads.select(*keep, F.from_json(payload_col, schema).alias("_p"))
    if "status string" in schema:
        parsed = parsed.filter(F.col("_p.status") == "ok")
    return parsed.select(*keep, F.explode(F.col(f"_p.{field}")).alias("a"))


def _normal_form(rows: DataFrame, text: Column, source: Column, published: Column, api: str) -> DataFrame:
    keep = [c for c in rows.columns if c != "a"]
    empty = F.lit("")
    return rows.select(
        *keep,
        F.coalesce("a.title", empty).alias("title"),
        text.alias("text"),
        source.alias("source"),
        F.coalesce("a.url", empty).alias("url"),
        F.to_timestamp(published).alias("published_at"),
        F.lit(api).alias("source_api"),
    )


def normalize_newsapi(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Articles with a title and a URL; text is the description followed by the content."""
    rows = _articles(payloads, NEWSAPI_SCHEMA, "articles", payload_col)
    rows = rows.filter((F.coalesce("a.title", F.lit("")) != "") & (F.coalesce("a.url", F.lit("")) != ""))
    content = F.coalesce("a.content", F.lit(""))
    text = F.concat(
        F.coalesce("a.description", F.lit("")), F.when(content != "", F.concat(F.lit(" "), content)).otherwise("")
    )
    return _normal_form(rows, text, F.coalesce("a.source.name", F.lit("NewsAPI")), F.col("a.publishedAt"), "newsapi")


def normalize_gnews(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    rows = _articles(payloads, GNEWS_SCHEMA, "articles", payload_col)
    text = F.coalesce("a.description", F.lit(""))
    return _normal_form(rows, text, F.coalesce("a.source.name", F.lit("GNews")), F.col("a.publishedAt"), "gnews")


def normalize_mediastack(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    rows = _articles(payloads, MEDIASTACK_SCHEMA, "data", payload_col)
    text = F.coalesce("a.description", F.lit(""))
    return _normal_form(rows, text, F.coalesce("a.source", F.lit("MediaStack")), F.col("a.published_at"), "mediastack")
