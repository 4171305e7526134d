"""Lexicon tables and the joins of tokens and texts with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.functions.automata import Shard, cut_into_shards
from claimweave.scale import contains_join, lookup_join

INLINE_PHRASES = 20
INLINE_TERMS = 1_000


def wide_lexicon(lexicon: DataFrame, categories: list[str], key: str = "term") -> DataFrame:
    """One row per term with one boolean column per category."""
    flags = [F.bool_or(F.col("category") == c).alias(c) for c in categories]
    kept = lexicon.filter(F.col("category").isin(categories))
    return kept.groupBy(F.col("term").alias(key)).agg(*flags)


def phrases_of(lexicon: DataFrame, categories: list[str]) -> DataFrame:
    multi = F.col("category").isin(categories) & F.col("term").contains(" ")
    return lexicon.filter(multi).select("category", "term").distinct()


def with_previous(tokens: Column) -> Column:
    """Array of (tok, prev) pairs; prev is null for the first token."""
    before = F.concat(F.array(F.lit(None).cast("string")), tokens)
    pairs = F.zip_with(tokens, before, lambda t, p: F.struct(t.alias("tok"), p.alias("prev")))
    return F.filter(pairs, lambda s: s["tok"].isNotNull())


def lexicon_hits(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens of each document found in each category."""
    terms = lexicon.select("category", F.col("term").alias("tok")).distinct()
    tokens = docs.select(id_col, F.explode(T.tokenize(text_col)).alias("tok"))
    hits = lookup_join(tokens, terms, ["tok"])
    return hits.groupBy(id_col, "category").agg(F.count(F.lit(1)).alias("hits"))


def phrase_hits(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The multi-word terms each lower-cased text contains, as substrings."""
    texts = docs.select(id_col, F.lower(T.text_of(text_col)).alias("_text"))
    multi = lexicon.filter(F.col("term").contains(" ")).select("category", "term").distinct()
    return contains_join(texts, multi, "_text", "term").select(id_col, "category", "term")


def phrase_masks(categories: list[str], rows: list[tuple]) -> list[Shard]:
    """Settled (category, term) rows as shards of terms; bit i of a mask stands for category i."""
    return cut_into_shards([(term, 1 << categories.index(c)) for c, term in rows if c in categories])


def count_masked(hits: str, bit: int, further: str = "true") -> Column:
    """How many of the found terms carry a bit."""
    return F.expr(f"CAST(size(filter({hits}, h -> (h.mask & {1 << bit}) != 0 AND {further})) AS BIGINT)")


def string_array(values: list[str]) -> Column:
    """Constant array of a fixed list; one literal that Catalyst folds, not one per value."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\u001f".join(values)), "\u001f")


def contained(text: Column, terms: list[str]) -> Column:
    """The terms of a short fixed list that occur in the text."""
    return F.filter(string_array(terms), lambda p: text.contains(p))


def whole_word_occurrences(text: Column, phrase: Column) -> Column:
    pattern = F.concat(F.lit(T.NO_WORD_BEFORE + r"\Q"), phrase, F.lit(r"\E" + T.NO_WORD_AFTER))
    return F.regexp_count(text, pattern)


def inline_terms(rows: list[tuple] | None, categories: list[str]) -> dict[str, list[str]] | None:
    """Terms by category of a settled (category, term) table when it is small enough for the plan, else None."""
    if rows is None or len(rows) > INLINE_TERMS:
        return None
    return {c: sorted({term for category, term in rows if category == c}) for c in categories}


def in_list(value: str, terms: list[str]) -> str:
    """SQL membership test in a fixed list; Catalyst turns a long one into a hash set."""
    if not terms:
        return "false"
    quoted = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms)
    return f"{value} IN ({quoted})"


def count_where(array: str, variable: str, condition: str) -> Column:
    return F.expr(f"CAST(size(filter({array}, {variable} -> {condition})) AS BIGINT)")
