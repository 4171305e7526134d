"""Column functions on text.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed

TOKEN_PATTERN = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"
#: The same matches without a stack frame for each part of a word; only Java reads possessive repeats.
TOKEN_IN_JAVA = r"[\p{L}\p{N}_]++(?:[-'][\p{L}\p{N}_]++)*+|[^\s\p{L}\p{N}_]"
WORD_PATTERN = r"[\p{L}\p{N}_]+"
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"
NO_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NO_WORD_AFTER = r"(?![\p{L}\p{N}_])"
WORD_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokenize(c: Column | str) -> Column:
    """Lower-cased tokens: words with inner hyphens or apostrophes, and single marks."""
    return find_all(F.lower(text_of(c)), TOKEN_IN_JAVA)


def tokenize_cased(c: Column | str) -> Column:
    return find_all(text_of(c), TOKEN_IN_JAVA)


def sentences(c: Column | str) -> Column:
    parts = F.transform(find_all(text_of(c), SENTENCE_PATTERN), lambda s: strip(s))
    return F.filter(parts, lambda s: s != "")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """Whitespace separated words."""
    return F.filter(F.split(text_of(c), r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Adjacent n-grams of an array, joined by a space."""
    last = F.size(tokens) - (n - 1)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def collapse_spaces(c: Column | str) -> Column:
    return strip(F.regexp_replace(text_of(c), r"\s+", " "))


def normalize_ws(c: Column | str) -> Column:
    return F.lower(collapse_spaces(c))


def clean_markup(c: Column | str) -> Column:
    """Drop links, tags and special characters, blank out digit runs, collapse spaces."""
    out = F.regexp_replace(text_of(c), r"http\S+|www\S+", "")
    out = F.regexp_replace(out, r"<.*?>", "")
    out = F.regexp_replace(out, r"""[^\p{L}\p{M}\p{N}_\s.,!?"'\-:]""", "")
    out = F.regexp_replace(out, r"\p{Nd}+", " ")
    return collapse_spaces(out)


def expand_contractions(c: Column | str) -> Column:
    out = F.lower(text_of(c))
    for short, full in fixed.CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(full))
    return out


def remove_stopwords(c: Column | str, stopwords: list[str] = fixed.STOPWORDS) -> Column:
    kept = F.filter(tokenize_cased(c), lambda t: ~F.lower(t).isin(stopwords))
    return F.array_join(kept, " ")


def preprocess_text(
    c: Column | str,
    remove_stops: bool = False,
    by_sentence: bool = True,
    stopwords: list[str] = fixed.STOPWORDS,
) -> Column:
    out = expand_contractions(clean_markup(c))
    if by_sentence:
        parts = sentences(out)
        if remove_stops:
            parts = F.transform(parts, lambda s: remove_stopwords(s, stopwords))
        return F.array_join(parts, " ")
    return remove_stopwords(out, stopwords) if remove_stops else out


def truncate(c: Column | str, n: int, suffix: str = "...", always: bool = False) -> Column:
    text = _col(c)
    head = F.substring(text, 1, n)
    if always:
        return F.concat(head, F.lit(suffix))
    return F.when(F.length(text) > n, F.concat(head, F.lit(suffix))).otherwise(text)


def normalize_source(c: Column | str) -> Column:
    """Bare publisher name of a domain or URL."""
    out = strip(F.lower(text_of(c)))
    out = F.regexp_replace(out, r"^[a-z][a-z0-9+.\-]*://", "")
    out = F.substring_index(out, "/", 1)
    for prefix in (r"^www\.", r"^news\.", r"^blog\."):
        out = F.regexp_replace(out, prefix, "")
    for suffix in (r"\.com$", r"\.org$", r"\.net$", r"\.co\.uk$", r"\.gov$", r"\.edu$"):
        out = F.regexp_replace(out, suffix, "")
    return out


def url_domain(c: Column | str) -> Column:
    return F.get(F.split(_col(c), "/"), F.lit(2))


def cache_key(prefix: str, *parts: Column | str) -> Column:
    cleaned = [F.replace(F.lower(_col(p)), F.lit(" "), F.lit("_")) for p in parts]
    return F.concat(F.lit(prefix), F.concat_ws("_", *cleaned))


def jaccard_words(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the lower-cased word sets, 0 when either is empty."""
    left, right = F.array_distinct(words(F.lower(_col(a)))), F.array_distinct(words(F.lower(_col(b))))
    return jaccard_sets(left, right)


def jaccard_sets(left: Column, right: Column) -> Column:
    common = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - common
    return F.when((F.size(left) > 0) & (F.size(right) > 0), common / union).otherwise(F.lit(0.0))


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")


def contains_any(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | c.contains(term)
    return out


def entities_similar(a: Column | str, b: Column | str) -> Column:
    """Equal, one inside the other, or at least half of the shorter one's words shared."""
    x, y = strip(F.lower(_col(a))), strip(F.lower(_col(b)))
    wx, wy = F.array_distinct(words(x)), F.array_distinct(words(y))
    shared = F.size(F.array_intersect(wx, wy))
    return (x == y) | x.contains(y) | y.contains(x) | (shared >= F.least(F.size(wx), F.size(wy)) / 2)


def semantic_similarity(a: Column | str, b: Column | str) -> Column:
    """(cosine + 1) / 2 of two vectors; 0 when a vector has no length."""
    x = F.transform(_col(a), lambda v: v.cast("double"))
    y = F.transform(_col(b), lambda v: v.cast("double"))
    dot = _sum(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(_sum(F.transform(x, lambda v: v * v))) * F.sqrt(_sum(F.transform(y, lambda v: v * v)))
    return F.when(norm > 0, (dot / norm + 1) / 2).otherwise(F.lit(0.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
