"""The linguistic training features of a text and its title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.functions import text as T
from claimweave.operators.lexical import count_where, in_list, inline_terms, wide_lexicon
from claimweave.scale import lookup_join, settle

CATEGORIES = ["positive", "negative", "subjective", "clickbait", "emotional", "exaggeration"]
SYLLABLES = r"[aeiouy]+|(?:^| )[^aeiouy ]+(?: |$)"


def source_credibility(mostly_true: str, half_true: str, false: str, barely_true: str, pants_on_fire: str) -> Column:
    good = F.col(mostly_true) + F.col(half_true)
    total = good + F.col(false) + F.col(barely_true) + F.col(pants_on_fire)
    return good / F.greatest(total, F.lit(1.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def polarity(positive: Column, negative: Column) -> Column:
    return ratio(positive - negative, positive + negative)


def population_variance(values: Column) -> Column:
    """Variance of an array of whole numbers, from exact sums."""
    zero = F.lit(0).cast("long")
    n = F.size(values)
    total = F.aggregate(values, zero, lambda acc, v: acc + v)
    squares = F.aggregate(values, zero, lambda acc, v: acc + v * v)
    return F.when(n > 0, (n * squares - total * total) / (n.cast("double") * n)).otherwise(F.lit(0.0))


def reading_grade(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    ok = (n_words > 0) & (n_sentences > 0)
    return F.when(ok, 0.39 * n_words / n_sentences + 11.8 * n_syllables / n_words - 15.59).otherwise(F.lit(0.0))


def text_statistics(docs: DataFrame, title_col: str, text_col: str) -> DataFrame:
    """Adds the lexicon-free statistics; a narrow step, no shuffle."""
    text, title = T.text_of(text_col), T.text_of(title_col)
    out = (
        docs.withColumn("_tokens", T.tokenize(text))
        .withColumn("_title_tokens", T.tokenize(title))
        .withColumn("_sentences", T.sentences(text))
        .withColumn("_lengths", F.transform("_sentences", lambda s: F.size(T.tokenize(s)).cast("long")))
    )
    spoken = F.filter("_tokens", lambda t: t.rlike(r"^[\p{L}\p{N}_]"))
    out = out.withColumn("_words", spoken)
    out = out.withColumn("_syllables", F.regexp_count(F.array_join("_words", "  "), F.lit(SYLLABLES)))
    n, n_sent = F.size("_tokens"), F.size("_sentences")
    varied = (F.length(text) >= 20) & (n_sent > 1)
    return (
        out.withColumn("n_tokens", n)
        .withColumn("n_title_tokens", F.size("_title_tokens"))
        .withColumn("text_length", F.length(text).cast("double"))
        .withColumn("word_count", F.size(T.words(text)).cast("double"))
        .withColumn("title_length", F.length(title).cast("double"))
        .withColumn("title_word_count", F.size(T.words(title)).cast("double"))
        .withColumn("avg_word_length", ratio(F.length(F.array_join("_tokens", "")), n))
        .withColumn("avg_sentence_length", ratio(n, n_sent))
        .withColumn("unique_word_ratio", ratio(F.size(F.array_distinct("_tokens")), n))
        .withColumn(
            "readability_score",
            F.when(F.length(text) > 100, reading_grade(F.size("_words"), n_sent, F.col("_syllables"))).otherwise(0.0),
        )
        .withColumn(
            "inconsistency_score",
            F.when(varied, F.least(F.lit(1.0), population_variance(F.col("_lengths")) / 100)).otherwise(0.0),
        )
        .drop("_sentences", "_lengths", "_words", "_syllables")
    )


def _known(rows: list | None) -> bool | None:
    """A settled table is small; any other is checked where it is joined."""
    return True if rows is not None else None


def _count_inline(stats: DataFrame, by: dict[str, list[str]]) -> DataFrame:
    """Hits per category inside each row: no shuffle at all.

    The tokens are first cut to those any category has, the categories then look at few.
    """
    every = in_list("t", sorted(set().union(*by.values())))
    found = stats.withColumns(
        {"_found": F.expr(f"filter(_tokens, t -> {every})"), "_title_found": F.expr(f"filter(_title_tokens, t -> {every})")}
    )
    counts = {f"_{c}": count_where("_found", "t", in_list("t", v)) for c, v in by.items()}
    counts |= {f"_title_{c}": count_where("_title_found", "t", in_list("t", v)) for c, v in by.items()}
    return found.withColumns(counts)


def _count_by_join(
    stats: DataFrame, lexicon: DataFrame, small: bool | None, id_col: str, keep: list[str], carried: list[str]
) -> DataFrame:
    """The same counts for a lexicon of any size.

    The tokens of title and text are exploded once and looked up; only hits (plus one
    marker row per document) reach the aggregate, whose shuffle carries about one row
    per document.  Rows are told apart by their position in the input, so rows that share an id
    stay as many as they were.
    """
    marker = F.array(F.struct(F.lit("").alias("tok"), F.lit(None).cast("boolean").alias("in_title")))
    rows = F.concat(
        marker,
        F.transform("_tokens", lambda t: F.struct(t.alias("tok"), F.lit(False).alias("in_title"))),
        F.transform("_title_tokens", lambda t: F.struct(t.alias("tok"), F.lit(True).alias("in_title"))),
    )
    numbered = stats.withColumn("_row", F.monotonically_increasing_id())
    exploded = numbered.select("_row", id_col, *keep, *carried, F.inline(rows))
    looked_up = lookup_join(exploded, wide_lexicon(lexicon, CATEGORIES, "tok"), ["tok"], "left", small=small)
    known = F.col("in_title").isNull() | F.col("positive").isNotNull()

    def hits(category: str, in_title: bool) -> Column:
        return F.count_if(F.col(category) & (F.col("in_title") == F.lit(in_title)))

    return looked_up.filter(known).groupBy("_row", id_col, *keep).agg(
        *[F.first(c).alias(c) for c in carried],
        *[hits(c, False).alias(f"_{c}") for c in CATEGORIES],
        *[hits(c, True).alias(f"_title_{c}") for c in CATEGORIES],
    )


def linguistic_features(
    docs: DataFrame,
    lexicon: DataFrame,
    id_col: str = "id",
    title_col: str = "clean_title",
    text_col: str = "clean_text",
    credibility_col: str | None = "source_credibility",
    clickbait_phrases: list[str] = fixed.TRAIN_CLICKBAIT_PHRASES,
    keep: list[str] | None = None,
) -> DataFrame:
    """All sixteen features, one row per document.

    One scan.  A small lexicon is counted inside the rows, a large one by a join.
    """
    keep = keep or []
    lexicon, terms = settle(lexicon)
    credibility = F.col(credibility_col) if credibility_col else F.lit(0.5)
    title = F.lower(T.text_of(title_col))
    stats = text_statistics(docs, title_col, text_col).withColumn(
        "_phrases", sum((title.contains(p).cast("long") for p in clickbait_phrases), F.lit(0).cast("long"))
    )
    scalars = [
        "n_tokens", "n_title_tokens", "text_length", "word_count", "title_length", "title_word_count",
        "avg_word_length", "avg_sentence_length", "unique_word_ratio", "readability_score",
        "inconsistency_score", "_phrases",
    ]
    stats = stats.select(
        id_col, *keep, *scalars, credibility.cast("double").alias("_credibility"), "_tokens", "_title_tokens"
    )
    by = inline_terms(terms, CATEGORIES)
    if by is not None:
        counted = _count_inline(stats, by)
    else:
        counted = _count_by_join(stats, lexicon, _known(terms), id_col, keep, [*scalars, "_credibility"])
    n, nt = F.col("n_tokens"), F.col("n_title_tokens")
    sentiment = polarity(F.col("_positive"), F.col("_negative"))
    title_sentiment = polarity(F.col("_title_positive"), F.col("_title_negative"))
    clickbait = F.when(nt > 0, (F.col("_title_clickbait") + 2 * F.col("_phrases")) / (nt + 0.1)).otherwise(0.0)
    return counted.select(
        id_col,
        *keep,
        "text_length",
        "word_count",
        sentiment.alias("sentiment_score"),
        ratio(F.col("_subjective"), n).alias("subjectivity_score"),
        clickbait.alias("clickbait_score"),
        ratio(F.col("_emotional"), n).alias("emotional_score"),
        ratio(F.col("_exaggeration"), n).alias("exaggeration_score"),
        "inconsistency_score",
        "avg_word_length",
        "avg_sentence_length",
        "readability_score",
        "unique_word_ratio",
        title_sentiment.alias("title_sentiment_score"),
        ratio(F.col("_title_subjective"), nt).alias("title_subjectivity_score"),
        F.abs(title_sentiment - sentiment).alias("sentiment_discrepancy"),
        F.col("_credibility").alias("source_credibility"),
        "title_length",
        "title_word_count",
    )


def sentence_length_variance(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lengths = F.transform(T.sentences(text_col), lambda s: F.size(T.tokenize(s)).cast("long"))
    out = docs.select(id_col, lengths.alias("_lengths"))
    return out.select(
        id_col,
        F.size("_lengths").cast("long").alias("n_sentences"),
        population_variance(F.col("_lengths")).alias("length_variance"),
    )


def fill_nan(df: DataFrame, columns: list[str], array_columns: list[str] | None = None) -> DataFrame:
    """NaN and null become 0.0 in scalars and inside vectors."""
    array_columns = array_columns or []
    zero = F.lit(0.0)
    changed = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), zero), zero) for c in columns}
    for c in array_columns:
        changed[c] = F.transform(c, lambda v: F.coalesce(F.nanvl(v.cast("double"), zero), zero))
    return df.withColumns(changed)


def count_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values ``fill_nan`` replaces, one row per column."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns]
    return df.agg(*bad).unpivot([], columns, "column_name", "n_filled")
