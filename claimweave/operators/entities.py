"""Entity candidates from regular expressions, as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.functions import text as T


def _bounded(pattern: str) -> str:
    """The pattern between word boundaries.

    A pattern of plain words only needs no word character around it.  One with a dot or a
    dollar sign at an end takes the full definition of a boundary.  Looking for the capital
    first lets most positions fail on their first character.
    """
    if r"\." in pattern or r"\$" in pattern:
        return T.WORD_EDGE + r"(?:" + pattern + r")" + T.WORD_EDGE
    ahead = "(?=[A-Z])" if pattern.startswith("[A-Z]") else ""
    return ahead + T.NO_WORD_BEFORE + r"(?:" + pattern + r")" + T.NO_WORD_AFTER


def capitalized_entities(c: Column | str, stopwords: list[str] = fixed.STOPWORDS) -> Column:
    """Runs of capitalised words longer than two characters that are no stopword.

    The repeats are possessive: Java matches a greedy group once a stack frame, and a run of some thousand words overflows it.
    """
    runs = T.find_all(T.text_of(c), "(?=[A-Z])" + T.NO_WORD_BEFORE + r"[A-Z][a-z]*+(?:\s++[A-Z][a-z]*+)*+")
    return F.filter(runs, lambda e: (F.length(e) > 2) & ~F.lower(e).isin(stopwords))


def simple_entities(c: Column | str) -> Column:
    return T.find_all(T.text_of(c), _bounded("[A-Z][a-z]+"))


def with_bias_entities(df: DataFrame, text: Column, out: str = "bias_entities") -> DataFrame:
    """Adds the bias scorer's entities as an array of (etype, entity), in order of type.

    Typed matches keep their duplicates; OTHER only holds what the typed patterns did not
    take.  The matches become columns of their own first, so that every pattern runs once.
    """
    raw = {k: T.find_all(text, _bounded(p)) for k, p in fixed.BIAS_ENTITY_PATTERNS.items()}
    found = df.withColumns({f"_{k}": v for k, v in raw.items()})
    taken = F.concat("_PERSON", "_ORG", "_GPE")
    tagged = [F.transform(f"_{k}", _tag(k)) for k in ("PERSON", "ORG", "GPE")]
    tagged.append(F.transform(F.array_except("_OTHER", taken), _tag("OTHER")))
    return found.withColumn(out, F.concat(*tagged)).drop(*[f"_{k}" for k in raw])


def _tag(etype: str):
    return lambda e: F.struct(F.lit(etype).alias("etype"), e.alias("entity"))


def typed_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One array column per entity type, distinct in order of appearance.

    Types come from the pattern list (a pattern that keeps a group yields that
    group only).  MISC holds multi-word capitals, then capitalised words that do not
    open a sentence and were not taken before.
    """
    stop = fixed.ENTITY_STOPWORDS
    text = F.col("_text")

    def usable(e: Column) -> Column:
        return (e != "") & ~e.isin(stop)

    out = docs.select(id_col, T.text_of(text_col).alias("_text"))
    for etype in fixed.ENTITY_TYPES[:-1]:
        found = [
            T.find_all(text, _bounded(p), group) for kind, p, group in fixed.ENTITY_PATTERNS if kind == etype
        ]
        out = out.withColumn(etype, F.filter(F.concat(*found), usable))
    phrases = T.find_all(text, _bounded(r"[A-Z][a-z]++(?:\s++[A-Z][a-z]++" + T.NO_WORD_AFTER + ")++"))
    inner = F.flatten(
        F.transform(F.split(text, r"\."), lambda s: F.slice(T.words(s), F.lit(2), F.greatest(F.size(T.words(s)), F.lit(1))))
    )
    capital = F.filter(inner, lambda w: w.rlike(r"^\p{Lu}") & usable(w))
    out = out.withColumn("_phrases", F.filter(phrases, usable)).withColumn("_capital", capital)
    taken = F.concat(*fixed.ENTITY_TYPES[:-1], "_phrases")
    out = out.withColumn("_taken", F.array_distinct(taken))
    misc = F.concat("_phrases", F.array_except("_capital", "_taken"))
    return out.select(
        id_col,
        *[F.array_distinct(t).alias(t) for t in fixed.ENTITY_TYPES[:-1]],
        F.array_distinct(misc).alias("MISC"),
    )


def entity_rows(typed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Long form (id, etype, pos, entity) of ``typed_entities``."""
    arrays = F.array(*[F.struct(F.lit(t).alias("etype"), F.col(t).alias("found")) for t in fixed.ENTITY_TYPES])
    long = typed.select(id_col, F.inline(arrays))
    return long.select(id_col, "etype", F.posexplode("found").alias("pos", "entity"))


def entity_map(typed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Map from type to entities, without the empty types."""
    pairs = []
    for t in fixed.ENTITY_TYPES:
        pairs += [F.lit(t), F.col(t)]
    return typed.select(id_col, F.map_filter(F.create_map(*pairs), lambda k, v: F.size(v) > 0).alias("entities"))


def flat_entities() -> Column:
    """All entities of ``typed_entities`` in order of type, distinct."""
    return F.array_distinct(F.concat(*[F.col(t) for t in fixed.ENTITY_TYPES]))
