"""Many terms looked for in one pass over a text: Aho-Corasick automata in vectorised functions.

Terms are cut into shards of a bounded number of characters, which bounds both what the driver holds and the automaton of a
task.  A text is read once for each shard, so the work grows with the texts and the hits, not with the number of terms.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_CHARS = 1_000_000
MAX_SHARDS = 32
FOUND = "array<struct<term: string, mask: int>>"

Shard = dict[str, int]


def cut_into_shards(terms: Iterable[tuple[str, int]], shard_chars: int = SHARD_CHARS) -> list[Shard]:
    """(term, mask) pairs in shards; the masks of a repeated term are united."""
    shards: list[Shard] = [{}]
    size = 0
    for term, mask in sorted(terms):
        if term not in shards[-1] and size + len(term) + 1 > shard_chars and shards[-1]:
            shards.append({})
            size = 0
        if term not in shards[-1]:
            size += len(term) + 1
        shards[-1][term] = shards[-1].get(term, 0) | mask
    return shards


def term_shards(terms: DataFrame, term_col: str = "term", shard_chars: int = SHARD_CHARS, max_shards: int = MAX_SHARDS) -> list[Shard] | None:
    """The distinct terms of a table in shards, or None if they have more than ``shard_chars * max_shards`` characters.

    The characters are summed up first, so no more than that goes to the driver.
    """
    distinct = terms.select(F.col(term_col).alias("term")).filter(F.col("term").isNotNull()).distinct()
    total = distinct.agg(F.sum(F.length("term") + 1)).first()[0] or 0
    if total > shard_chars * max_shards:
        return None
    return cut_into_shards([(t, 0) for t in distinct.toArrow().column("term").to_pylist()], shard_chars)


def _automaton(terms: Iterable[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for value in terms:
        if value:
            made.add_word(value, value)
    made.make_automaton()
    return made


def _finder(shard: Shard):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = _automaton(shard)
        # one object a term, however many texts of a batch have it
        known = {t: {"term": t, "mask": m} for t, m in shard.items()}
        always = [known[""]] if "" in shard else []
        for batch in texts:
            out = []
            for text in batch:
                if text is None:
                    out.append([])
                    continue
                hits = {term for _, term in made.iter(text)} if len(made) else ()
                out.append([*always, *(known[t] for t in sorted(hits))])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, FOUND)


def found_terms(text: Column | str, shards: list[Shard]) -> Column:
    """The distinct terms the text contains as substrings, with their masks.

    A null text contains none.  The empty term is in every other text.
    """
    column = F.col(text) if isinstance(text, str) else text
    parts = [_finder(s)(column) for s in shards if s]
    if not parts:
        return F.array().cast(FOUND)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _sentences_of_names(sentences: list[str], names: list[str]) -> list[list[int]]:
    """For each name the numbers of the sentences that contain it, in order; one pass over the sentences."""
    found: dict[str, list[int]] = {n: [] for n in names}
    if "" in found:
        found[""] = list(range(len(sentences)))
    made = _automaton(found)
    if len(made):
        starts, text = [], []
        at = 0
        for s in sentences:
            starts.append(at)
            text.append(s)
            at += len(s) + 1
        # no term spans two sentences: a line end stands between them, and hits that begin before their sentence are left out
        for end, name in made.iter("\n".join(text)):
            i = bisect_right(starts, end) - 1
            if end - len(name) + 1 >= starts[i] and end < starts[i] + len(sentences[i]):
                hits = found[name]
                if not hits or hits[-1] != i:
                    hits.append(i)
    return [found[n] for n in names]


SAID = "array<struct<name: string, p: long, n: long>>"


def said_of_names(sentences: Column, names: Column, lowered: Column, counts: Column) -> Column:
    """Of the names (an array) whose lowered form some sentence contains: the counts (p, n) summed over those sentences.

    ``counts`` holds a struct for each sentence.  Linear in the text and the hits, however many names there are.
    """

    def run(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in columns:
            out = []
            for many, given, low, pn in zip(*batch, strict=True):
                if many is None or given is None or not len(many) or not len(given):
                    out.append([])
                    continue
                at = _sentences_of_names(list(many), list(dict.fromkeys(low)))
                where = dict(zip(dict.fromkeys(low), at, strict=True))
                out.append([{"name": n, "p": sum(pn[i]["p"] for i in where[w]), "n": sum(pn[i]["n"] for i in where[w])} for n, w in zip(given, low, strict=True) if where[w]])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, SAID)(sentences, names, lowered, counts)


def members_by_list(lists: Column, positive: set[str], negative: set[str]) -> Column:
    """For each list of words in an array, how many are in either set: an array of (p, n)."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in columns:
            rows = []
            for row in batch:
                words = [[] if ws is None else ws for ws in ([] if row is None else row)]
                rows.append([{"p": sum(w in positive for w in ws), "n": sum(w in negative for w in ws)} for ws in words])
            yield pd.Series(rows, dtype=object)

    return F.pandas_udf(run, "array<struct<p: long, n: long>>")(lists)


def lexicon_counts(tokens: Column, words: Column, categories: list[str], masks: dict[str, int], loaded: set[str], prefix: str = "_") -> Column:
    """Token hits of a row by category, as one struct of counts; ``masks`` has bit i for a term of category i.

    A token counts once for each of its categories.  Further counts: pairs of neighbours that are a left or right term,
    positive or negative tokens after an exaggerating one, subjective tokens that are not the first, and words that are
    ``loaded``.  A set look-up a token; no row leaves its place.  Neither tokens nor words hold a space, so each row crosses to Python
    as two texts, and only the row in hand is a list: a batch of lists of words takes some twenty times its text.
    """
    bit = {c: 1 << i for i, c in enumerate(categories)}
    left, right, strong = bit["left"], bit["right"], bit["exaggeration"]
    positive, negative, subjective = bit["positive"], bit["negative"], bit["subjective"]
    pairs = {t: m & (left | right) for t, m in masks.items() if " " in t and m & (left | right)}
    openers = {t.split(" ", 1)[0] for t in pairs}
    names = [*categories, "left_pairs", "right_pairs", "more_positive", "more_negative", "more_subjective", "loaded"]

    def count(row, plain) -> list[int]:
        n = dict.fromkeys(names, 0)
        before = None
        for token in row.split(" ") if row else []:
            mask = masks.get(token, 0)
            if mask:
                for c, b in bit.items():
                    if mask & b:
                        n[c] += 1
                if before is not None:
                    n["more_subjective"] += bool(mask & subjective)
                    if masks.get(before, 0) & strong:
                        n["more_positive"] += bool(mask & positive)
                        n["more_negative"] += bool(mask & negative and not mask & positive)
            if before in openers:
                both = pairs.get(f"{before} {token}", 0)
                n["left_pairs"] += bool(both & left)
                n["right_pairs"] += bool(both & right)
            before = token
        n["loaded"] = sum(w in loaded for w in plain.split(" ")) if plain else 0
        return list(n.values())

    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in columns:
            yield pd.DataFrame([count(t, w) for t, w in zip(*batch, strict=True)], columns=[prefix + c for c in names], dtype="int64")

    return F.pandas_udf(run, ", ".join(f"{prefix}{c} long" for c in names))(F.array_join(tokens, " "), F.array_join(words, " "))
