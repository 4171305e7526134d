"""Lexicon-based bias scoring of articles and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.functions import text as T
from claimweave.functions.automata import FOUND, found_terms, lexicon_counts, members_by_list, said_of_names
from claimweave.operators.entities import with_bias_entities
from claimweave.operators.features import _known, ratio
from claimweave.operators.lexical import (
    INLINE_PHRASES,
    contained,
    count_masked,
    count_where,
    in_list,
    inline_terms,
    phrase_masks,
    phrases_of,
    string_array,
    whole_word_occurrences,
    wide_lexicon,
    with_previous,
)
from claimweave.scale import contains_join, cut_lineage, lookup_join, settle

TOKEN_CATEGORIES = ["left", "right", "positive", "negative", "subjective", "exaggeration", "hedging", "conspiracy"]
MAX_NAMES = 5_000
PHRASE_CATEGORIES = ["left", "right", "conspiracy", "loaded"]


def source_leaning(docs: DataFrame, sources: DataFrame, source_col: str = "source") -> DataFrame:
    """Leaning and strength per distinct publisher.

    A publisher matches the first known name (by ``ord``) that contains it or that it
    contains; one that normalises to nothing is unknown.  Worked out once per
    distinct publisher, not per article.
    """
    names = docs.select(F.coalesce(F.col(source_col), F.lit("")).alias(source_col)).distinct()
    names = names.withColumn("_name", T.normalize_source(source_col)).filter(F.col("_name") != "")
    known = sources.select("leaning", F.lower("name").alias("name"), "ord")
    names, known = settle(names, MAX_NAMES)[0], settle(known, MAX_NAMES)[0]
    inside = contains_join(names, known, "_name", "name").select(source_col, "leaning", "ord")
    around = contains_join(known, names, "name", "_name").select(source_col, "leaning", "ord")
    first = inside.unionByName(around).groupBy(source_col).agg(F.min_by("leaning", "ord").alias("source_leaning"))
    strength = F.lit(0.0)
    for leaning, value in fixed.SOURCE_STRENGTH.items():
        strength = F.when(F.col("source_leaning") == leaning, F.lit(value)).otherwise(strength)
    return first.withColumn("source_strength", strength)


def with_source_leaning(
    df: DataFrame, leaning: DataFrame, source_col: str = "source", small: bool | None = None
) -> DataFrame:
    """Adds the leaning of each row's publisher; unlisted ones are unknown."""
    return lookup_join(df, leaning, [source_col], "left", small=small).withColumns(
        {
            "source_leaning": F.coalesce("source_leaning", F.lit("unknown")),
            "source_strength": F.coalesce("source_strength", F.lit(0.0)),
        }
    )


def _with_sentiments(df: DataFrame, lexicon: DataFrame, terms: list[tuple] | None, cased: str, full: str) -> DataFrame:
    """Adds ``_sentiments``: an array of (entity, sentiment) of each row, over the sentences that contain the entity.

    The entities' sentences are found in one pass over the text, and everything else is looked up by sentence number, so a row
    costs its text and its hits and nothing leaves it.  A lexicon of more terms than a plan takes is looked up in a set in each
    task; one too large to be settled (``terms`` None) goes through a join of the tokens, by a number given to the written rows.
    """
    found = with_bias_entities(df, F.col(cased))
    names = F.array_distinct(F.transform("bias_entities", lambda s: s["entity"]))
    found = found.withColumn("_names", names).drop("bias_entities")
    # no filter on the entities: it would be pushed to the scan and match every pattern a second time
    found = found.withColumn("_sentences", F.when(F.size("_names") > 0, T.sentences(full)).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("_said", F.transform("_sentences", lambda s: T.tokenize(s)))
    by = inline_terms(terms, ["positive", "negative"])
    if by is not None:
        p, n = (f"CAST(size(filter(t, w -> {in_list('w', by[c])})) AS BIGINT)" for c in ("positive", "negative"))
        found = found.withColumn("_pn", F.expr(f"transform(_said, t -> named_struct('p', {p}, 'n', {n}))"))
    elif terms is not None:
        found = found.withColumn("_pn", members_by_list(F.col("_said"), *[{t for c, t in terms if c == side} for side in ("positive", "negative")]))
    else:
        found = _sentence_counts_by_join(found, lexicon)
    lowered = F.transform("_names", lambda e: F.lower(e))
    found = found.withColumn("_held", said_of_names(F.col("_sentences"), F.col("_names"), lowered, F.col("_pn")))
    score = F.transform("_held", lambda e: F.struct(e["name"].alias("entity"), ratio(e["p"] - e["n"], e["p"] + e["n"]).alias("sentiment")))
    return found.withColumn("_sentiments", score).drop("_names", "_sentences", "_said", "_pn", "_held")


def _sentence_counts_by_join(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``_pn`` by a join of the tokens with the lexicon: for lexicons of any size."""
    found = cut_lineage(found.withColumn("_number", F.monotonically_increasing_id()))
    rows = found.select("_number", F.posexplode("_said").alias("_pos", "_tokens")).select("_number", "_pos", F.explode("_tokens").alias("tok"))
    hits = lookup_join(rows, wide_lexicon(lexicon, ["positive", "negative"], "tok"), ["tok"])
    per = hits.groupBy("_number", "_pos").agg(F.count_if("positive").alias("p"), F.count_if("negative").alias("n"))
    counted = per.groupBy("_number").agg(F.map_from_entries(F.collect_list(F.struct("_pos", F.struct("p", "n")))).alias("_by"))
    joined = found.join(counted, "_number", "left")
    zero = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    each = F.transform("_said", lambda t, i: F.coalesce(F.try_element_at(F.col("_by"), i), zero))
    return joined.withColumn("_pn", each).drop("_number", "_by")


def entity_sentiment(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", title_col: str = "title",
                     text_col: str = "text") -> DataFrame:
    """Sentiment of every entity of a row over the sentences that contain it."""
    lexicon, terms = settle(lexicon.select("category", "term"))
    cased = F.concat(T.text_of(title_col), F.lit(" "), T.text_of(text_col))
    full = F.concat(T.normalize_ws(title_col), F.lit(" "), T.normalize_ws(text_col))
    base = docs.select(id_col, cased.alias("_cased"), full.alias("_full"))
    found = _with_sentiments(base, lexicon, terms, "_cased", "_full")
    # the outer form: a filter on the array's size would look for the entities a second time
    return found.select(id_col, F.inline_outer("_sentiments")).filter(F.col("entity").isNotNull())


def entity_bias(sentiments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spread of the sentiments of at least two entities."""
    agg = sentiments.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_entities"), F.var_pop("sentiment").alias("_variance")
    )
    spread = F.least(F.lit(1.0), 2 * F.sqrt(F.greatest(F.col("_variance"), F.lit(0.0))))
    return agg.select(
        id_col, "n_entities", F.when(F.col("n_entities") >= 2, spread).otherwise(F.lit(0.0)).alias("entity_bias")
    )


def _spread(sentiments: Column) -> Column:
    """``entity_bias`` of one row's array of sentiments."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        delta = x - acc["mean"]
        mean = acc["mean"] + delta / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + delta * (x - mean)).alias("m2"))

    def close(acc: Column) -> Column:
        return F.when(acc["n"] >= 2, F.least(F.lit(1.0), 2 * F.sqrt(acc["m2"] / acc["n"]))).otherwise(F.lit(0.0))

    return F.aggregate(sentiments, zero, add, close)


def rescale_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if abs(total - 1.0) > 0.001:
        return {k: v / total for k, v in weights.items()}
    return dict(weights)


def bias_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the component columns with the two boosts, clamped to 0..1."""
    w = rescale_weights(weights or fixed.BIAS_WEIGHTS)
    score = (
        w["political_bias"] * F.col("political_bias")
        + w["subjectivity_score"] * F.col("subjectivity_score")
        + w["sentiment_score"] * F.abs(F.col("sentiment_score"))
        + w["exaggeration_score"] * F.col("exaggeration_score")
        + w["loaded_phrase_score"] * F.col("loaded_phrase_score")
        + w["clickbait_score"] * F.col("clickbait_score")
        + w["citation_density"] * (1 - F.col("citation_density"))
    )
    score = score * F.when(F.col("entity_bias") > 0.3, 1 + 0.2 * F.col("entity_bias")).otherwise(F.lit(1.0))
    score = score * F.when(F.col("conspiracy_score") > 0.3, 1 + 0.3 * F.col("conspiracy_score")).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def bias_indicators(source_col: str = "source") -> Column:
    """The messages that apply, in fixed order."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(
                (c("political_bias") > 0.2) & (c("political_leaning") != "center"),
                F.concat(F.lit("Shows "), c("political_leaning"), F.lit("-leaning political terms")),
            ),
            F.when(
                (c("source_leaning") != "unknown") & (c("source_strength") > 0.3),
                F.concat(
                    F.lit("Source ("), c(source_col), F.lit(") has known "), c("source_leaning"), F.lit("-leaning bias")
                ),
            ),
            F.when(c("sentiment_score") > 0.2, F.lit("Uses positive loaded language")).when(
                c("sentiment_score") < -0.2, F.lit("Uses negative loaded language")
            ),
            F.when(c("subjectivity_score") > 0.2, F.lit("Contains subjective language")),
            F.when(c("hedging_score") > 0.2, F.lit("Uses hedging language")),
            F.when(c("exaggeration_score") > 0.2, F.lit("Uses exaggerated language")),
            F.when(c("clickbait_score") > 0.2, F.lit("Contains clickbait language")),
            F.when(
                (c("citation_density") < 0.3) & (c("n_tokens") > 50), F.lit("Lacks sufficient citations or sources")
            ),
            F.when(
                (c("entity_bias") > 0.3) & (c("n_entities") >= 2),
                F.lit("Shows contrasting sentiment toward different entities"),
            ),
            F.when(c("loaded_phrase_score") > 0.2, F.lit("Uses loaded phrases")),
            F.when(c("conspiracy_score") > 0.2, F.lit("Contains conspiracy-related language")),
        )
    )


def _inline_phrases(terms: list[tuple] | None) -> dict[str, list[str]] | None:
    """Multi-word terms and clickbait phrases by category when there are few, else None."""
    if terms is None:
        return None
    wanted = {c: set() for c in [*PHRASE_CATEGORIES, "clickbait"]}
    for category, term in terms:
        if category in wanted and (category == "clickbait" or " " in term):
            wanted[category].add(term)
    if sum(len(v) for v in wanted.values()) > INLINE_PHRASES:
        return None
    return {c: sorted(v) for c, v in wanted.items()}


def _with_phrase_counts(base: DataFrame, lexicon: DataFrame, terms: list[tuple] | None, id_col: str) -> DataFrame:
    """Adds the counts of multi-word terms and of clickbait phrases."""
    full, title = F.col("_full"), F.col("_title")
    by = _inline_phrases(terms)
    if by is not None:
        bait_found = contained(full, by["clickbait"])
        loaded = F.aggregate(
            contained(full, by["loaded"]),
            F.lit(0).cast("long"),
            lambda acc, p: acc + whole_word_occurrences(full, p).cast("long"),
        )
        return base.withColumns(
            {
                "_left_phrases": F.size(contained(full, by["left"])).cast("long"),
                "_right_phrases": F.size(contained(full, by["right"])).cast("long"),
                "_conspiracy_phrases": F.size(contained(full, by["conspiracy"])).cast("long"),
                "_loaded_phrases": loaded,
                "_bait_title": F.size(F.filter(string_array(by["clickbait"]), lambda p: title.contains(p))).cast("long"),
                "_bait_body": F.size(F.filter(bait_found, lambda p: ~title.contains(p))).cast("long"),
            }
        )
    kinds = [*PHRASE_CATEGORIES, "clickbait"]
    if terms is not None:
        wanted = [(c, t) for c, t in terms if c == "clickbait" or (c in PHRASE_CATEGORIES and " " in t)]
        hits = base.withColumn("_hits", found_terms(full, phrase_masks(kinds, wanted)))
    else:
        hits = _phrases_by_join(base, lexicon, kinds)
    bit = kinds.index
    occurrences = F.aggregate(
        F.expr(f"filter(_hits, h -> (h.mask & {1 << bit('loaded')}) != 0)"),
        F.lit(0).cast("long"),
        lambda acc, h: acc + whole_word_occurrences(full, h["term"]).cast("long"),
    )
    return hits.withColumns(
        {f"_{c}_phrases": count_masked("_hits", bit(c)) for c in ("left", "right", "conspiracy")}
        | {
            "_loaded_phrases": occurrences,
            "_bait_title": count_masked("_hits", bit("clickbait"), "contains(_title, h.term)"),
            "_bait_body": count_masked("_hits", bit("clickbait"), "NOT contains(_title, h.term)"),
        }
    ).drop("_hits")


def _phrases_by_join(base: DataFrame, lexicon: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds ``_hits`` for a lexicon too large to be settled; ``base`` is written, so its ``_row`` stays what it is."""
    multi = phrases_of(lexicon, PHRASE_CATEGORIES)
    bait = lexicon.filter(F.col("category") == "clickbait").select("category", "term").distinct()
    bits = F.lit(0)
    for i, c in enumerate(kinds):
        bits = F.when(F.col("category") == c, 1 << i).otherwise(bits)
    masks = multi.unionByName(bait).groupBy("term").agg(F.bit_or(bits).cast("int").alias("mask"))
    found = contains_join(base.select("_row", "_full"), masks, "_full", "term")
    lists = found.groupBy("_row").agg(F.collect_list(F.struct("term", "mask")).alias("_hits"))
    return base.join(lists, "_row", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(FOUND)))


def _count_inline(base: DataFrame, by: dict[str, list[str]]) -> DataFrame:
    """Token hits per category inside each row: no shuffle at all.

    One pass cuts the tokens to those that matter to any category, the categories then look at few.  Only a token kept
    is paired with the one before it, and only one that ends a term of two words is joined with it for a look-up.
    """
    single = sorted(set().union(*[by[c] for c in TOKEN_CATEGORIES]))
    pair = {c: [t for t in by[c] if " " in t] for c in ("left", "right")}
    bigram, both = "concat(s.prev, ' ', s.tok)", sorted(set(pair["left"] + pair["right"]))
    ends = in_list("t", sorted({t.rsplit(" ", 1)[1] for t in both}))
    joined = in_list("concat(get(_tokens, i - 1), ' ', t)", both)
    matters = f"{in_list('t', single)} OR ({ends} AND {joined})"
    kept = f"transform(_tokens, (t, i) -> CASE WHEN {matters} THEN named_struct('tok', t, 'prev', get(_tokens, i - 1)) END)"
    loaded = in_list("w", sorted({t.lower() for t in by["loaded"] if " " not in t}))
    found = base.withColumn("_found", F.array_compact(F.expr(kept))).withColumn("_words", T.words("_full"))
    is_in = {c: in_list("s.tok", by[c]) for c in TOKEN_CATEGORIES}
    strong = in_list("s.prev", by["exaggeration"])
    conditions = {f"_{c}": is_in[c] for c in TOKEN_CATEGORIES} | {
        "_left_pairs": in_list(bigram, pair["left"]),
        "_right_pairs": in_list(bigram, pair["right"]),
        "_more_positive": f"{is_in['positive']} AND {strong}",
        "_more_negative": f"{is_in['negative']} AND NOT ({is_in['positive']}) AND {strong}",
        "_more_subjective": f"{is_in['subjective']} AND s.prev IS NOT NULL",
    }
    counts = {name: count_where("_found", "s", condition) for name, condition in conditions.items()}
    return found.withColumns(counts | {"_loaded": count_where("_words", "w", loaded)})


def _count_in_sets(base: DataFrame, terms: list[tuple]) -> DataFrame:
    """The same counts for a settled lexicon of more terms than a plan takes: looked up in each task, no token leaves its row."""
    masks: dict[str, int] = {}
    for c, term in terms:
        if c in TOKEN_CATEGORIES:
            masks[term] = masks.get(term, 0) | 1 << TOKEN_CATEGORIES.index(c)
    loaded = {term.lower() for c, term in terms if c == "loaded"}
    found = base.withColumn("_counts", lexicon_counts(F.col("_tokens"), T.words("_full"), TOKEN_CATEGORIES, masks, loaded))
    return found.select("*", "_counts.*").drop("_counts")


def _count_by_join(
    base: DataFrame, lexicon: DataFrame, small: bool | None, id_col: str, source_col: str, scalars: list[str]
) -> DataFrame:
    """The same counts for a lexicon of any size.

    Tokens and whitespace words are exploded once and looked up; only hits and one marker
    row per document are aggregated.
    """
    none = F.lit(None).cast("string")
    rows = F.concat(
        F.array(F.struct(F.lit("").alias("tok"), none.alias("prev"), F.lit("m").alias("kind"))),
        F.transform(
            with_previous(F.col("_tokens")), lambda s: F.struct(s["tok"].alias("tok"), s["prev"].alias("prev"), F.lit("t").alias("kind"))
        ),
        F.transform(T.words("_full"), lambda w: F.struct(w.alias("tok"), none.alias("prev"), F.lit("w").alias("kind"))),
    )
    tokens = base.select("_row", id_col, source_col, *scalars, F.inline(rows))
    loaded_terms = F.when(F.col("category") == "loaded", F.lower("term")).otherwise(F.col("term"))
    flags = wide_lexicon(lexicon.withColumn("term", loaded_terms), [*TOKEN_CATEGORIES, "loaded"], "tok")
    pairs = wide_lexicon(lexicon.filter(F.col("term").contains(" ")), ["left", "right"], "_bigram")
    pairs = pairs.withColumnsRenamed({"left": "_left_pair", "right": "_right_pair"})
    strong = lexicon.filter(F.col("category") == "exaggeration").select(F.col("term").alias("prev")).distinct()
    hit = lookup_join(tokens, flags, ["tok"], "left", small=small)
    hit = hit.withColumn("_bigram", F.concat_ws(" ", "prev", "tok"))
    hit = lookup_join(hit, pairs, ["_bigram"], "left", small=small)
    hit = lookup_join(hit, strong.withColumn("_strong", F.lit(True)), ["prev"], "left", small=small)
    hit = hit.filter(
        (F.col("kind") == "m") | F.col("left").isNotNull() | (F.col("prev").isNotNull() & F.col("_left_pair").isNotNull())
    )
    is_token = F.col("kind") == "t"
    has_prev = F.col("prev").isNotNull()
    boosted = is_token & F.coalesce("_strong", F.lit(False))

    def n(cond: Column) -> Column:
        return F.count_if(cond)

    # the source is a key, not a first(): a string in the buffer would turn this into a sort aggregate
    counted = hit.groupBy("_row", id_col, source_col).agg(
        *[F.first(c).alias(c) for c in scalars],
        *[n(is_token & F.col(c)).alias(f"_{c}") for c in TOKEN_CATEGORIES],
        n(has_prev & F.col("_left_pair")).alias("_left_pairs"),
        n(has_prev & F.col("_right_pair")).alias("_right_pairs"),
        n(boosted & F.col("positive")).alias("_more_positive"),
        n(boosted & F.col("negative") & ~F.col("positive")).alias("_more_negative"),
        n(is_token & has_prev & F.col("subjective")).alias("_more_subjective"),
        n((F.col("kind") == "w") & F.col("loaded")).alias("_loaded"),
    )
    return counted


def score_bias(
    docs: DataFrame,
    lexicon: DataFrame,
    sources: DataFrame,
    id_col: str = "doc_id",
    title_col: str = "title",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    citation_patterns: list[str] = fixed.CITATION_PATTERNS,
    with_entities: bool = True,
) -> DataFrame:
    """All bias components, the score and the indicators, one row per document.

    ``lexicon`` has (category, term), ``sources`` (leaning, name, ord).  A small lexicon
    is counted inside the rows, a large one by a join of the exploded tokens.  Terms of several words and entities are
    found in one pass over each row's text.  The documents are read once, beside the names of their publishers.
    """
    lexicon, terms = settle(lexicon.select("category", "term"))
    small = _known(terms)
    title, text = T.normalize_ws(title_col), T.normalize_ws(text_col)
    # rows that share an id are told apart by their position in the input
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        id_col,
        F.coalesce(F.col(source_col), F.lit("")).alias(source_col),
        title.alias("_title"),
        F.concat(title, F.lit(" "), text).alias("_full"),
        *([F.concat(T.text_of(title_col), F.lit(" "), T.text_of(text_col)).alias("_cased")] if with_entities else []),
    )
    if terms is None:
        base = cut_lineage(base)  # a number given twice to rows of an unwritten input need not be the same
    if with_entities:
        base = _with_sentiments(base, lexicon, terms, "_cased", "_full").drop("_cased")
        spread = {"n_entities": F.size("_sentiments").cast("long"), "entity_bias": _spread(F.col("_sentiments.sentiment"))}
        base = base.withColumns(spread).drop("_sentiments")
    else:
        base = base.withColumns({"n_entities": F.lit(0).cast("long"), "entity_bias": F.lit(0.0)})
    base = base.withColumn("_tokens", T.tokenize("_full")).withColumn("n_tokens", F.size("_tokens").cast("long"))
    cited = sum((T.occurrences(F.col("_full"), p) for p in citation_patterns), F.lit(0).cast("long"))
    base = _with_phrase_counts(base.withColumn("_citations", cited), lexicon, terms, id_col)
    scalars = [
        "n_tokens", "_citations", "_left_phrases", "_right_phrases", "_conspiracy_phrases",
        "_loaded_phrases", "_bait_title", "_bait_body", "n_entities", "entity_bias",
    ]
    by = inline_terms(terms, [*TOKEN_CATEGORIES, "loaded"])
    if by is not None:
        counted = _count_inline(base, by)
    elif terms is not None:
        counted = _count_in_sets(base, terms)
    else:
        counted = _count_by_join(base, lexicon, small, id_col, source_col, scalars)
    leaning, leaning_rows = settle(source_leaning(docs, sources, source_col))
    counted = with_source_leaning(counted, leaning, source_col, _known(leaning_rows))
    return _finish(counted, id_col, source_col, weights)


def _finish(counted: DataFrame, id_col: str, source_col: str, weights: dict[str, float] | None) -> DataFrame:
    c, one = F.col, F.lit(1.0)
    total = c("n_tokens")
    by_source = F.lit(int(fixed.SOURCE_STRENGTH["left"] * 5)).cast("long")
    left = c("_left") + 2 * c("_left_pairs") + 2 * c("_left_phrases")
    left = left + F.when(c("source_leaning") == "left", by_source).otherwise(F.lit(0))
    right = c("_right") + 2 * c("_right_pairs") + 2 * c("_right_phrases")
    right = right + F.when(c("source_leaning") == "right", by_source).otherwise(F.lit(0))
    out = counted.withColumns(
        {
            "left_count": left,
            "right_count": right,
            "positive_count": c("_positive") + c("_more_positive"),
            "negative_count": c("_negative") + c("_more_negative"),
        }
    )
    both = c("left_count") + c("right_count")
    share = c("left_count") / both
    signed = ratio(c("positive_count") - c("negative_count"), c("positive_count") + c("negative_count"))

    def scaled(count: Column, factor: int) -> Column:
        return F.least(one, ratio(count, total) * factor)

    out = out.withColumns(
        {
            "political_leaning": F.when(both == 0, "center")
            .when(share > 0.6, "left")
            .when(share < 0.4, "right")
            .otherwise("center"),
            "political_bias": scaled(both, 20),
            "sentiment_score": signed,
            "subjectivity_score": scaled(c("_subjective") + c("_more_subjective"), 20),
            "hedging_score": scaled(c("_hedging"), 25),
            "exaggeration_score": scaled(c("_exaggeration"), 25),
            "loaded_phrase_score": F.least(
                one, (c("_loaded") + 2 * c("_loaded_phrases")) / F.greatest(F.lit(5.0), total / 30)
            ),
            "clickbait_score": F.least(one, 0.3 * c("_bait_title") + 0.2 * c("_bait_body")),
            "citation_density": F.least(one, c("_citations") / F.greatest(one, total / 100)),
            "conspiracy_score": F.least(
                one, (c("_conspiracy") + 2 * c("_conspiracy_phrases")) / F.greatest(F.lit(10.0), total / 10)
            ),
        }
    )
    empty = total == 0
    out = out.withColumn("bias_score", F.when(empty, F.lit(0.0)).otherwise(bias_score(weights)))
    out = out.withColumn(
        "bias_indicators",
        F.when(empty, F.array().cast("array<string>")).otherwise(bias_indicators(source_col)),
    )
    return out.select(
        id_col, source_col, "n_tokens", "bias_score", "political_leaning", "political_bias", "left_count",
        "right_count", "subjectivity_score", "sentiment_score", "positive_count", "negative_count",
        "exaggeration_score", "hedging_score", "loaded_phrase_score", "clickbait_score", "citation_density",
        "entity_bias", "n_entities", "conspiracy_score", "source_leaning", "source_strength", "bias_indicators",
        F.when(empty, F.lit("No tokens found in text")).alias("error"),
    )
