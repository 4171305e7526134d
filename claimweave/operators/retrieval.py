"""Search terms of claims, candidate articles and their de-duplication."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.functions import text as T
from claimweave.operators.entities import capitalized_entities
from claimweave.operators.evidence import with_article_words
from claimweave.scale import cut_lineage, fits_broadcast, hot_key_join, written


WORD_SALTS = 16
#: Below the limit (1,000) up to which Spark cuts a window's rows before it moves them.
MAP_SIDE_MOST = 500
MAX_DAYS = 4_000


def content_words(c: Column | str, stopwords: list[str] = fixed.STOPWORDS) -> Column:
    """Lower-cased words that start with a letter a-z, have three or more characters and are no stopword."""
    found = T.find_all(F.lower(T.text_of(c)), T.WORD_PATTERN)
    return F.filter(found, lambda w: w.rlike("^[a-z]") & (F.length(w) > 2) & ~w.isin(stopwords))


def term_frequency(docs: DataFrame, sizes: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """The most common n-grams of content words per document.

    ``sizes`` maps n to how many are kept; ties go to the gram seen first.  The words of a document move
    once, to the partition of its id, and are counted there one id at a time: no gram is a row before it is among the most
    common, so nothing but the words is shuffled or spilled.  Rows that share an id, null included, are counted together.
    """
    words = F.array_join(content_words(text_col), " ").alias("_words")  # no word has a space
    prepared = docs.select(id_col, words).repartition(id_col).sortWithinPartitions(id_col)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return prepared.mapInArrow(partial(_most_common, sizes), f"`{id_col}` {kind}, n int, term string, freq long, first_pos int, rank int")


def _grams_of(words: list[str], n: int) -> Iterable[str]:
    return words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)), strict=False))


def _most_common(sizes: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, words) in order of id: the most common grams of each id, with their counts and first places."""
    names = ("n", "term", "freq", "first_pos", "rank")
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32())

    def top(texts: list[list[str]]) -> Iterator[tuple]:
        for n, k in sorted(sizes.items()):
            counts: Counter[str] = Counter()
            for words in texts:
                counts.update(_grams_of(words, n))
            if len(texts) == 1:
                # a counter keeps the order of first sight, and so do the most common among equals
                best = counts.most_common(k)
                at = _first_places(texts[0], n, {t for t, _ in best})
            else:
                at = {}
                for words in texts:
                    for t, i in _first_places(words, n, None).items():
                        at[t] = min(i, at.get(t, i))
                best = nsmallest(k, counts.items(), key=lambda x: (-x[1], at[x[0]]))
            yield from ((n, t, freq, at[t], rank) for rank, (t, freq) in enumerate(best, 1))

    def table(held: list[tuple]) -> pa.RecordBatch:
        ids = pa.array([i for i, _ in held], id_type)
        rows = list(zip(*(r for _, r in held), strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], [id_name, *names])

    id_name, id_type, now, texts, started, held = "", None, None, [], False, []
    for batch in batches:
        id_name, id_type = batch.schema.names[0], batch.schema.types[0]
        for i, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if started and i != now:
                held.extend((now, r) for r in top(texts))
                texts = []
            now, started = i, True
            texts.append(words.split(" ") if words else [])
        if len(held) > 10_000:
            yield table(held)
            held = []
    if started:
        held.extend((now, r) for r in top(texts))
        yield table(held)


def _first_places(words: list[str], n: int, wanted: set[str] | None) -> dict[str, int]:
    """The first place of the wanted grams, or of all."""
    at: dict[str, int] = {}
    for i, gram in enumerate(_grams_of(words, n)):
        if gram not in at and (wanted is None or gram in wanted):
            at[gram] = i
            if wanted is not None and len(at) == len(wanted):
                break
    return at


def key_terms(claims: DataFrame, id_col: str = "claim_id", text_col: str = "claim") -> DataFrame:
    """Key terms per claim: two trigrams, bigrams not inside one, then single words up to eight terms."""
    top = term_frequency(claims, {1: 15, 2: 4, 3: 2}, id_col, text_col)

    def ordered(n: int) -> Column:
        packed = F.collect_list(F.when(F.col("n") == n, F.struct("rank", "term")))
        return F.transform(F.array_sort(packed), lambda s: s["term"])

    lists = top.groupBy(id_col).agg(ordered(1).alias("_one"), ordered(2).alias("_two"), ordered(3).alias("_three"))

    def add(limit: int | None):
        def step(chosen: Column, term: Column) -> Column:
            skip = F.exists(chosen, lambda c: c.contains(term))
            if limit:
                skip = skip | (F.size(chosen) >= limit)
            return F.when(skip, chosen).otherwise(F.array_append(chosen, term))

        return step

    lists = lists.withColumn("_phrases", F.aggregate("_two", F.col("_three"), add(None)))
    lists = lists.withColumn("key_terms", F.aggregate("_one", F.col("_phrases"), add(8)))
    return lists.select(id_col, "key_terms")


def search_terms(entities: Column, terms: Column) -> Column:
    """Entities first, then terms not among them, five in all."""
    fresh = F.array_except(terms, entities)
    return F.slice(F.concat(entities, fresh), 1, 5)


def search_queries(claims: DataFrame, id_col: str = "claim_id", text_col: str = "claim") -> DataFrame:
    terms = key_terms(claims, id_col, text_col)
    out = claims.join(terms, id_col, "left")
    found = F.coalesce("key_terms", F.array().cast("array<string>"))
    return out.withColumn("search_query", F.array_join(search_terms(capitalized_entities(text_col), found), " "))


def offered_articles(articles: DataFrame) -> DataFrame:
    """Articles a feed would offer at any time: English and in an allowed category, per feed."""
    ok = F.col("lang") == "en"
    for feed, banned in fixed.FEED_EXCLUDED_CATEGORIES.items():
        allowed = F.coalesce(~F.col("category").isin(*banned), F.lit(True))
        ok = ok & ((F.col("source_api") != feed) | allowed)
    return articles.filter(ok)


def recent_articles(articles: DataFrame, asof: Column | str) -> DataFrame:
    """Articles not older than their feed allows."""
    asof = F.lit(asof) if isinstance(asof, str) else asof
    ok = F.lit(True)
    for feed, days in fixed.FEED_MAX_AGE_DAYS.items():
        recent = F.col("published_at") >= F.date_sub(F.to_date(asof), days).cast("timestamp")
        ok = ok & ((F.col("source_api") != feed) | recent)
    return articles.filter(ok)


def eligible_articles(articles: DataFrame, asof: Column | str) -> DataFrame:
    """Articles a feed would offer: English, recent and in an allowed category, per feed."""
    return recent_articles(offered_articles(articles), asof)


def article_postings(articles: DataFrame) -> DataFrame:
    """(word, source_api, published_at, article_id) for each distinct word of an article's title and text."""
    text = F.lower(F.concat_ws(" ", T.text_of("title"), T.text_of("text")))
    # the outer form keeps Spark from cutting each text a second time for a filter on the array's size
    word = F.explode_outer(F.array_distinct(T.find_all(text, T.WORD_PATTERN))).alias("word")
    rows = articles.select("article_id", "source_api", "published_at", word)
    return rows.select("word", "source_api", "published_at", "article_id")


def newest_postings(postings: DataFrame, most: int, words: DataFrame | None = None) -> DataFrame:
    """The newest ``most`` postings of each word and feed.

    Up to ``MAP_SIDE_MOST`` of them are found in each task before anything moves, so a word in most articles is a few rows a task.
    For more, which Spark doesn't limit there, the newest of each salt come first.  ``words`` names the words
    that are wanted: few of them (checked) are sent to the scan, many are left to the join that follows.
    """
    if words is not None and fits_broadcast(words):
        postings = postings.join(F.broadcast(words), "word", "left_semi")
    postings = postings.withColumn("_salt", F.pmod(F.xxhash64("article_id"), F.lit(WORD_SALTS))) if most > MAP_SIDE_MOST else postings
    for keys in (["word", "source_api", "_salt"], ["word", "source_api"]):
        if keys[-1] in postings.columns:
            newest = Window.partitionBy(*keys).orderBy(F.desc("published_at"), "article_id")
            postings = postings.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= most).drop("_rank")
    return postings.drop("_salt")


def _feed_limit(limits: dict[str, int], default: int) -> Column:
    limit = F.lit(default)
    for feed, k in limits.items():
        limit = F.when(F.col("source_api") == feed, F.lit(k)).otherwise(limit)
    return limit


def select_candidates(
    queries: DataFrame,
    articles: DataFrame,
    asof: Column | str,
    id_col: str = "claim_id",
    query_col: str = "search_query",
    limits: dict[str, int] = fixed.FEED_LIMITS,
    default_limit: int = fixed.OTHER_FEED_LIMIT,
    index=None,
) -> DataFrame:
    """Newest matching articles per claim and feed: (claim, article, source_api, published_at, feed_rank).

    ``limits`` says how many each feed offers, ``default_limit`` how many any other feed does (a null
    feed name is one such feed).

    An article matches when it has a word of the query.  The newest k articles that
    have any of the words are among the newest k of each single word, so the
    article lists are cut to k per (word, feed) before they meet the claims.  A
    word in a third of all articles therefore costs k rows per claim, not
    a third of the articles, and the result is exact.

    ``index`` (a ``sources.postings.PostingsIndex``) holds these lists already, and then no article is read.  Its lists are cut without
    a look at the date, which loses nothing: the newest come first, so the recent ones of the newest k are the newest k recent ones.
    """
    postings = _wanted_postings(queries, articles, asof, id_col, query_col, max(default_limit, *limits.values()), index)
    return _candidates_of(queries, postings, id_col, query_col, limits, default_limit)


def _query_words(queries: DataFrame, id_col: str, query_col: str) -> DataFrame:
    words = F.array_distinct(T.find_all(F.lower(F.col(query_col)), T.WORD_PATTERN))
    return queries.select(id_col, F.explode(words).alias("word"))


def _wanted_postings(
    queries: DataFrame, articles: DataFrame, asof: Column | str, id_col: str, query_col: str, most: int, index
) -> DataFrame:
    """The newest ``most`` postings of each word of the queries and each feed."""
    vocabulary = _query_words(queries, id_col, query_col).select("word").distinct()
    if index is None:
        return newest_postings(article_postings(eligible_articles(articles, asof)), most, vocabulary)
    if most > index.depth:
        raise ValueError(f"the index holds the newest {index.depth} articles of a word, not {most}")
    return newest_postings(recent_articles(index.postings(vocabulary), asof), most)


def _candidates_of(
    queries: DataFrame, postings: DataFrame, id_col: str, query_col: str, limits: dict[str, int], default_limit: int
) -> DataFrame:
    """The newest articles of each claim and feed among ``postings``."""
    most, limit = max(default_limit, *limits.values()), _feed_limit(limits, default_limit)
    pairs = hot_key_join(_query_words(queries, id_col, query_col), postings, "word").drop("word").distinct()
    order = Window.partitionBy(id_col, "source_api").orderBy(F.desc("published_at"), "article_id")
    ranked = pairs.withColumn("feed_rank", F.row_number().over(order)).filter(F.col("feed_rank") <= most)
    return ranked.filter(F.col("feed_rank") <= limit)


def _capped_candidates(
    queries: DataFrame, articles: DataFrame, asof: Column | str, id_col: str, query_col: str, cap_col: str
) -> DataFrame:
    """The rows of ``select_candidates`` that can be among the first ``cap_col`` of a claim once they are de-duplicated.

    Articles of the first feed come first and are never tested, so a claim with as many of them as the highest cap keeps
    just these; no other row of it is made.  All other claims get all their rows, with ``tested`` true.
    A candidate without an id has no article, so a claim with one among its first goes with the others.
    """
    limits, default, first = fixed.FEED_LIMITS, fixed.OTHER_FEED_LIMIT, fixed.FEED_ORDER[0]
    most = max(default, *limits.values())
    postings = _wanted_postings(queries, articles, asof, id_col, query_col, most, None)
    cap = queries.agg(F.max(cap_col)).first()[0] or 0
    if not 0 < cap <= limits.get(first, default):
        found = _candidates_of(queries, postings, id_col, query_col, limits, default)
        return found.withColumn("tested", F.lit(True))
    postings = written(postings)
    newest = Window.partitionBy("word").orderBy(F.desc("published_at"), "article_id")
    # rows of one article that comes twice have one rank
    of_first = postings.filter(F.col("source_api") == first).withColumn("_rank", F.dense_rank().over(newest))
    of_first = of_first.filter(F.col("_rank") <= cap).drop("_rank")
    found = written(_candidates_of(queries, of_first, id_col, query_col, {first: cap}, cap))
    full = found.groupBy(id_col).agg(F.count("article_id").alias("_n")).filter(F.col("_n") >= cap).select(id_col)
    full = written(full)
    rest = _candidates_of(queries.join(full, id_col, "left_anti"), postings, id_col, query_col, limits, default)
    found = found.join(full, id_col, "left_semi").withColumn("tested", F.lit(False))
    return found.unionByName(rest.withColumn("tested", F.lit(True)))


def feed_position() -> Column:
    position = F.lit(len(fixed.FEED_ORDER))
    for i, feed in enumerate(fixed.FEED_ORDER):
        position = F.when(F.col("source_api") == feed, F.lit(i)).otherwise(position)
    return position


def drop_known_urls(new: DataFrame, existing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """New articles whose non-empty URL is not among the existing ones.

    Articles without a URL have nothing to be known by: they pass beside the join.
    """
    on = [*(keys or []), "url"]
    has_url = F.coalesce("url", F.lit("")) != ""
    seen = existing.filter(has_url).select(*on).distinct()
    return new.filter(has_url).join(seen, on, "left_anti").select(*new.columns).unionByName(new.filter(~has_url))


def title_words(c: Column | str = "title") -> Column:
    """The distinct lower-cased words of a title."""
    return F.array_distinct(T.words(F.lower(T.text_of(c))))


def _near_copies(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct words above 0.8: 9 times the common words exceed 4 times both sizes.

    Sizes too far apart for it are told first, so most pairs are not compared word by word.
    """
    both = (F.size(a) + F.size(b)) * 4
    return (F.least(F.size(a), F.size(b)) * 9 > both) & (F.size(F.array_intersect(a, b)) * 9 > both)


def dedup_articles(evidence: DataFrame, id_col: str = "claim_id") -> DataFrame:
    """Greedy de-duplication of each claim's feed results, in feed order.

    An article goes when its URL is known or its title words overlap a kept title by
    more than 0.8 (Jaccard).  Articles of the first feed are never tested.  A
    claim has at most as many rows as the feed limits add up to (40), so the fold
    over its ordered array is small.  ``evidence`` needs article_id, source_api,
    feed_rank, url and title, or in its place ``title_words``, which a caller makes once an article.
    """
    words = F.col("title_words") if "title_words" in evidence.columns else title_words()
    slim = evidence.select(
        id_col,
        F.struct(
            feed_position().alias("feed"),
            F.col("feed_rank"),
            F.col("article_id"),
            F.coalesce("url", F.lit("")).alias("url"),
            words.alias("words"),
        ).alias("_a"),
    )
    grouped = slim.groupBy(id_col).agg(F.array_sort(F.collect_list("_a")).alias("_all"))

    def step(kept: Column, a: Column) -> Column:
        known = (a["url"] != "") & F.exists(kept, lambda k: k["url"] == a["url"])
        similar = F.exists(kept, lambda k: _near_copies(k["words"], a["words"]))
        return F.when((a["feed"] > 0) & (known | similar), kept).otherwise(F.array_append(kept, a))

    empty = F.slice(F.col("_all"), 1, 0)
    kept = grouped.select(id_col, F.aggregate("_all", empty, step).alias("_kept"))
    rows = kept.select(id_col, F.posexplode("_kept").alias("ord", "_a"))
    return rows.select(id_col, F.col("_a.article_id").alias("article_id"), F.col("ord").cast("long").alias("ord"))


def similar_titles(evidence: DataFrame, id_col: str = "claim_id", threshold: float = 0.8) -> DataFrame:
    """Pairs of a claim's feed results whose titles are near copies (at most 40 rows a claim)."""
    cols = [F.col("article_id"), F.array_distinct(T.words(F.lower(T.text_of("title")))).alias("words")]
    lists = evidence.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("_all"))
    rows = lists.select(id_col, F.explode("_all").alias("a"), "_all")
    rows = rows.select(id_col, "a", F.explode(F.filter("_all", lambda b: b["article_id"] > F.col("a.article_id"))).alias("b"))
    sim = T.jaccard_sets(F.col("a.words"), F.col("b.words"))
    return rows.select(
        id_col, F.col("a.article_id").alias("article_a"), F.col("b.article_id").alias("article_b"), sim.alias("similarity")
    ).filter(F.col("similarity") > threshold)


def wanted_articles(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The articles whose id occurs in ``wanted``.

    Their distinct ids are counted: up to the bound of a broadcast they are sent to the scan, so no other
    article's text is moved; more of them go through a shuffle.  Where both sides tell the day (``dt``) it is part of the key, and
    folders of other days are not read (a list of up to ``MAX_DAYS`` days goes to the scan, no list if there are more).
    """
    on = ["article_id", "dt"] if "dt" in wanted.columns and "dt" in articles.columns else ["article_id"]
    ids = cut_lineage(wanted.select(*on).distinct())
    if "dt" in on:
        days = [r[0] for r in ids.select("dt").distinct().limit(MAX_DAYS + 1).collect()]
        if len(days) <= MAX_DAYS:
            articles = articles.filter(F.col("dt").isin(days))
    return articles.join(F.broadcast(ids) if fits_broadcast(ids) else ids, on, "left_semi")


def gather_evidence(
    queries: DataFrame,
    articles: DataFrame,
    asof: Column | str,
    id_col: str = "claim_id",
    query_col: str = "search_query",
    cap_col: str | None = None,
    index=None,
    prepared: DataFrame | None = None,
) -> DataFrame:
    """Evidence per claim in feed order: (claim, ord, article_id, title, text, source, url, source_api).

    A claim without any hit gets one placeholder article with a null article_id.
    The candidates come out of a scan of all articles and are used several times, so they are
    written out once; they are four short columns and at most 40 rows per claim.  The same
    holds for the queries and the kept articles.  ``cap_col`` of the queries caps the articles of each
    claim before any text is fetched, and only articles somebody kept are moved to meet the claims; candidates beyond every
    cap are not made, and titles are compared only for claims whose first feed gives fewer articles than the cap.
    With an ``index`` of the articles the candidates come from its postings, and titles and texts from the days of its
    store that hold a wanted article; ``articles`` is not looked at then.
    ``prepared`` (``evidence.prepared_lists``) goes along with each claim's rows, beside what ``evidence.score_evidence``
    needs of an article: claims go to the articles then, so a text is cut into words and moved once, not once for each claim.
    """
    queries = cut_lineage(queries.select(id_col, query_col, *([cap_col] if cap_col else [])))
    day = []
    if cap_col and index is None:
        candidates = _capped_candidates(queries, articles, asof, id_col, query_col, cap_col)
    else:
        candidates = select_candidates(queries, articles, asof, id_col, query_col, index=index).withColumn("tested", F.lit(True))
    if index is not None:
        articles, day = index.articles(), ["dt"]
        # of an article stored on several days a claim takes the newest
        again = Window.partitionBy(id_col, "article_id").orderBy(F.desc("published_at"), "feed_rank")
        candidates = candidates.withColumn("_again", F.row_number().over(again)).filter("_again = 1").drop("_again")
        candidates = candidates.withColumn("dt", index.day("published_at"))
    candidates = cut_lineage(candidates)
    heads = wanted_articles(articles.select("article_id", title_words().alias("title_words"), "url", *day), candidates)
    headed = hot_key_join(candidates, heads, ["article_id", *day])
    # words go along only where an article of a later feed may have to be compared
    kept = dedup_articles(headed.withColumn("title_words", F.when(F.col("tested"), F.col("title_words"))), id_col)
    if index is not None:
        kept = kept.join(candidates.select(id_col, "article_id", "dt"), [id_col, "article_id"])
    if cap_col:
        kept = cap_evidence(kept.join(queries.select(id_col, cap_col), id_col), F.col(cap_col), id_col).drop(cap_col)
    kept = cut_lineage(kept)
    bodies = wanted_articles(articles.select("article_id", "title", "text", "source", "url", "source_api", *day), kept)
    found = kept
    if prepared is not None:
        found, bodies = kept.join(prepared, id_col, "left"), with_article_words(bodies, edges=True)
    found = hot_key_join(found, bodies, ["article_id", *day])
    columns = [id_col, "ord", "article_id", "title", "text", "source", "url", "source_api"]
    missing = queries.join(kept.select(id_col).distinct(), id_col, "left_anti")
    none = F.lit(None)
    placeholder = missing.select(
        id_col,
        F.lit(0).cast("long").alias("ord"),
        none.cast(dict(articles.dtypes)["article_id"]).alias("article_id"),
        F.concat(F.lit("Information about "), F.col(query_col)).alias("title"),
        F.concat(
            F.lit("This is a mock article generated because no real articles were found for the query: "),
            F.col(query_col),
        ).alias("text"),
        F.lit("System Generated").alias("source"),
        F.lit("").alias("url"),
        F.lit("mock").alias("source_api"),
    )
    if prepared is not None:
        placeholder = with_article_words(placeholder.join(prepared, id_col, "left"), edges=True)
        columns = placeholder.columns
    return found.select(*columns).unionByName(placeholder)


def cap_evidence(evidence: DataFrame, k: Column | int, id_col: str = "claim_id") -> DataFrame:
    """The first k articles per claim; ``k`` is a number or a column with each row's own."""
    order = Window.partitionBy(id_col).orderBy("ord")
    ranked = evidence.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")
