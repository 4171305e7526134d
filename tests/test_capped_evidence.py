"""Claims with enough articles of the first feed have no other rows made, and titles go along only where they are compared."""

from datetime import datetime

from pyspark.sql import functions as F

from claimweave.operators import evidence as E
from claimweave.operators import retrieval as R

ASOF = "2024-02-15"
SCHEMA = "article_id long, title string, text string, source string, url string, source_api string, published_at timestamp, lang string, category string"


def articles(spark):
    """Word a is in many articles of all feeds, b in two of the first feed and near copies of the others, c in none of the first; one article comes twice, some have no id."""
    rows = []
    for i in range(60):
        feed = ["newsapi", "gnews", "mediastack", "other"][i % 4]
        rows.append((i, f"a title {i // 8} of many", "some text", feed))
    for i in range(60, 68):
        rows.append((i, f"b b1 b2 b3 b4 b5 b6 b7 b8 b9 {i // 3}", "b", "newsapi" if i < 62 else "gnews"))
    rows += [(i, f"c story {i}", "c", ["gnews", "mediastack"][i % 2]) for i in range(68, 75)]
    rows += [(56, "a title again", "a", "newsapi"), (56, "a title again", "a", "newsapi"), *[(None, "d a lost one", "d", "newsapi")] * 2]
    rows += [(i, f"d kept {i}", "d", "newsapi") for i in range(80, 86)]
    made = [(i, t, x, "src", f"http://s/{(i or 0) % 9}" if (i or 0) % 5 else "", f, datetime(2024, 2, 1 + (i or 0) % 13), "en", "business") for i, t, x, f in rows]
    return spark.createDataFrame(made, SCHEMA)


def queries(spark):
    given = [(1, "a", 5), (2, "b", 5), (3, "c", 5), (4, "a b c", 3), (5, "zzz", 5), (6, "d", 5), (7, "many", 5), (7, "story", 2), (8, None, 5), (None, "a", 5)]
    return spark.createDataFrame(given, "claim_id long, search_query string, article_cap int")


def test_the_cap_changes_no_row(spark):
    asked, stored = queries(spark), articles(spark)
    kept = R.gather_evidence(asked, stored, ASOF, cap_col="article_cap")
    # all candidates with all titles, capped at the end
    found = R.select_candidates(asked, stored, ASOF).join(stored.select("article_id", "title", "url"), "article_id")
    want = R.dedup_articles(found).join(asked.select("claim_id", "article_cap"), "claim_id")
    want = R.cap_evidence(want, F.col("article_cap")).join(stored.select("article_id", "title"), "article_id")
    columns = ["claim_id", "article_id", "ord", "title"]
    got = kept.filter("source_api <> 'mock'").select(*columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*columns).collect()))
    assert {r[0] for r in got.select("claim_id").collect()} == {1, 2, 3, 4, 6, 7}
    assert {r[0] for r in kept.filter("source_api = 'mock'").select("claim_id").collect()} == {5, 8, None}


def test_only_rows_within_reach_of_the_cap_are_made(spark):
    asked, stored = queries(spark).filter("claim_id IN (1, 3)"), articles(spark)
    made = R._capped_candidates(asked, stored, ASOF, "claim_id", "search_query", "article_cap").collect()
    assert sorted((r["feed_rank"], r["source_api"], r["tested"]) for r in made if r["claim_id"] == 1) == [(i, "newsapi", False) for i in range(1, 6)]
    assert len([r for r in made if r["claim_id"] == 3 and r["tested"]]) == 7
    assert len(made) < R.select_candidates(asked, stored, ASOF).count()


def test_packed_claims_are_unpacked_as_they_were(spark):
    texts = ["The U.S. said: it isn't so! A b cd ef. Gh ij kl mn op", "", None, "x", "\u0130stanbul \u039f\u0394\u039f\u03a3 \u039f\u03a3. a  b\tc \u00a0 d'e-f", ". . !", "one two. one two."]
    claims = spark.createDataFrame(list(enumerate(texts)), "claim_id int, claim string")
    plain = E.prepare_claims(claims)
    packed = E.unpacked(E.prepared_lists(claims).select("claim_id", F.inline("prepared")))
    rows = [sorted((r["claim_id"], r["claim_tokens"], sorted(r["phrases"])) for r in df.collect()) for df in (plain, packed)]
    assert rows[0] == rows[1]


def test_flags_follow_the_terms_asked_for(spark):
    stored, claims = articles(spark).filter("article_id < 4"), spark.createDataFrame([(1, "a title")], "claim_id long, claim string")
    asked = spark.createDataFrame([(1, "a title")], "claim_id long, search_query string")
    gathered = R.gather_evidence(asked, stored, ASOF, prepared=E.prepared_lists(claims))
    plain = R.gather_evidence(asked, stored, ASOF)
    for terms in ({}, {"confirming": ["some text"], "denying": ["title"]}):
        got, want = (sorted(map(repr, E.score_evidence(claims, x, **terms).collect())) for x in (gathered, plain))
        assert got == want
    assert "confirms=True, denies=True" in got[0]


def test_pairs_a_text_cannot_hold_are_left_out_and_no_other(spark):
    claims = spark.createDataFrame([(1, "art in of gold is x fine here")], "claim_id int, claim string")
    texts = [("smart init", ["art in"]), ("art\tin part in", ["art in"]), ("artin of golden", ["in of", "of gold"]), ("", []), ("zart iz", []), ("gold  is", [])]
    stored = spark.createDataFrame([(t, "", want) for t, want in texts], "title string, text string, want array<string>")
    met = E.with_article_words(stored, edges=True).crossJoin(E.prepared_lists(claims).select(F.inline("prepared")))
    for r in E.unpacked(met).collect():
        held = [p for p in r["phrases"] if p in r["full_text"]]
        assert held == r["want"] and len(r["phrases"]) <= len(held) + 2, r
