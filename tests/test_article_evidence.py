"""Claims that go to their articles are scored like articles that go to their claims, and titles are cut into words once an article."""

from datetime import datetime

from pyspark.sql import functions as F

from claimweave.operators import evidence as E
from claimweave.operators import retrieval as R

ARTICLES = [
    (1, "Storm hits the coast", "A storm hit the coast. Officials confirm it.", "src1", "http://a/1"),
    (2, "Storm hits the coast", "The storm was a hoax, some say. A storm hit nobody.", "src2", "http://a/2"),
    (3, "Harvest is good", "The harvest in the north is good this year.", None, ""),
]


def inputs(spark):
    rows = [(i, t, x, s, u, "gnews", datetime(2024, 2, 1 + i), "en", "general") for i, t, x, s, u in ARTICLES]
    articles = spark.createDataFrame(rows, "article_id long, title string, text string, source string, url string, source_api string, published_at timestamp, lang string, category string")
    # one id twice, one null, one that finds nothing
    given = [(1, "A storm hit the coast. Officials confirm it."), (1, "Nobody was hit by the storm"), (2, "Harvest is good"), (3, "zzz"), (None, "storm")]
    return articles, spark.createDataFrame(given, "claim_id long, claim string")


def test_scores_are_the_same_when_claims_go_to_their_articles(spark):
    articles, claims = inputs(spark)
    queries = claims.groupBy("claim_id").agg(F.lower(F.concat_ws(" ", F.sort_array(F.collect_list("claim")))).alias("search_query"))
    plain = E.score_evidence(claims, R.gather_evidence(queries, articles, "2024-02-15"))
    gathered = R.gather_evidence(queries, articles, "2024-02-15", prepared=E.prepared_lists(claims))
    found = E.score_evidence(claims, gathered)
    assert found.columns == plain.columns
    rows = sorted(map(repr, plain.collect()))
    assert rows == sorted(map(repr, found.collect())) and len(rows) > 4
    # a row of evidence stays one row, however many claims have its id
    assert gathered.count() == R.gather_evidence(queries, articles, "2024-02-15").count()


def test_titles_cut_beforehand_are_deduplicated_alike(spark):
    words = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h i", "x", "", None, "X x"]
    rows = [(1, n, "gnews", n, "", t) for n, t in enumerate(words)]
    df = spark.createDataFrame(rows, "claim_id int, article_id int, source_api string, feed_rank int, url string, title string")
    cut = df.withColumn("title_words", R.title_words()).drop("title")
    assert sorted(R.dedup_articles(cut).collect()) == sorted(R.dedup_articles(df).collect())
    assert [r["article_id"] for r in R.dedup_articles(cut).orderBy("ord").collect()] == [0, 3, 4, 5]


def test_phrases_beyond_five_add_nothing(spark):
    df = spark.createDataFrame([("a b c d e f g", ["a b", "b c", "x", "c d", "d e", "e f", "f g"]), ("a b", ["a b", "x"])], "full_text string, phrases array<string>")
    assert [r[0] for r in df.select(E.phrase_match()).collect()] == [1.0, 0.2]
