"""Values worked out by hand from the formulas."""

import pytest
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.operators import bias as B
from claimweave.operators import evidence as E
from claimweave.operators import features as FE
from claimweave.operators import knowledge as K
from claimweave.operators import retrieval as R
from claimweave.operators import sampling as S
from claimweave.operators import verdict as V
from claimweave.operators.entities import flat_entities, typed_entities, with_bias_entities
from claimweave.sources import lexicons


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("See http://a.b/c <b>Bold</b> text & more 123 times!", "See Bold text more times!"),
        ("a  b\n\nc", "a b c"),
        (None, ""),
    ],
)
def test_clean_markup(spark, text, want):
    assert one(spark, T.clean_markup("t"), t=text) == want


def test_contractions_apply_short_forms_first(spark):
    assert one(spark, T.expand_contractions("t"), t="I can't, they'll and Bob's") == "i ca not, they will and bob is"


def test_tokens_and_sentences(spark):
    assert one(spark, T.tokenize("t"), t="Pro-choice isn't 3.5, ok?") == ["pro-choice", "isn't", "3", ".", "5", ",", "ok", "?"]
    assert one(spark, T.sentences("t"), t="One. Two!  Three") == ["One.", "Two!", "Three"]
    assert one(spark, T.ngrams(T.words("t"), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, T.ngrams(T.words("t"), 2), t="a") == []


@pytest.mark.parametrize(
    ("source", "want"),
    [("https://www.cnn.com/a/b", "cnn"), ("WWW.News.BBC.co.uk", "bbc"), ("blog.x.org", "x"), ("Reuters", "reuters"), ("", "")],
)
def test_normalize_source(spark, source, want):
    assert one(spark, T.normalize_source("s"), s=source) == want


def test_truncate(spark):
    assert one(spark, T.truncate("t", 3), t="abcd") == "abc..."
    assert one(spark, T.truncate("t", 3), t="abc") == "abc"
    assert one(spark, T.truncate("t", 3, always=True), t="ab") == "ab..."


def test_jaccard_and_similarity(spark):
    assert one(spark, T.jaccard_words("a", "b"), a="A b c", b="b C d") == pytest.approx(0.5)
    assert one(spark, T.jaccard_words("a", "b"), a="", b="x") == 0.0
    assert one(spark, T.entities_similar("a", "b"), a="Barack Obama", b="Michelle Obama") is True
    assert one(spark, T.entities_similar("a", "b"), a="New York City", b="York Minster Abbey") is False


def test_default_lexicon_sizes(spark):
    sizes = {r["category"]: r["n_terms"] for r in lexicons.lexicon_stats(lexicons.default_lexicon(spark)).collect()}
    assert sizes == {
        "positive": 47, "negative": 47, "subjective": 44, "exaggeration": 51, "hedging": 38, "loaded": 40, "clickbait": 36,
        "left": 35, "right": 33,
    }


def scored(spark, title, text, source="", **kw):
    docs = spark.createDataFrame([(1, title, text, source)], "doc_id int, title string, text string, source string")
    sources = spark.createDataFrame([("left", "cnn", 0), ("right", "fox news", 1)], "leaning string, name string, ord long")
    return B.score_bias(docs, lexicons.default_lexicon(spark), sources, **kw).head()


def test_bias_counts_phrases_twice(spark):
    r = scored(spark, "", "the tax cuts and a liberal", "www.cnn.com")
    # two-word phrase: 2 as bigram, 2 as contained text; the other side: one token and 3 for the publisher
    assert (r["left_count"], r["right_count"]) == (4, 4)
    assert r["political_leaning"] == "center" and r["political_bias"] == 1.0
    assert r["bias_indicators"][0] == "Source (www.cnn.com) has known left-leaning bias"


def test_bias_sentiment_intensified(spark):
    r = scored(spark, "", "very good and bad")
    assert (r["positive_count"], r["negative_count"]) == (2, 1)
    assert r["sentiment_score"] == pytest.approx(1 / 3)


def test_bias_subjectivity_counts_non_first_twice(spark):
    r = scored(spark, "", "think " + "x " * 98 + "believe")
    assert r["subjectivity_score"] == pytest.approx(3 / 100 * 20)


def test_bias_without_tokens(spark):
    r = scored(spark, "", " ")
    assert r["bias_score"] == 0.0 and r["error"] == "No tokens found in text"


def test_bias_clickbait_title_and_body(spark):
    r = scored(spark, "The secret is out", "a shocking secret")
    assert r["clickbait_score"] == pytest.approx(0.5)


def test_bias_weights_are_rescaled():
    assert sum(B.rescale_weights({"a": 2.0, "b": 2.0}).values()) == pytest.approx(1.0)


def test_relevance_threshold_and_bands(spark):
    rows = [(1, 1, 0, "t", "s", 0.05), (1, 2, 1, "t", "s", 0.0500001), (1, 3, 2, "t", "s", 0.5), (1, 4, 3, "t", "s", 0.3), (1, 5, 4, "t", "BBC", 0.9)]
    df = spark.createDataFrame(rows, "claim_id int, article_id int, ord int, title string, source string, relevance double")
    p = E.evidence_profile(E.relevant_only(df)).head()
    assert (p["n_evidence"], p["n_high"], p["n_medium"], p["credible"]) == (4, 1, 2, True)


def facts(spark, evidence, claim="Apples are red fruits indeed"):
    claims = spark.createDataFrame([(1, claim)], "claim_id int, claim string")
    schema = "claim_id int, article_id int, ord int, title string, text string, source string"
    return E.check_facts(claims, E.score_evidence(claims, spark.createDataFrame(evidence, schema))).head()


def test_no_evidence_scores_point_four(spark):
    r = facts(spark, [])
    assert r["verification_score"] == pytest.approx(0.4)
    assert "No relevant evidence sources were found." in r["explanation"]


def test_one_weak_article(spark):
    assert facts(spark, [(1, 1, 0, "x", "apples grow", "s")])["verification_score"] == pytest.approx(0.45)


def test_contradiction_resets(spark):
    full = "Apples are red fruits indeed"
    r = facts(spark, [(1, 1, 0, "x", full + " confirm", "BBC"), (1, 2, 1, "x", full + " hoax", "s")])
    assert r["contradiction"] and r["verification_score"] == pytest.approx(0.5)


def test_strong_evidence_blends_with_one(spark):
    full = "Apples are red fruits indeed"
    r = facts(spark, [(1, i, i, "x", full, "BBC") for i in range(3)])
    assert r["verification_score"] == pytest.approx((0.5 + 0.3 + 0.1 + 1) / 2)
    assert r["explanation"].startswith("This claim is highly likely to be true. Found 3 relevant sources. Source 1: BBC (highly relevant).")


def test_key_terms_prefer_long_phrases(spark):
    claims = spark.createDataFrame([(1, "solar panels power solar panels power homes")], "claim_id int, claim string")
    terms = R.key_terms(claims).head()["key_terms"]
    assert terms[0] == "solar panels power" and "solar" not in terms and len(terms) <= 8


def test_greedy_dedup_keeps_first_and_third(spark):
    same = "one two three four five six seven eight nine"
    rows = [
        (1, 1, "newsapi", 1, same, "u1"), (1, 2, "newsapi", 2, same, "u1"),  # the first feed is never tested
        (1, 3, "gnews", 1, same + " ten", "u3"),  # 9/10 similar: dropped
        (1, 4, "gnews", 2, "a b c d e f g h i", "u4"), (1, 5, "gnews", 3, "a b c d e f g h i j", "u5"),  # similar to 4
        (1, 6, "mediastack", 1, "b c d e f g h i j", "u6"),  # similar to 5 only, which is gone
        (1, 7, "mediastack", 2, "other", "u4"), (1, 8, "mediastack", 3, "", ""), (1, 9, "mediastack", 4, "", ""),
    ]
    df = spark.createDataFrame(rows, "claim_id int, article_id int, source_api string, feed_rank int, title string, url string")
    assert [r["article_id"] for r in R.dedup_articles(df).orderBy("ord").collect()] == [1, 2, 4, 6, 8, 9]


def test_jaccard_of_exactly_point_eight_is_kept(spark):
    rows = [(1, 1, "gnews", 1, "a b c d", "u1"), (1, 2, "gnews", 2, "a b c d e", "u2")]
    df = spark.createDataFrame(rows, "claim_id int, article_id int, source_api string, feed_rank int, title string, url string")
    assert R.dedup_articles(df).count() == 2


def test_typed_entities_keep_first_group(spark):
    text = "We saw Dr. Smith of Kansas City met John Brown in March 5, 2020 at NASA. They saw Acme Corporation"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    r = typed_entities(df).withColumn("flat", flat_entities()).head()
    assert r["PERSON"] == ["Kansas City", "John Brown", "Acme Corporation", "Dr. Smith"]
    assert r["ORG"] == ["Corporation", "NASA"] and r["GPE"] == ["City"] and r["DATE"] == ["March", "2020"]
    assert r["flat"][0] == "Kansas City"


def test_bias_entities_and_boundaries(spark):
    df = spark.createDataFrame([("Ann Lee sued Acme Inc. in Russia",)], "t string")
    found = with_bias_entities(df, F.col("t")).head()["bias_entities"]
    assert [(e["etype"], e["entity"]) for e in found] == [("PERSON", "Ann Lee"), ("PERSON", "Acme Inc"), ("ORG", "Acme Inc"), ("GPE", "Russia")]


def test_plausible_relation(spark):
    def check(s, p, o):
        return one(spark, K.plausible_relation("s", "p", "o"), s=s, p=p, o=o)

    assert check("President Smith", "involves", "vote count") is True
    assert check("covid rules", "About", "public health") is True
    assert check("covid rules", "located in", "public health") is False
    assert check("Red Cross", "mentions", "Blue Moon") is False


def test_entity_pairs_order(spark):
    df = spark.createDataFrame([(1, ["A", "B", "C", "D"]), (2, ["A", "B"]), (3, ["A"])], "claim_id int, entities array<string>")
    rows = [tuple(r) for r in K.entity_pairs(df).orderBy("claim_id", "attempt").collect()]
    assert [r[2:] for r in rows if r[0] == 1][:3] == [("A", "related to", "B"), ("A", "involves", "B"), ("A", "related to", "C")]
    assert len([r for r in rows if r[0] == 2]) == 2 and not [r for r in rows if r[0] == 3]


@pytest.mark.parametrize(("v", "b", "want"), [(0.75, 0.0, "true"), (0.55, 0.0, "mostly true"), (0.35, 0.0, "partially true"), (0.15, 0.0, "mostly false"), (0.1, 1.0, "false")])
def test_rule_verdict_bands(spark, v, b, want):
    df = spark.createDataFrame([(v, b)], "verification_score double, bias_score double")
    assert V.rule_verdict(df).head()["verdict"] == want


def parsed(spark, response):
    df = spark.createDataFrame([(1, "c", response)], "claim_id int, claim string, response string")
    return V.parse_responses(df).head()


def test_parse_json_answer(spark):
    r = parsed(spark, 'ok ```json\n{"verdict": "mostly TRUE", "trust_score": 1.7, "explanation": "e", "contributing_factors": ["f"]}\n``` bye')
    assert (r["verdict"], r["trust_score"], r["decision_explanation"], r["contributing_factors"]) == ("mostly true", 1.0, "e", ["f"])


def test_parse_broken_json_and_one_fence(spark):
    assert parsed(spark, '```json\n{"verdict": "TRUE"}\n```')["contributing_factors"] == ["Insufficient evidence", "Processing error"]
    r = parsed(spark, '```json\n{"verdict": "TRUE"')
    assert r["verdict"] == "unverified" and r["decision_explanation"] == "Could not determine explanation from LLM response."


def test_parse_headings(spark):
    r = parsed(spark, "VERDICT: Mostly False\nTRUST_SCORE: 0.25\nEXPLANATION: why\nCONTRIBUTING_FACTORS:\n- one\n* two")
    assert (r["verdict"], r["trust_score"], r["decision_explanation"], r["contributing_factors"]) == ("mostly false", 0.25, "why", ["one", "two"])


def test_labels(spark):
    rows = [("liar", "barely-true"), ("liar", "half-true"), ("isot", "barely-true"), ("isot", "real"), ("x", "what")]
    df = spark.createDataFrame(rows, "dataset_source string, label string")
    assert [r["binary_label"] for r in S.standardize_labels(df).collect()] == [0, 1, 0, 1, 1]


def test_split_is_complete_and_disjoint(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), (F.col("id") % 4 == 0).cast("int").alias("binary_label"))
    out = S.stratified_split(df)
    counts = {(r["binary_label"], r["split"]): r["count"] for r in out.groupBy("binary_label", "split").count().collect()}
    assert out.count() == 200 and counts[(0, "train")] == 105 and counts[(1, "train")] == 35 and counts[(1, "val")] == 7


def test_augment_at_ten_and_eleven_words(spark):
    df = spark.createDataFrame([("a", " ".join("w" * 10)), ("b", " ".join("abcdefghijk"))], "id string, text string")
    copies = S.augment_minority(df).filter("augmented").collect()
    assert [r["id"] for r in copies] == ["b"] and len(copies[0]["text"].split()) == 10


def test_oversample_with_noise_is_repeatable(spark):
    rows = [(str(i), 1, [1.0, 2.0]) for i in range(6)] + [("m", 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, binary_label int, v array<double>")
    a, b = (S.oversample_minority(df, vector_cols=["v"], noise=0.01).filter("oversampled").collect() for _ in range(2))
    assert len(a) == 5 and sorted(map(str, a)) == sorted(map(str, b))
    assert all(r["binary_label"] == 0 and 0 < abs(r["v"][0]) < 0.1 for r in a)


def test_fill_nan(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("nan"), None]), (None, None)], "x double, v array<double>")
    out = FE.fill_nan(df, ["x"], ["v"]).collect()
    assert out[0]["x"] == 0.0 and out[0]["v"] == [1.0, 0.0, 0.0] and out[1]["x"] == 0.0
