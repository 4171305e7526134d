"""File sources and sinks on small invented files."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as fixed
from claimweave.plans import training as TR
from claimweave.plans import verify as P
from claimweave.sources import corpora, lexicons, pages, store


def test_read_liar(spark, tmp_path):
    row = "1\tfalse\tA claim\ttaxes\tbob\tjob\ttx\t\t1\t2\t3\t4\t0\ta speech\n"
    for name in ("train", "valid", "test"):
        (tmp_path / f"{name}.tsv").write_text(row)
    df = corpora.read_liar(spark, str(tmp_path))
    r = df.head()
    assert df.count() == 3 and df.columns == corpora.CORPUS_COLUMNS
    assert (r["text"], r["source"], r["context_info"], r["political_affiliation"]) == ("A claim", "bob", "a speech", "")
    assert r["source_credibility"] == pytest.approx(7 / 10)


def test_read_isot(spark, tmp_path):
    (tmp_path / "Fake.csv").write_text('title,text,subject\n"T, one","multi\nline",news\n')
    (tmp_path / "True.csv").write_text("title,text,subject\nT2,text two,\n")
    df = corpora.read_isot(spark, str(tmp_path))
    got = {r["title"]: (r["label"], r["text"], r["source"]) for r in df.collect()}
    assert got == {"T, one": ("fake", "multi\nline", "news"), "T2": ("real", "text two", "")}


def test_read_mpqa(spark, tmp_path):
    lines = ["# note", "", "type=weaksubj len=1 word1=Fine pos1=adj stemmed1=n priorpolarity=positive",
             "type=strongsubj len=1 word1=mixed priorpolarity=both word1=mixed", "type=weaksubj word1=flat priorpolarity=neutral", "word1=x type=weaksubj"]
    (tmp_path / "clues.tff").write_text("\n".join(lines))
    got = {tuple(r) for r in lexicons.read_mpqa(spark, str(tmp_path / "clues.tff")).collect()}
    assert got == {("subjective", "fine"), ("positive", "fine"), ("subjective", "mixed"), ("positive", "mixed"), ("negative", "mixed"), ("subjective", "flat")}


def test_read_lexicon_json(spark, tmp_path):
    body = {"political_terms": {"left": ["a b"], "right": ["c"]}, "media_bias_sources": {"left_leaning": ["cnn"], "center": ["ap", "bbc"]}, "hedging_words": ["may"]}
    (tmp_path / "l.json").write_text(json.dumps(body))
    lexicon, sources = lexicons.read_lexicon_json(spark, str(tmp_path / "l.json"))
    assert {tuple(r) for r in lexicon.collect()} == {("left", "a b"), ("right", "c"), ("hedging", "may")}
    assert [r["name"] for r in sources.orderBy("ord").collect()] == ["cnn", "ap", "bbc"]


def test_lexicon_json_with_plain_list(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"political_terms": ["progressive taxes", "tax cuts now", "zebra"]}))
    lexicon, _ = lexicons.read_lexicon_json(spark, str(tmp_path / "l.json"), lexicons.default_lexicon(spark))
    assert {tuple(r) for r in lexicon.collect()} == {("left", "progressive taxes"), ("right", "tax cuts now")}


def test_read_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 1200)
    r = corpora.read_text_documents(spark, str(tmp_path / "a.txt"), "My claim").head()
    assert r["content"].startswith("My claim\nxxx") and len(r["preview"]) == 1003 and r["preview"].endswith("...")


def test_search_links(spark):
    html = '<a href="/url?q=http://a.org/x&sa=U">1</a><a href="/url?q=http://a.org/x&b">2</a><a href="/url?q=http://google.com">3</a><a href="/other">4</a>'
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r["link"] for r in pages.extract_links(df).collect()] == ["http://a.org/x"]


CORPUS = [(str(i), f"Title {i % 3}", ("good " if i % 2 else "bad ") + "words about topic number here and there again " * 3, "real" if i % 2 else "fake") for i in range(60)]


@pytest.fixture(scope="module")
def training_set(spark):
    df = spark.createDataFrame(CORPUS, "id string, title string, text string, label string")
    df = df.filter("id not in ('0', '2', '4')")
    df = df.withColumns({"source": F.lit("s"), "context_info": F.lit(""), "subject": F.lit(""), "dataset_source": F.lit("isot"),
                         "source_credibility": F.lit(0.5), "political_affiliation": F.lit("")})
    return TR.build_training_set(df, lexicons.training_lexicon(spark), max_df=1.0)


def test_training_pipeline_and_store(spark, training_set, tmp_path):
    ts, path = training_set, str(tmp_path / "store")
    store.write_feature_store(ts.features, ts.tfidf, path, ts.rows.select("id", "title", "split"))
    back = store.read_feature_store(spark, path, "train")
    assert set(back) == {"features", "tfidf", "metadata"} and back["features"].count() > 30
    report = store.validate_feature_store(ts.features, ts.tfidf).collect()
    assert all(r["matching"] for r in report) and {r["split"] for r in report} == {"train", "val", "test"}
    have, missing = store.present_features(ts.features)
    assert len(have) == 16 and not missing
    labels = ts.oversampled.groupBy("binary_label").count().collect()
    assert labels[0]["count"] == labels[1]["count"]


def test_classifier_beats_chance_and_scores_claims(spark, training_set, tmp_path):
    ts = training_set
    vectors = TR.vectorizer(ts.vocabulary)
    rows = ts.features.join(ts.rows.select("id", "combined_text"), "id").withColumn("emb", F.array(F.lit(0.1), F.lit(float("nan"))))
    for embedding in (None, "emb"):
        data = TR.assemble(rows, vectors, embedding_col=embedding).cache()
        model, history = TR.train_classifier(data, "m", penalties=(0.1, 0.01), max_iter=10)
        assert history.count() == 2
        preds = TR.predictions(data.filter("split = 'test'"), model, "m")
        assert TR.M.auc(preds).head()["auc"] > 0.9
        store.write_model_comparison(TR.M.compare_models(preds), str(tmp_path / f"cmp{embedding}"))
        assert spark.read.csv(str(tmp_path / f"cmp{embedding}"), header=True).count() == 5
    model, _ = TR.train_classifier(TR.assemble(rows, vectors), penalties=(0.1,), max_iter=10)
    texts = spark.createDataFrame([(1, "good words about topic"), (2, "bad words about topic")], "claim_id int, model_text string")
    p = {r["claim_id"]: r["probability"] for r in TR.score_claims(texts, vectors, model).collect()}
    assert set(p) == {1, 2} and all(0.0 <= x <= 1.0 for x in p.values())


def small_tables(spark):
    articles = spark.createDataFrame(
        [(1, "Solar panels power many homes", "Solar panels power homes in Spain today.", "en", "BBC", "http://b/1", "2024-02-10", "newsapi", "health"),
         (2, "Cooking", "How to cook pasta.", "en", "s", "http://b/2", "2024-02-11", "gnews", "health"),
         (3, "Solar", "Solar panels are fake", "fr", "s", "http://b/3", "2024-02-11", "gnews", "health")],
        "article_id long, title string, text string, lang string, source string, url string, published_at string, source_api string, category string",
    ).withColumn("published_at", F.to_timestamp("published_at"))
    return P.Tables(articles, lexicons.default_lexicon(spark), lexicons.no_sources(spark), "2024-02-15")


CLAIMS = [(1, "Solar panels power homes", "x"), (2, "Quantum zebra flies", "x"), (3, "   ", "x"), (4, "y" * 1001, "x")]


def test_verify_claims_end_to_end(spark, tmp_path):
    claims = spark.createDataFrame(CLAIMS, "claim_id long, claim string, source string")
    out = P.verify_claims(claims, small_tables(spark)).cache()
    r = {x["claim_id"]: x for x in out.collect()}
    assert r[1]["n_articles"] == 1 and r[1]["verdict"] == "mostly true" and r[1]["retrieval_status"] == "complete"
    assert r[2]["retrieval_status"] == "placeholder" and r[2]["verdict"] is not None
    assert r[3]["reject_reason"] == "empty" and r[4]["reject_reason"] == "too long" and r[4]["verdict"] is None
    good = out.filter("reject_reason is null")
    store.write_verifications(good, str(tmp_path / "v"))
    back = spark.read.json(str(tmp_path / "v"))
    assert back.count() == 2 and {"decision", "bias_analysis", "evidence", "configuration", "dt"} <= set(back.columns)
    store.write_reports(good, str(tmp_path / "r"))
    assert "VERDICT: mostly true" in "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "r")).collect())


def test_registered_step_replaces_a_step(spark, monkeypatch):
    monkeypatch.setattr(P, "STEPS", {})
    P.register_step("decide", lambda df, tables: P.decide(df, tables).withColumn("verdict", F.lit("mine")))
    claims = spark.createDataFrame(CLAIMS[:1], "claim_id long, claim string, source string")
    assert P.verify_claims(claims, small_tables(spark)).head()["verdict"] == "mine"
    doubled = P.map_model(spark.range(3), lambda it: (p.assign(id=p["id"] * 2) for p in it), "id long")
    assert sorted(r["id"] for r in doubled.collect()) == [0, 2, 4]


def test_knowledge_step(spark):
    tables = small_tables(spark)
    tables.entities = spark.createDataFrame([("Ann Lee", "wikidata", "d", ["x"])], "entity string, src string, description string, aliases array<string>")
    tables.attributes = spark.createDataFrame([], "entity string, src string, attr string, vals array<string>, is_list boolean, ord int")
    tables.triples = spark.createDataFrame([("Ann Lee", "knows", "Bob Ray")], "s string, p string, o string")
    claims = spark.createDataFrame([(1, "Ann Lee met Bob Ray", "x")], "claim_id long, claim string, source string")
    r = P.verify_claims(claims, tables).head()
    assert r["kg_verification"] and r["kg_score"] == pytest.approx(0.7) and "Confirmed: Ann Lee related to Bob Ray." in r["explanation"]
    assert not P.verify_claims(claims, tables, "fast").head()["kg_verification"]


def test_copies_of_an_article_get_ids_of_their_own(spark):
    raw = spark.createDataFrame([("t", "same text", "fake")] * 30 + [("u", "other", "real")] * 2, "title string, text string, label string")
    ids = [r["id"] for r in corpora.isot_corpus(raw).select("id").collect()]
    assert len(set(ids)) == 32 and len({i.split("-")[0] for i in ids}) == 2
    df = corpora.isot_corpus(raw.unionByName(raw))
    built = TR.build_training_set(df, lexicons.training_lexicon(spark), min_df=1, max_df=1.0)
    assert built.tfidf.select("id").distinct().count() == built.rows.count() == 64
    assert built.rows.groupBy("id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0


def test_the_whole_vocabulary_takes_part(spark):
    rows = [(f"term{i:05d}", 5, 5, 100) for i in range(6000)]
    vectors = TR.vectorizer(spark.createDataFrame(rows, "term string, df long, tf long, n_docs long"))
    assert len(vectors.stages[0].vocabulary) == 6000


def test_a_broken_part_of_the_store_is_no_missing_part(spark, tmp_path):
    (tmp_path / "features").mkdir()
    with pytest.raises(AnalysisException):
        store.read_feature_store(spark, str(tmp_path))
    assert store.read_feature_store(spark, str(tmp_path / "nowhere")) == {}


def test_legacy_terms_use_the_built_in_lists(spark, tmp_path):
    term = fixed.LEFT_TERMS[0]
    (tmp_path / "l.json").write_text(json.dumps({"political_terms": [f"more {term}"]}))
    lexicon, _ = lexicons.read_lexicon_json(spark, str(tmp_path / "l.json"))
    assert [tuple(r) for r in lexicon.collect()] == [("left", f"more {term}")]


def test_unknown_feeds_offer_articles_and_unknown_modes_are_rejected(spark):
    tables = small_tables(spark)
    tables.articles = tables.articles.withColumn("source_api", F.when(F.col("article_id") == 1, "archive").otherwise(F.col("source_api")))
    claims = spark.createDataFrame(
        [(1, "Solar panels power homes", "s", "fast"), (2, "Solar panels power homes", "s", "quickest"), (3, "", "s", "fast")],
        "claim_id int, claim string, source string, mode string",
    )
    out = {r["claim_id"]: r for r in P.verify_claims(claims, tables).collect()}
    assert out[1]["n_real_articles"] == 1 and out[1]["reject_reason"] is None
    assert out[2]["reject_reason"] == "unknown mode" and out[2]["verdict"] is None
    assert out[3]["reject_reason"] == "empty"
