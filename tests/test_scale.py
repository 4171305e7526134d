"""The ways for large sides must give the same rows as the ways for small ones."""

from collections import Counter

from pyspark.sql import functions as F

from claimweave import scale
from claimweave.operators import bias, features
from claimweave.operators import lexical as L


def rows(df):
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_lookup_join_salted_equals_broadcast(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("5", 2), ("7", 3)], "k string, v int")
    for how in ("inner", "left"):
        assert rows(scale.lookup_join(facts, table, ["k"], how)) == rows(scale.lookup_join(facts, table, ["k"], how, max_rows=1, hot_rows=5))


def test_hot_keys_of_several_columns_nulls_and_repeated_rows(spark):
    ids = [(i % 7, None if i % 4 == 0 else f"k{i % 3}") for i in range(3000)]
    facts = spark.createDataFrame(ids + ids, "id int, k string")
    table = spark.createDataFrame([(i, f"k{j}", i * j) for i in range(5) for j in range(2)] + [(1, None, 9)], "id int, k string, v int")
    for how in ("inner", "left"):
        want = rows(facts.join(table, ["id", "k"], how))
        for hot in (10, 10_000):
            assert rows(scale.hot_key_join(facts, table, ["id", "k"], hot_rows=hot, how=how)) == want


def test_hot_key_join(spark):
    facts = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    other = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert rows(scale.hot_key_join(facts, other, "k", hot_rows=10)) == rows(facts.join(other, "k"))
    assert rows(scale.hot_key_join(facts, other, "k", hot_rows=10, max_hot=0)) == rows(facts.join(other, "k"))


def test_contains_join_index_equals_brute_force(spark):
    texts = [(1, "the cat sat on the mat"), (2, "concatenate"), (3, "a"), (4, ""), (5, "mat the mat")]
    terms = ["cat", "the mat", "a", "at", "zzz", "mat the", "", "mat the mat"]
    t = spark.createDataFrame(texts, "id int, text string")
    w = spark.createDataFrame([(x,) for x in terms], "term string")
    want = {(i, x) for i, text in texts for x in terms if x in text}
    for chars, shards in ((100, 1), (6, 100), (1, 1)):  # one automaton, several, the index
        got = scale.contains_join(t, w, "text", "term", shard_chars=chars, max_shards=shards).select("id", "term").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_global_rank_matches_window(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("d"))
    df = df.withColumn("b", F.substring("d", 1, 1))
    got = scale.global_rank(df, ["g"], "b", [F.col("d")], "rank", "size").collect()
    for g in (0, 1):
        ours = sorted((r["d"], r["rank"], r["size"]) for r in got if r["g"] == g)
        assert [r[1] for r in ours] == list(range(1, 151)) and {r[2] for r in ours} == {150}


def lexicon(spark):
    terms = [("positive", "good"), ("negative", "bad"), ("exaggeration", "very"), ("left", "social justice"), ("right", "tax cuts"),
             ("subjective", "think"), ("hedging", "maybe"), ("loaded", "so-called"), ("loaded", "deep state"), ("clickbait", "secret"),
             ("conspiracy", "cover-up"), ("left", "reform"), ("emotional", "sad")]
    return spark.createDataFrame(terms, "category string, term string")


DOCS = [
    (1, "A secret reform", "I think the deep state and social justice are very good. Very bad tax cuts, maybe a cover-up.", "cnn.com"),
    (2, "", "so-called good plan. The bad plan is sad.", ""),
    (3, "", "", ""),
    (4, "None", "Nothing here at all.", None),
]


def test_inline_and_join_counts_agree(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id int, title string, text string, source string")
    sources = spark.createDataFrame([("left", "cnn", 0)], "leaning string, name string, ord long")

    def run():
        scored = bias.score_bias(docs, lexicon(spark), sources).withColumn("bias_indicators", F.array_join("bias_indicators", "|"))
        return rows(scored), rows(features.linguistic_features(docs, lexicon(spark), "doc_id", "title", "text", None))

    inline = run()
    assert sum(inline[1].values()) == len(DOCS)
    monkeypatch.setattr(L, "INLINE_TERMS", 0)
    assert run() == inline
    monkeypatch.setattr(bias, "INLINE_PHRASES", 0)
    assert run() == inline
    monkeypatch.setattr(scale, "BROADCAST_MAX_ROWS", 0)
    assert run() == inline


def test_rows_that_share_an_id_stay_apart(spark, monkeypatch):
    docs = spark.createDataFrame([DOCS[0], DOCS[0], (1, *DOCS[1][1:]), DOCS[3]], "doc_id int, title string, text string, source string")
    run = lambda: rows(features.linguistic_features(docs, lexicon(spark), "doc_id", "title", "text", None))
    inline = run()
    assert sum(inline.values()) == 4
    monkeypatch.setattr(L, "INLINE_TERMS", 0)
    assert run() == inline


def test_checkpoint_folder_comes_from_the_session(spark):
    out = scale.cut_lineage(spark.range(5))
    assert out.count() == 5 and spark.sparkContext.getCheckpointDir() is not None
