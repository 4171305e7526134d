"""Long runs of words match like short ones (Java matches a greedy group once a stack frame), and long texts cross to Python as texts."""

import random

from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.operators.entities import _bounded, capitalized_entities, typed_entities, with_bias_entities

MANY = 20_000


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column.alias("y")).head()["y"]


def test_capitalized_entities_of_a_long_run(spark):
    run = " ".join(["Thwh"] * MANY)
    assert one(spark, f"so {run} it", capitalized_entities("x")) == [run]


def test_typed_entities_of_a_long_run(spark):
    run = "\t ".join(["Thwh"] * MANY)
    found = typed_entities(spark.createDataFrame([(1, f"so {run} it")], "doc_id int, text string")).head()
    assert found["MISC"][0] == run and len(found["MISC"]) == 2 and found["MISC"][1] == "Thwh"


def test_bias_entities_of_a_long_run(spark):
    run = " ".join(["Thwh"] * MANY)
    df = spark.createDataFrame([(f"so {run} it",)], "x string")
    found = with_bias_entities(df, F.col("x")).head()["bias_entities"]
    assert [e["entity"] for e in found if e["etype"] == "OTHER"] == [run]
    assert [e["entity"] for e in found if e["etype"] == "PERSON"] == ["Thwh Thwh Thwh"] * (MANY // 3) + ["Thwh Thwh"]


def test_tokens_of_a_long_chain(spark):
    chain = "-".join(["a"] * MANY)
    assert one(spark, f"so {chain}!", T.tokenize("x")) == ["so", chain, "!"]
    assert one(spark, f"So {chain}!", T.tokenize_cased("x")) == ["So", chain, "!"]


def test_short_runs_match_as_the_greedy_patterns(spark):
    """The same matches as by the greedy forms of the patterns, on texts where those have to go back."""
    draw = random.Random(5)
    texts = ["".join(draw.choice(["A", "B", "a", "b", " ", " ", "\n", "1", "_", "é", "É", "-", "'", ".", "Ab", "Ba "]) for _ in range(40)) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    runs = T.find_all(F.col("x"), "(?=[A-Z])" + T.NO_WORD_BEFORE + r"[A-Z][a-z]*(?:\s+[A-Z][a-z]*)*")
    pairs = [
        (capitalized_entities("x", ["ab"]), F.filter(runs, lambda e: (F.length(e) > 2) & (F.lower(e) != "ab"))),
        (T.tokenize("x"), T.find_all(F.lower("x"), T.TOKEN_PATTERN)),
        (T.tokenize_cased("x"), T.find_all(F.col("x"), T.TOKEN_PATTERN)),
    ]
    rows = df.select(*[F.struct(a.alias("now"), b.alias("greedy")) for a, b in pairs]).collect()
    assert all(c["now"] == c["greedy"] for r in rows for c in r)
    typed = typed_entities(df.select(F.monotonically_increasing_id().alias("doc_id"), F.col("x").alias("text")), "doc_id").select("MISC")
    phrases = df.select(F.array_distinct(T.find_all(F.col("x"), _bounded(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"))).alias("p")).collect()
    for got, want in zip(typed.collect(), phrases, strict=True):
        assert got["MISC"][: len(want["p"])] == want["p"]
    other = with_bias_entities(df, F.col("x")).select(F.transform(F.filter("bias_entities", lambda e: e["etype"] == "OTHER"), lambda e: e["entity"]).alias("e"))
    taken = with_bias_entities(df, F.col("x")).select(F.transform(F.filter("bias_entities", lambda e: e["etype"] != "OTHER"), lambda e: e["entity"]).alias("e"))
    plain = df.select(T.find_all(F.col("x"), _bounded(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+")).alias("p"))
    for got, gone, want in zip(other.collect(), taken.collect(), plain.collect(), strict=True):
        assert got["e"] == [p for p in dict.fromkeys(want["p"]) if p not in gone["e"]]


def test_lexicon_counts_take_texts_and_no_lists(spark):
    """A batch of lists of words takes many times its text in Python; empty rows and odd spaces count as before."""
    from claimweave.functions import text as T
    from claimweave.functions.automata import lexicon_counts

    terms = {"good": 4, "very": 32, "left one": 1}
    names = ["left", "right", "positive", "negative", "subjective", "exaggeration"]
    df = spark.createDataFrame([(1, "very good left one"), (2, ""), (3, "sly fox sly\tfox"), (4, None)], "id int, x string")
    out = df.select("id", lexicon_counts(T.tokenize("x"), T.words("x"), names, terms, {"fox", "sly fox"}).alias("c"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 2
    got = {r["id"]: r["c"].asDict() for r in out.collect()}
    assert got[1] == {"_left": 0, "_right": 0, "_positive": 1, "_negative": 0, "_subjective": 0, "_exaggeration": 1, "_left_pairs": 1, "_right_pairs": 0,
                      "_more_positive": 1, "_more_negative": 0, "_more_subjective": 0, "_loaded": 0}
    assert got[3]["_loaded"] == 2 and not any(got[2].values()) and not any(got[4].values())
