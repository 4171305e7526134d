"""The most common grams of each id against a plain count."""

import random
from collections import Counter

from claimweave.operators import retrieval as R
from claimweave.functions import fixed_values as fixed


def test_term_frequency_against_plain_counts(spark):
    """Null and empty texts, a null id, repeated ids, ids that are texts; nothing but the words of a document is shuffled."""
    draw = random.Random(3)
    words = ["cat", "mouse", "the", "Éclair", "house", "x", "tree_1", "dog"]
    texts = [(str(i % 40) if i % 9 else None, " ".join(draw.choices(words, k=draw.randrange(60)))) for i in range(120)] + [("e", ""), ("n", None)]
    sizes = {1: 4, 2: 3, 3: 2}
    df = spark.createDataFrame(texts, "k string, text string")
    top = R.term_frequency(df.repartition(5), sizes, "k", "text")
    assert top.dtypes == [("k", "string"), ("n", "int"), ("term", "string"), ("freq", "bigint"), ("first_pos", "int"), ("rank", "int")]
    got = {}
    for r in top.collect():
        got.setdefault((r["k"], r["n"]), []).append((r["rank"], r["freq"], r["first_pos"], r["term"]))
    counts, at = {}, {}
    for k, text in texts:
        kept = [w for w in (text or "").lower().split() if w[0] in "abcdefghijklmnopqrstuvwxyz" and len(w) > 2 and w not in fixed.STOPWORDS]
        for n in sizes:
            for i in range(len(kept) - n + 1):
                gram = " ".join(kept[i : i + n])
                counts.setdefault((k, n), Counter())[gram] += 1
                at[k, n, gram] = min(i, at.get((k, n, gram), i))
    assert got.keys() == counts.keys()
    for (k, n), c in counts.items():
        want = sorted((-f, at[k, n, g]) for g, f in c.items())[: sizes[n]]
        mine = sorted(got[k, n])
        assert [(-f, p) for _, f, p, _ in mine] == want and [r for r, *_ in mine] == list(range(1, len(want) + 1))
        assert all(c[g] == f and at[k, n, g] == p for _, f, p, g in mine)
    plan = R.term_frequency(df, sizes, "k", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Window" not in plan


def test_term_frequency_of_no_rows(spark):
    assert R.term_frequency(spark.createDataFrame([], "k int, text string"), {1: 2}, "k", "text").collect() == []
