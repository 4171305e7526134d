import random

import numpy as np
from llm_helpers import clashing, documents, prose
from pyspark.sql import functions as F

from claimweave.llm import decontamination as D


def align(a, b):
    """Plain Smith-Waterman over word lists."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, last[j - 1] + (2 if x == y else -1), last[j] - 1, row[j - 1] - 1))
        best, last = max(best, *row), row
    return best


def test_alignment_equals_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item = rng.integers(0, 4, rng.integers(1, 12))
        regions = rng.integers(-1, 4, (5, rng.integers(1, 20)))
        assert D.aligned(item, regions).tolist() == [align(item.tolist(), r.tolist()) for r in np.where(regions < 0, 99, regions)]


def edited(rng, words, share):
    out = []
    for w in words:
        roll = rng.random()
        if roll < share / 3:
            continue
        out.append(f"x{rng.randrange(99)}" if roll < 2 * share / 3 else w)
        if 2 * share / 3 <= roll < share:
            out.append(f"y{rng.randrange(99)}")
    return out


def test_copies_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(8)
    items = [prose(rng, rng.randrange(15, 60), 3000) for _ in range(30)]
    texts, want = [], set()
    for i in range(300):
        words = prose(rng, rng.randrange(20, 400), 3000)
        if i % 3 == 0:
            n = rng.randrange(len(items))
            share = rng.choice([0, 0.1, 0.2, 0.25])
            at = rng.randrange(len(words))
            copy = edited(rng, items[n], share)
            words[at:at] = copy
            if align(items[n], words) >= len(items[n]):
                want.add((i, n))
        texts.append(" ".join(words).capitalize() if i % 2 else ",  ".join(words))
    given = spark.createDataFrame([(n, " ".join(w) + ".", "x") for n, w in enumerate(items)], "item_id long, text string, doc string")
    df = clashing(documents(spark, texts))
    rows = D.contaminated(df, given).collect()
    got = {(r.doc_id, r.item_id): r.score for r in rows}
    assert set(got) == want and len(want) > 80
    for (i, n), score in got.items():
        words = [w for w in "".join(c if c.isalnum() else " " for c in texts[i].lower()).split(" ") if w]
        assert abs(score - align(items[n], words) / (2 * len(items[n]))) < 1e-9
    kept = D.drop_contaminated(df, given)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(300)) - {i for i, _ in want}


def test_common_phrases_long_texts_and_repeats(spark):
    rng = random.Random(9)
    item = ["which", "of", "the", "following", *prose(rng, 12, 3000)]
    filler = "which of the following " * 3000
    texts = [filler, filler + " ".join(item), None, "", " ".join(item + item), " ".join(item)]
    given = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    df = documents(spark, texts)
    got = {(r.doc_id, r.item_id, r.score) for r in D.contaminated(df.unionByName(df), given).collect()}
    assert {(i, n) for i, n, s in got if s == 1.0} == {(1, 1), (4, 1), (5, 1)} == {(i, n) for i, n, _ in got}
    nulls = spark.createDataFrame([(None, texts[5]), (7, "clean text of no item here")], "doc_id long, text string")
    assert [(r.doc_id, r.score) for r in D.contaminated(nulls, given).collect()] == [(None, 1.0)]
    assert [r.doc_id for r in D.drop_contaminated(nulls, given).collect()] == [7]
    assert D.contaminated(df.filter(F.lit(False)), given).count() == 0
    assert D.contaminated(df, given.limit(0)).count() == 0


def test_every_fifth_word_replaced_beside_verbatim_copies(spark):
    rng = random.Random(10)
    items = [prose(rng, 40, 3000) for _ in range(6)]
    texts, want = [], set()
    for n, item in enumerate(items):
        for every in (5, 6, 4):
            copy = [f"z{n}" if i % every == every - 1 else w for i, w in enumerate(item)]
            assert align(item, copy) >= len(item)
            want.add((len(texts), n))
            texts.append(" ".join(prose(rng, 30, 3000) + copy + prose(rng, 30, 3000)))
        want.add((len(texts), n))
        texts.append(" ".join(item))
    given = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(documents(spark, texts), given).collect()}
    assert set(got) == want
    for (i, n), score in got.items():
        assert abs(score - align(items[n], texts[i].split(" ")) / 80) < 1e-9


def test_given_passages(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in D.op2_decontamination(spark, sf).collect()}
    verbatim = {(i, n) for i, t in docs.items() for n, p in items.items() if p in (t or "")}
    assert verbatim <= got
    words = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split(" ") if w]
    for i, n in got:
        assert align(words(items[n]), words(docs[i])) >= len(words(items[n]))
