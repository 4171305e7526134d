import hashlib
import random

from llm_helpers import clashing, documents, prose
from pyspark.sql import functions as F

from claimweave.llm import closed_syncmers as C


def edited(texts):
    """Texts in descending id order with the last third replaced from the next."""
    out = []
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        third = len(text) // 3
        out.append(text[: len(text) - third] + after[:third])
    return out


def hashes(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "w array<string>")
    return [r.h for r in df.select(F.transform("w", lambda w: F.xxhash64(w)).alias("h")).collect()]


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(2)
    rows = [prose(rng, n, 30) for n in (0, 1, 2, 3, 4, 5, 40, 300)]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "id int, text string")
    got = {r.id: list(r.a) for r in C.with_pairs(df, "text", "p").select("id", C.anchors("p").alias("a")).collect()}
    word = {w: h for r in rows for w, h in zip(r, hashes(spark, [r])[0], strict=True)}
    pairs = sorted({(a, b) for r in rows for a, b in zip(r, r[1:], strict=False)})
    df = spark.createDataFrame([(a, b, word[a], word[b]) for a, b in pairs], "a string, b string, x long, y long")
    pair = {(r.a, r.b): r.h for r in df.select("a", "b", F.xxhash64("x", "y").alias("h")).collect()}
    for i, r in enumerate(rows):
        if len(r) < C.K:
            assert len(got[i]) == (len(r) > 0)
            continue
        inner = [pair[p] for p in zip(r, r[1:], strict=False)]
        chosen = [j for j in range(len(r) - 3) if min(inner[j : j + 3]) in (inner[j], inner[j + 2])]
        assert len(got[i]) == len(chosen)
    one = C.with_pairs(spark.createDataFrame([(" ".join(rows[7]),), (" ".join(["other", *rows[7][40:90], "end"]),)], "text string"), "text", "p")
    a, b = (set(r.a) for r in one.select(C.anchors("p").alias("a")).collect())
    assert len(a & b) >= len(b) - 4


def test_rows_against_plain_order(spark):
    rng = random.Random(3)
    texts = ["", "a", "ab", "ééé日本語", *(" ".join(prose(rng, rng.randrange(1, 200))) for _ in range(80)), " ".join(prose(rng, 30_000))]
    ids = rng.sample([*range(50), *range(10**6, 10**6 + 40), -(10**12), 2**60, *range(10**9, 10**9 + 60)], len(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, mine string")
    got = {r.doc_id: r for r in C.edited_pairs(df).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    want = edited([t for _, t in order])
    assert len(got) == len(texts)
    for (i, text), changed in zip(order, want, strict=True):
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest(), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    long = [i for i, t in order if len(t.split()) > 50]
    assert sum(got[i].near_edited > 0.3 for i in long) > 0.9 * len(long)
    assert all(got[i].near_next < 0.1 for i in long)


def test_equal_texts_nulls_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z z z")], "doc_id long, text string")
    rows = C.edited_pairs(clashing(df)).collect()
    assert len(rows) == 6
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].fingerprint == by_id[2][0].fingerprint == ""
    assert by_id[1][0].near_edited == 1.0
    assert by_id[3][0].fingerprint == by_id[4][0].fingerprint == by_id[4][1].fingerprint
    text = "a b c d e f"
    # 4, 4, 3, 2, 1, null, then the first again
    assert by_id[3][0].edited_sha256 == hashlib.sha256(text[: 11 - 3].encode()).hexdigest()
    assert by_id[None][0].edited_sha256 == hashlib.sha256(("z z z"[:4] + "a").encode()).hexdigest()
    single = C.edited_pairs(documents(spark, ["abc def"])).first()
    assert single.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    assert C.edited_pairs(df.filter(F.lit(False))).count() == 0


def test_likeness_is_over_all_anchors(spark):
    rng = random.Random(4)
    passage = prose(rng, 50, 10**6)
    one, two = ([*prose(rng, 2000, 10**6), *passage, *prose(rng, 2000, 10**6)] for _ in range(2))
    df = spark.createDataFrame([(2, " ".join(one)), (1, " ".join(two)), (0, " ".join([*two[:-1], "end"]))], "doc_id long, text string")
    got = {r.doc_id: r for r in C.edited_pairs(df).collect()}
    marks = [set(C.with_marks(spark.createDataFrame([(" ".join(t),)], "text string"), "text", "m").select(F.col("m")["h"].alias("h")).first().h) for t in (one, two)]
    assert got[2].near_next == len(marks[0] & marks[1]) / len(marks[0] | marks[1]) > 0
    assert 0 < got[2].placed_next < 0.02 and got[1].placed_next > 0.99
    assert len({r.fingerprint for r in got.values()}) == 3
    moved = spark.createDataFrame([(2, " ".join(two)), (1, " ".join([*two[3000:], *two[:3000]]))], "doc_id long, text string")
    row = next(r for r in C.edited_pairs(moved).collect() if r.doc_id == 2)
    assert row.near_next > 0.99 and row.placed_next > 0.99


def test_every_text_with_words_has_an_anchor(spark):
    df = documents(spark, [f"a{i} b{i} c{i} d{i}" for i in range(60)])
    rows = C.edited_pairs(df).collect()
    assert len({r.fingerprint for r in rows} - {""}) == 60
    assert all(r.near_next == 0 for r in rows)
    assert any(len(a.a) == 0 for a in C.with_pairs(df, "text", "p").select(C.anchors("p").alias("a")).collect())
