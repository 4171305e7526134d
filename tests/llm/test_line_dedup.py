import random

from llm_helpers import SF_DIR, clashing, documents, prose
from pyspark.sql import functions as F

from claimweave.llm import line_dedup as L


def close(a, b):
    """At most one word inserted, deleted or replaced."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return None
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    rests = {0: (a[at + 1 :], b[at + 1 :]), 1: (a[at + 1 :], b[at:]), -1: (a[at:], b[at + 1 :])}[len(a) - len(b)]
    return 1 if rests[0] == rests[1] else None


def plain(rows):
    """(doc, line) -> (kept doc, kept line, edits)."""
    lines = []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.split():
                lines.append((i, n, line.lower().split()))
    first, out = {}, {}
    for i, n, words in lines:
        first.setdefault(tuple(words), (i, n))
    order = list(first.items())
    near = {}
    for at, (words, _) in enumerate(order):
        for other, place in order[:at]:
            if min(len(words), len(other)) >= L.MIN_WORDS and close(list(words), list(other)) == 1:
                near[words] = place
                break
    for i, n, words in lines:
        key = tuple(words)
        if key in near:
            out[i, n] = (*near[key], 1)
        elif first[key] != (i, n):
            out[i, n] = (*first[key], 0)
    return out


def found(df):
    return {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no, r.edits) for r in L.near_duplicate_lines(df).collect()}


def edit(rng, words):
    out, at = list(words), rng.randrange(len(words))
    kind = rng.randrange(3)
    if kind == 0:
        out[at] = f"n{rng.randrange(99)}"
    elif kind == 1:
        del out[at]
    else:
        out.insert(at, f"n{rng.randrange(99)}")
    return out


def test_against_plain_search(spark):
    rng = random.Random(11)
    pool = [prose(rng, rng.randrange(4, 12), 6) for _ in range(25)] + [prose(rng, 40) for _ in range(10)]
    texts = []
    for _ in range(120):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                line = edit(rng, line) if line else line
            lines.append("  ".join(line).upper() if rng.random() < 0.1 else " ".join(line))
        texts.append("\n".join(lines))
    rows = list(enumerate(texts))
    df = clashing(documents(spark, texts))
    want = plain(rows)
    assert len(want) > 100 and {e for _, _, e in want.values()} == {0, 1}
    assert found(df) == want


def test_one_edit(spark):
    rng = random.Random(12)
    pairs = []
    for _ in range(300):
        a = prose(rng, rng.randrange(1, 9), 3)
        b = list(a)
        for _ in range(rng.randrange(3)):
            b = edit(rng, b) if b else b
        pairs.append((a, b if rng.random() < 0.7 else prose(rng, rng.randrange(1, 9), 3)))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = [r.c for r in df.select(L.one_edit(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [close(a, b) is not None for a, b in pairs]


def test_nulls_long_lines_and_dropping(spark):
    rng = random.Random(13)
    long = prose(rng, 20_000)
    line = "a b c d e f"
    texts = [None, "", f"{line}\nshort one", " ".join(long), f"X y z v w q\n{line}", " ".join([*long[:777], "changed", *long[778:]]), "a b c d e G\n", line]
    df = clashing(documents(spark, texts))
    want = {(4, 1): (2, 0, 0), (5, 0): (3, 0, 1), (6, 0): (2, 0, 1), (7, 0): (2, 0, 0)}
    assert found(df) == want
    kept = L.drop_lines(df, L.near_duplicate_lines(df))
    assert kept.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {
        **{i: (texts[i], len(texts[i] or "")) for i in (0, 1, 2, 3)}, 4: ("X y z v w q", 11),
    }
    assert found(df.filter(F.lit(False))) == {}


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (3, "v w x y z"), (9, "v w x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == {(None, 0): (3, 0, 0), (9, 0): (3, 0, 0)}


def test_equal_short_lines(spark):
    texts = ["les.\na b c d e f\n\nand ornd.", "Les.\na b c d", "a b c d\nles.\na b c e\na b c d e G", "les."]
    df = clashing(documents(spark, texts))
    gone = L.near_duplicate_lines(df, equal_from=1)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no, r.edits) for r in gone.collect()}
    assert got == {(1, 0): (0, 0, 0), (2, 0): (1, 1, 0), (2, 1): (0, 0, 0), (2, 3): (0, 1, 1), (3, 0): (0, 0, 0)}
    assert {r.doc_id: r.text for r in L.drop_lines(df, gone).collect()} == {0: texts[0], 1: "a b c d", 2: "a b c e"}
    long = L.near_duplicate_lines(df, equal_from=L.MIN_WORDS).collect()
    assert [(r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in long] == [(2, 3, 0, 1)]


def test_stage_cuts_equal_short_lines(spark):
    from corpus_pipeline import line_dedup

    out = line_dedup(spark, documents(spark, ["les.\none two", "les.\nthree", "three"]), SF_DIR)
    assert {r.doc_id: r.text for r in out.collect()} == {0: "les.\none two", 1: "three"}


def test_rows_that_share_an_id_or_have_none_lose_their_own_lines_alone(spark):
    rows = [(1, "a b c d e f"), (7, "a b c d e f\nkept one"), (7, "p q r s t u\nkept two"), (None, "a b c d e f"), (None, "unique words that no one else has")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = L.without_repeated_lines(df)
    assert got.columns == df.columns
    want = [(1, "a b c d e f"), (7, "kept one"), (7, "p q r s t u\nkept two"), (None, "unique words that no one else has")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert L.without_repeated_lines(df.limit(0)).count() == 0


def test_sql(spark):
    from compare import compare, database

    assert compare(spark, database(SF_DIR), L.op9_line_dedup, L.SQL, SF_DIR)["ok"]
