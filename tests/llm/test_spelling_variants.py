import random
import re
import zlib
from collections import Counter
from itertools import combinations

from compare import compare, database
from llm_helpers import DOCUMENTS, SF_DIR, clashing, documents
from pyspark.sql import functions as F

from claimweave.llm import spelling_variants as S


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def slow_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def slow(rows):
    """All pairs of words compared."""
    n = slow_words(rows)
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def got(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def edited(rng, word, letters="abcéÿ"):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:i] + rng.choice(letters) * (kind != 0) + word[i + (kind != 2) :]


def texts_of(rng, stems, n):
    out = []
    for _ in range(n):
        words = [w if rng.random() < 0.6 else edited(rng, w) for w in rng.choices(stems, k=rng.randrange(1, 40))]
        out.append(" ".join(w.title() if rng.random() < 0.2 else w for w in words))
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(12)
    stems = ["".join(rng.choice("abcéÿ") for _ in range(rng.randrange(7, 13))) for _ in range(25)]
    stems += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "aaaaaab"]
    texts = texts_of(rng, stems, 150)
    assert any(w[0] != w[2] for w in slow(list(enumerate(texts))))
    for largest in (2_000, 30, 3):
        assert got(S.spelling_variants(documents(spark, texts), largest=largest)) == slow(list(enumerate(texts)))


def test_parts_hold_every_pair_once_at_every_depth(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(400)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))
    for largest in (1_000, 20, 2):
        near = S.near_words(df, largest=largest)
        assert sorted((r["word"], r["near"]) for r in near.collect()) == want
    parts = S.parts_of_composition(df, largest=2)
    assert max(r["count"] for r in parts.groupBy("part").count().collect()) <= 3  # one letter of two, or none


def test_acceptor_is_minimal_and_composes():
    words = sorted(["tap", "taps", "top", "tops", "cap", "caps", "xyz"])
    made = S.Acceptor(words)
    # the start, the fork behind t, the shared place before an s, and the end
    assert len(made.arcs) == 4
    accepted = []

    def read(q, so_far):
        if made.final[q]:
            accepted.append(so_far)
        for label, t in made.arcs[q]:
            read(t, so_far + label)

    read(made.start, "")
    assert sorted(accepted) == words
    want = sorted((a, b) for a in words for b in words if len(a) == 4 and one_edit(a, b) and (len(b) < 4 or a < b))
    assert sorted((max(p, key=len), min(p, key=len)) if len(p[0]) != len(p[1]) else tuple(sorted(p)) for p in made.pairs(4, 9)) == want


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(12)] + [("x", "w5")], "word string, form string")
    assert {r["word"]: r["root"] for r in S.roots(forms).collect()} == {f"w{i}": "w12" for i in range(12)} | {"x": "w12"}


def test_whole_table_equals_its_sql(spark):
    assert compare(spark, database(SF_DIR), S.op13_spelling_variants, S._sql(), SF_DIR)["ok"]


def test_edges(spark):
    rows = [
        (None, "ÀÉÿabcd ÀÉÿabcd àéÿabcd"), (None, None), (1, ""), (1, "Éaaaaaaa Éaaaaaaa éaaaaaaa"), (1, "Éaaaaaaa Éaaaaaaa éaaaaaaa"),
        (2, "q" * 30_000 + " " + "q" * 30_000 + " " + "q" * 30_001 + "\n" + "q" * 30_001), (3, "word's-hyphen 1234567 abcdefg×÷h " * 40),
        (4, "\U0001f600abcdefgh\U0001f600abcdefgh àbcdefgh"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    messy = clashing(docs).withColumns({"word": F.lit("x"), "n": F.lit(1), "run": F.lit(2), "i": F.lit("y"), "part": F.lit(0)})
    assert got(S.spelling_variants(messy)) == slow(rows)
    assert got(S.spelling_variants(docs.limit(0))) == []
    assert got(S.spelling_variants(documents(spark, ["abc def"] * 3))) == []
