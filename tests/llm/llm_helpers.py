"""Small inputs shared by the tests of this folder."""

import random

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside, as further columns of an input.
CLASHING = ["words", "line", "_key", "fp", "key", "doc", "surrogate", "length", "salt", "_t"]


def documents(spark, texts, first=0, langs=None):
    rows = [(first + i, t, langs[i] if langs else "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingled(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def near_pairs(texts, width=5, least=0.8):
    """All pairs of places whose shingle sets are that alike, counted over every shared shingle."""
    sets, where, common = [shingled(t, width) for t in texts], {}, {}
    for i, s in enumerate(sets):
        for shingle in s:
            for j in where.setdefault(shingle, []):
                common[j, i] = common.get((j, i), 0) + 1
            where[shingle].append(i)
    return {p for p, n in common.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def first_of_groups(rows, width=5, least=0.8):
    """The smallest id of each group of rows joined by near pairs or equal texts."""
    texts = [t or "" for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    first = {}
    links = near_pairs(texts, width, least) | {(first.setdefault(t, i), i) for i, t in enumerate(texts)}
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    least_id = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        least_id[root] = min(least_id.get(root, doc_id), doc_id)
    return set(least_id.values())
