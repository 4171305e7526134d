import random
from itertools import combinations

import numpy as np
import xxhash
from llm_helpers import clashing, documents, first_of_groups, near_pairs, prose, shingled
from pyspark.sql import functions as F

from claimweave.llm import simhash_golay as S
from claimweave.llm.common import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_equals_plain_count():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "Two Words", "a\u00a0b c d", "ÀÉ Straße x\x85y z \x1c k", *(" ".join(prose(rng, n)) for n in (1, 2, 3, 50, 400))]
    assert [S.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_codewords_are_three_bits_away_at_most_and_words_two_apart_meet():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 500)
    near = S.nearby_indices(words)
    assert max(len(set(r)) for r in near.tolist()) == 6
    for flips in [(1 << a) | (1 << b) for a, b in combinations(range(23), 2)][::7] + [1, 1 << 22]:
        other = S.nearby_indices(words ^ flips)
        assert all(set(a) & set(b) for a, b in zip(near.tolist(), other.tolist(), strict=True))


def test_golay_keys_meet_for_every_pair_within_two_bits():
    base = np.random.default_rng(5).integers(0, 1 << 63, 40).astype(np.uint64)
    for a, b in [(0, 0), (0, 1), (22, 23), (45, 46), (10, 63), (62, 63), (46, 63), (5, 30)]:
        other = base ^ np.uint64((1 << a) | (1 << b))
        for one, two in zip(base, other, strict=True):
            keys = [set(S.golay_keys(np.array([v]).view(np.int64))[1].tolist()) for v in (one, two)]
            assert keys[0] & keys[1]


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    fps = {0, -1}
    for _ in range(30):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(60 if rng.random() < 0.2 else 4):
            flip = 0
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                flip |= 1 << b
            fps.add(centre ^ flip)
    fps = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    near = [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = roots(fps, near)
    for crowded in (2, 32):
        edges = S.links(df, crowded).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges)
        assert roots(fps, [(r.a, r.b) for r in edges]) == want
    got = {r.node: r.root for r in components(S.links(df)).collect()}
    assert got == {f: r for f, r in want.items() if any(f in e for e in near)}


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 7), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in [1, 7, *range(200, 260)]}}


def test_documents(spark):
    rng = random.Random(2)
    long = prose(rng, 60_000)
    texts = [None, "", " ", "one", "one", " ".join(long), " ".join([*long[:-1], "changed"]), *(" ".join(prose(rng, 80)) for _ in range(10))]
    df = documents(spark, texts)
    df = clashing(df.unionByName(df.limit(1)))
    got = S.near_duplicates(df).collect()
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    near = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in got} == roots(fps, near)
    assert len(got) == len(texts) + 1
    assert all(r.fp & (1 << 64) - 1 == fps[r.doc_id] for r in got)
    kept = S.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first_of_groups(list(enumerate(texts))))


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "x y z q r")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in S.near_duplicates(df).collect())
    assert got == [("4", "4"), ("None", "4"), ("None", "None")]
    assert S.near_duplicates(df.filter(F.lit(False))).count() == 0


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = [f"e{rng.randrange(9999)}"] * rng.randrange(2)
    return out


def test_stage_finds_near_copies_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(2)
    planted = [(10_000 + i, " ".join(edited(rng, t.split(), max(1, len(t.split()) // 60)))) for i, (_, t) in enumerate(rows[:150]) if t and len(t.split()) > 60]
    every = [*rows, *planted]
    texts = sorted({t or "" for _, t in every})
    want = {(texts[a], texts[b]) for a, b in near_pairs(texts)}
    assert len(want) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {tuple(sorted((texts[r.a], texts[r.b]))) for r in S.similar_texts(df).collect()}
    assert got <= want
    kept = {r.doc_id for r in S.keep_one_of_each(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    first = first_of_groups(every)
    gone, should = {i for i, _ in every} - kept, {i for i, _ in every} - first
    assert gone <= should and len(gone) >= 0.98 * len(should)


def drifting(rng, start, times, step):
    """Texts each of which changes a few words of the one before, so that only neighbours are alike."""
    out = [start]
    for i in range(times):
        words = list(out[-1])
        for at in rng.sample(range(0, len(words), 5), step):
            words[at] = f"d{i}x{at}"
        out.append(words)
    return [" ".join(words) for words in out]


def test_no_link_is_lost(spark):
    rng = random.Random(12)
    texts = {"", "one", "One", "two words"}
    for _ in range(12):
        base = prose(rng, 150, 4000)
        texts |= {" ".join(base).upper(), *drifting(rng, base, 12, 3)}
        texts |= {" ".join(edited(rng, base, rng.randrange(1, 5))) for _ in range(6)}
        texts.add(" ".join(base + prose(rng, 35, 4000)))
    passage = prose(rng, 60, 4000)
    texts |= {" ".join(passage + prose(rng, rng.randrange(2, 60), 4000)) for _ in range(60)}
    texts = sorted(texts)
    want = near_pairs(texts)
    assert len(want) > 300
    of = roots(range(len(texts)), want)
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for crowded in (2, 1000):
        got = {(r.a, r.b) for r in S.similar_texts(df, paired_up_to=crowded).collect()}
        assert got <= want
        assert roots(range(len(texts)), got) == of
    sets = [frozenset(shingled(t)) for t in texts]
    stand = {i for i, s in enumerate(sets) if sets.index(s) == i}
    assert {p for p in want if set(p) <= stand} <= got
    kept = S.keep_one_of_each(documents(spark, texts)).collect()
    assert {r.doc_id for r in kept} == set(of.values())


def test_order_of_shingles_and_parities():
    rng = np.random.default_rng(4)
    every = np.unique(rng.integers(0, 1 << 63, 600).astype(np.uint64))
    common = rng.permutation(every)[:200]
    place = {h: (1, -i) for i, h in enumerate(common.tolist())}
    for size in (1, 2, 5, 40, 300):
        one = np.sort(rng.permutation(every)[:size])
        assert S.rare_first(one, common).tolist() == sorted(one.tolist(), key=lambda h: place.get(h, (0, h)))
        other = np.unique(np.concatenate([one[size // 8 :], every[: size // 16]]))
        apart = len(np.setxor1d(one, other))
        for longs, others in ((8, 8), (1, 64), (128, 4), (64, 64)):
            assert S.differing_at_least(S.parities(one, longs), S.parities(other, others)) <= apart
        assert S.differing_at_least(S.parities(one, 64), S.parities(one, 4)) == 0
        if len(np.intersect1d(one, other)) >= 0.8 * len(np.union1d(one, other)):
            heads = [set(S.rare_first(h, common)[: S.prefix_length(len(h), 0.8)].tolist()) for h in (one, other)]
            assert heads[0] & heads[1]


def test_a_large_group_of_near_copies_keeps_one(spark):
    rng = random.Random(6)
    words = prose(rng, 120, 3000)
    copies = [" ".join(edited(rng, words, 1)) for _ in range(300)]
    others = [" ".join(prose(rng, 80, 3000)) for _ in range(40)]
    kept = S.keep_one_of_each(documents(spark, copies + others)).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(300, 340)]


def test_stage_goes_by_id_and_text(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(prose(rng, 50, 5000)) for _ in range(3))
    rows = [(2, a), (7, a.upper()), (7, b), (7, b), (None, c), (None, a), (None, c), (8, None), (9, ""), (5, "two words"), (6, "Two words"), (4, "other words")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = S.keep_one_of_each(df)
    assert got.columns == df.columns
    want = [(2, a), (7, b), (None, c), (8, None), (5, "two words"), (4, "other words")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert S.keep_one_of_each(df.limit(0)).count() == 0
