import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import clashing, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimweave.llm import best_fit_packing as B

HARD = [
    "", " ", "  a  b\n\n c\t", "I'll don't we've 'S", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|end", "ÀÉ ñ ß 日本語 😀👍🏽",
    "12345 3.14 ½ Ⅷ ٣", "x" * 3000, "   y \x85 z\x1c", "é" * 50 + "\r\n\r\n", "_a__b", "﻿bom ‍", "ab" * 700 + " " * 300,
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(B.vocabulary())


def test_ids_equal_those_of_the_tokenizers_library(spark, reference):
    encoder = B.tokenizer(B.vocabulary())
    rng = random.Random(1)
    parts = [*HARD, "the", " of", "'t", "\n", " ", "9", "Ñ", "é", "<|endoftext|>"]
    texts = [*HARD, *("".join(rng.choice(parts) for _ in range(12)) for _ in range(400))]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert encoder.encode(text, allowed_special="all") == reference.encode(text, add_special_tokens=False).ids, text[:80]


def test_pieces():
    for n in (1, 2047, 2048, 2049, 4096, 5000):
        cut = B.pieces_of(list(range(n)))
        assert [a for a, _ in cut] == list(np.cumsum([0, *[s for _, s in cut]])[:-1]) and sum(s for _, s in cut) == n
        assert all(s == 2048 for _, s in cut[1:]) and len(cut) == -(-n // 2048)


def bins(patterns):
    return sum(times for _, times in patterns)


def best_fit(counts):
    """Sequences of plain best-fit-decreasing, a piece at a time."""
    room = []
    for size in range(2048, 0, -1):
        for _ in range(int(counts[size])):
            at = bisect.bisect_left(room, size)
            left = (room.pop(at) if at < len(room) else 2048) - size
            bisect.insort(room, left)
    return len(room)


def test_plan_uses_every_piece_once_and_as_few_sequences_as_best_fit():
    rng = np.random.default_rng(3)
    for trial in range(40):
        counts = np.zeros(2049, np.int64)
        kinds = rng.integers(1, 2049, rng.integers(1, 300))
        large = trial % 2
        counts[kinds] += rng.integers(1, 10 ** rng.integers(1, 7) if large else 20, len(kinds))
        patterns = B.plan(counts)
        used = np.zeros_like(counts)
        for lengths, times in patterns:
            assert sum(lengths) <= 2048 and times > 0
            for size in lengths:
                used[size] += times
        assert (used == counts).all()
        assert bins(patterns) >= -(-int(counts @ np.arange(2049)) // 2048)
        assert large or bins(patterns) <= 1.02 * best_fit(counts) + 1
        assert len(patterns) < 4 * 2049


def test_exact_complements_are_found():
    counts = np.zeros(2049, np.int64)
    for size in (1000, 1048, 900, 700, 448, 600, 500, 400, 548):
        counts[size] += 5
    assert all(sum(lengths) == 2048 for lengths, _ in B.plan(counts))
    counts[:] = 0
    counts[1024] = 7
    assert sorted(B.plan(counts)) == [((1024,), 1), ((1024, 1024), 3)]


def hold(rows, texts, reference):
    """Every token of every row once, sequences without a gap, none too long."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in got] == B.pieces_of(ids)
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for places in sequences.values():
        end = 0
        for at, size in sorted(places):
            assert at == end
            end += size
        assert end <= 2048
    return len(sequences)


def test_packing(spark, reference):
    rng = random.Random(5)
    texts = [None, "", *HARD[4:6], "a b " * 9000, *(" ".join(["word"] * rng.randrange(1, 1500)) for _ in range(60)), *["same text"] * 40]
    df = clashing(documents(spark, texts))
    rows = B.packed(df).collect()
    n = hold(rows, dict(enumerate(texts)), reference)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 2
    twice = B.packed(df.limit(5).unionByName(df.limit(5))).collect()
    assert len(twice) == 2 * len(B.packed(df.limit(5)).collect())
    assert B.packed(df.filter(F.lit(False))).count() == 0
    assert [r.doc_id for r in B.packed(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()] == [None]


def test_given_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = B.op10_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    hold(rows, texts, reference)


def test_long_runs_of_blanks_have_the_ids_of_the_library():

    ours, theirs = B.tokenizer(B.vocabulary()), Tokenizer.from_file(B.vocabulary())
    run = " " * 3_000
    texts = [run, run + "word", "word" + run, "a" + run + "b" + run + "\n", "x\n" * 2 + "\t" * 2_000 + "y", run + "\u3000", "\x1c" * 1_500 + "z", run + "1", run + ".", "\u2003" * 1_200 + "w"]
    texts += [run + token for token in sorted(ours.special_tokens_set)[:2]]
    for text in texts:
        assert B.encoded(ours, text) == theirs.encode(text, add_special_tokens=False).ids
    many = B.encoded(ours, " " * 1_000_000)
    assert len(many) == len(theirs.encode(" " * 1_000_000, add_special_tokens=False).ids)
