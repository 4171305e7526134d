"""Packing of token sequences by exact complements of lengths, then best fit."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, stored, table

CAPACITY = 2048
SALTS = 64
#: Fixed value: how the vocabulary file cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Fixed value: the blanks of the expression's \\s.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONGEST_BLANKS = 1_000


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter; the rest take letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a ``tokenizers`` file, encoded by tiktoken: the same ids at four times the speed.

    Merges are applied in the order of the ids, which holds for files whose merges number them; a
    file where it does not hold is refused.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, vocab = byte_of_letter(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if ids != sorted(ids):
        raise ValueError(f"{path}: merges are not in the order of the ids")
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoded(encoder: tiktoken.Encoding, text: str, longest: int = LONGEST_BLANKS) -> list[int]:
    """The ids of a text; runs of more than ``longest`` blanks are cut out first, since the expression can't take them whole.

    Before a further character the expression leaves the last blank of a run to it and takes the others as one piece; at the end of
    the text, and before a special token, it takes the whole run.  The cuts are at these places, so the ids are the same.
    """
    ids: list[int] = []
    at = 0
    special = tuple(encoder.special_tokens_set)
    for run in re.finditer(f"{BLANK}{{{longest + 1},}}", text):
        start, end = run.span()
        if end < len(text) and not (special and text.startswith(special, end)):
            end -= 1
        ids.extend(encoder.encode(text[at:start], allowed_special="all"))
        ids.extend(encoder._encode_single_piece(text[start:end]))
        at = end
    ids.extend(encoder.encode(text[at:], allowed_special="all"))
    return ids


def pieces_of(ids: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of one document; only the first may be shorter than the capacity."""
    first = len(ids) % capacity or min(len(ids), capacity)
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every row; ids end with 0 and a null text is empty."""
    kind = dict(docs.dtypes)[id_col]
    name = path.rsplit("/", 1)[-1]
    docs.sparkSession.sparkContext.addFile(path)
    slim = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(SparkFiles.get(name))
        for batch in batches:
            out = []
            for row, text in zip(batch["_i"], batch["_t"], strict=True):
                ids = [*encoded(encoder, text or ""), 0]
                packed = np.array(ids, "<u4").tobytes()
                for n, (start, length) in enumerate(pieces_of(ids, capacity)):
                    out.append((row, n, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(out, columns=["_i", "piece", "start", "length", "ids_crc32"])

    out = slim.mapInPandas(run, f"_i {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("_i", id_col)


class Stock:
    """How many pieces of each length are left, with look-ups of exact sums among those available."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64)
        self.capacity = len(counts) - 1

    def pair(self, gap: int) -> tuple[int, int] | None:
        """The two available lengths that make up ``gap``, the longer one as long as possible."""
        low = np.arange(1, gap // 2 + 1)
        fits = (self.left[low] > 0) & (self.left[gap - low] > 0) & ((low * 2 != gap) | (self.left[low] > 1))
        at = int(fits.argmax()) if len(low) else 0
        return (gap - int(low[at]), int(low[at])) if len(low) and fits[at] else None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill ``gap`` exactly, under their counts."""
        if self.left[gap] > 0:
            return (gap,)
        if two := self.pair(gap):
            return two
        for long in np.flatnonzero(self.left[:gap] > 0)[::-1].tolist():
            self.left[long] -= 1
            two = self.pair(gap - long)
            self.left[long] += 1
            if two:
                return (long, *two)
        return None

    def longest(self, gap: int) -> int | None:
        fits = np.flatnonzero(self.left[: gap + 1] > 0)
        return int(fits[-1]) if len(fits) else None


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), from the number of pieces of each length.

    Sequences are opened with the longest length left.  An exact complement of one to three
    lengths closes it; without one, the longest length that fits is added and the rest is tried again.
    A pattern is taken as often as its counts allow, so each step uses up a length (or its last even
    number) and the plan has a few patterns for each length, whatever the number of pieces.
    """
    stock, out = Stock(counts), []
    while (first := stock.longest(stock.capacity)) is not None:
        chosen = [first]
        stock.left[first] -= 1
        gap = stock.capacity - first
        while gap:
            if rest := stock.complement(gap):
                chosen += rest
                for size in rest:
                    stock.left[size] -= 1
                break
            if (size := stock.longest(gap)) is None:
                break
            chosen.append(size)
            stock.left[size] -= 1
            gap -= size
        sizes, uses = np.unique(chosen, return_counts=True)
        more = int((stock.left[sizes] // uses).min())
        stock.left[sizes] -= more * uses
        out.append((tuple(chosen), more + 1))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, sequences, offset, step) of each use of a length in a pattern.

    The ranks of a use run over the sequences of its pattern; equal lengths of one pattern follow each other.
    """
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for size in lengths:
            out.append((size, taken.get(size, 0), times, sequence, offset))
            taken[size] = taken.get(size, 0) + times
            offset += size
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to ``capacity`` tokens.

    Only the histogram of lengths (``capacity`` numbers) goes to the driver.  Pieces are numbered
    within their length by the sums of (length, salt) groups, so a length that a third of all pieces
    have is numbered by many tasks, and each number falls into one slot of the plan.  The slots
    are a table of a few rows for each length.
    """
    spark: SparkSession = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.groupBy("length").agg(F.count(F.lit(1))).collect():
        counts[size] = n
    table_of = "length long, first long, uses long, sequence long, offset long"
    uses = spark.createDataFrame(slots(plan(counts)), table_of)
    spans = uses.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "uses", "sequence", "offset"))).alias("spans"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "start", "ids_crc32"), F.lit(SALTS)))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    shift = F.expr("coalesce(sum(n) OVER (PARTITION BY length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    before = before.select("length", "salt", shift.alias("shift"))
    order = "row_number() OVER (PARTITION BY length, salt ORDER BY {}, piece, start, ids_crc32)".format(f"`{id_col}`")
    ranked = salted.withColumn("rank", F.expr(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("shift"))
    # capacity rows of spans in all: a proven bound
    joined = ranked.join(F.broadcast(spans), "length")
    slot = F.element_at(F.filter("spans", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["uses"])), 1)
    placed = joined.withColumn("slot", slot)
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id"), F.col("slot.offset").alias("offset"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents.

    A null or empty text is the one id 0.  Repeated rows are packed each for itself.  Null ids are
    kept.  No rows give no rows; further columns are not looked at.
    """
    return pack(stored(tokenized(docs.select("doc_id", "text"), path or vocabulary(), capacity)), capacity)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
