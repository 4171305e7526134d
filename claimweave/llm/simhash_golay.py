"""SimHash near-duplicates linked through the indices of the (23, 12) Golay code.

The query links fingerprints within two bits.  The pipeline's stage joins five-word shingles of a likeness of 0.8, through the same
indices of several fingerprints and, for what these leave out, through the rarest shingles of each text, and verifies every link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimweave.llm.common import components, query, small_side, stored, table

#: The generator polynomial of the binary Golay code and its length.
GENERATOR, LENGTH = 0xC75, 23
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
PAIRED_UP_TO = 32
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of XXH64 over the word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if n == 1:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=42), shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch["_t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"_i": batch["_i"], "fp": values})

    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    return slim.mapInPandas(run, f"_i {kind}, fp long").withColumnRenamed("_i", id_col)


def _remainder(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _errors() -> np.ndarray:
    """The error pattern of at most three bits for each of the 2,048 remainders."""
    patterns = np.array([sum(1 << i for i in c) for k in range(4) for c in combinations(range(LENGTH), k)], np.int64)
    out = np.zeros(2048, np.int64)
    out[_remainder(patterns)] = patterns
    return out


ERRORS = _errors()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index of the one codeword within three bits of each 23-bit word."""
    return (words ^ ERRORS[_remainder(words)]) >> 11


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """The indices of each word and of its 23 neighbours, a row each (at most six differ).

    Two words within two bits have a word in between that neighbours both, so their rows meet.
    """
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(np.int64)
    return codeword_index((words[:, None] ^ flips[None, :]).ravel()).reshape(len(words), -1)


def golay_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: one segment as it is with an index of the next one, distinct for each row.

    Two errors leave one of three segments untouched, and any other segment has two errors at most.
    """
    values = values.view(np.uint64)
    parts = [(values >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i, part in enumerate(parts):
        near = np.sort(nearby_indices(parts[(i + 1) % 3]), axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(fresh)
        rows.append(row)
        keys.append((np.int64(i) << 40) | (part[row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy(np.int64)
        rows, keys = golay_keys(fps)
        yield pd.DataFrame({"key": keys, "fp": fps[rows]})


def links(fps: DataFrame, paired_up_to: int = PAIRED_UP_TO) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that differ in one or two bits, enough to connect all that link.

    Fingerprints that meet under a Golay key are compared in pairs where the key has few.  Those
    under a crowded key are linked through the words in between: all fingerprints one bit from the
    same word are within two bits of each other, so each is tied to the smallest one there.  Both
    ways miss no link, and the work is linear in the fingerprints.
    """
    keyed = stored(fps.select("fp").mapInPandas(_keyed, "key long, fp long"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(keyed.join(counts, "key"))
    few = shared.filter(F.col("n") <= paired_up_to)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & close).select("a", "b")
    crowd = shared.filter(F.col("n") > paired_up_to).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    middle = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("w"))
    least = middle.groupBy("w").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    tied = middle.join(least, "w").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(tied).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): documents whose fingerprints are joined by links of at most two bits.

    A null or word-less text has fingerprint 0 and links like any other.  Repeated rows and equal
    texts share a fingerprint, so they are one node of the graph however many there are.  A null id
    never becomes a component's id unless all its members' ids are null.  No rows in, no rows out.
    """
    prints = stored(fingerprints(docs.select(id_col, text_col), id_col, text_col))
    nodes = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    classes = components(links(nodes))
    known = nodes.join(classes, nodes["fp"] == classes["node"]).select("fp", "root", "least")
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = known.join(roots, "root").select("fp", "component_id")
    alone = nodes.join(classes, nodes["fp"] == classes["node"], "left_anti").select("fp", F.col("least").alias("component_id"))
    return prints.join(linked.unionByName(alone), "fp").select(id_col, "fp", "component_id")


#: Seeds of the mixed hashes of the stage; each gives two segments of 23 bits and two anchors.
SEEDS = tuple(range(1, 5))
BITS = 64 * len(SEEDS)
#: Longs of parity bits a text; texts of which one in so many is counted to find shingles that many share; shingles so ordered.
MARKS, ORDER_FROM, ORDERED = 8, 16, 1 << 18
#: Texts of one part of a crowded key that meet all texts of the key.
SIDE = 1024
#: Of the bits of two texts this share may differ before they are compared word by word (0.15 is expected at a likeness of 0.8).
FAR = 0.25


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Further hashes of the same shingles: a finalising mix of the hash and a seed."""
    x = hashes + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words has one, of all its words, or none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), seed=42)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(partial(xxh64_intdigest, seed=42), shingles), np.uint64, len(words) - width + 1))


def banded(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """(keys, sketch) of a set of shingles.

    The sketch is a majority fingerprint of 64 bits a seed.  Two 23-bit segments of each are decoded to the indices of
    the codewords nearby, and an index becomes a key together with an anchor, the least or greatest shingle under that seed's hash.  Texts
    meet under a key if they share the anchor and the segments differ by two bits (and often if by more); of 8 segments
    one has at most two errors while they differ by 23 bits in all.  The anchor keeps strangers apart, and the index
    keeps apart texts that only share a passage.
    """
    keys: list[int] = []
    sketch: list[int] = []
    for seed in SEEDS:
        mixed = _mixed(hashes, seed)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(mixed), CHUNK):
            part = mixed[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = counts * 2 > len(mixed)
        value = np.packbits(bits, bitorder="little").view("<u8")
        sketch.append(int(value.view(np.int64)[0]))
        segments = np.array([int(value[0]) & 0x7FFFFF, int(value[0]) >> 23 & 0x7FFFFF], np.int64)
        for i, (near, anchor) in enumerate(zip(nearby_indices(segments), (mixed.min(), mixed.max()), strict=True)):
            place = np.uint64(seed * 2 + i) << np.uint64(12)
            unique = np.unique(near).astype(np.uint64) | place
            keys.extend(_mixed(unique ^ anchor, 99).view(np.int64).tolist())
    return keys, sketch


def rare_first(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The sorted hashes with those of ``common`` (most frequent first) put last, the least frequent of them first."""
    if len(common) == 0:
        return hashes
    order = np.argsort(common)
    at = np.minimum(np.searchsorted(common, hashes, sorter=order), len(common) - 1)
    place = order[at]
    known = common[place] == hashes
    return np.concatenate([hashes[~known], common[np.sort(place[known])[::-1]]])


def prefix_length(size: int, least: float) -> int:
    """So many first shingles of two sets, in one order of all shingles, have one in common if their likeness is ``least``."""
    return size - math.ceil(least * size - 1e-9) + 1


def parities(hashes: np.ndarray, longs: int = MARKS) -> np.ndarray:
    """For each of 64 * longs buckets, whether it holds an odd number of the hashes: two sets differ in as many elements at least as these bits."""
    odd = np.bincount((hashes % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").astype(np.int64)


def differing_at_least(a: np.ndarray, b: np.ndarray) -> int:
    """Differing parities of two sets, the longer (both a power of two) folded to the shorter."""
    if len(a) < len(b):
        a, b = b, a
    return int(np.bitwise_count((np.bitwise_xor.reduce(a.reshape(-1, len(b))) ^ b).view(np.uint64)).sum())


def _keys_of_texts(width: int, least: float, common: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [(node, s) for node, s in zip(batch["node"], (shingle_set(t, width) for t in batch["text"]), strict=True) if len(s)]
            if not sets:  # pandas would make columns of numbers of the empty lists
                continue
            made = [banded(s) for _, s in sets]
            yield pd.DataFrame(
                {
                    "node": np.array([node for node, _ in sets], np.int64),
                    "same": np.array([xxh64_intdigest(s.tobytes()) for _, s in sets], np.uint64).view(np.int64),
                    "size": np.array([len(s) for _, s in sets], np.int64),
                    "rare": [rare_first(s, common)[: prefix_length(len(s), least)].view(np.int64) for _, s in sets],
                    "marks": [parities(s) for _, s in sets],
                    "keys": [k for k, _ in made],
                    "sketch": [s for _, s in made],
                }
            )

    return run


def _sets_of_texts(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t, width).view(np.int64) for t in batch["text"]]})

    return run


def _parities_of_texts(width: int):
    """Four buckets a shingle or more, so that few pairs just below the bound are left for the whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            bits = [parities(s, 1 << (len(s) // 16).bit_length()).astype("<i8").tobytes() for s in sets]
            yield pd.DataFrame({"node": batch["node"], "size": [len(s) for s in sets], "bits": bits})

    return run


def _within(least: float):
    """Keeps the pairs whose sizes and parities do not rule out a likeness of ``least``."""
    most = (1 - least) / (1 + least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = batch["size_a"] + batch["size_b"]
            apart = [differing_at_least(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")) for a, b in zip(batch["bits_a"], batch["bits_b"], strict=True)]
            yield batch.loc[np.array(apart, np.int64) <= most * total.to_numpy() + 1e-9, ["a", "b"]]

    return run


def _differing(a: list[int], b: np.ndarray) -> np.ndarray:
    """Bits in which a sketch differs from each row of sketches."""
    return np.bitwise_count(np.array(a, np.int64).view(np.uint64)[None, :] ^ b.view(np.uint64)).sum(axis=1)


def _led(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, node): each node with the earlier leaders of its key it is near to; one near to none is a leader.

    A leader comes out paired with itself.  Only the leaders of the present key are held.
    """
    now: tuple | None = None
    leaders: list[int] = []
    held = np.zeros((16, len(SEEDS)), np.int64)
    for batch in batches:
        rows: list[tuple[int, int, int]] = []
        for key, part, node, sketch in zip(batch["key"], batch["part"], batch["node"], batch["sketch"], strict=True):
            if (key, part) != now:
                now, leaders = (key, part), []
            near = np.flatnonzero(_differing(sketch, held[: len(leaders)]) <= FAR * BITS) if leaders else ()
            rows.extend((key, leaders[i], node) for i in near)
            if len(near) == 0:
                if len(leaders) == len(held):
                    held = np.concatenate([held, np.zeros_like(held)])
                held[len(leaders)] = sketch
                leaders.append(node)
                rows.append((key, node, node))
        yield pd.DataFrame(rows, columns=["key", "a", "b"])


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that many texts share, most frequent first, counted over one text in ORDER_FROM.

    They only say which shingles come last in the order of all, which changes the work and no result.
    """
    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(ORDER_FROM)) == 0).groupBy("node").agg(F.first("text").alias("text"))
    found = some.mapInPandas(_sets_of_texts(width), "node long, shingles array<long>").select(F.explode("shingles").alias("shingle"))
    counts = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    rows = counts.orderBy(F.desc("n"), "shingle").limit(ORDERED).select("shingle").toPandas()
    return rows["shingle"].to_numpy(np.int64).view(np.uint64)


def _led_pairs(known: DataFrame) -> DataFrame:
    """Candidates (a, b): nodes that meet under a Golay key follow the leaders there (nodes near to no earlier one).

    They do so in parts of the key first and then over the leaders of all its parts, so a key of many near copies costs
    its rows times a few leaders and no pairs.
    """
    keyed = known.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(keyed.join(shared, "key").join(known.select("node", "sketch"), "node"))
    # keys of few rows are whole in one part
    part = F.when(F.col("n") > 64, F.pmod(F.xxhash64("node"), F.least(F.lit(1 << 20), F.ceil(F.col("n") / 64)))).otherwise(F.lit(0).cast("long"))
    schema = "key long, a long, b long"
    first = met.select("key", part.alias("part"), "node", "sketch").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    first = stored(first.mapInPandas(_led, schema))
    split = met.filter("n > 64").select("key").distinct()
    heads = first.filter("a = b").join(split, "key", "left_semi").select("key", F.col("a").alias("node")).join(known.select("node", "sketch"), "node")
    second = heads.select("key", F.lit(0).cast("long").alias("part"), "node", "sketch").repartition("key").sortWithinPartitions("key", "node").mapInPandas(_led, schema)
    return first.unionByName(second).filter("a <> b").select("a", "b")


def _sizes_alike(least: float) -> Column:
    """False only for rows (size, other_size) whose sizes rule out a likeness of ``least``."""
    return F.least("size", "other_size") >= least * F.greatest("size", "other_size") - 1e-9


def _marks_alike(least: float) -> Column:
    """False only for rows (size, marks, other_size, other_marks) whose parities rule out a likeness of ``least``."""
    bits = sum(F.bit_count(F.col("marks")[i].bitwiseXOR(F.col("other_marks")[i])) for i in range(MARKS))
    return bits <= (1 - least) / (1 + least) * (F.col("size") + F.col("other_size")) + 1e-9


def _others(met: DataFrame) -> DataFrame:
    return met.withColumnsRenamed({"node": "other", "size": "other_size", "marks": "other_marks", "root": "other_root"})


def _pairs_of(joined: DataFrame, least: float) -> DataFrame:
    alike = _sizes_alike(least) & _marks_alike(least) if "marks" in joined.columns else _sizes_alike(least)
    return joined.filter(alike).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _across(crowd: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) of crowded keys that ``edges`` do not connect yet.

    Under each key the nodes outside the largest component there meet all nodes, dealt out in parts of SIDE of them.
    """
    roots = components(edges)
    met = crowd.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = stored(met)
    sizes = met.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    spans = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).filter("n > most.n")
    spans = stored(spans.select("key", F.col("most.root").alias("large"), F.ceil((F.col("n") - F.col("most.n")) / SIDE).alias("parts")))
    outside = met.join(spans, "key").filter("root <> large").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    every = _others(met).join(spans.select("key", "parts"), "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = outside.drop("parts").join(every.drop("parts"), ["key", "part"])
    return _pairs_of(pairs.filter("root <> other_root AND (other_root = large OR node < other)"), least)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of a likeness of ``least``: first by their parities, which rule most of the others out, then on the whole sets."""

    def of_nodes(pairs: DataFrame, run, schema: str) -> DataFrame:
        wanted = small_side(stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        return stored(texts.join(wanted, "node", "left_semi").mapInPandas(run, schema).dropDuplicates(["node"]))

    pairs = stored(pairs.distinct())
    bits = of_nodes(pairs, _parities_of_texts(width), "node long, size long, bits binary")
    for side in ("a", "b"):
        pairs = pairs.join(bits.withColumnsRenamed({"node": side, "size": f"size_{side}", "bits": f"bits_{side}"}), side)
    pairs = stored(pairs.mapInPandas(_within(least), "a long, b long"))
    sets = of_nodes(pairs, _sets_of_texts(width), "node long, shingles array<long>")
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stored(both.filter(common >= least * (F.size("x") + F.size("y") - common)).select("a", "b"))


def similar_texts(texts: DataFrame, width: int = 5, least: float = 0.8, paired_up_to: int = PAIRED_UP_TO) -> DataFrame:
    """Edges (a, b), a < b, between nodes of different ``texts`` (node, text) whose shingle sets have a Jaccard likeness of ``least``.

    No link is lost: the edges connect all that link.  Texts of equal sets are tied to the smallest node of them, which stands for all.
    Candidates come from Golay keys and, exactly, from the first shingles of each set in one order of all shingles, which two
    sets that are alike share.  Nodes under a first shingle are compared in pairs where it has at most ``paired_up_to``.  Under a
    crowded one each is compared with the next one there, and then those with one another that no edges found so far connect.
    Every edge is verified on the whole sets.  Equal nodes may come repeated.
    """
    made = texts.mapInPandas(
        _keys_of_texts(width, least, common_shingles(texts, width)),
        "node long, same long, size long, rare array<long>, marks array<long>, keys array<long>, sketch array<long>",
    )
    made = stored(made)
    if not made.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        made = stored(made.dropDuplicates(["node"]))
    heads = made.groupBy("same").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = stored(made.join(heads, "same").filter("node <> a").select("a", F.col("node").alias("b")))
    known = made.join(small_side(ties.select(F.col("b").alias("node"))), "node", "left_anti")
    under = Window.partitionBy("key")
    met = known.select(F.explode("rare").alias("key"), "node", F.col("size").cast("int"))
    met = stored(met.withColumn("n", F.count(F.lit(1)).over(under)).filter("n > 1"))
    few, crowd = met.filter(F.col("n") <= paired_up_to).drop("n"), met.filter(F.col("n") > paired_up_to).drop("n")
    crowd = stored(crowd.join(known.select("node", "marks"), "node"))
    near = _pairs_of(few.join(_others(few), "key").filter("node < other"), least)
    row = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node")
    ahead = {"other": "node", "other_size": "size", "other_marks": "marks"}
    after = _pairs_of(crowd.withColumns({k: F.lead(c).over(row) for k, c in ahead.items()}).filter("other IS NOT NULL"), least)
    edges = _verified(_led_pairs(known).unionByName(near).unionByName(after), texts, width, least)
    if not crowd.isEmpty():
        edges = edges.unionByName(_verified(_across(crowd, edges, least), texts, width, least))
    return edges.unionByName(ties)


def keep_one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of every group of documents that are joined by links of likeness ``least``: the one with the smallest id.

    Rows go by their ids and texts together, so rows that share an id or have none stand each for itself, and of
    equal rows one stays.  Equal texts are one group whatever their ids.  A null id sorts last, among equal ids the smaller digest stays.
    A text without words is near to equal texts alone; a null text counts as empty.  No rows give no rows; further columns are carried.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.xxhash64(text, F.md5(text))
    marked = docs.withColumn("_digest", digest)
    rows = marked.groupBy(F.col("_digest").alias("node"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n")).alias("first")))
    classes = components(similar_texts(marked.select(F.col("_digest").alias("node"), "text"), width, least))
    roots = nodes.join(classes, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    kept = roots.groupBy("root").agg(F.min(F.struct("first", "node")).alias("least"))
    kept = stored(kept.select(F.col("least.node").alias("_node"), F.col("least.first.doc_id").alias("_id"), F.col("least.first.n").alias("_n")))
    chosen = marked.join(kept, (F.col("_digest") == F.col("_node")) & docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    if not kept.filter("_n > 1").isEmpty():
        chosen = chosen.dropDuplicates(["_digest"])
    return chosen.select(*docs.columns)


@query("op7_simhash_golay")
def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
