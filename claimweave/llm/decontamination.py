"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, small_side, stored, table

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
PAIRS_AT_ONCE = 1024


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _with_grams(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_grams``, the hashes of all word n-grams of a text in order."""
    hashed = df.withColumn("_w", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    grams = F.col("_w")
    cut = lambda skip, drop: F.slice("_w", F.lit(skip + 1), F.greatest(F.size("_w") - (skip + drop), F.lit(0)))
    grams = cut(0, SEED_WORDS - 1)
    for i in range(1, SEED_WORDS):
        grams = F.zip_with(grams, cut(i, SEED_WORDS - 1 - i), lambda a, b: F.xxhash64(a, b))
    return hashed.withColumn("_grams", grams).drop("_w")


def aligned(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Best local alignment score of one item with each row of ``regions`` (word ids, padded with -1).

    One step for each item word and all regions at once; a row of the table takes its gaps along
    the region from a running maximum.
    """
    columns = np.arange(regions.shape[1] + 1) * -GAP
    last = np.zeros((len(regions), regions.shape[1] + 1), np.int32)
    best = np.zeros(len(regions), np.int32)
    for word in item:
        row = np.zeros_like(last)
        row[:, 1:] = last[:, :-1] + np.where(regions == word, MATCH, MISMATCH)
        row[:, 1:] = np.maximum(row[:, 1:], last[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + columns, axis=1) - columns
        best = np.maximum(best, row.max(axis=1))
        last = row
    return best


def _scored(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Score of each region; 0 where fewer of its words are words of the item than ``threshold`` takes."""
    for batch in batches:
        found = np.zeros(len(batch))
        for _, rows in batch.groupby("item_text", sort=False).indices.items():
            words = batch["item_text"].iat[rows[0]].split(" ")
            ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
            item = np.array([ids[w] for w in words])
            every = ((i, [ids.get(w, -1) for w in batch["region"].iat[i].split(" ")]) for i in rows)
            hopeful = [(i, codes) for i, codes in every if len(codes) - codes.count(-1) >= threshold * len(item) - 1e-9]
            for at in range(0, len(hopeful), PAIRS_AT_ONCE):
                part, coded = zip(*hopeful[at : at + PAIRS_AT_ONCE], strict=True)
                padded = np.full((len(part), max(map(len, coded))), -1)
                for i, codes in enumerate(coded):
                    padded[i, : len(codes)] = codes
                found[list(part)] = aligned(item, padded) / (MATCH * len(item))
        yield pd.DataFrame({"doc": batch["doc"], "item_id": batch["item_id"], "score": found})


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score) of every document and test item whose best alignment reaches ``threshold``.

    Score: local alignment of words (2 for an equal word, -1 for a replaced, left out or added one) as a
    share of the item aligned with itself.  1 is a verbatim copy, 0.5 one in which a third of the
    words differ, or half of the item.

    Seeds are all word trigrams of the items, however common, so a copy is found if three words in a row
    of it are unchanged.  A seed hit places the item in the document; hits on nearby diagonals
    share a region, and equal regions of a document are aligned once.  A region with too few words of
    the item to reach ``threshold`` is not aligned, which changes no result.  Hits times the items that share a trigram
    are counted up where they arise and only regions move on.

    Null and empty texts and items of fewer than three words match nothing.  Rows that share an id are
    one document whose score is the best of its rows; so are null ids.  Of items that share an id the best score
    counts.  Empty tables give no rows; further columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    given = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") >= SEED_WORDS)
    given = given.select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("item_text"))
    given = stored(given.withColumn("item", F.xxhash64("item_id", "item_text")).distinct())
    tests = stored(_with_grams(given, "item_text").select("item", "n", F.posexplode("_grams").alias("at", "gram")))
    wanted = small_side(stored(tests.select("gram").distinct()))
    # the outer form: else a filter on the size of the array is put below, and the grams are made twice
    exploded = _with_grams(docs, "text").select("doc", F.posexplode_outer("_grams").alias("pos", "gram"))
    hits = exploded.join(wanted, "gram", "left_semi")
    placed = hits.join(small_side(tests), "gram").select("doc", "item", "n", (F.col("pos") - F.col("at")).alias("diagonal"))
    wide = F.greatest(F.lit(8), F.floor(F.col("n") / 2)).cast("int")
    groups = placed.groupBy("doc", "item", "n", F.floor(F.col("diagonal") / wide).alias("part"))
    near = groups.agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    slack = F.floor(F.col("n") / 4).cast("int") + 4
    start = F.greatest(F.col("low") - slack, F.lit(0))
    region = F.struct("item", (start + 1).alias("first"), (F.col("high") + F.col("n") + slack - start).alias("size"))
    by_doc = stored(near.groupBy("doc").agg(F.collect_list(region).alias("regions")))
    # only the ids go to the scan, and only while they are few; the lists of regions meet the texts that are left
    found = by_doc.withColumnRenamed("doc", "_doc")
    held = docs.join(small_side(found.select("_doc")), F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
    read = held.join(found, F.col("doc").eqNullSafe(F.col("_doc"))).select("doc", "regions", words_of(F.col("text")).alias("w"))
    cut = F.transform("regions", lambda r: F.struct(r["item"].alias("item"), F.array_join(F.slice("w", r["first"], r["size"]), " ").alias("region")))
    regions = read.select("doc", F.explode(F.array_distinct(cut)).alias("r")).select("doc", "r.item", "r.region").filter("region <> ''")
    regions = regions.repartition("doc", "region").join(small_side(given), "item").select("doc", "item_id", "item_text", "region")
    kinds = f"doc {dict(docs.dtypes)['doc']}, item_id {dict(items.dtypes)['item_id']}, score double"
    scored = regions.mapInPandas(partial(_scored, threshold=threshold), kinds)
    best = scored.groupBy("doc", "item_id").agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)
    return best.withColumnRenamed("doc", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose text holds no copy of a test item, columns as they came; rows that share an id, or have none, go by their own texts."""
    key = F.concat_ws("|", docs["doc_id"].cast("string"), F.length(docs["text"]).cast("string"), F.xxhash64(docs["text"]).cast("string"))
    found = contaminated(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(found, key == found["_held"], "left_anti")


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
