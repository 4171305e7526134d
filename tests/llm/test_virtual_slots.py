import random
import zlib
from collections import Counter

import numpy as np
import xxhash
from llm_helpers import DOCUMENTS, SF_DIR, clashing, documents
from pyspark.sql import functions as F

from claimweave.llm import virtual_slots as V


def slow_slot(doc_id, text, slots):
    seed = 42
    if doc_id is not None:
        seed = xxhash.xxh64(int(doc_id).to_bytes(8, "little", signed=True), seed=seed).intdigest()
    digest = xxhash.xxh64((text or "").encode(), seed=seed).intdigest()
    return (digest - (1 << 64 if digest >> 63 else 0)) % slots


def check_law(rows, texts_by_id, shards):
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    for r in rows:
        data = (texts_by_id[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert 0 <= shard < shards
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_slots_are_those_of_the_plain_hash(spark):
    texts = [None, "", "é" * 7, *[f"text {i}" * (i % 9) for i in range(300)]]
    got = V.sharded(documents(spark, texts), shards=5, slots=512).collect()
    check_law(got, dict(enumerate(texts)), 5)
    assert {r["doc_id"]: r["hash_slot"] for r in got} == {i: slow_slot(i, t, 512) for i, t in enumerate(texts)}


def test_whole_table_is_level(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = V.op11_virtual_slots(spark, SF_DIR).collect()
    check_law(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 24)
    assert len(rows) == docs.count()
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["size"]
    fair = sum(held.values()) / 24
    largest = max(r["size"] for r in rows)
    assert max(held.values()) <= max(largest, fair * 1.01)


def plain_gain(shard_of, load, shards):
    """True if one slot given, or swapped for another, would bring two shards nearer: all choices tried."""
    total = [sum(w for s, w in zip(shard_of, load, strict=True) if s == k) for k in range(shards)]
    for hi in range(shards):
        for lo in range(shards):
            mine = [w for s, w in zip(shard_of, load, strict=True) if s == hi and w]
            theirs = [0] + [w for s, w in zip(shard_of, load, strict=True) if s == lo and w]
            gap = total[hi] - total[lo]
            if any(abs(gap - 2 * (a - b)) < gap for a in mine for b in theirs):
                return True
    return False


def test_rebalance_ends_where_no_edit_helps():
    rng = random.Random(4)
    for shards in (1, 2, 5):
        for _ in range(8):
            load = np.array([rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 3000)]) for _ in range(40)], np.int64)
            start = np.array([s % shards for s in range(40)], np.int64)
            after = V.rebalance(start, load, shards)
            assert not plain_gain(after.tolist(), load.tolist(), shards)
            assert (after[load == 0] == start[load == 0]).all()
    level = np.array([5, 5, 5, 5], np.int64)
    assert (V.rebalance(np.array([0, 1, 0, 1]), level, 2) == [0, 1, 0, 1]).all()


def test_grow_takes_slots_only_into_the_new_shard():
    rng = np.random.default_rng(2)
    load = rng.integers(100, 200, 600)
    before = V.rebalance(np.arange(600) % 8, load, 8)
    after = V.grow(before, load, 8)
    moved = before != after
    assert set(after[moved]) == {8}
    held = np.bincount(after, weights=load, minlength=9)
    assert held[8] >= 0.9 * load.sum() / 9 and held.max() - held.min() < 200


def test_versions_hold_only_what_changed(spark, tmp_path):
    slot_map = V.SlotMap.create(spark, str(tmp_path / "map"), 3, 12)
    first = slot_map.array()
    assert first.tolist() == [s % 3 for s in range(12)] and slot_map.version() == 0
    second = first.copy()
    second[[4, 7]] = 2
    assert slot_map.edit(second) == 1 and slot_map.edit(second) == 1
    third = second.copy()
    third[4] = 0
    assert slot_map.edit(third) == 2
    assert slot_map.edits().filter("version = 1").count() == 2 and slot_map.edits().filter("version = 2").count() == 1
    assert slot_map.array(0).tolist() == first.tolist() and slot_map.array(1).tolist() == second.tolist()
    assert slot_map.array().tolist() == third.tolist()


def test_a_stored_map_is_edited_and_not_dealt_anew(spark, tmp_path):
    path = str(tmp_path / "map")
    V.SlotMap.create(spark, path, 4, 256)
    docs = documents(spark, ["x" * (50 + i % 13) for i in range(400)])
    V.sharded(docs, 4, 256, path).count()
    slot_map = V.SlotMap(spark, path, 256)
    assert slot_map.version() == 1 and slot_map.edits().filter("version = 1").count() < 40
    more = docs.unionByName(documents(spark, ["y" * 4_000], first=1_000))
    before = slot_map.array()
    V.sharded(more, 4, 256, path).count()
    assert slot_map.version() == 2 and (slot_map.array() != before).sum() < 120


def test_a_record_that_is_a_third_of_all_rows_is_dealt_over_slots(spark):
    rows = [(7, "same text", "en", "s", 9)] * 600 + [(i, f"other {i}", "en", "s", 7) for i in range(1_000, 2_200)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = V.sharded(docs, 6, 64)
    rows = got.collect()
    check_law(rows, {7: "same text"} | {i: f"other {i}" for i in range(1_000, 2_200)}, 6)
    assert Counter(r["doc_id"] for r in rows)[7] == 600
    assert len({r["hash_slot"] for r in rows if r["doc_id"] == 7}) > 10
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["size"]
    assert max(held.values()) - min(held.values()) < 20


def test_edges(spark):
    rows = [(None, None, "en", "s", 0), (None, "a", None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "long " * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = V.sharded(clashing(docs).withColumns({"slot": F.lit(1), "shard": F.lit("x"), "digest": F.lit(0)}), 3, 32).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 8), (0, 9), (1, 8), (1, 8), (2, 1_000_008)]
    for shard, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert V.sharded(docs.limit(0)).count() == 0
