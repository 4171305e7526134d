import hashlib
import math
import random

import numpy as np
from compare import compare, database
from llm_helpers import SF_DIR
from pyspark.sql import functions as F

from claimweave.llm import sharded_lloyd as L

VECTORS = "vec_id long, embedding array<float>, label int"


def slow(rows, dims, clusters, rounds, scale=64):
    """Plain loops over whole vectors."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [math.floor(scale * float(np.float32(c))) for c in x]))
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in kept[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    found = [(vec_id, *nearest(v)) for vec_id, v in kept]
    inertia = sum(d for _, d, _ in found)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sum(e for _, e, k in found if k == c), inertia, digests[c]) for i, d, c in found), key=str)


def got(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def vectors(rng, n, dims):
    return [(i, [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]


def test_equals_plain_loops(spark):
    rng = random.Random(8)
    for dims, width, clusters in [(8, 3, 4), (5, 8, 3), (6, 2, 7), (4, 1, 1)]:
        rows = vectors(rng, 60, dims)
        df = spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS)
        made = L.clustered(df, dimensions=dims, clusters=clusters, rounds=3, width=width)
        assert got(made) == slow(rows, dims, clusters, 3)


def test_whole_table_equals_its_sql(spark):
    assert compare(spark, database(SF_DIR), L.op12_sharded_lloyd, L._sql(), SF_DIR)["ok"]


def test_ties_go_to_the_smaller_number_and_an_empty_cluster_stays(spark):
    # equal vectors as several centroids: all rows go to the first of them, the others keep their place without rows
    rows = [(i, [0.5, 0.5]) for i in range(9)] + [(20, [4.0, 4.0])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS)
    made = L.clustered(df, dimensions=2, clusters=6, rounds=2, width=1)
    assert got(made) == slow(rows, 2, 6, 2)


def test_partial_distances_add_up(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, x, 0) for i, x in vectors(rng, 20, 7)], VECTORS)
    points = L.whole(df, dimensions=7)
    parts = L.blocks(points, 7, 3)
    assert parts.groupBy("block").count().count() == 3
    centroids = L.first_centroids(points, 4)
    near = {r["key"]: r["distance"] for r in L.assigned(parts, centroids, 3).collect()}
    for r in points.collect():
        v = np.array(r["v"], np.int64)
        assert near[r["key"]] == min(((v - c) ** 2).sum() for c in centroids)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.3, 0.1]), (2, None), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [-inf, 0.0]),
        (6, [None, 0.0]), (7, [0.1]), (8, [0.1, 0.2, 0.3]), (9, []), (10, [-0.9, 3.0]),
    ]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS)
    messy = df.withColumns({"key": F.lit("x"), "cluster": F.lit(5), "block": F.lit("b"), "distance": F.lit(None)})
    assert got(L.clustered(messy, dimensions=2, clusters=3, rounds=2, width=1)) == slow(rows, 2, 3, 2)
    assert len(got(L.clustered(df, dimensions=2, clusters=9, rounds=1))) == 4
    none = L.clustered(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    far = spark.createDataFrame([(1, [3e38, -3e38], 0), (2, [0.0, 0.0], 0)], VECTORS)
    made = L.clustered(far, dimensions=2, clusters=2, rounds=1)
    assert sorted(r["distance"] for r in made.collect()) == [0, 0]
    doubles = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert L.clustered(doubles, dimensions=2, clusters=2, rounds=1).count() == 4
