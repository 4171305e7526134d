"""Lloyd's clustering with the dimensions dealt over shards.

A vector is cut into column blocks.  A task over a block computes exact partial distances against the block's slice of the
centroids; the partial distances of a vector are added by its key and the smallest sum names its cluster; then each block
sums its own columns by cluster and updates its own slice.  All numbers are whole, so sums don't depend on their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, stored, table

DIMENSIONS = 64
BLOCK = 16
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: A component beyond it counts as this large, so that distances fit a long.
LARGEST = (1 << 27) - 1


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vec_id, v) of the vectors with the right number of components, all finite, as whole numbers; written once.

    Any other vector is left out.  ``key`` tells the rows apart, repeated ids and null ids included.
    """
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter(F.size("x") == dimensions)
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("x", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    kept = kept.filter(F.coalesce(finite, F.lit(False)))
    return stored(kept.select(F.monotonically_increasing_id().alias("key"), "vec_id", scaled.alias("v")))


def blocks(points: DataFrame, dimensions: int = DIMENSIONS, width: int = BLOCK) -> DataFrame:
    """(key, vec_id, part, block) with a row for each column block, written in a folder for each block."""
    parts = F.array(*[F.struct(F.lit(at // width).alias("block"), F.slice("v", at + 1, width).alias("part")) for at in range(0, dimensions, width)])
    return stored(points.select("key", "vec_id", F.inline(parts)).select("key", "vec_id", "part", "block"), partition_by="block")


def first_centroids(points: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose digests of ``1:<vec_id>`` come first, a row each; ties go by the components.

    Fewer vectors give fewer centroids.  ``clusters`` rows go to the driver.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = points.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(clusters).collect()
    return np.array([row["v"] for row in first], np.int64)


def partial_distances(parts: DataFrame, centroids: np.ndarray, width: int = BLOCK) -> DataFrame:
    """(key, vec_id, d0, d1, ...) for each block row: squared distances to the centroids' slices of that block."""
    k = len(centroids)
    kind = dict(parts.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            flat = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = batch.column("part").value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            out = np.zeros((k, len(block)), np.int64)
            for b in np.unique(block):
                rows = np.flatnonzero(block == b)
                own = centroids[:, b * width : (b + 1) * width]
                x = flat[starts[rows][:, None] + np.arange(own.shape[1])]
                for c in range(k):
                    gap = x - own[c]
                    out[c, rows] = np.einsum("ij,ij->i", gap, gap)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vec_id"), *map(pa.array, out)], names=["key", "vec_id", *[f"d{c}" for c in range(k)]])

    return parts.select("key", "vec_id", "part", "block").mapInArrow(run, f"key long, vec_id {kind}, " + ", ".join(f"d{c} long" for c in range(k)))


def assigned(parts: DataFrame, centroids: np.ndarray, width: int = BLOCK) -> DataFrame:
    """(key, vec_id, cluster, distance): the nearest centroid of each vector, the smaller number among equals."""
    names = [f"d{c}" for c in range(len(centroids))]
    summed = partial_distances(parts, centroids, width).groupBy("key", "vec_id").agg(*[F.sum(d).alias(d) for d in names])
    least = F.least(*names) if len(names) > 1 else F.col(names[0])
    cluster = reduce(lambda later, c: F.when(F.col(names[c]) == F.col("distance"), c).otherwise(later), range(len(names) - 1, -1, -1), F.lit(None))
    return summed.withColumn("distance", least).select("key", "vec_id", cluster.cast("int").alias("cluster"), "distance")


def _floor_mean(total: Column, n: Column) -> Column:
    """floor(total / n) of whole numbers, exactly."""
    return F.expr("({0} - pmod({0}, {1})) div {1}".format(total, n))


def moved(parts: DataFrame, nearest: DataFrame, centroids: np.ndarray, width: int = BLOCK) -> np.ndarray:
    """Each block's slice of the centroids after its vectors; a cluster without vectors stays.

    The sums are made by (block, cluster) with map-side sums; as many rows as clusters times blocks go to the driver.
    """
    joined = parts.select("key", "part", "block").join(nearest.select("key", "cluster"), "key")
    sums = [F.sum(F.get("part", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(width)]
    totals = joined.groupBy("block", "cluster").agg(F.count(F.lit(1)).alias("n"), *sums)
    means = totals.select("block", "cluster", F.array(*[_floor_mean(f"s{i}", "n") for i in range(width)]).alias("mean"))
    out = centroids.copy()
    for block, cluster, mean in means.collect():
        own = out[cluster, block * width : (block + 1) * width]
        own[:] = mean[: len(own)]
    return out


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = BLOCK,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dimensions`` finite components.

    Vectors of another length, null vectors and vectors with a null, NaN or infinite component are left out.  Repeated rows and null
    ids stay, each row for itself.  A component beyond 2 ** 27 counts as 2 ** 27 - 1, with its sign.  Fewer vectors than clusters give
    as many clusters as vectors; no vectors give no rows.  Further columns are not looked at.  Only the centroids
    (``clusters`` times ``dimensions`` numbers) are on the driver and sent to the tasks.
    """
    points = whole(vectors, id_col, vector_col, dimensions)
    centroids = first_centroids(points, clusters)
    columns = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if len(centroids) == 0:
        return points.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")])
    parts = blocks(points, dimensions, width)
    for _ in range(rounds):
        centroids = moved(parts, assigned(parts, centroids, width), centroids, width)
    found = stored(assigned(parts, centroids, width))
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(n for _, n in inertia)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # a row for each cluster: a proven bound
    sums = found.sparkSession.createDataFrame([(c, n, total, digest[c]) for c, n in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """All rounds written out: distances over (vector, centroid, dimension) rows, exact floors of sums."""
    steps = [
        "points AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM points QUALIFY c < 16)",
    ]
    for r in range(ROUNDS + 1):
        gaps = "list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - q.m[i]) * (p.v[i] - q.m[i])))::BIGINT"
        steps.append(f"a{r} AS (SELECT p.k, p.vec_id, p.v, q.c, q.m, {gaps} AS d FROM points p, c{r} q QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY d, q.c) = 1)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)")
            steps.append(f"u{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS (SELECT c{r}.c, coalesce(u{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN u{r} ON c{r}.c = u{r}.c)")
    return (
        "WITH " + ", ".join(steps) + f" SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,"
        f" (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{ROUNDS}"
    )


@query("op12_sharded_lloyd", _sql())
def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))
