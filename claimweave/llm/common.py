"""What the operators of this folder share: registry, tables, written intermediate results, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` gives the same rows in DuckDB."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session that names none gets one of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: later jobs start from the files.

    ``partition_by`` names the last column, each value of which gets a folder of its own.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 100) -> DataFrame:
    """(node, root) of every node of an undirected graph, root being the smallest node reachable.

    Alternating large-star and small-star steps over the edge table: every step is two shuffles
    by node with map-side minima, no neighbour list is gathered, and a step's edges are written
    before the next one starts.  A hub is split by the skew handling of the join.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = stored(now)
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u move to the smallest node around u
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct())
        # small star: neighbours below u, and u itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        after = stored(small.filter("u <> v").distinct())
        same = after.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(after, ["u", "v"], "left_anti").isEmpty()
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Marks ``df`` for broadcast if a count of at most ``max_rows`` + 1 rows proves it small, else leaves the join to a shuffle.

    For tables already written and of a few numbers a row; the result of the join is the same.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
