"""Size checks, hot-key handling and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.automata import MAX_SHARDS, SHARD_CHARS, found_terms, term_shards

BROADCAST_MAX_ROWS = 200_000
SETTLED_MAX_ROWS = 50_000
HOT_ROWS = 100_000


def session_options() -> dict[str, str]:
    """Options the jobs are tuned for; values a cluster sets itself are left alone."""
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads at most one row more."""
    return df.limit(max_rows + 1).count() <= max_rows


def settle(df: DataFrame, max_rows: int = SETTLED_MAX_ROWS) -> tuple[DataFrame, list[tuple] | None]:
    """Evaluates a small parameter table (a lexicon, a publisher list) once.

    With at most ``max_rows`` rows the table comes back as a local relation together with its
    rows, so that the plans built on it neither repeat its own plan nor need another
    size check.  A larger one comes back as it is, with None.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, None
    local = df.sparkSession.createDataFrame(rows, df.schema)
    columns = [c.to_pylist() for c in rows.columns]
    return local, list(zip(*columns, strict=True))


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_MAX_ROWS,
    small: bool | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a large fact side to a lookup table.

    A table that passes the size check is broadcast (``small`` states the outcome where the
    caller has checked already).  A larger one is joined by shuffle through ``hot_key_join``: the keys
    that hold many facts are spread over several partitions and repeated, all others are not.
    """
    if fits_broadcast(table, max_rows) if small is None else small:
        return facts.join(F.broadcast(table), on, how)
    return hot_key_join(facts, table, on, hot_rows, how=how)


def hot_key_join(
    facts: DataFrame,
    other: DataFrame,
    on: str | list[str],
    hot_rows: int = HOT_ROWS,
    max_hot: int = BROADCAST_MAX_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Inner or left join where only the keys that are hot on the fact side are split.

    The keys with more than ``hot_rows`` fact rows are counted first (map-side
    combined, key columns only).  Their facts are spread over one salt per
    ``hot_rows`` rows and just those keys are repeated on the other side, so wide rows of
    ordinary keys are shuffled once.  Facts of a left join whose key is null are spread like any hot key.
    """
    on = [on] if isinstance(on, str) else list(on)
    hot = (
        facts.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*[F.col(c).alias(f"_hot_{c}") for c in on], F.ceil(F.col("_n") / F.lit(hot_rows)).cast("long").alias("_parts"))
    )
    hot = cut_lineage(hot)
    n_hot = hot.limit(max_hot + 1).count()
    if n_hot == 0:
        return facts.join(other, on, how)
    if n_hot <= max_hot:
        hot = F.broadcast(hot)
    parts = F.coalesce(F.col("_parts"), F.lit(1).cast("long"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on])
    left = facts.join(hot, same, "left").withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), parts))
    right = other.join(hot, same, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    out = left.select(*facts.columns, "_salt").join(right.select(*other.columns, "_salt"), [*on, "_salt"], how)
    return out.drop("_salt")


def lookup_keys(keys: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Distinct keys for a semi-join, marked for broadcast where a count proves them few; their plan runs once."""
    keys = cut_lineage(keys)
    return F.broadcast(keys) if fits_broadcast(keys, max_rows) else keys


def contains_join(
    texts: DataFrame,
    terms: DataFrame,
    text_col: str,
    term_col: str,
    gram: int = 3,
    shard_chars: int = SHARD_CHARS,
    max_shards: int = MAX_SHARDS,
) -> DataFrame:
    """Pairs of rows where the text contains the term as a substring.

    Terms of up to ``shard_chars * max_shards`` characters in all (checked) become automata: each text is read once for a shard
    of terms, where it lies, and only its hits meet the terms again.  More terms go through an index: each term is filed under its
    first ``gram`` characters, only (row, gram) moves, grams no term starts with are dropped first
    where the starts are few, and each text is fetched once for its candidates and tested.
    """
    shards = term_shards(terms, term_col, shard_chars, max_shards)
    if shards is None:
        return _contains_by_gram(texts, terms, text_col, term_col, gram)
    hits = texts.withColumn("_hit", F.explode(found_terms(F.col(text_col), shards))).withColumn("_hit", F.col("_hit.term"))
    others = terms.filter(F.col(term_col).isNotNull()).withColumn("_hit", F.col(term_col))
    return lookup_join(hits, others, ["_hit"]).drop("_hit")


def _contains_by_gram(texts: DataFrame, terms: DataFrame, text_col: str, term_col: str, gram: int) -> DataFrame:
    """``contains_join`` for terms of any number.

    The rows are written with a number first, since they are read twice.  Terms shorter than a gram are filed under themselves, and
    the grams of their lengths are made only if there are such terms.
    """
    texts = cut_lineage(texts.withColumn("_key", F.monotonically_increasing_id()))
    filed = terms.filter(F.col(term_col).isNotNull()).withColumn("_gram", F.substring(term_col, 1, gram))
    sizes = [r[0] for r in filed.select(F.length("_gram")).distinct().collect()]

    def grams(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text_col) - (n - 1)))
        return F.transform(starts, lambda i: F.substring(F.col(text_col), i, F.lit(n)))

    own = F.array_distinct(F.concat(*[grams(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    first = lookup_keys(filed.select("_gram").distinct())
    placed = texts.select("_key", F.explode_outer(own).alias("_gram")).join(first, "_gram", "left_semi")
    candidates = hot_key_join(placed, filed, "_gram").drop("_gram").distinct()
    held = F.struct(*[c for c in filed.columns if c != "_gram"])
    by_text = candidates.groupBy("_key").agg(F.collect_set(held).alias("_terms"))
    met = texts.join(by_text, "_key").withColumn("_term", F.explode("_terms")).drop("_key", "_terms").select("*", "_term.*").drop("_term")
    return met.filter(F.col(text_col).contains(F.col(term_col)))


def running_totals(df: DataFrame, group: list[str], bucket: str, order: list, values: list[str]) -> DataFrame:
    """Running sums within a group without sorting a whole group in one task.

    ``bucket`` must be a monotone coarse key of ``order``.  Rows are summed up within
    (group, bucket) and shifted by the sums of the earlier buckets, a small table with
    one row per bucket.  It joins on the key the rows are already partitioned by,
    so the rows move once.  Adds ``cum_<value>`` and ``total_<value>``.
    """
    per_bucket = df.groupBy(*group, bucket).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    in_group = Window.partitionBy(*group)
    earlier = in_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *group,
        bucket,
        *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.sum(f"_{v}").over(in_group).alias(f"total_{v}") for v in values],
    )
    within = (
        Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = df.withColumns({f"cum_{v}": F.sum(v).over(within) for v in values})
    joined = summed.join(offsets, [*group, bucket])
    return joined.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"_before_{v}") for v in values}).drop(
        *[f"_before_{v}" for v in values]
    )


def global_rank(df: DataFrame, group: list[str], bucket: str, order: list, rank: str, size: str) -> DataFrame:
    """Exact row number and row count of every group, by ``running_totals``."""
    counted = running_totals(df.withColumn("one", F.lit(1).cast("long")), group, bucket, order, ["one"])
    return counted.withColumnsRenamed({"cum_one": rank, "total_one": size}).drop("one")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster: the one named by ``spark.checkpoint.dir``.

    Only a session that names none (a local test) gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder of the cluster and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for many rows: Parquet in the same folder, in which values that repeat cost next to nothing.

    A checkpoint holds every row in full and uncompressed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
