"""Streaming jobs: claims verified as they arrive, repeated queries, request rates, article de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimweave.functions import text as T
from claimweave.plans.verify import Tables, verify_claims
from claimweave.sources.postings import PostingsIndex


def verify_stream(claims: DataFrame, tables: Tables, out: str, checkpoint: str, mode: str = "balanced") -> StreamingQuery:
    """Verifies each micro-batch against the articles known when it starts.

    With ``tables.index`` a batch reads the postings of its own words and the days that hold articles it keeps; what
    ``index_articles`` added since the last batch takes part.  With ``tables.articles`` alone, every batch tokenises all of them.
    A batch is written to a folder of its own number, so a batch that runs again
    after a failure replaces its rows instead of adding to them.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        verify_claims(batch, tables, mode).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return claims.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_articles(articles: DataFrame, index: PostingsIndex, checkpoint: str) -> StreamingQuery:
    """Adds arriving articles to the index, a segment for each micro-batch; a batch that runs again replaces its segment."""

    def run(batch: DataFrame, batch_id: int) -> None:
        index.add(batch, f"batch_{batch_id}")

    return articles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _answered(times: list[int], last: int | None, span: int) -> tuple[list[int], int | None]:
    """Places of the requests that are answered, given sorted times and the last answered one."""
    out = []
    for i, t in enumerate(times):
        if last is None or t - last >= span:
            out.append(i)
            last = t
    return out, last


def suppress_repeats(
    requests: DataFrame, query_col: str = "query", ts_col: str = "ts", within: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """The requests that are answered anew: the first of each query key, and then the first one a full ``within`` after the last answered.

    A request exactly one time span later is answered again.  In a stream the time of the last answer is the state of a key; it is dropped
    when the watermark, ``lateness`` behind the newest request, has passed the end of its span.  Requests behind the watermark
    are left out.  Requests of a key within one micro-batch go in order of time; equal times give one answer.
    In a batch the distinct times of each key are folded in order, and of equal rows one is answered.
    """
    keyed = requests.withColumn("query_key", T.cache_key("query_", query_col)).withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    span = int(pd.Timedelta(within).total_seconds() * 1_000_000)
    if not requests.isStreaming:
        return _suppress_in_batch(keyed, ts_col, span)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([f for f in frames if len(f)]).sort_values(ts_col, kind="stable")
        # the filter of the engine lags by a batch: a request behind the watermark may find its key forgotten
        rows = rows[rows[ts_col].astype("datetime64[us]").astype("int64") >= state.getCurrentWatermarkMs() * 1000]
        times = rows[ts_col].astype("datetime64[us]").astype("int64").tolist()
        places, last = _answered(times, state.get[0] if state.exists else None, span)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + span) // 1000, state.getCurrentWatermarkMs() + 1))
        if places:
            yield rows.iloc[places]

    watched = keyed.withWatermark(ts_col, lateness)
    timeout = GroupStateTimeout.EventTimeTimeout
    return watched.groupBy("query_key").applyInPandasWithState(step, keyed.schema, "last long", "append", timeout)


def _suppress_in_batch(keyed: DataFrame, ts_col: str, span: int) -> DataFrame:
    times = keyed.filter(F.col(ts_col).isNotNull()).groupBy("query_key").agg(F.array_sort(F.collect_set(F.unix_micros(ts_col))).alias("_times"))
    empty = F.array().cast("array<bigint>")

    def add(kept: Column, t: Column) -> Column:
        return F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= span), F.array_append(kept, t)).otherwise(kept)

    chosen = times.select("query_key", F.explode(F.aggregate("_times", empty, add)).alias("_at"))
    first = Window.partitionBy("query_key", ts_col).orderBy(*[c for c in keyed.columns if c not in ("query_key", ts_col)])
    ranked = keyed.withColumn("_at", F.unix_micros(ts_col)).join(chosen, ["query_key", "_at"]).withColumn("_n", F.row_number().over(first))
    return ranked.filter("_n = 1").select(*keyed.columns)


def rate_flags(
    requests: DataFrame,
    key_col: str = "user_id",
    ts_col: str = "ts",
    per: str = "1 minute",
    limit: int = 60,
    lateness: str = "1 minute",
) -> DataFrame:
    """Requests per key and tumbling window, flagged above the limit; the same plan in batch and stream."""
    timed = requests.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if requests.isStreaming:
        timed = timed.withWatermark(ts_col, lateness)
    counts = timed.groupBy(key_col, F.window(ts_col, per).alias("w")).agg(F.count(F.lit(1)).alias("n_requests"))
    return counts.select(
        key_col, F.col("w.start").alias("window_start"), "n_requests", (F.col("n_requests") > limit).alias("over_limit")
    )


def dedup_article_stream(
    articles: DataFrame, ts_col: str = "published_at", within: str = "30 days", id_col: str = "article_id"
) -> DataFrame:
    """Articles whose URL was not seen within the time span; articles without URL all pass."""
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("id:"), F.col(id_col).cast("string")))
    keyed = articles.withColumn("_url_key", key).withWatermark(ts_col, within)
    return keyed.dropDuplicatesWithinWatermark(["_url_key"]).drop("_url_key")
