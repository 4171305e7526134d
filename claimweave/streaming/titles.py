"""Articles of a stream without repeats: known URLs and near-equal titles, against all articles kept so far.

What was kept is filed in a folder, a segment for each micro-batch: URLs by the bucket of the URL, titles under the few of their words that any
title near to them shares.  A batch reads the buckets of its own URLs and words, so its work follows the batch and its hits.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.functions import text as T
from claimweave.operators.retrieval import feed_position
from claimweave.scale import cut_lineage, hot_key_join, lookup_join

URLS = "value string, segment string, bucket int"
TITLES = "value string, words array<string>, segment string, bucket int"


def prefix_words(words: Column, threshold: float) -> Column:
    """The words of a set of which two sets with a Jaccard likeness over ``threshold`` share one: longest first, as a rule for rare."""
    ranked = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])
    return F.slice(ranked, 1, F.greatest(F.lit(1), F.size(words) - F.ceil(F.size(words) * F.lit(threshold)).cast("int") + 1))


class KeptArticles:
    """The kept articles under ``path``; a title is near to another if their words have a Jaccard likeness over ``threshold``."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.8, buckets: int = 64):
        self.spark, self.path, self.threshold, self.buckets = spark, path.rstrip("/"), threshold, buckets

    def _bucket(self, value: str) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _stored(self, kind: str, schema: str, values: DataFrame, segment: str) -> DataFrame | None:
        """What other segments hold for the given values, from their buckets alone; None before the first segment."""
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        buckets = [r[0] for r in values.select(self._bucket("value")).distinct().collect()]
        return rows.filter((F.col("segment") != segment) & F.col("bucket").isin(buckets)).drop("segment", "bucket")

    def _file(self, kind: str, rows: DataFrame, segment: str) -> None:
        filed = rows.withColumn("bucket", self._bucket("value")).repartition("bucket")
        filed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/segment={segment}")

    def admit(self, articles: DataFrame, segment: str) -> DataFrame:
        """The rows of ``articles`` that stay, and files them; the same segment again replaces itself.

        Rows go in order of feed, date and id, after all earlier segments.  Those of the first feed stay.  Any other goes if its
        URL (if it has one) or a title near to its own stays before it.  An empty title is near to none.
        """
        segment = re.sub(r"\W", "_", segment)
        # written first: the number of a row is given once
        rows = cut_lineage(articles.withColumn("_n", F.monotonically_increasing_id()))
        place = F.struct(feed_position().alias("feed"), F.col("published_at"), F.col("article_id"), F.col("_n"))
        url = F.nullif(F.coalesce("url", F.lit("")), F.lit(""))
        words = F.array_sort(F.array_distinct(T.words(F.lower(T.text_of("title")))))
        slim = rows.select("_n", place.alias("place"), url.alias("url"), F.when(F.size(words) > 0, words).alias("words"))
        slim = cut_lineage(slim.withColumn("set", F.xxhash64("words")).withColumn("set", F.when(F.col("words").isNotNull(), F.col("set"))))
        tested = F.col("place.feed") > 0
        sets = cut_lineage(slim.filter("set IS NOT NULL").select("set", "words").dropDuplicates(["set"]))
        keyed = cut_lineage(sets.select("set", "words", F.explode(prefix_words(F.col("words"), self.threshold)).alias("value")))
        gone = self._known(slim.filter(tested), keyed, segment)
        todo = slim.join(gone, "_n", "left_anti") if gone is not None else slim
        state = todo.select("_n", "place", "url", "set", F.when(tested, "open").otherwise("kept").alias("state"))
        kept = self._fold(cut_lineage(state), self._near_sets(keyed))
        kept = cut_lineage(kept.select("_n", "url", "set"))
        self._file("titles", keyed.join(kept.select("set").distinct(), "set", "left_semi").select("value", "words"), segment)
        self._file("urls", kept.filter("url IS NOT NULL").select(F.col("url").alias("value")).distinct(), segment)
        return rows.join(kept.select("_n"), "_n", "left_semi").drop("_n")

    def _near(self, pairs: DataFrame) -> DataFrame:
        return pairs.filter(T.jaccard_sets(F.col("words"), F.col("others")) > self.threshold)

    def _known(self, slim: DataFrame, keyed: DataFrame, segment: str) -> DataFrame | None:
        """Numbers of the rows whose URL or title other segments know."""
        asked = slim.filter("url IS NOT NULL").select(F.col("url").alias("value"), "_n")
        urls = self._stored("urls", URLS, asked, segment)
        titles = self._stored("titles", TITLES, keyed, segment)
        if urls is None or titles is None:
            return None
        by_url = asked.join(urls, "value", "left_semi").select("_n")
        near = self._near(hot_key_join(keyed, titles.withColumnRenamed("words", "others"), "value")).select("set").distinct()
        return cut_lineage(by_url.unionByName(slim.join(near, "set", "left_semi").select("_n")).distinct())

    def _near_sets(self, keyed: DataFrame) -> DataFrame:
        """(set, other) of sets of words near to each other, each set also to itself."""
        others = keyed.select("value", F.col("set").alias("other"), F.col("words").alias("others"))
        return cut_lineage(self._near(hot_key_join(keyed, others, "value")).select("set", "other").distinct())

    def _fold(self, state: DataFrame, near: DataFrame) -> DataFrame:
        """The rows that stay.  Each round keeps the open rows nothing open lies before and drops those something kept lies before.

        Rows meet through the least places of their sets and URLs, so equal titles or URLs cost their number and no pairs.
        """
        while not state.filter("state = 'open'").isEmpty():
            live = state.filter("state <> 'gone'")

            def least(by: str, live: DataFrame = live) -> DataFrame:
                first = [F.min(F.when(F.col("state") == s, F.col("place"))).alias(f"{s}_{by}") for s in ("open", "kept")]
                return live.filter(F.col(by).isNotNull()).groupBy(by).agg(*first)

            around = near.join(least("set").withColumnRenamed("set", "other"), "other").groupBy("set")
            around = around.agg(F.min("open_set").alias("open_set"), F.min("kept_set").alias("kept_set"))
            seen = lookup_join(lookup_join(state, around, ["set"], "left"), least("url"), ["url"], "left")
            before = lambda c: F.coalesce(F.col(c) < F.col("place"), F.lit(False))
            drop, wait = before("kept_set") | before("kept_url"), before("open_set") | before("open_url")
            now = F.when(F.col("state") != "open", F.col("state")).when(drop, "gone").when(wait, "open").otherwise("kept")
            state = cut_lineage(seen.withColumn("state", now).select("_n", "place", "url", "set", "state"))
        return state.filter("state = 'kept'")


def dedup_title_stream(articles: DataFrame, kept: KeptArticles, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the arriving articles that stay, a folder for each micro-batch; a batch that runs again replaces its folder and its segment."""

    def run(batch: DataFrame, batch_id: int) -> None:
        kept.admit(batch, f"batch_{batch_id}").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return articles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
