"""URL rules by a sort-merge range join on reversed hosts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, stored, table

#: Fixed values of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a slash, which no host contains: a host and its subdomains are one interval of keys."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/")))


class Sweep:
    """The stack of hosts with rules that contain the present key, each with its paths by length."""

    def __init__(self) -> None:
        self.part: int | None = None
        self.stack: list[tuple[str, dict[int, dict[str, str]]]] = []

    def reach(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        same = self.stack[-1][1].setdefault(len(path), {})
        same[path] = max(verdict, same.get(path, verdict))

    def longest(self, path: str) -> tuple[str, str] | None:
        best = None
        for key, by_length in self.stack:
            for size, paths in by_length.items():
                if (said := paths.get(path[:size])) is not None and (best is None or (len(key) + size, len(key)) > best[0]):
                    best = ((len(key) + size, len(key)), ".".join(key[:-1].split("/")[::-1]) + path[:size], said)
        return best and best[1:]


def _swept(default: str, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep = Sweep()
        for batch in batches:
            out = []
            for part, key, is_url, path, verdict, host, row in zip(*(batch[c] for c in ("_part", "_key", "_is_url", "_path", "_verdict", "_host", "_id")), strict=True):
                sweep.reach(part, key)
                if not is_url:
                    sweep.rule(key, path, verdict)
                else:
                    found = sweep.longest(path) or (None, default)
                    out.append((row, host, path, *found))
            yield pd.DataFrame(out, columns=names)

    return run


def judge(
    urls: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    parts: int | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict), a row for each row of ``urls``.

    A rule (rule_host, rule_path, rule_verdict) fits its host and all subdomains where the path
    starts with its own.  The rule with most characters wins, of equally long ones that with the
    longer host; of one rule given twice, the later verdict.  Nothing fits: rule null and the
    default verdict.  A null url or one without ``://`` has an empty host and path, which no rule
    fits.  Null ids and repeated rows are judged row by row; rules with a null in any column or an
    empty host are left out.

    Rules and urls are range-partitioned together by reversed host and path, so a host that holds a
    third of the urls is cut into many parts.  Each part is swept in order with a stack of the
    hosts that contain the present one.  A rule that begins in an earlier part and reaches into this
    one belongs to an ancestor of the part's first key, so those few rules are joined to the
    part and go in front.  Memory holds the rules on the stack.
    """
    kind = dict(urls.dtypes)[id_col]
    spark: SparkSession = urls.sparkSession
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    none = F.lit(None)
    asked = urls.select(
        host_key(host).alias("_key"), F.lit(True).alias("_is_url"), path.alias("_path"), none.cast("string").alias("_verdict"), host.alias("_host"), F.col(id_col).alias("_id")
    )
    clean = rules.dropna(subset=["rule_host", "rule_path", "rule_verdict"]).filter("rule_host <> ''").distinct()
    given = clean.select(
        host_key(F.lower("rule_host")).alias("_key"), F.lit(False).alias("_is_url"), F.col("rule_path").alias("_path"),
        F.col("rule_verdict").alias("_verdict"), none.cast("string").alias("_host"), none.cast(kind).alias("_id"),
    )
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.unionByName(given).repartitionByRange(parts, "_key", "_is_url", "_path", "_id")
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()))
    firsts = dealt.groupBy("_part").agg(F.min("_key").alias("first")).filter("first <> ''")
    labels = F.slice(F.split("first", "/"), F.lit(1), F.size(F.split("first", "/")) - 1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "/"), F.lit("/")))
    carried = firsts.select("_part", F.explode(above).alias("_key")).join(given, "_key").select(dealt.columns)
    ready = dealt.unionByName(carried).repartition(parts, "_part").sortWithinPartitions("_part", "_key", "_is_url", "_path")
    names = [id_col, "host", "path", "rule", "verdict"]
    return ready.mapInPandas(_swept(default, names), f"{id_col} {kind}, host string, path string, rule string, verdict string")


SQL = r"""
WITH cut AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT cut.page_id, cut.host, cut.path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN fit ON fit.page_id = cut.page_id AND place = 1
"""


@query("op6_url_filter", SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(RULES, RULE_SCHEMA))
