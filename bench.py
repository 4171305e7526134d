"""Times the headline queries on all rows of $BENCH_SF_DIR and prints one JSON line.

The text tables come as single files, which one task reads.  They are dealt into one file a core beforehand
(not timed), as a table on a cluster consists of many files; the queries themselves are the same.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from claimweave import catalog  # noqa: E402
from claimweave.scale import session_options  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "verify_claims", "score_bias", "linguistic_features", "tfidf", "gather_evidence", "term_frequency", "typed_entities",
    "verify_triples", "first_verified", "entity_sentiment", "extract_article_text", "stratified_split", "auc",
]
TEXT_TABLES = ["documents", "pages", "conversations"]


def dealt(spark: SparkSession) -> str:
    """A folder with the given tables, the text tables in as many files as there are cores."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(SF_DIR):
        if name.split(".")[0] in TEXT_TABLES:
            spark.read.parquet(f"{SF_DIR}/{name}").repartition(int(CPUS)).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(f"{SF_DIR}/{name}", f"{folder}/{name}")
    return folder


def main() -> None:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        # many small files stay many splits
        .config("spark.sql.files.openCostInBytes", "64m")
    )
    for key, value in session_options().items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    folder = dealt(spark)
    # one small query first, so that the start of the engine is not booked on the first headline
    catalog.QUERIES["label_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    claims = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    rates = {}
    if "verify_claims" in times:
        rates["claims_per_sec"] = round(claims / times["verify_claims"], 2)
        rates["claims_per_hour"] = round(3600 * claims / times["verify_claims"])
    for key, name in (("bias_docs_per_sec", "score_bias"), ("feature_docs_per_sec", "linguistic_features"), ("tfidf_docs_per_sec", "tfidf")):
        if name in times:
            rates[key] = round(docs / times[name], 1)
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": os.path.basename(SF_DIR),
            }
        )
    )


if __name__ == "__main__":
    main()
