"""Streams over files, one micro-batch per file."""

from pyspark.sql import functions as F
from test_sources import CLAIMS, small_tables

from claimweave.plans import verify as P
from claimweave.streaming import jobs


def write(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/part{n}")


def run(df, tmp_path, name):
    out = str(tmp_path / name)
    q = df.writeStream.format("parquet").option("checkpointLocation", out + "_cp").outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    return df.sparkSession.read.parquet(out)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path + "/*")


def test_suppress_repeats(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [[("Solar Power", "10:00"), ("solar power", "10:20")], [("Solar Power", "10:50")], [("other", "12:30")], [("later", "13:00")], [("Solar Power", "14:30")]]
    for i, rows in enumerate(batches):
        write(spark, [(q, f"2024-01-01 {t}:00") for q, t in rows], "query string, ts string", path, i)
    got = run(jobs.suppress_repeats(stream(spark, "query string, ts timestamp", path)), tmp_path, "out")
    seen = sorted((r["query_key"], r["ts"].hour) for r in got.collect())
    assert [h for k, h in seen if k == "query_solar_power"] == [10, 14]


def test_repeats_at_the_edge_of_the_hour_and_late_ones(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [
        [("a", "10:00:00"), ("b", "10:00:00"), ("c", "10:00:00")],
        [("a", "10:59:00"), ("b", "11:00:00"), ("c", "11:01:00"), ("c", "11:00:30")],  # unsorted: the earlier one is answered
        [("a", "11:00:00"), ("b", "11:59:59"), ("d", "11:55:00"), ("d", "11:55:00")],
        [("late", "11:30:00"), ("a", "12:05:00")],  # ten minutes behind the newest: left out
        [("a", "13:05:00"), ("b", "13:06:00")],
    ]
    for i, rows in enumerate(batches):
        write(spark, [(q, f"2024-01-01 {t}") for q, t in rows], "query string, ts string", path, i)
    live = run(jobs.suppress_repeats(stream(spark, "query string, ts timestamp", path)), tmp_path, "out")
    seen = sorted((r["query"], str(r["ts"])[11:]) for r in live.collect())
    want = [("a", "10:00:00"), ("a", "11:00:00"), ("a", "12:05:00"), ("a", "13:05:00"), ("b", "10:00:00"), ("b", "11:00:00"), ("b", "13:06:00"),
            ("c", "10:00:00"), ("c", "11:00:30"), ("d", "11:55:00")]
    assert seen == want
    rows = [(q, f"2024-01-01 {t}") for batch in batches for q, t in batch if q != "late"]
    batch = jobs.suppress_repeats(spark.createDataFrame(rows, "query string, ts string"))
    assert sorted((r["query"], str(r["ts"])[11:]) for r in batch.collect()) == want


def test_dedup_article_stream_keeps_rows_without_url(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(1, "u"), (2, "u"), (3, ""), (4, "")]
    write(spark, [(i, u, "2024-01-01 00:00:00") for i, u in rows], "article_id long, url string, published_at string", path, 0)
    write(spark, [(5, "u", "2024-01-02 00:00:00")], "article_id long, url string, published_at string", path, 1)
    df = stream(spark, "article_id long, url string, published_at timestamp", path)
    got = run(jobs.dedup_article_stream(df), tmp_path, "out")
    assert sorted(r["url"] for r in got.collect()) == ["", "", "u"]


def test_rate_flags_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "user_id long, ts string"
    write(spark, [(1, f"2024-01-01 00:00:{s:02d}") for s in range(5)] + [(2, "2024-01-01 00:00:30")], schema, path, 0)
    write(spark, [(1, "2024-01-01 00:10:00")], schema, path, 1)
    write(spark, [(1, "2024-01-01 00:20:00")], schema, path, 2)
    live = run(jobs.rate_flags(stream(spark, "user_id long, ts timestamp", path), limit=3), tmp_path, "out")
    batch = jobs.rate_flags(spark.read.schema("user_id long, ts timestamp").json(path + "/*"), limit=3)
    closed = batch.filter(F.col("window_start") < F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert {tuple(r) for r in closed.collect()} <= {tuple(r) for r in live.collect()} <= {tuple(r) for r in batch.collect()}
    assert {r["over_limit"] for r in closed.filter("user_id = 1").collect()} == {True}


def test_verify_stream_equals_batch(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "claim_id long, claim string, source string"
    for i, row in enumerate(CLAIMS[:2]):
        write(spark, [row], schema, path, i)
    tables = small_tables(spark)
    jobs.verify_stream(stream(spark, schema, path), tables, out, str(tmp_path / "cp")).awaitTermination(200)
    live = {(r["claim_id"], r["verdict"]) for r in spark.read.parquet(out).collect()}
    batch = P.verify_claims(spark.createDataFrame(CLAIMS[:2], schema), tables)
    assert live == {(r["claim_id"], r["verdict"]) for r in batch.collect()}
