"""Quoted CSV cut at any byte."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from claimweave.sources import corpora
from claimweave.sources.quoted_csv import csv_records, read_quoted_csv


@pytest.fixture
def cut(spark):
    """Sets the bytes of a range for one test."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def at(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield at
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(rng, n):
    values = ["plain", "", "two words", 'a "quoted" word', "line\nend", "\n\n", "é, ü\n\"\n\"", "comma, here", "x" * 300, "a\n" * 120]
    return [[rng.choice(values) for _ in range(3)] for _ in range(n)]


def text_of(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["title", "text", "subject"], *rows])
    return out.getvalue()


def got(df):
    return [tuple(v or "" for v in r) for r in df.orderBy("_file", "_offset").select("title", "text", "subject").collect()]


def test_equals_the_plain_reader_wherever_the_file_is_cut(spark, tmp_path, cut):
    rng = random.Random(3)
    rows = rows_of(rng, 150)
    (tmp_path / "a.csv").write_text(text_of(rows))
    offsets = None
    for size in (10_000_000, 5_000, 700, 64):
        cut(size)
        df = read_quoted_csv(spark, str(tmp_path / "a.csv"))
        assert got(df) == [tuple(r) for r in rows]
        now = sorted(r[0] for r in df.select("_offset").collect())
        assert offsets in (None, now)
        offsets = now
    assert csv_records(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 1
    # more ranges than are allowed for a broadcast: sorted anew, same records
    slow = csv_records(spark, str(tmp_path / "a.csv"), max_ranges=3)
    assert sorted(r["offset"] for r in slow.collect())[1:] == offsets


def test_offsets_are_those_of_the_bytes(spark, tmp_path, cut):
    rows = [["é", "two\nlines", "s"], ["b", "c", ""], ["last", "ünd\n\n", "x"]]
    data = text_of(rows).encode()
    (tmp_path / "a.csv").write_bytes(data)
    cut(16)
    found = {r["record"]: r["offset"] for r in csv_records(spark, str(tmp_path / "a.csv")).collect()}
    assert len(found) == 4
    for record, offset in found.items():
        assert data[offset : offset + len(record.encode())] == record.encode()


def test_odd_files(spark, tmp_path, cut):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_bytes(text_of([["1", "crlf\r\nin a value", "s"], ["2", "", ""]], "\r\n").encode("utf-8-sig"))
    (tmp_path / "f" / "b.csv").write_text('title,text,subject\n\n3,"never closed, with\nlines')
    (tmp_path / "f" / "c.csv").write_text("title,text,subject\n")
    cut(20)
    assert got(read_quoted_csv(spark, str(tmp_path / "f"))) == [("1", "crlf\r\nin a value", "s"), ("2", "", ""), ("3", "never closed, with\nlines", "")]


def test_isot_ids_do_not_depend_on_the_cuts(spark, tmp_path, cut):
    rows = rows_of(random.Random(9), 60)
    (tmp_path / "Fake.csv").write_text(text_of(rows))
    (tmp_path / "True.csv").write_text(text_of(rows))
    seen = []
    for size in (1_000_000, 333):
        cut(size)
        df = corpora.read_isot(spark, str(tmp_path))
        assert df.count() == 120 and df.select("id").distinct().count() == 120
        seen.append(sorted(r["id"] for r in df.select("id").collect()))
    assert seen[0] == seen[1]
    assert {r["label"] for r in df.select(F.col("label")).distinct().collect()} == {"fake", "real"}
