"""Quoted CSV files, one file read by many tasks although quoted values hold line ends.

The files are scanned as lines, which Spark cuts by byte ranges wherever the files lie.  A line end is part of a value if the number
of quotes before it is odd.  A first pass counts quotes and bytes of every range; their sums over the ranges before tell
each range whether it begins inside a value, and at which byte.  So each range finds its records for itself, and only the
record that crosses a cut is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.scale import cut_lineage, fits_broadcast

MAX_RANGES = 2_000_000
PIECES = "file string, offset long, opens boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, seq, value): the lines of each byte range; ``at`` is where the range begins, ``seq`` grows within it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"), "value"
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, at, quotes, bytes): how many quotes and bytes of the file lie before each range's first line."""
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "at").agg(F.sum(quotes).alias("q"), F.sum(F.octet_length("value") + 1).alias("b"))
    before = "coalesce(sum({}) OVER (PARTITION BY file ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return cut_lineage(sums.select("file", "at", F.expr(before.format("q")).alias("quotes"), F.expr(before.format("b")).alias("bytes")))


def _pieces(whole: bool):
    """Reads the lines of ranges in order; puts out the records that lie in one range, or else the pieces of those that don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        inside, offset = 0, 0
        held: list[str] = []
        held_at, held_opens = 0, True
        out: tuple[list, list, list, list] = ([], [], [], [])

        def put(file: str, at: int, opens: bool, text: str) -> None:
            for column, value in zip(out, (file, at, opens, text), strict=True):
                column.append(value)

        def let_go() -> None:
            """The range ends: what is held belongs to a record that goes on."""
            if held and not whole:
                put(now[0], held_at, held_opens, "\n".join(held))
            held.clear()

        for batch in batches:
            value = batch.column("value")
            quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False)
            sizes = pc.binary_length(value).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            columns = [batch.column(c).to_pylist() for c in ("file", "at", "quotes", "bytes")]
            for i, (file, at, q, b) in enumerate(zip(*columns, strict=True)):
                if (file, at) != now:
                    if now is not None:
                        let_go()
                    now, inside, offset = (file, at), q & 1, b
                if not held:
                    held_at, held_opens = offset, not inside
                odd = int(quotes[i]) & 1
                if not held and held_opens and not odd:
                    if whole:
                        put(file, offset, True, value[i].as_py())
                else:
                    held.append(value[i].as_py())
                    inside ^= odd
                    if not inside:
                        if held_opens == whole:
                            put(file, held_at, held_opens, "\n".join(held))
                        held.clear()
                offset += int(sizes[i])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["file", "offset", "opens", "text"])
                for column in out:
                    column.clear()
        if now is not None:
            let_go()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["file", "offset", "opens", "text"])

    return run


def csv_records(spark: SparkSession, path: str, max_ranges: int = MAX_RANGES) -> DataFrame:
    """(file, offset, record): every record of the files with the byte it begins at, line ends inside values kept.

    A quote counts wherever it stands, so one inside a value must be doubled or the value quoted, as the format asks.  A record that is not
    closed ends with its file.  Empty lines between records are left out.
    """
    lines = _lines(spark, path)
    ranges = _ranges(lines)
    if fits_broadcast(ranges, max_ranges):
        # the order of the scan stays: nothing moves
        placed = lines.join(F.broadcast(ranges), ["file", "at"])
    else:
        placed = lines.join(ranges, ["file", "at"]).repartition("file", "at").sortWithinPartitions("file", "at", "seq")
    placed = placed.select("file", "at", "quotes", "bytes", "value")
    whole = placed.mapInArrow(_pieces(True), PIECES).select("file", "offset", "text")
    parts = placed.mapInArrow(_pieces(False), PIECES)
    # two pieces a range at most: the text stays out of the window
    owner = F.expr("max(CASE WHEN opens THEN offset END) OVER (PARTITION BY file ORDER BY offset)")
    owners = parts.select("file", "offset", owner.alias("owner"))
    pieces = parts.select("file", "offset", "text").join(owners, ["file", "offset"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "text")))
    crossing = pieces.groupBy("file", "owner").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))
    both = whole.unionByName(crossing.withColumnRenamed("owner", "offset"))
    record = F.regexp_replace("text", "\r$", "")
    return both.select("file", "offset", record.alias("record")).filter(F.trim("record") != "")


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first record of the first file."""
    return [c.lstrip("\ufeff") for c in spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns]


def read_quoted_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The columns of the files (a file or a folder, each file with a header) as strings, with ``_file`` and ``_offset``.

    File name and first byte tell records apart and stay the same however the files are cut.
    """
    columns = columns or header(spark, path)
    schema = ", ".join(f"`{c}` string" for c in columns)
    records = csv_records(spark, path).filter(F.col("offset") > 0)
    parsed = F.from_csv("record", schema, {"quote": '"', "escape": '"', "multiLine": "true"})
    name: Column = F.element_at(F.split("file", "/"), -1)
    return records.select(parsed.alias("r"), name.alias("_file"), F.col("offset").alias("_offset")).select("r.*", "_file", "_offset")
