"""CSV with quoted line breaks, read in many tasks per file.

Spark's text reader deals byte ranges of files to tasks, and a line is read by the range it begins in. Whether
a line begins inside quotes depends on all quotes before it in the file; of these only the parity counts. So one scan takes the parity of each
range, a running sum over a file's ranges (a row each) tells in which state each begins, and in a second scan every task finds the true beginnings
of records by itself. What a range has of a record that began before it, or that goes on after it, is put together
by file and record; all other records never move.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.types import missing_to_null
from plumbline.session import same_ranges, scratch_dir

#: States of ranges that are broadcast; with more, lines are sorted by range instead.
BROADCAST_RANGES = 500_000
QUOTE = '"'


def ranges_of_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line, odd) of all lines: its file, where its byte range begins, its bytes, and whether it has an odd number of quotes.

    Rows are in the order of the file within a range.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    value = F.col("value").cast("binary")
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit(QUOTE), F.lit("")))
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("line"), (quotes % 2 == 1).alias("odd"))


def range_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether a range begins inside quotes."""
    parity = lines.groupBy("file", "start").agg((F.count_if("odd") % 2).alias("p"))
    before = F.sum("p").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    return parity.select("file", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


class RangeCutter:
    """Cuts the lines of one range to records."""

    def __init__(self, file: int, start: int, inside: bool):
        self.file, self.start, self.inside = file, start, inside
        self.begun = not inside  # whether what is held began in this range
        self.held: list[bytes] = []
        self.first = start == 0

    def cut(self, texts: list[bytes], odd: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The records that these lines complete: those that began in this range, and the one that began before it."""
        after = (np.cumsum(odd) % 2 == 1) ^ self.inside
        whole, head, at = [], [], 0
        if not self.held and self.begun and not after.any():
            return texts, head
        for end in np.flatnonzero(~after).tolist():
            (whole if self.begun else head).append(b"\n".join([*self.held, *texts[at : end + 1]]))
            self.held, self.begun, at = [], True, end + 1
        self.held += texts[at:]
        self.inside = bool(after[-1])
        return whole, head

    def rows(self, records: list[bytes], part: str | None) -> Iterator[pa.RecordBatch]:
        if records:
            n = len(records)
            first = [part != "head" and self.first] + [False] * (n - 1)
            self.first = self.first and part == "head"
            columns = [pa.array([self.file] * n, pa.int64()), pa.array([self.start] * n, pa.int64()), pa.array(records, pa.binary()), pa.array([part] * n, pa.string()), pa.array(first, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "start", "record", "part", "first"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What goes on in the next range."""
        yield from self.rows([b"\n".join(self.held)] if self.held else [], "tail" if self.begun else "head")


def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (``part`` null), and parts of records that lie in several ranges: ``head`` continues one, ``tail`` begins one.

    ``first`` tells that a record is the first of its file. A range that lies in one record altogether is a head.
    """
    range_ = None
    for batch in batches:
        file, start, inside, odd = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start", "inside", "odd"))
        new = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        edges = [0, *new.tolist(), len(file)] if len(file) else []
        for a, z in zip(edges, edges[1:]):
            if range_ is None or (range_.file, range_.start) != (file[a], start[a]):
                if range_:
                    yield from range_.rest()
                range_ = RangeCutter(int(file[a]), int(start[a]), bool(inside[a]))
            whole, head = range_.cut(batch.column("line").slice(a, z - a).to_pylist(), odd[a:z])
            yield from range_.rows(head, "head")
            yield from range_.rows(whole, None)
    if range_:
        yield from range_.rest()


def cut_lines(lines: DataFrame) -> DataFrame:
    """What ``cut_records`` gives of all lines, as a written table. Both scans must have the same ranges; a range that is new in the second one fails."""
    spark = lines.sparkSession
    at = scratch_dir(spark, "ranges")
    range_states(lines).write.parquet(at)
    states = spark.read.parquet(at)
    if states.count() <= BROADCAST_RANGES:
        known = lines.join(F.broadcast(states), ["file", "start"], "left")
    else:
        numbered = lines.withColumn("_n", F.monotonically_increasing_id())
        known = numbered.join(states, ["file", "start"], "left").repartition("file", "start").sortWithinPartitions("file", "start", "_n")
    inside = F.coalesce("inside", F.raise_error(F.lit("byte ranges changed between two scans")).cast("boolean")).alias("inside")
    # the part of a record that ends a range, and what of it others have, are few rows
    cut = known.select("file", "start", "line", "odd", inside).mapInArrow(cut_records, "file bigint, start bigint, record binary, part string, first boolean")
    at = scratch_dir(spark, "records")
    cut.write.parquet(at)
    return spark.read.parquet(at)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first) of all CSV records under a path, as bytes; quoted line breaks are part of a record, and empty records are left out.

    Quotes inside of fields are doubled, and only quoted fields have any. A last record whose quote is never closed is given as it stands.
    """
    with same_ranges(spark):
        cut = cut_lines(ranges_of_lines(spark, path))
    order = W.partitionBy("file").orderBy("start", F.col("part") == "tail")
    number = F.sum((F.col("part") == "tail").cast("bigint")).over(order)
    pieces = cut.filter("part is not null").withColumn("_r", number).groupBy("file", "_r").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("part") == "tail").alias("t"), F.hex("record").alias("h")))).alias("p"), F.max("first").alias("first"))
    joined = pieces.select(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "0A")).alias("record"), "first")
    every = cut.filter("part is null").select("record", "first").unionByName(joined)
    return every.filter(~F.col("record").isin(b"", b"\r"))


#: What the parser gets for a character of number 0, which it takes for a mark of its own, and for the first character of this.
ZERO, ONE = "\x01a", "\x01b"


def marked(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\0")), F.replace(F.replace(text, F.lit("\x01"), F.lit(ONE)), F.lit("\0"), F.lit(ZERO))).otherwise(text)


def unmarked(field: Column, had_zero: Column) -> Column:
    return F.when(had_zero, F.replace(F.replace(field, F.lit(ZERO), F.lit("\0")), F.lit(ONE), F.lit("\x01"))).otherwise(field)


def parsed_records(records: DataFrame, names: list[str], delimiter: str, encoding: str) -> DataFrame:
    """The fields of (record) as strings, and what is too many in ``_over``: an empty field is null, one in quotes an empty text."""
    every = [*names, "_over"]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in every)
    text = F.regexp_replace(F.decode("record", encoding), "\r\\z", "")
    options = {"sep": delimiter, "escape": QUOTE, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "nullValue": "\0", "emptyValue": ""}
    texts = records.select(text.alias("t"))
    got = texts.select(F.from_csv(marked(F.col("t")), schema, options).alias("f"), F.contains("t", F.lit("\0")).alias("z"))
    return got.select(*(unmarked(F.col("f")[n], F.col("z")).alias(n) for n in every))


def read_quoted_csv(spark: SparkSession, path: str, delimiter: str = ",", columns: list[str] | None = None, encoding: str = "ISO-8859-1", missing_tokens: bool = True) -> DataFrame:
    """What ``files.read_csv`` gives for files with a header and quoted line breaks, but in many tasks per file.

    Rows with too many fields are dropped, those with too few are filled up with nulls; missing-value tokens become null.
    Without ``missing_tokens`` a field in quotes that is empty is an empty text, and one without quotes null. An
    encoding must keep ASCII bytes as they are (UTF-8, ISO-8859-*, Windows-125*). An empty file, or none, has no columns.
    """
    records = quoted_records(spark, path)
    if columns is None:
        head = records.filter("first").select("record").limit(1).collect()
        if not head:
            return spark.createDataFrame([], T.StructType([]))
        columns = header_fields(bytes(head[0][0]).decode(encoding).rstrip("\r"), delimiter)
    parsed = parsed_records(records.filter("not first"), columns, delimiter, encoding).filter("_over is null")
    return parsed.select(*((missing_to_null(F.col(f"`{n}`")) if missing_tokens else F.col(f"`{n}`")).alias(n) for n in columns))


def header_fields(line: str, delimiter: str) -> list[str]:
    return next(csv.reader(io.StringIO(line, newline=""), delimiter=delimiter))
