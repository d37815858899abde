"""Quoted CSV read by many tasks, records across lines included.

Spark splits a text file at line ends, but a line end inside quotes ends no
record, and whether a split begins inside quotes depends on all that comes
before it.  A first pass tells, for each split, in which state (between
records, or inside a quoted field) it ends if it begins in either; the states
of all splits follow by composing these along the file.  In the second pass
each split cuts its own records; what is left of a record at its ends is
joined with its neighbours'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from utterscope.session import reliable_checkpoint, sized_broadcast

MAX_SPLITS_BROADCAST = 1_000_000


class LineStates:
    """Whether a line that begins between records or inside quotes ends so.

    A quote opens a field only at its beginning; inside, a doubled quote is a
    quote.  Quotes in the middle of an unquoted field mean nothing."""

    def __init__(self, sep: str):
        other = f"[^{re.escape(sep)}]"
        quoted = r'"(?:[^"]|"")*+"' + other + "*+"
        field = f'(?:{quoted}|[^"{re.escape(sep)}]{other}*+|)'
        self.whole = re.compile(f"{field}(?:{re.escape(sep)}{field})*+\\Z")
        self.rest = re.compile(r'(?:[^"]|"")*+"' + other + f"*+(?:{re.escape(sep)}|\\Z)")

    def inside_after(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        at = 0
        if inside:
            closed = self.rest.match(line)
            if not closed:
                return True
            at = closed.end()
        return not self.whole.match(line, at)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """((file, start), line) of the rows of a task."""
    for b in batches:
        yield from zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist())


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, start, begins, owner): for each split whether it begins inside
    quotes, and where the split begins that holds the first line of the record
    that is open there."""
    schema = "file string, start long, out boolean, inside boolean, opens_out boolean, opens_inside boolean"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = LineStates(sep)
        now, ends, opens = None, [False, True], [False, False]

        def told():
            return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "out": [ends[0]], "inside": [ends[1]],
                                               "opens_out": [opens[0]], "opens_inside": [opens[1]]})

        for at, line in _runs(batches):
            if at != now:
                if now is not None:
                    yield told()
                now, ends, opens = at, [False, True], [False, False]
            for k in (0, 1):
                after = states.inside_after(line, ends[k])
                opens[k] = after and (opens[k] or not ends[k])  # the open record began in this split
                ends[k] = after
        if now is not None:
            yield told()

    found = reliable_checkpoint(lines.mapInArrow(scanned, schema))
    # one row per split: states composed along each file
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # a split whose end doesn't depend on its beginning settles it; up to the next such one an odd number of flips does
    kind = F.when(F.col("out") == F.col("inside"), F.col("out"))
    flips = F.when(F.col("out") & ~F.col("inside"), 1).otherwise(0)
    settled = F.last(F.when(kind.isNotNull(), F.struct(kind.alias("state"), F.col("flipped").alias("flipped"))), ignorenulls=True)
    counted = found.withColumn("flipped", F.sum(flips).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.sum(flips).over(w), F.lit(0))
    states = counted.withColumn("last", settled.over(w)).withColumn("before", before)
    odd = (F.col("before") - F.coalesce(F.col("last.flipped"), F.lit(0))) % 2 == 1
    begins = F.coalesce(F.col("last.state"), F.lit(False)) != odd
    known = states.select("file", "start", begins.alias("begins"),
                          F.when(begins, F.col("opens_inside")).otherwise(F.col("opens_out")).alias("opens"))
    return known.select("file", "start", "begins", F.coalesce(F.last(F.when(F.col("opens"), F.col("start")), ignorenulls=True).over(w),
                                                             F.lit(-1).cast("long")).alias("owner"))


def split_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, start, nth, record): the records of quoted CSV files, headers
    and empty lines left out; ``start`` and ``nth`` tell the split a record
    begins in and its place there.

    Splits are those of Spark's text source, so one large file is read by
    many tasks.  Only records across splits are shuffled.
    """
    lines = _lines(spark, path)
    states = sized_broadcast(split_states(lines, sep), MAX_SPLITS_BROADCAST)
    schema = "file string, start long, nth long, part long, record string, whole boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records and, with their owner and place in it, parts of records."""
        machine = LineStates(sep)
        out: list[tuple] = []
        now, inside, nth, held, owner = None, False, 0, [], -1

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (
                pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))],
                names=["file", "start", "nth", "part", "record", "whole"])

        def left_over():
            """The record that the split leaves open: its own, or one that began before."""
            if held:
                out.append((now[0], owner if owner >= 0 else now[1], -1, now[1], "\n".join(held), False))

        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(5)))
            for file, start, line, begins, owned in keys:
                if (file, start) != now:
                    left_over()
                    now, inside, nth, held, owner = (file, start), begins, 0, [], owned if begins else -1
                held.append(line)
                inside = machine.inside_after(line, inside)
                if not inside:
                    if owner >= 0:  # the end of a record that began before
                        left_over()
                    else:
                        out.append((file, start, nth, start, "\n".join(held), True))
                    nth, held, owner = nth + 1, [], -1
            if len(out) > 10_000:
                yield rows()
                out = []
        left_over()
        if out:
            yield rows()

    known = lines.join(states, ["file", "start"]).select("file", "start", "value", "begins", "owner")
    cut_rows = reliable_checkpoint(known.mapInArrow(cut, schema))
    # a record across splits: the last of the split it begins in, and a part of each split it goes through
    parts = cut_rows.filter("NOT whole").groupBy("file", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda p: p["record"]), "\n").alias("record"))
    joined = parts.select("file", "start", F.lit(1 << 40).alias("nth"), "record")
    records = cut_rows.filter("whole").select("file", "start", "nth", "record").union(joined)
    records = records.withColumn("record", F.regexp_replace("record", "\r$", ""))
    first = F.min(F.struct("start", "nth")).alias("first")
    headers = sized_broadcast(records.groupBy("file").agg(first), MAX_SPLITS_BROADCAST)
    return records.join(headers, "file").filter((F.struct("start", "nth") != F.col("first")) & (F.col("record") != "")).drop("first")


def read_split_csv(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """Quoted CSV files (quotes doubled inside quotes) with a header, by
    ``split_records``; a record of another number of fields is an error."""
    options = {"sep": sep, "escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = split_records(spark, path, sep).select(F.from_csv("record", F.lit(ddl), options).alias("r"))
    return parsed.select("r.*")
