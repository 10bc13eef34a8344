"""Text files of which a record may cross lines or splits, read by many tasks.

Spark's own reader cuts a file at a separator and deals byte ranges of it to tasks; each piece comes with the
begin of its range. What a piece means depends on what stands before it: whether a quoted text is open, and
in JSON how deep it lies. A first pass tells for each range what it makes of either state, a scan over the
ranges (a row each) gives the state that each one really begins with, and a second pass reads it right.
Records that cross ranges are put together from their parts; nothing else moves, and no task holds a file.
"""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.store import staged

PLACE = "f string, b bigint"


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(f, b, i, value)``: the pieces between separators, with their file, the begin of their range and their order in it."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")


def _ranges(batches):
    """``(f, b, rows)`` for each range of sorted batches; ``rows`` are lists of columns."""
    own, held = None, []
    for batch in batches:
        f, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(b):
            end = at
            while end < len(b) and b[end] == b[at] and f[end] == f[at]:
                end += 1
            part = batch.slice(at, end - at)
            if own is not None and own != (f[at], b[at]):
                yield *own, held
                held = []
            own = (f[at], b[at])
            held.append(part)
            at = end
    if own is not None:
        yield *own, held


def _in_order(pieces_: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces with their range's state, whatever way Spark joins them."""
    return pieces_.join(states, ["f", "b"]).sortWithinPartitions("f", "b", "i")


def _before(states: DataFrame, end: F.Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``end`` over the ranges of a file before one's own."""
    past = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return states.withColumn(name, F.coalesce(F.sum(end).over(past), F.lit(0)))


def opened(ends: DataFrame) -> DataFrame:
    """Adds ``open`` (0 or 1), the state in which a range begins, to ``ends(f, b, e0, e1)``, where it ends if it begins with 0 and with 1.

    A range either fixes the state, keeps it, or swaps it. So the state is the last fixed one, swapped as often
    as ranges swap after it.
    """
    upto = Window.partitionBy("f").orderBy("b")
    swaps = F.sum(F.when((F.col("e0") == 1) & (F.col("e1") == 0), 1).otherwise(0)).over(upto)
    both = ends.withColumn("_s", swaps % 2).withColumn("_v", F.when(F.col("e0") == F.col("e1"), (F.col("e0") + F.col("_s")) % 2))
    after = (F.coalesce(F.last("_v", ignorenulls=True).over(upto), F.lit(0)) + F.col("_s")) % 2
    return both.withColumn("_after", after).withColumn("open", F.coalesce(F.lag("_after").over(upto), F.lit(0)).cast("int")).drop("_s", "_v", "_after")


# --- CSV ----------------------------------------------------------------------------------------


def _closing(line: str, at: int) -> int:
    """The place after the quote that ends a quoted field, -1 if it stays open."""
    while (q := line.find('"', at)) >= 0:
        if line[q + 1 : q + 2] != '"':
            return q + 1
        at = q + 2
    return -1


def stays_open(line: str, open_: bool) -> bool:
    """Whether a quoted field is open after a line. A quote opens a field at its begin only, and a doubled one closes none."""
    if '"' not in line:
        return open_
    after = lambda q: q + 2 if q >= 0 else -1
    at = 0 if open_ else 1 if line[0] == '"' else after(line.find(',"'))
    while at >= 0:
        if (at := _closing(line, at)) < 0:
            return True
        at = after(line.find(',"', at))
    return False


def parsed(texts: list[str]) -> list[list[str]]:
    """The cells of each text, a row of a CSV file; a row that its file leaves open ends there."""
    csv.field_size_limit(1 << 30)
    return [next(csv.reader([t]), []) for t in texts]


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(row_no, cells)`` of headerless CSV files: ragged, blank and multi-line rows kept; rows are numbered in each file from 0, in order."""
    lines = pieces(spark, path, "\n")

    def ends(batches):
        for f, b, held in _ranges(batches):
            state, rows = [False, True], [0, 0]
            for part in held:
                for v in part.column(3).to_pylist():
                    rows = [n + (not s) for n, s in zip(rows, state, strict=True)]
                    state = [stays_open(v, s) for s in state]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([f, b, *map(int, state), *rows], [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["f", "b", "e0", "e1", "n0", "n1"])

    found = opened(staged(lines.mapInArrow(ends, f"{PLACE}, e0 int, e1 int, n0 bigint, n1 bigint"), "csv-ranges"))
    states = staged(_before(found, F.when(F.col("open") == 1, F.col("n1")).otherwise(F.col("n0")), "first").select("f", "b", "open", "first"), "csv-states")
    kind = "f string, row_no bigint, b bigint, part string, cells array<string>"

    def rows(batches):
        def out(f, b, nos, texts, whole):
            cells = parsed(texts) if whole else [None] * len(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([f] * len(nos), pa.string()), pa.array(nos, pa.int64()), pa.array([b] * len(nos), pa.int64()), pa.array([None if whole else t for t in texts], pa.string()), pa.array(cells, pa.list_(pa.string()))],
                ["f", "row_no", "b", "part", "cells"],
            )

        for f, b, held in _ranges(batches):
            open_, no = bool(held[0].column(4)[0].as_py()), held[0].column(5)[0].as_py()
            began, text = not open_, []  # whether the row of these lines begins in this range
            no -= open_
            for part in held:
                nos, texts = [], []
                for v in part.column(3).to_pylist():
                    text.append(v)
                    if not (open_ := stays_open(v, open_)):
                        if began:
                            nos.append(no)
                            texts.append("\n".join(text))
                        else:
                            yield out(f, b, [no], ["\n".join(text)], False)
                        no, began, text = no + 1, True, []
                if nos:
                    yield out(f, b, nos, texts, True)
            if text:
                yield out(f, b, [no], ["\n".join(text)], False)

    read = _in_order(lines, states).mapInArrow(rows, kind)
    parts = F.array_sort(F.collect_list(F.struct("b", "part")))  # of one row
    crossing = read.where("cells is null").groupBy("f", "row_no").agg(F.array_join(F.transform(parts, lambda x: x.part), "\n").alias("text"))
    cells = arrow_udf(lambda t: pa.array(parsed(t.to_pylist()), pa.list_(pa.string())), "array<string>")
    return read.where("cells is not null").select("row_no", "cells").unionByName(crossing.select("row_no", cells("text").alias("cells")))
