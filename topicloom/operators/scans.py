"""Scans over a whole table in an order: places of rows, and values carried forward, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.store import staged


def _before():
    """The tasks before one's own; over tables of one row a task only."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _sorted(rows: DataFrame, order) -> DataFrame:
    """``rows`` sorted over all tasks and written, with the task (``_part``) and the place in it (``_at``), so that both are the same each time."""
    return staged(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sorted")


def positioned(rows: DataFrame, *order, name: str = "pos", first: int = 0) -> DataFrame:
    """Adds ``name``: 0 (or ``first``) and on, by the columns of ``order``, which tell all rows apart that a caller wants apart.

    Rows are sorted over all tasks and numbered within each; what stands before a task's rows comes from
    the tasks' counts. The sorted rows are written first, so that the numbers are the same each time.
    """
    sorted_ = _sorted(rows, order)
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row a task
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(_before()), F.lit(0)))
    own = sorted_.join(before.select("_part", "_first", "_before"), "_part")
    return own.withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + first).cast("long")).drop("_part", "_at", "_first", "_before")


def carried(rows: DataFrame, value, order: str, name: str) -> DataFrame:
    """Adds ``name``: the last value of the column ``value`` that is not null, at the row or before it in the order of the distinct values of ``order``.

    A segmented scan: rows are sorted over all tasks; within each, the last value comes from a window over
    that task's rows; a task's first rows take what the nearest task before it ended with, found in a table
    of one row a task. Null where no value comes before. An empty table gives no rows.
    """
    sorted_ = _sorted(rows.withColumn("_value", value), [order])
    here = sorted_.withColumn("_own", F.last("_value", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_at")))
    ends = sorted_.groupBy("_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_end"))  # a row a task
    ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(_before())).select("_part", "_carry")
    return here.join(ends, "_part").withColumn(name, F.coalesce("_own", "_carry")).drop("_part", "_at", "_value", "_own", "_carry")

