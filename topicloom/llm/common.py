"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.store import discard, shared_dir, staged  # noqa: F401

#: The white space that separates words, as bytes and as a Java / DuckDB / Python character class.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

def prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has (in any case): names with it clash with nothing."""
    p = "__"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


#: Bytes of a batch of texts on the way to Python; one longer text is a batch of its own.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends whole texts to Python in batches of at most so many rows, and of BATCH_BYTES where they are longer.

    Spark takes these bounds from the session when it plans a query, so they stay set; they are lowered only.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        now = int(str(now).lower().removesuffix("b")) if now and str(now).lower().removesuffix("b").lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


#: Called by a worker that goes over to another operator: frees what the last one remembered.
remembered: list = []


def forget() -> None:
    """Empties the caches of the worker and gives their memory back to the system."""
    if any([clear() for clear in remembered]):
        import ctypes
        import gc

        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_space(text) -> F.Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def components(edges: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``; component is the smallest node.

    Alternating large-star and small-star steps: every node points its neighbours at the smallest node
    that it knows of. Neighbour lists are never gathered; a node of a million links costs one
    aggregate and one join, whose skewed side Spark can split. Two numbers a round reach the driver.
    """
    e = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{tag}-edges",
    )
    seen = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}-low")
        # written before the join, so that Spark can split the links of a node that has many
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct()
        )
        old, e = e, staged(small, f"{tag}-star")
        for done in (old, least):  # the new round is written, and nothing reads these any more
            discard(done)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
