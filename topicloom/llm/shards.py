"""Sharding by a uniform shuffle with exact shard sizes.

How many rows go from each source partition to each shard is drawn from the multivariate
hypergeometric law, the law of those counts under a uniform permutation of all rows. Then each
partition permutes its rows and deals them out by those counts, the rows are exchanged, and each
shard permutes what it got.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import staged

#: The matrix has at most so many rows: source partitions beyond it share one.
MOST_SOURCES = 4096
#: A shard is permuted in so many blocks, each of which one task sorts.
BLOCKS = 64
#: numpy draws hypergeometric numbers for fewer good and bad rows than this (its own bound); draws of fewer rows go one by one.
NUMPY_MOST, FEW = 10**9, 32
#: Digits of the logarithms beyond numpy's bound, and a fixed value, two pi.
DIGITS = 50
_TWO_PI = Decimal("6.28318530717958647692528676655900576839433879875021")


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int, most: int = NUMPY_MOST) -> np.ndarray:
    """Rows from each source (``counts``) to each shard (``sizes``, of equal sum): one exact draw."""
    rng, left = np.random.default_rng(seed), sizes.astype(np.int64).copy()
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for i, n in enumerate(counts):
        rest = left.sum()
        # the marginals method is exact and needs time by shards, not rows
        out[i] = left if n == rest else _draw(rng, left, int(n), most)
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, colors: np.ndarray, n: int, most: int) -> np.ndarray:
    out, rest = np.zeros(len(colors), np.int64), int(colors.sum())
    for j, c in enumerate(colors):
        rest -= int(c)
        out[j] = hypergeometric(rng, int(c), rest, n, most)
        n -= int(out[j])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, most: int = NUMPY_MOST) -> int:
    """How many of ``n`` rows drawn from ``good + bad`` are good, for numbers of any size.

    numpy draws where its arguments allow. Beyond, the same law is drawn by ratio-of-uniforms rejection:
    a point under a hat is kept with the ratio of two probabilities, whose logarithm is taken from
    factorials with DIGITS digits. Its error is below 1e-20 at every size, where doubles would lose the ratio.
    """
    if not n or not good:
        return 0
    if not bad:
        return n
    if good < most and bad < most:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    if 2 * n > total:  # what is left behind follows the law too
        return good - hypergeometric(rng, good, bad, total - n, most)
    if good > bad:
        return n - hypergeometric(rng, bad, good, n, most)
    if min(n, good) <= FEW:  # draws and good rows may change places: row by row
        drawn, left = min(n, good), max(n, good)
        found = 0
        for i in range(drawn):
            found += int(rng.integers(total - i)) < left - found
        return found
    mode = (n + 1) * (good + 1) // (total + 2)
    mean, spread = Fraction(n * good, total), n * good * bad * (total - n) / (total * total * (total - 1))
    centre, width = float(mean - mode) + 0.5, math.sqrt(8 / math.e * (spread + 0.5)) + 3 - 2 * math.sqrt(3 / math.e)
    with localcontext() as c:
        c.prec = DIGITS
        log_of = lambda k: -sum(map(_log_factorial, (k, good - k, n - k, bad - n + k)))
        top = log_of(mode)
        while True:
            u, v = 1 - rng.random(), rng.random()  # u is not zero
            k = mode + math.floor(centre + width * (v - 0.5) / u)
            if max(0, n - bad) <= k <= min(n, good) and 2 * Decimal(u).ln() <= log_of(k) - top:
                return k


def _log_factorial(n: int) -> Decimal:
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)  # Stirling's series; what it leaves out is below 1 / (1188 n^9)
    return x * x.ln() - x + (x * _TWO_PI).ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (i < rows % shards) for i in range(shards)], np.int64)


def shuffle(df: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Adds ``shard int`` (0 to shards - 1) and ``slot long`` (gapless from 0 in the shard) to the rows of ``df``.

    Shard sizes differ by one row at most. ``df`` is written to the shared folder first, so a lost
    executor changes nothing; pass narrow rows (ids, sizes). Repeated rows, null ids and any column
    names but ``shard`` and ``slot`` are fine; no rows give no rows.
    """
    names = df.columns
    rows = staged(df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("_source", (F.spark_partition_id() % MOST_SOURCES).cast("int")).withColumn("_row", F.monotonically_increasing_id()), "shards")
    spark = rows.sparkSession
    counts = sorted((r["_source"], r["count"]) for r in rows.groupBy("_source").count().collect())  # MOST_SOURCES rows at most
    sizes = shard_sizes(sum(n for _, n in counts), shards)
    matrix = communication_matrix(np.array([n for _, n in counts], np.int64), sizes, seed)
    ends = spark.createDataFrame([(s, [int(x) for x in np.cumsum(m)]) for (s, _), m in zip(counts, matrix, strict=True)], "_source int, _ends array<bigint>")
    local = Window.partitionBy("_source").orderBy(F.xxhash64("_row", F.lit(seed)), "_row")
    sent = (
        rows.withColumn("_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(ends), "_source")  # at most MOST_SOURCES x shards numbers
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
        .withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(seed + 1)), F.lit(BLOCKS)).cast("int"))
        .drop("_ends", "_rank", "_source")
    )
    sent = staged(sent, "shards-sent")
    blocks = sent.groupBy("shard", "_block").count()  # shards x BLOCKS rows
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    again = Window.partitionBy("shard", "_block").orderBy(F.xxhash64("_row", F.lit(seed + 2)), "_row")
    done = (
        sent.withColumn("_place", F.row_number().over(again) - 1)
        .join(F.broadcast(starts), ["shard", "_block"])
        .withColumn("slot", (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_block", "_row", "_place", "_start")
    )
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "shard", "slot")
