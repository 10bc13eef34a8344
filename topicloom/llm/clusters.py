"""Centroid clustering with Hamerly's bounds, in integers.

Each vector keeps an upper bound on the distance to its centroid and one lower bound on the distance to
any other. When centroids move, the bounds loosen by the drift; a vector whose upper bound stays below the
lower one, or below half the way from its centroid to the nearest other, keeps its centroid without a
look at the others. For the rest, all distances are computed exactly. Bounds are rounded outwards, so that
no rounding error decides. The vectors with their bounds are written to the shared folder each round;
centroids are the only state on the driver: ``k`` rows of integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import discard, prefix, staged

#: Integers are kept within these bounds: 64 squares of their differences fit into 64 bits.
MOST = 1 << 27
#: Integers up to this are exact as doubles, products and their sums over 64 components too.
EXACT = 1 << 22


def quantised(vector: Column, scale: int = 64, size: int = 64) -> Column:
    """The vector in whole numbers floor(scale * x); null unless it has ``size`` components, none null, infinite or NaN.

    Numbers beyond MOST (x beyond 2^21 at the scale of 64) count as MOST, since squared distances of
    64 bits hold no more.
    """
    fine = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int")
    return F.when(fine, F.transform(vector, whole))


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``q`` to those of ``c``."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most <= EXACT and q.shape[1] <= 64:
        x, y = q.astype(float), c.astype(float)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    x, y = q.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in y], 1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def assign(q: np.ndarray, centres: np.ndarray, state=None, drift: np.ndarray | None = None):
    """``(cluster, upper, lower, scanned)`` of the rows of ``q``; ``state`` is what an earlier round gave, before the centroids moved by ``drift``.

    Ties go to the smaller number. ``upper`` and ``lower`` bound true distances from above and below.
    """
    n, k = len(q), len(centres)
    if state is None:
        cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.full(n, -np.inf)
        open_ = np.ones(n, bool)
    else:
        cluster, upper, lower = (x.copy() for x in state)
        most = np.array([max((drift[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
        upper, lower = _up(upper + drift[cluster]), _down(lower - most[cluster])
        if k > 1:
            between = squared(centres, centres).astype(float)
            np.fill_diagonal(between, np.inf)
            half = _down(_down(np.sqrt(between.min(1))) / 2)[cluster]
        else:
            half = np.full(n, np.inf)
        bound = np.maximum(half, lower)
        open_ = upper >= bound
        at = np.nonzero(open_)[0]
        if len(at):  # the upper bound is made exact before a scan
            exact = np.concatenate([squared(q[at][cluster[at] == j], centres[j : j + 1])[:, 0] for j in range(k)])
            order = np.concatenate([at[cluster[at] == j] for j in range(k)])
            upper[order] = _up(np.sqrt(exact.astype(float)))
            open_ = upper >= bound
    at = np.nonzero(open_)[0]
    if len(at):
        d = squared(q[at], centres)
        best = d.argmin(1)  # the first of equals
        cluster[at] = best
        upper[at] = _up(np.sqrt(d[np.arange(len(at)), best].astype(float)))
        d[np.arange(len(at)), best] = np.iinfo(np.int64).max
        lower[at] = _down(np.sqrt(d.min(1).astype(float))) if k > 1 else np.inf
    return cluster, upper, lower, len(at)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int32)


def _round(rows: DataFrame, centres: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """``rows(key, q[, cluster, upper, lower])`` with new clusters and bounds, and exact squared distances."""
    schema = rows.select("key", "q")

    def out(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), batch.num_rows)
            state = None if drift is None else tuple(batch.column(i).to_numpy() for i in (2, 3, 4))
            cluster, upper, lower, _ = assign(q, centres, state, drift)
            own = ((q.astype(np.int64) - centres[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(own, pa.int64())], ["key", "q", "cluster", "upper", "lower", "distance"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema)
    return rows.drop("distance").mapInArrow(out, f"{kind}, cluster int, upper double, lower double, distance bigint")


def _means(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Floors of the components' means, exact; a centroid without vectors stays. ``k`` rows reach the driver."""
    size = centres.shape[1]
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("q")[i].cast("bigint")).alias(f"s{i}") for i in range(size)])
    out = centres.copy()
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return out


def centre_digest(centre) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centre).encode()).hexdigest()


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, size: int = 64) -> DataFrame:
    """``(key, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for each vector that ``quantised`` keeps.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:key``, in that order; ties of
    repeated keys go by components, vectors without a key come last. If fewer are kept, each of them starts
    one. Each of ``rounds`` rounds assigns all vectors and moves each centroid to the floor of its vectors'
    mean; then they are assigned once more. Distances are squared; a sum beyond 64 bits is null. Other
    vectors give no row; repeated ones a row each. An empty table gives no rows.
    """
    p = prefix(df)
    own = df.select(F.col(key).alias("key"), quantised(F.col(vector), scale, size).alias("q")).where("q is not null")
    state = staged(own, "clusters-vectors")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = state.orderBy(named.asc_nulls_last(), "q").limit(k).select("q").collect()
    centres, drift = np.array([r.q for r in first], np.int64).reshape(-1, size), None
    for i in range(rounds + 1 if len(first) else 0):
        old, state = state, staged(_round(state, centres, drift), f"clusters-{i}")
        discard(old)
        if i < rounds:
            moved = _means(state, centres)
            drift = _up(np.sqrt(np.array([int(x) for x in ((moved - centres) ** 2).sum(1)], float)))
            centres = moved
    spark = df.sparkSession
    if not len(first):
        state = state.select("*", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    digests = spark.createDataFrame([(j, centre_digest(c)) for j, c in enumerate(centres)], f"cluster int, {p}sha string")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    each = staged(state.groupBy("cluster").agg(total("distance").alias("s")), "clusters-inertia")  # k rows
    each = each.join(digests, "cluster").crossJoin(F.broadcast(each.agg(F.sum("s").alias("all"))))  # one row
    fits = lambda c: F.expr(f"try_cast({c} as bigint)")
    each = each.select("cluster", fits("s").alias("cluster_inertia"), fits("`all`").alias("inertia"), F.col(f"{p}sha").alias("centroid_sha256"))
    return state.join(F.broadcast(each), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
