"""Embedding near-dedup: random-hyperplane sign hashing, exact verification, connected components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from topicloom.llm.common import components, staged

#: Links have this cosine; a pair that has just so much is missed by all tables with probability MISS at most.
COSINE, MISS = 0.98, 1e-4
#: Bits of a table at least, and distinct vectors for each bucket, about: more vectors mean more bits and so more tables.
LEAST_BITS, BUCKET = 12, 16
#: Vectors that one task compares with as many others; larger buckets are split into pairs of such blocks.
BLOCK = 512
#: Rows that are compared in one go, and groups of up to so many rows that are compared shift by shift, all at once.
ROWS, SMALL = 16384, 48


def hashing(vectors: int, cosine: float = COSINE, miss: float = MISS, bits: int | None = None) -> tuple[int, int]:
    """Tables and bits for so many vectors. Two at the cosine share a bit with probability 1 - acos(cosine) / pi."""
    bits = bits or max(LEAST_BITS, math.ceil(math.log2(max(1, vectors) / BUCKET)))
    shared = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-shared)), bits


def planes(dim: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One number of ``bits`` bits for each vector and table."""
    side = (x @ planes(x.shape[1], tables, bits) > 0).reshape(len(x), tables, bits)
    return side @ (1 << np.arange(bits, dtype=np.int64))


def _blocks(x: np.ndarray, y: np.ndarray | None, cosine: float):
    """Pairs ``(i, j)`` of rows of two blocks (or within one) that are near, in pieces of bounded size."""
    one = y is None
    y = x if one else y
    nx, ny = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y))
    for at in range(0, len(x), 256):
        s = slice(at, at + 256)
        near = (x[s] @ y.T) / (nx[s, None] * ny[None]) >= cosine
        if one:
            near &= np.arange(at, at + near.shape[0])[:, None] < np.arange(len(y))[None]
        i, j = np.nonzero(near)
        yield i + at, j


def _shifts(x: np.ndarray, group: np.ndarray, most: int, cosine: float):
    """Near pairs within consecutive groups of up to ``most`` rows: each row against the next, the one after, and so on."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    for k in range(1, most):
        i = np.nonzero(group[k:] == group[:-k])[0]
        if not len(i):
            return
        i = i[np.einsum("ij,ij->i", x[i], x[i + k]) / (norm[i] * norm[i + k]) >= cosine]
        yield i, i + k


def group_links(x: np.ndarray, table: np.ndarray, left: np.ndarray, cuts: np.ndarray, same: np.ndarray, weight: np.ndarray, tables: int, bits: int, cosine: float):
    """Links of groups of rows: ``(total, root)`` for each row.

    ``cuts`` are the borders of the groups; a group compares its rows with each other (``same``) or those
    ``left`` with the rest. A pair counts in the first table that shows it. ``total`` adds up the weights of
    a row's partners, and ``root`` names the least row that its links reach: a spanning forest of stars.
    """
    size = np.diff(cuts)
    group = np.repeat(np.arange(len(size)), size)
    few = (size <= SMALL) & same
    found = []
    rows = np.nonzero(few[group])[0]
    if len(rows):
        found += [(rows[i], rows[j]) for i, j in _shifts(x[rows], group[rows], int(size[few].max()), cosine)]
    for k in np.nonzero(~few)[0].tolist():
        at = np.arange(cuts[k], cuts[k + 1])
        a, b = (at, None) if same[k] else (at[left[at]], at[~left[at]])
        if len(a) and (b is None or len(b)):
            for i, j in _blocks(x[a], None if b is None else x[b], cosine):
                found.append((a[i], (a if b is None else b)[j]))
    total, root = np.zeros(len(x), np.int64), np.arange(len(x))
    sign, old = None, np.arange(tables)
    for n, (i, j) in enumerate(found):
        late = table[i] > 0
        if late.any():
            sign = signatures(x, tables, bits) if sign is None else sign
            new = ~late
            for at in range(0, len(i), ROWS):
                s = slice(at, at + ROWS)
                new[s] |= ~((sign[i[s]] == sign[j[s]]) & (old < table[i[s], None])).any(1)
            i, j = found[n] = i[new], j[new]
        np.add.at(total, i, weight[j])
        np.add.at(total, j, weight[i])
    while True:  # the least root spreads over the links, and through what it names
        before = root.copy()
        for i, j in found:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return total, root


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", cosine: float = COSINE, tables: int | None = None, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each row: ``(key, n_links, component_id, kept)``.

    Rows link when ``group`` is equal and not null and the cosine, in double precision, is ``cosine`` or
    more. Candidates share a bucket of a table; every candidate is verified. ``hashing`` chooses tables and
    bits by the number of distinct vectors, so that buckets stay small. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do those of different
    dimension. Equal vectors of a group collapse to one with a multiplicity before hashing; a bucket
    of any size is split into blocks whose pairs are compared by separate tasks, and a pair counts in
    the first table that shows it. So pairs are never emitted: what leaves a task is a count for each
    vector and a spanning forest. A repeated key counts as another vector; a
    row without a key links with nothing. No rows give no rows.
    """
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.col(key).isNotNull() & F.col(group).isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    fine &= F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    rows = df.select(F.col(key).alias("_k"), F.when(fine, F.col(group)).alias("_g"), F.when(fine, F.col(vector)).alias("_v"))
    # what stands for a class of equal vectors: 128 bits of their text
    form = F.md5(F.concat_ws("|", F.col("_g").cast("string"), F.array_join(F.transform(F.col("_v"), lambda c: (c + F.lit(0)).cast("string")), ",")))
    rows = staged(rows.withColumn("_class", F.when(F.col("_g").isNotNull(), form)), "vectors")
    classes = rows.where("_class is not null").groupBy("_class").agg(F.min("_k").alias("least"), F.count("*").alias("n"), F.first("_g").alias("g"), F.first("_v").alias("vector"))
    classes = staged(classes.withColumn("id", F.xxhash64("_class")), "vector-classes")
    if tables is None or bits is None:
        found, bits = hashing(classes.count(), cosine, bits=bits)
        tables = tables or found

    @pandas_udf("array<bigint>")
    def signed(vs: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vs), index=vs.index, dtype=object)
        for _, part in vs.groupby(vs.map(len)):
            for i, s in zip(part.index, signatures(np.stack(part.to_numpy()).astype(np.float64), tables, bits), strict=True):
                out[i] = s
        return out

    at = classes.select("id", "n", "g", F.size("vector").alias("d"), signed("vector").alias("_s"))
    at = staged(at.select("id", "n", "g", "d", F.posexplode("_s").alias("t", "s")), "vector-buckets")
    sizes = at.groupBy("g", "d", "t", "s").agg(F.count("*").alias("m")).where("m > 1")
    many = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.col("_b")).cast("int")
    # each member meets each block of its bucket once: pairs (i, j) of blocks with i <= j
    placed = (
        at.join(sizes, ["g", "d", "t", "s"]).withColumn("_b", many).withColumn("_i", mine)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .select("id", "n", "g", "d", "t", "s", "_i", F.least("_i", "_o").alias("x"), F.greatest("_i", "_o").alias("y"))
    )
    placed = placed.join(classes.select(F.col("id").alias("_id"), "vector"), F.col("id") == F.col("_id")).drop("_id")

    def checked(batches):
        """Rows come sorted by pair of blocks; whole groups of them, of about ROWS rows, are in memory at a time."""
        held, rows = [], 0

        def flush(parts):
            keys, own, ids, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
            for d in np.unique(keys[:, 1]).tolist():  # one dimension at a time
                at = np.nonzero(keys[:, 1] == d)[0]
                k, x = keys[at], np.stack([v for p in parts for v, q in zip(p[4], p[0], strict=True) if q[1] == d]).astype(np.float64)
                cuts = np.concatenate([[0], np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1, [len(k)]])
                first = k[cuts[:-1]]
                total, root = group_links(x, k[:, 2], own[at] == k[:, 4], cuts, first[:, 4] == first[:, 5], n[at], tables, bits, cosine)
                some, tied = np.nonzero(total)[0], np.nonzero(root != np.arange(len(root)))[0]
                a = np.concatenate([ids[at][some], ids[at][tied]])
                b = np.concatenate([ids[at][some], ids[at][root[tied]]])
                m = np.concatenate([total[some], np.zeros(len(tied), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, m)], ["a", "b", "n"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            keys = np.stack([c.astype(np.int64) for c in cols[:6]], 1)
            vectors = batch.column(9).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(keys):
                to = min(len(keys), at + ROWS)
                held.append((keys[at:to], cols[6][at:to], cols[7][at:to], cols[8][at:to], vectors[at:to]))
                at, rows = to, rows + to - at
                if rows < ROWS:
                    continue
                # all but the last group, which may go on
                last = held[-1][0]
                cut = int(np.nonzero((last != last[-1]).any(1))[0][-1]) + 1 if (last != last[-1]).any() else 0
                if cut or len(held) > 1 and (held[-2][0][-1] != last[-1]).any():
                    yield from flush([*held[:-1], tuple(c[:cut] for c in held[-1])])
                    held = [tuple(c[cut:] for c in held[-1])]
                    rows = len(held[0][0])
        if held:
            yield from flush(held)

    by = ["g", "d", "t", "s", "x", "y"]
    placed = placed.select(F.xxhash64("g").alias("g"), *by[1:], "_i", "id", "n", "vector").repartition(*by).sortWithinPartitions(*by)
    found = staged(placed.mapInArrow(checked, "a bigint, b bigint, n bigint"), "vector-links")
    linked = found.where("a = b").groupBy("a").agg(F.sum("n").alias("m"))
    roots = components(found.where("a <> b").select("a", "b"), "vectors")
    of = classes.join(linked, F.col("id") == F.col("a"), "left").join(roots, F.col("id") == F.col("node"), "left")
    of = staged(of.select("_class", "least", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("_c")), "vector-named")
    of = of.join(of.groupBy("_c").agg(F.min("least").alias("component_id")), "_c").select("_class", "n_links", "component_id")
    out = rows.join(of, "_class", "left").select(F.col("_k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("_k")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
