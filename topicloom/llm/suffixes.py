"""Suffix-array dedup: suffixes are ordered only through ``threshold`` bytes, by most-significant-digit passes.

A pass groups suffixes by their next digit and drops those that are alone; the groups left after the
threshold are exactly the repeated windows. Not every suffix enters the first pass. A window's anchor
is the position of the smallest hash among its first ``REACH`` places; equal windows have their anchors
at equal distances, and a suffix that starts at an anchor has at least threshold - REACH + 1 bytes of
each of the anchor's windows. So the first digit, those bytes, is compared for anchors alone (one in
about 150 places). The next digit is the stretch of text that all windows of an anchor cover: where it
is equal, all of them are repeated. Only windows of anchors that are in a group but whose stretch is
unique, the ends of repeated passages, are ordered one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import prefix, staged

THRESHOLD, REACH, GRAM = 400, 300, 32
#: Window starts of a document that are handled at once; a digit of the last passes, in bytes.
SEGMENT, DIGIT = 1 << 20, 50
#: Stretches of one group that a task orders; those of larger groups are ordered by Spark, window by window.
LOCAL_GROUP, LOCAL_BYTES = 4096, 4 << 20
_BASES = (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)
_BYTES = tuple(np.random.default_rng(s).integers(0, 1 << 64, 256, np.uint64) for s in (5, 6))
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(family: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get((family, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[family], -1, 1 << 64) if inverse else _BASES[family]
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        _powers[family, inverse] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Prefix:
    """Hashes of any stretches of ``raw``, from a polynomial over its bytes."""

    def __init__(self, raw: np.ndarray, family: int):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[family][raw] * _power(family, len(raw)), dtype=np.uint64, out=self.sums[1:])
        self.back = _power(family, len(raw) + 1, True)

    def of(self, lo, hi) -> np.ndarray:
        return _mixed((self.sums[hi] - self.sums[lo]) * self.back[lo] + np.asarray(hi - lo).astype(np.uint64))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive numbers."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, threshold: int, reach: int, gram: int):
    """For each segment, arrays ``(first window, windows, anchor - first window, digit, stretch digit)``."""
    for at in range(0, len(data) - threshold + 1, SEGMENT):
        raw = np.frombuffer(data, np.uint8)[at : at + SEGMENT + threshold - 1]
        n = len(raw) - threshold + 1
        one, two = Prefix(raw, 0), Prefix(raw, 1)
        i = np.arange(n + reach - 1)
        mask = np.uint64((1 << 22) - 1)
        least = _smallest((two.of(i, i + gram) & ~mask) | i.astype(np.uint64), reach)
        place = (least & mask).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
        end = np.append(first[1:], n)
        where = place[first]
        stretch = _mixed(two.of(first, end - 1 + threshold) + (where - first).astype(np.uint64))
        yield first + at, end - first, where - first, one.of(where, where + threshold - reach + 1).view(np.int64), stretch.view(np.int64)


def repeated(stretches: list[np.ndarray], groups: np.ndarray, offsets: np.ndarray, twice: np.ndarray, threshold: int, digit: int = DIGIT):
    """Orders the windows of stretches of text and finds those that are equal to another's.

    Returns arrays (stretch, first window, windows) of runs; those of stretches marked ``twice``, which
    are repeated anyway, serve as partners only.
    """
    sizes = np.array([len(s) for s in stretches])
    starts = np.cumsum(sizes) - sizes
    raw = np.concatenate(stretches)
    counts = sizes - threshold + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    local = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at, prefix = starts[owner] + local, Prefix(raw, 0)
    # equal windows have the same group and the same distance to their anchor
    _, group = np.unique(groups[owner].astype(np.int64) * np.int64(1 << 20) + (offsets[owner] - local), return_inverse=True)
    keep = np.arange(len(owner))
    for depth in range(0, threshold, digit):
        lo = at[keep] + depth
        h = prefix.of(lo, np.minimum(lo + digit, at[keep] + threshold))
        order = np.lexsort((h, group))
        g, h = group[order], h[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]) if len(g) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1 if len(g) else new
        keep, group = keep[order][many], number[many]
        if not len(keep):
            break
    keep = np.sort(keep[~twice[owner[keep]]])
    if not len(keep):
        return keep, keep, keep
    o, w = owner[keep], local[keep]
    cut = np.concatenate([[0], np.nonzero((o[1:] != o[:-1]) | (w[1:] != w[:-1] + 1))[0] + 1])
    return o[cut], w[cut], np.append(cut[1:], len(keep)) - cut


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, reach: int = REACH, gram: int = GRAM, local_group: int = LOCAL_GROUP) -> DataFrame:
    """Runs ``(key, start, windows)`` of byte positions whose next ``threshold`` bytes also start anywhere else."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def first(batches):
        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                for parts in anchors((t.as_py() or "").encode(), threshold, reach, gram):
                    yield _named(batch, i, parts)

    def _named(batch, i, parts):
        k = batch.column(0).slice(i, 1)
        n = len(parts[0])
        return pa.RecordBatch.from_arrays([k.take(pa.array(np.zeros(n, np.int64))), pa.array(parts[0], pa.int64()), *[pa.array(x, pa.int32()) for x in parts[1:3]], *[pa.array(x, pa.int64()) for x in parts[3:]]], ["k", "p", "n", "o", "d", "s"])

    found = docs.mapInArrow(first, f"k {kind}, p bigint, n int, o int, d bigint, s bigint")
    # first pass: what groups hold is counted with a partial aggregate, then looked up by a join that Spark can split
    met = staged(found.groupBy("d").agg(F.count("*").alias("c")).where("c > 1").select("d"), "suffix-met")
    # dealt anew: a file of one group's rows would be one map task of the next join, which Spark can't split
    left = staged(found.join(met, "d", "left_semi").repartition("k", "p"), "suffix-first")
    # second pass: the stretch of all windows of an anchor
    alike = left.groupBy("d", "s", "n", "o").agg(F.count("*").alias("c"), F.min(F.struct("k", "p")).alias("at"))
    alike = staged(alike, "suffix-second")
    whole = left.join(alike.where("c > 1").select("d", "s", "n", "o"), ["d", "s", "n", "o"], "left_semi").select("k", "p", "n")
    # last passes: one stretch of each kind, in groups where some stretch is unique
    open_ = alike.groupBy("d").agg(F.count("*").alias("m"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("lone")).where("lone > 0 and m > 1")
    ends = alike.join(open_, "d").select(F.col("at.k").alias("k"), F.struct(F.col("at.p").alias("p"), "n", "o", "d", (F.col("c") > 1).alias("twice"), (F.col("m") > local_group).alias("large")).alias("_a"))
    # the anchors of one document
    ends = ends.groupBy("k").agg(F.collect_list("_a").alias("_as"))
    fields = f"k {kind}, p bigint, n int, o int, d bigint, e bigint, twice boolean, part binary"

    def stretches(batches):
        for batch in batches:
            rows = []
            for i, (k, t, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)):
                data = (t.as_py() or "").encode()
                for x in places.as_py():
                    part = data[x["p"] : x["p"] + x["n"] - 1 + threshold]
                    if len(part) < threshold:
                        continue
                    if not x["large"]:
                        rows.append((k, x["p"], x["n"], x["o"], x["d"], None, x["twice"], part))
                        continue
                    raw = np.frombuffer(part, np.uint8)
                    at = np.arange(len(raw) - threshold + 1)
                    one, two = (Prefix(raw, f).of(at, at + threshold).view(np.int64).tolist() for f in (0, 1))
                    rows += [(k, x["p"] + j, 1, 0, one[j], two[j], x["twice"], None) for j in range(len(at))]
                if len(rows) > 20000:
                    yield batched(rows, batch)
                    rows = []
            if rows:
                yield batched(rows, batch)

    def batched(rows, batch):
        cols = [*zip(*rows, strict=True)]
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k", "p", "n", "o", "d", "e", "twice", "part"])

    cut = docs.join(ends, docs["k"].eqNullSafe(ends["k"])).select(docs["k"], "t", "_as").mapInArrow(stretches, fields)
    cut = staged(cut, "suffix-ends")

    def ordered(batches):
        rows, size, last, number = [], 0, None, 0

        def flush():
            o, w, n = repeated([np.frombuffer(r[4], np.uint8) for r in rows], np.array([r[0] for r in rows]), np.array([r[3] for r in rows]), np.array([r[5] for r in rows]), threshold)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in o], key_type), pa.array([rows[i][2] + int(j) for i, j in zip(o, w, strict=True)], pa.int64()), pa.array(n, pa.int32())], ["k", "p", "n"])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(1).type
            for d, k, p, o, part, twice in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if d != last:
                    if size > LOCAL_BYTES:
                        yield flush()
                        rows, size = [], 0
                    last, number = d, number + 1
                rows.append((number, k, p, o, part, twice))
                size += len(part)
        if rows:
            yield flush()

    near = cut.where("part is not null").select("d", "k", "p", "o", "part", "twice").repartition("d").sortWithinPartitions("d").mapInArrow(ordered, f"k {kind}, p bigint, n int")
    wide = cut.where("part is null").select("k", "p", "d", "e", "twice")
    shared = wide.groupBy("d", "e").agg(F.count("*").alias("c")).where("c > 1").select("d", "e")
    far = wide.where("not twice").join(shared, ["d", "e"], "left_semi").select("k", "p", F.lit(1).alias("n"))
    return whole.unionByName(near).unionByName(far).select(F.col("k").alias("key"), F.col("p").alias("start"), F.col("n").alias("windows"))


def _cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
    cols = [[], [], [], [], []]
    for t, r in zip(texts, runs, strict=True):
        data = (t.as_py() or "").encode()
        out, at, gone, spans = [], 0, 0, 0
        for lo, hi in sorted((x["start"], x["end"]) for x in r.as_py() or ()):
            hi = min(hi, len(data))
            if hi <= at:
                continue
            if lo > at or not spans:
                out.append(data[at:lo])
                spans, at = spans + 1, lo
            gone, at = gone + hi - at, hi
        out.append(data[at:])
        # of a character that is cut, the text keeps nothing
        for c, x in zip(cols, (len(data), gone, spans, b"".join(out), "".join(x.decode(errors="ignore") for x in out)), strict=True):
            c.append(x)
    return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())], ["n_bytes", "n_removed", "n_spans", "kept", "kept_text"])


def number_of(text) -> F.Column:
    """Tells rows of one key with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, **options) -> DataFrame:
    """The rows of ``df`` with ``n_bytes long, n_removed long, n_spans long, kept binary, kept_text string`` added.

    Every byte that a repeated string of ``threshold`` bytes covers is removed, in all its places.
    ``n_spans`` counts maximal removed runs; ``kept`` holds the other bytes (a cut may fall inside a
    character), and ``kept_text`` the whole characters among them. Null and empty texts have no bytes.
    A repeated row is another place of its strings. Rows of one key (null too) with different texts are
    documents of their own. Columns of ``df`` that are named like the new ones are replaced. An empty
    table gives no rows.
    """
    p, new = prefix(df), ("n_bytes", "n_removed", "n_spans", "kept", "kept_text")
    rows = df.select(F.struct(F.col(key).alias("key"), number_of(F.col(text)).alias("d")).alias("k"), F.col(text).alias("t"))
    runs = repeated_windows(rows, "k", "t", threshold, **options)
    span = F.struct("start", (F.col("start") + F.col("windows") - 1 + threshold).alias("end"))
    of = runs.groupBy(F.col("key").alias(f"{p}k")).agg(F.collect_list(span).alias(f"{p}runs"))  # of one document
    same = F.col(key).eqNullSafe(F.col(f"{p}k.key")) & (number_of(F.col(text)) == F.col(f"{p}k.d"))
    cut = arrow_udf(_cut, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary,kept_text:string>")
    both = df.join(of, same, "left").withColumn(f"{p}out", cut(F.col(text), F.col(f"{p}runs")))
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[F.col(f"{p}out.{c}").alias(c) for c in new])
