"""SimHash near-dedup with anchor-point covering.

The 64 bits are cut into short blocks, and the anchors are the words whose blocks are all zeros or all
ones: a covering code, the product of repetition codes, whose radius is the sum of the blocks'. Each
fingerprint's home is its nearest anchor. It is replicated to every anchor, within covering radius plus
threshold, that is home to some word within the threshold of it. So the two fingerprints of any link
meet at the home of either, and comparing homes with replicas anchor by anchor finds every link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import bounded_batches, components, forget, prefix, staged

BITS, THRESHOLD, SHINGLE = 64, 3, 3
#: Lengths of the blocks: 12 of 5 bits and one of 4, so 2^13 anchors of covering radius 26.
BLOCKS = (5,) * 12 + (4,)
_STARTS = np.concatenate([[0], np.cumsum(BLOCKS)[:-1]])
#: Fingerprints whose replicas are made at once, and candidate pairs that are compared at once.
BATCH, PAIRS = 8192, 1 << 21
#: Replicas of one anchor that a task compares; those of a fuller anchor are split by the part of the word in which a link's ends agree.
ANCHOR_ROWS = 1 << 20
#: Words that are hashed at once.
WORDS = 1 << 16
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_TABLE = bytes.maketrans(_UPPER + b"\t\n\x0b\x0c\r", _LOWER + b"     ")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode().translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts, digest, join = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, WORDS):
        part = words[at : min(at + WORDS, n) + shingle - 1]
        if len(part) >= shingle == 3:
            grams = [b"%b %b %b" % g for g in zip(part, part[1:], part[2:])]
        else:
            grams = [join(part[i : i + shingle]) for i in range(max(1, len(part) - shingle + 1))]
        h = np.fromiter([digest(g, 42) for g in grams], np.uint64, len(grams))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", shingle: int = SHINGLE) -> DataFrame:
    """Adds ``out``, the fingerprint as a long (its 64 bits); texts without a word have zero."""

    @arrow_udf("bigint")
    def hashed(texts: pa.Array) -> pa.Array:
        forget()
        return pa.array(_signed(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)), pa.int64())

    return df.withColumn(out, hashed(F.col(text)))


def _majorities(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint as a number (a bit a block), and the flips by which each block changes its side."""
    home, cost = np.zeros(len(x), np.int64), np.zeros((len(x), len(BLOCKS)), np.int8)
    for i, (at, n) in enumerate(zip(_STARTS, BLOCKS, strict=True)):
        ones = np.bitwise_count((x >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)
        side = ones * 2 > n  # a tie is nearest to both; zeros are home
        home |= side.astype(np.int64) << i
        cost[:, i] = np.where(side, ones - n // 2, n // 2 + 1 - ones)
    return home, cost


def replicas(x: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, is home)``: each fingerprint at every anchor that is home to a word within the threshold."""
    home, cost = _majorities(x)
    anchors, rows = [home], [np.arange(len(x))]
    for k in range(1, min(threshold, len(BLOCKS)) + 1):
        for some in combinations(range(len(BLOCKS)), k):
            near = np.nonzero(cost[:, some].sum(1) <= threshold)[0]
            if len(near):
                anchors.append(home[near] ^ sum(1 << i for i in some))
                rows.append(near)
    own = np.zeros(sum(map(len, rows)), bool)
    own[: len(x)] = True
    return np.concatenate(anchors), np.concatenate(rows), own


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        while (b := self.up.get(a, a)) != a:
            self.up[a] = a = self.up.get(b, b)
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _part(x: np.ndarray, part: int, threshold: int) -> np.ndarray:
    """One of the threshold + 1 parts of each word; words within the threshold agree in one of them."""
    width = -(-BITS // (threshold + 1))
    return (x >> np.uint64(part * width)) & np.uint64((1 << width) - 1)


def compare(homes: np.ndarray, near: np.ndarray, threshold: int = THRESHOLD, parts: range | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between an anchor's homes and replicas.

    Candidates agree in one of threshold + 1 parts of the word (``parts`` names those to look at), so
    they are found by sorting each part; they are compared in blocks of bounded size.
    """
    forest, out = _Forest(), []
    homes, near = np.unique(homes), np.unique(near)
    for part in range(threshold + 1) if parts is None else parts:
        keys = _part(near, part, threshold)
        order = np.argsort(keys, kind="stable")
        keys, mine = keys[order], _part(homes, part, threshold)
        lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(homes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = (hi - lo)[at:to]
            a = np.repeat(homes[at:to], n)
            b = near[order[np.repeat(lo[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
            close = (np.bitwise_count(a ^ b) <= threshold) & (a != b)
            for u, v in zip(a[close].tolist(), b[close].tolist(), strict=True):
                if forest.join(u, v):
                    out.append((u, v))
            at = to
    return out


def _by_anchor(x: np.ndarray, threshold: int):
    """``(anchor numbers, replicas of each, which of them are home)`` of some fingerprints."""
    anchor, row, own = replicas(x, threshold)
    order = np.argsort(anchor, kind="stable")
    anchor, value, own = anchor[order], x[row[order]], own[order]
    cuts = np.nonzero(np.diff(anchor, prepend=-1))[0]
    return anchor[cuts], np.split(value, cuts[1:]), np.split(own, cuts[1:])


def full_anchors(spread: DataFrame, threshold: int, most: int) -> dict[int, int]:
    """Anchors with more than ``most`` replicas, and the pieces to split each into. Anchors are 2^13, whatever the input."""

    def count(batches):
        total = np.zeros(1 << len(BLOCKS), np.int64)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), BATCH):
                total += np.bincount(replicas(every[i : i + BATCH], threshold)[0], minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["anchor", "n"])

    counts = spread.mapInArrow(count, "anchor int, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    return {r.anchor: -(-r.n // most) for r in counts.where(F.col("n") > most).collect()}  # anchors at most


def links(prints: DataFrame, threshold: int = THRESHOLD, column: str = "simhash", most: int = ANCHOR_ROWS) -> DataFrame:
    """Links ``(a long, b long)`` between distinct fingerprints, enough of them to connect all that are linked.

    An anchor with more than ``most`` replicas is split: each replica goes once for each part of its word
    to the piece that the part's value names, so the ends of a link still meet in a part that they share.
    """
    spread = prints.select(F.col(column).alias("x")).where("x is not null").distinct()
    # a given number of files: by bytes alone, as Spark merges partitions, so short rows would give few tasks much to do;
    # not by x itself, since Spark drops a repartition that its aggregate's already equals
    parts = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = staged(spread.repartition(parts, F.xxhash64("x")), "simhash-distinct")
    full = full_anchors(spread, threshold, most)

    def out(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), BATCH):
                rows = []
                for name, near, own in zip(*_by_anchor(every[i : i + BATCH], threshold), strict=True):
                    n = full.get(int(name))
                    if n is None:
                        rows.append((name, -1, 0, near.tobytes(), near[own].tobytes()))
                        continue
                    for part in range(threshold + 1):
                        # a factor mixes the value, of which the high bits then choose the piece
                        piece = ((_part(near, part, threshold) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n)
                        for j in np.unique(piece):
                            at = piece == j
                            rows.append((name, part, j, near[at].tobytes(), near[at & own].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "part", "piece", "near", "homes"])

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def met(batches):
        group, near, homes = None, [], []

        def flush():
            parts = None if group[1] < 0 else range(group[1], group[1] + 1)
            pairs = compare(np.frombuffer(b"".join(homes), np.uint64), np.frombuffer(b"".join(near), np.uint64), threshold, parts)
            flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["a", "b"])

        for batch in batches:
            for *name, n, h in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if name != group and near:
                    yield flush()
                    near, homes = [], []
                group = name
                near.append(n)
                homes.append(h)
        if near:
            yield flush()

    sent = spread.mapInArrow(out, "anchor int, part int, piece bigint, near binary, homes binary")
    by = ["anchor", "part", "piece"]
    return sent.repartition(*by).sortWithinPartitions(*by).mapInArrow(met, "a bigint, b bigint")


def _labelled(df: DataFrame, key: str, text: str, threshold: int, shingle: int, most: int) -> DataFrame:
    """``groups`` with ``_c``, a name of the group that no other has: a fingerprint."""
    bounded_batches(df.sparkSession)
    rows = staged(with_fingerprints(df.select(F.col(key), F.col(text)), text, "simhash", shingle).select(key, "simhash"), "simhash")
    least = rows.groupBy("simhash").agg(F.min(key).alias("_least"))
    found = staged(components(links(rows, threshold, most=most), "simhash"), "simhash-components")
    named = least.join(found, F.col("simhash") == F.col("node"), "left").select("simhash", "_least", F.coalesce("component", "simhash").alias("_c"))
    smallest = named.groupBy("_c").agg(F.min("_least").alias("component_id"))
    of = named.join(smallest, "_c").select("simhash", "component_id", "_c")
    return rows.join(of, "simhash").select(key, "simhash", "component_id", "_c")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE, most: int = ANCHOR_ROWS) -> DataFrame:
    """One row for each row: ``(key, simhash long, component_id)``, the smallest key that links reach.

    Rows whose fingerprints differ in at most ``threshold`` bits are linked; equal fingerprints collapse
    first, so copies cost nothing. Null texts count as empty, and texts without a word (fingerprint
    zero) are linked like any other. ``most`` bounds what a task compares and changes no result. Null keys take part, but only a group without other keys has a null
    component. An empty table gives no rows.
    """
    return _labelled(df, key, text, threshold, shingle, most).drop("_c")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest key, one of those that repeat it or of those without keys."""
    p = prefix(df)
    found = _labelled(df, key, text, threshold, shingle, ANCHOR_ROWS).where(F.col(key).eqNullSafe(F.col("component_id")))
    stay = found.select(F.col(key).alias(f"{p}k"), F.col("simhash").alias(f"{p}s"), F.col("_c").alias(f"{p}c")).distinct()
    rows = with_fingerprints(df, text, f"{p}print", shingle)
    # merge: the same plan at every size
    both = rows.join(stay.hint("merge"), F.col(key).eqNullSafe(F.col(f"{p}k")) & (F.col(f"{p}print") == F.col(f"{p}s")))
    return both.dropDuplicates([f"{p}c"]).select(*df.columns)


def hexadecimal(column: str = "simhash") -> F.Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
