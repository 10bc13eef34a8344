"""Near-dedup by SimHash, with a verified similarity of shingle sets and an exact way for what fingerprints miss.

Two texts are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Texts whose
SimHash fingerprints of these shingles differ in few bits are candidates; anchor covering finds them. Not
all similar texts have such fingerprints. The rest comes from prefix filtering: under any one order of all
shingles, the sets of a similar pair share a shingle among the first n - ceil(0.8 n) + 1 of either, so
comparing the documents that share one finds every link. The order puts shingles that lead many documents
last and is else that of their hashes. All candidates are verified on their whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm import simhash
from topicloom.llm.common import bounded_batches, components, discard, forget, prefix, staged
from topicloom.llm.simhash import _TABLE
from topicloom.llm.substrings import _MIX, _mixed

SHINGLE = 5
#: The least similarity as a fraction, so that all bounds are in whole numbers.
UP, DOWN = 4, 5
#: A shingle comes last in the order if it leads more documents than this, or than a share of all leading shingles by which no more than so many do.
HEAVY, MOST_HEAVY = 32, 1 << 19
#: Shingles that are counted at once, and how often one stands among them to be taken down.
FLUSH, OFTEN = 1 << 20, 3


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles, made of the hashes of their words; a shorter text is one shingle, and so is one without a word."""
    words = [w for w in (text or "").encode().translate(_TABLE).split(b" ") if w]
    if not words:
        return np.zeros(1, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += _mixed(h[i : i + n] + _MIX[i]) * _MIX[i]
    return np.unique(_mixed(out))


def leading(x: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order: any similar set has one of them among its own first."""
    if len(heavy):
        late = heavy[np.minimum(np.searchsorted(heavy, x), len(heavy) - 1)] == x
        x = np.concatenate([x[~late], x[late]])
    return x[: len(x) - -(-UP * len(x) // DOWN) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DOWN >= UP * (len(a) + len(b) - both)


_SKETCH = [f"s{i}" for i in range(8)]


def _tokens(rows: DataFrame, heavy: np.ndarray) -> DataFrame:
    """``(token, row, n, at)``: the leading shingles of each row, the size of its set and the place in the order."""
    shared = rows.sparkSession.sparkContext.broadcast(heavy)

    def out(batches):
        forget()
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                names, texts = (batch.column(c).slice(i, 100).to_pylist() for c in (0, 1))
                sets = [shingles(t) for t in texts]
                first = [leading(x, shared.value) for x in sets]
                k = [len(x) for x in first]
                columns = [
                    pa.array(np.concatenate(first).view(np.int64), pa.int64()), pa.array(np.repeat(np.array(names, np.int64), k), pa.int64()),
                    pa.array(np.repeat([len(x) for x in sets], k), pa.int64()), pa.array(np.concatenate([np.arange(m) for m in k]), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["token", "row", "n", "at"])

    return rows.select("row", "text").mapInArrow(out, "token bigint, row bigint, n bigint, at bigint")


def _shared(tokens: DataFrame) -> DataFrame:
    """The rows of tokens that lead several, with the places of two of these: the least and the greatest by a hash."""
    names = ["token", "row", "n", "at", *(f"{c}{i}" for i in (0, 1) for c in ("row", "n", "at"))]

    def whole(x):
        with np.errstate(over="ignore"):
            x = x[:, np.lexsort((x[1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), x[0]))]
        lo = np.nonzero(np.diff(x[0], prepend=~x[0][:1]))[0]
        size = np.diff(lo, append=x.shape[1])
        ends = [np.repeat(x[1:, at], size, axis=1) for at in (lo, lo + size - 1)]
        out = np.concatenate([x, *ends])[:, np.repeat(size, size) > 1]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    def out(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if held and x[0, -1] == held[0][0, 0]:
                held.append(x)
                continue
            x = np.concatenate([*held, x], axis=1)
            cut = int(np.searchsorted(x[0], x[0, -1]))
            held = [x[:, cut:]]
            if cut:
                yield whole(x[:, :cut])
        if held:
            yield whole(np.concatenate(held, axis=1))

    return tokens.repartition("token").sortWithinPartitions("token").mapInArrow(out, ", ".join(f"{c} bigint" for c in names))


def _common(rows: DataFrame) -> np.ndarray:
    """Shingles that several of some FLUSH bytes of documents hold: those of common lines and passages, wherever they stand in the order."""

    def out(batches):
        forget()
        held, size = [], 0

        def flush():
            x, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x[n >= OFTEN].view(np.int64), pa.int64()), pa.array(n[n >= OFTEN], pa.int64())], ["token", "c"])

        for batch in batches:
            for t in batch.column(0):
                held.append(shingles(t.as_py()))
                size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return _most(staged(rows.select("text").mapInArrow(out, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c")), "near-common"))


def _most(counts: DataFrame) -> np.ndarray:
    """Tokens of the largest counts: at most ``MOST_HEAVY``, whatever the input."""
    least = max(HEAVY, (counts.agg(F.sum("c")).first()[0] or 0) // MOST_HEAVY)
    some = counts.where(F.col("c") > least).select("token").toArrow()["token"].to_numpy()
    discard(counts)
    return np.sort(some.astype(np.int64).view(np.uint64))


def _heavy(rows: DataFrame) -> np.ndarray:
    """Shingles that come last in the order: common ones, and those that lead more documents than others. It changes no result."""
    common = _common(rows)
    counts = staged(_tokens(rows, common).groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "near-counts")
    return np.union1d(common, _most(counts))


def _fits(a: str, b: str) -> F.Column:
    """Whether sets of which the token at these places is the first that they share can be similar: at most it and what follows it is shared.

    What stands before a shared token in the one order stands before it in both sets, so a similar pair
    passes at the first token that it shares.
    """
    c = lambda s, x: F.col(f"{s}.{x}")
    most = F.least(c(a, "n") - c(a, "at"), c(b, "n") - c(b, "at"))
    return (UP + DOWN) * most >= UP * (c(a, "n") + c(b, "n"))


def _sketches(rows: DataFrame) -> DataFrame:
    """``(node, s0 .. s7)``: 512 bits for each row, the parity of the shingles that hash to each.

    Where two sketches differ in a bit, some shingle is in one set alone. So sets whose sketches differ
    in h bits share at most (n + m - h) / 2 shingles: an exact bound, whatever the texts.
    """

    def out(batches):
        forget()
        for batch in batches:
            odd = np.stack([np.bincount((shingles(t.as_py()) >> np.uint64(55)).astype(np.int64), minlength=512) & 1 for t in batch.column(1)]) if batch.num_rows else np.zeros((0, 512), int)
            bits = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(8)]], ["node", *_SKETCH])

    return rows.select("row", "text").mapInArrow(out, ", ".join(f"{c} bigint" for c in ("node", *_SKETCH)))


def _alike(a: str, b: str) -> F.Column:
    """Whether sets can be similar by their sizes and sketches."""
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(8)), F.lit(0))
    return (DOWN - UP) * (F.col(f"{a}.n") + F.col(f"{b}.n")) >= (UP + DOWN) * apart


def _by_fingerprints(rows: DataFrame) -> DataFrame:
    """Candidates ``(a long, b long)``: rows of one SimHash fingerprint with the first of them, and first rows of fingerprints that are linked."""
    prints = staged(simhash.with_fingerprints(rows, "text", "print", SHINGLE).select("row", "print"), "near-prints")
    least = staged(prints.groupBy("print").agg(F.min("row").alias("least"), F.count("*").alias("c")), "near-first-rows")
    same = prints.join(least.where("c > 1"), "print").where("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b"))
    of = lambda c: least.select(F.col("print").alias(c), F.col("least").alias(f"{c}_row"))
    met = simhash.links(prints, column="print").join(of("a"), "a").join(of("b"), "b")
    out = staged(same.unionByName(met.select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b"))), "near-candidates")
    discard(prints)
    discard(least)
    return out


def _verified(pairs: DataFrame, rows: DataFrame, tag: str) -> DataFrame:
    """Those of ``pairs(a long, b long)`` whose whole texts are similar."""

    @arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        forget()
        return pa.array([similar(shingles(x.as_py()), shingles(y.as_py())) for x, y in zip(left, right, strict=True)], pa.bool_())

    text = lambda c: rows.select(F.col("row").alias(c), F.col("text").alias(f"t{c}"))
    pairs = staged(pairs.distinct(), f"{tag}-pairs")
    both = pairs.join(text("a"), "a").join(text("b"), "b")
    out = staged(both.where(alike("ta", "tb")).select("a", "b"), tag)
    discard(pairs)
    return out


def links(rows: DataFrame) -> DataFrame:
    """Links ``(a long, b long)`` between rows of ``rows(row long, text)``, enough of them to connect all that are similar.

    First each row is compared with those that its fingerprint is near to, and with two rows of those that share a
    leading shingle with it. Then all pairs
    that share one, are not yet connected and can be similar by places, sizes and sketches are compared, so a
    large group of copies costs few comparisons, and one of unlike texts too.
    """
    near = _by_fingerprints(rows)
    written = staged(_shared(_tokens(rows, _heavy(rows))), "near-shared")
    place = lambda i: F.struct(F.col(f"row{i}").alias("row"), F.col(f"n{i}").alias("n"), F.col(f"at{i}").alias("at"))
    shared = written.withColumns({"lo": place(0), "hi": place(1)})
    x = shared.select("token", F.struct("row", "n", "at").alias("x"), F.explode(F.array("lo", "hi")).alias("y"))
    pair = [F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")]
    first = _verified(near.unionByName(x.where((F.col("x.row") != F.col("y.row")) & _fits("x", "y")).select(*pair)), rows, "near-first")
    discard(near)
    found = staged(components(first, "near-first"), "near-connected")
    x = shared.select("token", F.struct("row", "n", "at").alias("x")).join(found, F.col("x.row") == F.col("node"), "left")
    # pairs within a component need no comparison, so only tokens of several components stay
    x = x.select("token", "x", F.coalesce("component", "x.row").alias("c"))
    many = x.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    x = open_ = staged(x.join(many, "token"), "near-open")
    discard(written)
    sketched = staged(_sketches(rows.join(x.select(F.col("x.row").alias("row")).distinct(), "row", "left_semi")), "near-sketches")
    x = x.join(sketched, F.col("x.row") == F.col("node")).select("token", F.struct("x.row", "x.n", "x.at", *_SKETCH).alias("x"), "c")
    x = staged(x, "near-sketched")
    discard(open_)
    discard(sketched)
    y = x.select("token", F.col("x").alias("y"), F.col("c").alias("d"))
    last = x.join(y, "token").where((F.col("c") < F.col("d")) & _fits("x", "y") & _alike("x", "y")).select(*pair)
    found = first.unionByName(_verified(last, rows, "near-last"))
    discard(x)
    return found


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group that links connect, with its columns as they were: that of the smallest key.

    Rows are told apart by a number of their own, so null and repeated keys are like any others: a null
    key stays only if its group has no other, and of rows that repeat the smallest key one stays. Null
    texts count as empty, and texts without a word are copies of each other.
    """
    bounded_batches(df.sparkSession)
    p = prefix(df)
    df = staged(df.withColumn(f"{p}row", F.monotonically_increasing_id()), "near-rows")
    rows = df.select(F.col(f"{p}row").alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    found = staged(components(links(rows), "near"), "near-components")
    named = found.join(rows.select("row", "key"), F.col("node") == F.col("row"))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    stay = named.groupBy("component").agg(F.min(order)["row"].alias("stay")).select("stay")
    gone = found.join(stay, F.col("node") == F.col("stay"), "left_anti").select(F.col("node").alias(f"{p}gone"))
    return df.join(gone.hint("merge"), F.col(f"{p}row") == F.col(f"{p}gone"), "left_anti").drop(f"{p}row")
