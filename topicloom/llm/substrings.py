"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words; its minimiser is the word ``gram``-gram with the smallest hash
in it. Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket,
where equal windows meet. There the windows are sorted, so each is counted exactly (equal hashes are
compared as bytes), and all but the first of each are marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import SPACES, bounded_batches, discard, forget, prefix, staged

WINDOW, GRAM = 20, 4
#: Bytes of text whose packed strings are gathered before they are sent, and bytes that are cut into words at once.
FLUSH, BLOCK = 4 << 20, 1 << 20
#: Minimisers are counted in so many slots. The strings of a slot are split into their windows when it leads a share of
#: 1 / HEAVY of all packed strings, or so many of them that they would fill a bucket, whatever the input.
SLOTS, HEAVY = 1 << 24, 4096
#: Minimisers that a task counts at once, and split windows whose first place it remembers.
COUNTED, RECENT = 1 << 20, 1 << 16
#: Buckets for each shuffle partition at least, and packed strings (some 170 bytes each) for each bucket at most, about.
BUCKETS, BUCKET_STRINGS = 2, 1 << 17
_TO_SPACE = bytes.maketrans(SPACES, b" " * len(SPACES))
_LAST = np.iinfo(np.int64).max
_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64) | 1 for i in range(64)], np.uint64)
_BYTE = np.random.default_rng(3).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x5851F42D4C957F2D


def word_blocks(text: str | None, block: int = BLOCK):
    """The words of a text, a list for each block of bytes."""
    data, at = (text or "").encode().translate(_TO_SPACE), 0
    while at < len(data):
        end = len(data) if len(data) - at <= block else data.find(b" ", at + block)
        end = len(data) if end < 0 else end
        yield [w for w in data[at:end].split(b" ") if w]
        at = end


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def super_kmers(words: list[bytes], window: int, gram: int):
    """``(minimiser, first window, end window)`` for each run of windows that share one."""
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(h) - gram + 1
    g = np.zeros(n, np.uint64)
    for i in range(gram):
        g += _mixed(h[i : i + n] + _MIX[i]) * _MIX[i]
    g = _mixed(g)
    at = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(1) + np.arange(len(h) - window + 1)
    cuts = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    return g[at[cuts]], cuts, np.append(cuts[1:], len(at))


def _runs(rows, window: int, gram: int):
    """For each document of ``rows`` (key, number, text): ``(key, number, first word of the block, words, super-k-mers)``."""
    for key, number, text in rows:
        carry, first = [], 0
        for block in word_blocks(text):
            words = carry + block
            if len(words) >= window:
                yield key, number, first, words, super_kmers(words, window, gram)
                carry, first = words[-window + 1 :], first + len(words) - window + 1
            else:
                carry = words


def _flushes(batches, most: int):
    """Lists of ``(key, number, text)`` in the order of keys, of about so many bytes each; a null key counts as the largest."""
    forget()
    rows, size = [], 0
    for batch in batches:
        for k, n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            t = t.as_py() or ""
            rows.append((_LAST if k is None else k, n, t))
            size += len(t)
            if size >= most:
                yield sorted(rows)
                rows, size = [], 0
    if rows:
        yield sorted(rows)


def _blob(entries) -> bytes:
    """Packed strings ``(key, number, start, windows, string)``."""
    *numbers, strings = zip(*entries, strict=True)
    return _numbers_blob(*numbers, [len(s) for s in strings], tail=b"".join(strings))


def _unblob(blob: bytes):
    *numbers, data = _numbers_of(blob, 5)
    return *numbers, data


def _numbers_blob(*columns, tail: bytes = b"") -> bytes:
    # each number as a step from the one before, which is mostly small
    head = [np.diff(np.array(c, np.int64), prepend=0).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(columns[0])).tobytes() + b"".join(head) + tail)


def _numbers_of(blob: bytes, columns: int):
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return *[np.cumsum(np.frombuffer(data, np.int64, n, 8 + 8 * n * i)) for i in range(columns)], data[8 + 8 * n * columns :]


def merged(key: np.ndarray, number: np.ndarray, start: np.ndarray, windows: np.ndarray):
    """Runs in the order of their places; those of one document that touch or overlap become one."""
    order = np.lexsort((start, number, key))
    k, d, s, n = key[order], number[order], start[order], windows[order]
    if not len(k):
        return k, d, s, n
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
    shift = (np.cumsum(new) - 1) * (int((s + n).max()) + 2)  # documents side by side on one line
    reach = np.maximum.accumulate(shift + s + n)
    cut = np.concatenate([[0], np.nonzero(shift[1:] + s[1:] > reach[:-1])[0] + 1])
    last = np.append(cut[1:], len(k)) - 1
    return k[cut], d[cut], s[cut], reach[last] - shift[last] - s[cut]


def heavy_slots(df: DataFrame, window: int, gram: int) -> tuple[np.ndarray, int]:
    """A bit for each slot of minimisers, set if its strings are to be split, and the number of all strings.

    Every string is counted, and what reaches the driver are the split slots. The bits take SLOTS / 8
    bytes at any size of the input. They decide how work is dealt, never a result.
    """

    def count(batches):
        held, size = [], 0

        def flush():
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n, pa.int64())], ["slot", "n"])

        for rows in _flushes(batches, FLUSH):
            for *_, (mins, _, _) in _runs(rows, window, gram):
                held.append((mins % np.uint64(SLOTS)).astype(np.int32))
                size += len(mins)
            if size > COUNTED:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    seen = staged(df.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")), "superkmer-slots")
    total = seen.agg(F.sum("n")).first()[0] or 0
    most = max(64, min(total // HEAVY, BUCKET_STRINGS // 2))
    bits = np.zeros(SLOTS, bool)
    bits[seen.where(F.col("n") >= most).select("slot").toArrow()["slot"].to_numpy()] = True  # SLOTS numbers at most
    discard(seen)
    return np.packbits(bits), total


def _is_set(bits: np.ndarray, mins: np.ndarray) -> np.ndarray:
    slot = mins % np.uint64(8 * len(bits))
    return (bits[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def packed(df: DataFrame, window: int, gram: int, buckets: int, heavy: np.ndarray, flush: int = FLUSH) -> DataFrame:
    """``(bucket int, done boolean, blob binary)``: each flush sends a bucket one blob; equal strings of a flush go once.

    A split window that the task sent before goes again only if it stands earlier now, so a passage of
    many copies costs its bucket a few strings a task, however many flushes that task has.

    The copies that are not the first need no comparison any more; they travel as merged runs, without
    their strings, to the bucket of their document.
    """

    shared = df.sparkSession.sparkContext.broadcast(heavy)

    def out(batches):
        recent: dict[bytes, tuple[int, int, int]] = {}
        for rows in _flushes(batches, flush):
            seen: dict[bytes, tuple[int, int, int]] = {}
            if len(recent) > RECENT:
                recent.clear()
            sent: dict[int, list] = {}
            done: list[tuple[int, int, int, int]] = []
            for key, number, first, words, (mins, lo, hi) in _runs(rows, window, gram):
                hot = _is_set(shared.value, mins)
                for m, a, b, split in zip((mins % np.uint64(buckets)).tolist(), lo.tolist(), hi.tolist(), hot.tolist(), strict=True):
                    for i, j in [(x, x + 1) for x in range(a, b)] if split else ((a, b),):
                        s = b" ".join(words[i : j + window - 1])
                        here, met = (key, number, first + i), recent if split else seen
                        place = met.get(s)
                        if place is None or here < place:
                            met[s] = here
                            sent.setdefault(xxhash.xxh64_intdigest(s) % buckets if split else m, []).append((key, number, first + i, j - i, s))
                        elif place != here:  # else a repeated row
                            done.append((key, number, first + i, j - i))
            blobs = [(b, False, _blob(x)) for b, x in sent.items()]
            blobs += [(b, True, x) for b, x in _by_document(np.array(done, np.int64).reshape(-1, 4).T, buckets)]
            if blobs:
                bucket, is_done, data = zip(*blobs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(is_done, pa.bool_()), pa.array(data, pa.binary())], ["bucket", "done", "blob"])

    return df.mapInArrow(out, "bucket int, done boolean, blob binary")


def _by_document(runs, buckets: int):
    """``(bucket, blob)`` of merged runs (key, number, start, windows), a blob for each bucket of documents."""
    k, d, s, n = merged(*runs)
    to = (_mixed(k.view(np.uint64) ^ d.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.concatenate([[0], np.nonzero(np.diff(to[order]))[0] + 1, [len(to)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            at = order[a:b]
            yield int(to[at[0]]), _numbers_blob(k[at], d[at], s[at], n[at])


def _hashed(data: bytes, counts: np.ndarray, sizes: np.ndarray, window: int):
    """Hash, begin and end of every window of the packed strings in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    power = np.full(len(raw) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], dtype=np.uint64, out=prefix[1:])
    ends = np.cumsum(sizes, dtype=np.int64)
    begins = ends - sizes
    # a word ends at a space or where its string ends; a string of n windows has n + window - 1 words
    spaces = np.nonzero(raw == 32)[0]
    stop = np.sort(np.concatenate([spaces, ends]))
    start = np.sort(np.concatenate([spaces + 1, begins]))
    words = counts.astype(np.int64) + window - 1
    at = np.repeat(np.cumsum(words) - words, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
    lo, hi = start[at], stop[at + window - 1]
    back = pow(_BASE, -1, 1 << 64)
    inverse = np.full(len(raw) + 1, back, np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    return _mixed((prefix[hi] - prefix[lo]) * inverse[lo] + (hi - lo).astype(np.uint64)), lo, hi


def _repeats(blobs: list[bytes], window: int):
    """``key, number, start, windows``: runs of windows of the bucket's strings that are not the first of their kind."""
    keys, numbers, starts, hashes, spans, texts = [], [], [], [], [], []
    for b in blobs:
        k, d, s, m, size, data = _unblob(b)
        texts.append(data)
        h, lo, hi = _hashed(data, m, size, window)
        keys.append(np.repeat(k, m))
        numbers.append(np.repeat(d, m))
        starts.append(np.repeat(s, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))  # as long as a text may be
        hashes.append(h)
        spans.append(np.stack([np.full(len(h), len(texts) - 1, np.int32), lo.astype(np.int32), hi.astype(np.int32)], 1))
    none = np.zeros(0, np.int64)
    if not keys:
        return none, none, none, none
    h = np.concatenate(hashes)
    hashes.clear()
    # windows whose hash is alone are done; the rest is sorted by hash, key and place
    order = np.argsort(h)
    h = h[order]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    met_again = same | np.append(same[1:], False)
    order, h = order[met_again], h[met_again]
    take = lambda parts: np.concatenate(parts)[order]
    k, d, s, span = take(keys), take(numbers), take(starts), take(spans)
    for parts in (keys, numbers, starts, spans):
        parts.clear()
    if not len(h):
        return none, none, none, none
    order = np.lexsort((s, d, k, h))
    k, d, s, h, span = k[order], d[order], s[order], h[order], span[order]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    later = same.copy()
    text = lambda i: texts[span[i, 0]][span[i, 1] : span[i, 2]]
    first = 0
    for i in np.nonzero(same)[0].tolist():
        if not same[i - 1] or i - 1 < first:
            first = i - 1
        if text(i) != text(first):  # two windows share a hash: sort this group by its bytes
            j = first
            while j + 1 < len(h) and h[j + 1] == h[first]:
                j += 1
            met: set[bytes] = set()
            for x in range(first, j + 1):
                later[x] = text(x) in met
                met.add(text(x))
    # the same place of one document (a repeated row) is not earlier than itself
    tie = later & np.concatenate([[False], (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (s[1:] == s[:-1])])
    for i in np.nonzero(tie)[0].tolist():
        later[i] = later[i - 1]
    return k[later], d[later], s[later], np.ones(int(later.sum()), np.int64)


def number_of(text) -> F.Column:
    """Tells rows of one key with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, flush: int = FLUSH) -> DataFrame:
    """``(key, number, runs array<struct<start,end>>)``: the words of each document that are in a window whose word sequence also starts earlier.

    Earlier is: at a smaller key, among rows of one key at a smaller ``number_of`` their text, or earlier in
    the document. Buckets grow with the input, and each is held alone. What a task finds leaves it as one
    packed blob for each bucket of documents; there the runs of a document meet and become one row.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("bigint").alias("k"), number_of(F.col(text)).alias("d"), F.col(text).alias("t"))
    heavy, strings = heavy_slots(rows, window, gram)
    buckets = buckets or max(parts * BUCKETS, strings // BUCKET_STRINGS)
    sent = packed(rows, window, gram, buckets, heavy, flush)

    def find(batches):
        bucket, blobs, found, held = None, [], [], 0

        def flush():
            for to, blob in _by_document([np.concatenate(c) for c in zip(*found, strict=True)], buckets):
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for b, done, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != bucket:
                    if blobs:
                        found.append(_repeats(blobs, window))
                        held, blobs = held + len(found[-1][0]), []
                    if held > FLUSH:
                        yield from flush()
                        found, held = [], 0
                    bucket = b
                if done:
                    found.append(_numbers_of(blob.as_py(), 4)[:4])
                    held += len(found[-1][0])
                else:
                    blobs.append(blob.as_py())
        if blobs:
            found.append(_repeats(blobs, window))
        if found:
            yield from flush()

    def gather(batches):
        bucket, found = None, []

        def flush():
            k, d, s, n = merged(*[np.concatenate(c) for c in zip(*found, strict=True)])
            cuts = np.concatenate([[0], np.nonzero((k[1:] != k[:-1]) | (d[1:] != d[:-1]))[0] + 1])
            runs = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(s + n + (window - 1), pa.int64())], ["start", "end"])
            runs = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(k)), pa.int32()), runs)
            return pa.RecordBatch.from_arrays([pa.array(k[cuts], pa.int64(), mask=k[cuts] == _LAST), pa.array(d[cuts], pa.int64()), runs], ["key", "number", "runs"])

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket and found:
                    yield flush()
                    found = []
                bucket = b
                found.append(_numbers_of(blob.as_py(), 4)[:4])
        if found:
            yield flush()

    found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(find, "bucket int, blob binary")
    return found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "key bigint, number bigint, runs array<struct<start:bigint,end:bigint>>")


def _kept(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """The words that no run covers, joined by one space."""
    n_words, n_removed, kept = [], [], []
    for t, r in zip(texts, runs, strict=True):
        spans = sorted((x["start"], x["end"]) for x in r.as_py() or ())
        out, at, gone, i = [], 0, 0, 0
        for words in word_blocks(t.as_py()):
            end, place = at + len(words), at
            while i < len(spans) and spans[i][0] < end:
                lo, hi = max(spans[i][0], place), min(spans[i][1], end)
                if hi > lo:
                    out += words[place - at : lo - at]
                    gone, place = gone + hi - lo, hi
                if spans[i][1] > end:
                    break
                i += 1
            out += words[place - at :]
            at = end
        n_words.append(at)
        n_removed.append(gone)
        kept.append(b" ".join(out).decode())
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, names: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """The rows of ``df`` with ``n_words long, n_removed long, kept string`` added, under the given ``names``.

    Each word that a repeated window covers is removed, and the first place of each window stays.
    Words are runs of bytes other than white space; null and empty texts have none. A repeated row is
    treated as the row that it repeats. Rows of one key with different texts are documents of their own;
    the one whose text has the smaller hash counts as earlier. A null key counts as the largest.
    Keys are integers. Columns of ``df`` that are named like the new ones, in any case, are replaced. An empty
    table gives no rows.
    """
    p = prefix(df)
    found = repeated_windows(df, key, text, window, gram).select(F.col("key").alias(f"{p}k"), F.col("number").alias(f"{p}d"), F.col("runs").alias(f"{p}runs"))
    both = df.join(found, F.col(key).cast("bigint").eqNullSafe(F.col(f"{p}k")) & (number_of(F.col(text)) == F.col(f"{p}d")), "left")
    # called nondeterministic, so that a filter on its results doesn't evaluate it a second time, in a second worker
    cut = arrow_udf(_kept, "struct<n_words:bigint,n_removed:bigint,kept:string>").asNondeterministic()
    both = both.withColumn(f"{p}out", cut(F.col(text), F.col(f"{p}runs")))
    taken = {n.lower() for n in names}
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[F.col(f"{p}out.{c}").alias(new) for c, new in zip(("n_words", "n_removed", "kept"), names, strict=True)])
