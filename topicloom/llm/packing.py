"""Best-fit packing, planned over runs of equal length.

The rounds over rows of the bulk-synchronous method (range-sort, successor sweeps, conflicts by rank) are
not run. Lengths are 1 to ``capacity``, and pieces of one length are alike to a sweep, so all that it would
decide follows from the histogram of lengths: the driver plans over its at most ``capacity`` runs, from the
longest pieces to the shortest, each into the smallest gap that holds it (the i-th piece takes the i-th such
gap), and pieces without a gap open sequences. What grows with the corpus (tokenising, ranking the
pieces of a length, looking up each one's place) is distributed.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import bounded_batches, remembered, staged

CAPACITY = 2048
#: Words (parts of a text between spaces) whose ids a worker remembers, in two generations of so many, and their longest.
CACHE_WORDS, CACHE_CHARS = 800_000, 48
#: Stands between words that are encoded together.
_MARK = "\x01"
#: Characters that are cut into words at once.
BLOCK = 1 << 20
#: Pieces are ranked within so many blocks of source partitions.
MOST_SOURCES = 4096


class WordIds:
    """Ids by a ``tokenizers`` file, as ``encode(text, add_special_tokens=False)`` gives them.

    Where the file's tokenizer drops white space, what stands on two sides of a space is independent: each
    part between spaces is encoded once and its ids are remembered. For another tokenizer, which ``PROBES``
    tell, whole texts are encoded.
    """

    PROBES = ("a b", " a", "a ", "a  b", "a\nb", "a \n b", "1 2", "it 's", ". .", "a . 1", "<|endoftext|> a", "é  ü")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.most = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        whole = [e.ids for e in self.tokenizer.encode_batch([*self.PROBES], add_special_tokens=False)]
        parts = [[i for w in re.split("[ \n]", p) for i in self.tokenizer.encode(w, add_special_tokens=False).ids] for p in self.PROBES]
        self.by_words = whole == parts
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _slow(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Adds words to ``known``: all are encoded as one text, with a mark between them whose one id tells where each ends."""
        known, older = self.known, self.older
        new = []
        for w in words:
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        if not new:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.nonzero(ids == self.mark)[0] if self.mark is not None else []
        if len(stops) != len(new) - 1:  # the mark stands in a word, or has not one id
            known.update(zip(new, self._slow(new), strict=True))
            return
        raw, stops = ids.tobytes(), (stops * 4).tolist()
        known.update(zip(new, [raw[i:j] for i, j in zip([0, *[x + 4 for x in stops]], [*stops, len(raw)], strict=True)], strict=True))

    def _blocks(self, texts):
        """``(number of the text, words)`` of each block of each text."""
        for no, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text) if len(text) - at <= BLOCK else text.find(" ", at + BLOCK)
                end = len(text) if end < 0 else end
                yield no, text[at:end].replace("\n", " ").split(" ")
                at = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words that are new to some of about BLOCK characters of texts are learned together."""
        if not self.by_words:
            return [x for t in texts for x in self._slow([t])]
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0

        def flush():
            if len(self.known) > self.most:
                self.known, self.older = {}, self.known
            known = self.known
            missing = {w for _, words in held for w in {*words} if w not in known}
            self._learn([*missing])
            for no, words in held:
                out[no].append(b"".join(map(known.__getitem__, words)))
            for w in missing:
                if len(w) > CACHE_CHARS:  # such words hardly come again
                    del known[w]

        for no, words in self._blocks(texts):
            held.append((no, words))
            size += len(words)
            if size > BLOCK // 4:
                flush()
                held, size = [], 0
        flush()
        return [b"".join(x) for x in out]


@functools.lru_cache(maxsize=1)
def word_ids(path: str, cache_words: int) -> WordIds:
    """One for each worker, so that later tasks know the words of earlier ones."""
    return WordIds(path, cache_words)


def _clear() -> bool:
    some = word_ids.cache_info().currsize > 0
    word_ids.cache_clear()
    return some


remembered.append(_clear)


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Tokenises whole texts and cuts those over ``capacity`` ids: ``(key, piece, start, length, ids_crc32[, ids])``.

    A document's ids end with ``end_id``, so a null or empty text is one piece of one id. Strings of special
    tokens in a text count as the library takes them, as special tokens. Repeated rows are cut each, a null
    key stays null, other columns are not read, and no rows give no rows.
    ``cache_words`` bounds what a worker remembers (some 200 bytes a word, twice) and changes no result.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def cut(batches):
        ids_of, end = word_ids(tokenizer, cache_words), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            cols = defaultdict(list)
            raw = ids_of([t.as_py() or "" for t in batch.column(1)])
            for k, ids in zip(batch.column(0).to_pylist(), raw, strict=True):
                ids += end
                for no, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, x in (("k", k), ("piece", no), ("start", at // 4), ("length", len(part) // 4), ("crc", zlib.crc32(part))):
                        cols[name].append(x)
                    if with_ids:
                        cols["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(cols["k"], batch.schema.field(0).type), pa.array(cols["piece"], pa.int32()), *[pa.array(cols[c], pa.int64()) for c in ("start", "length", "crc")]]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(cols["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(key, text).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first rank, end rank, first sequence, offset)``: the rank-th piece of a length goes to
    sequence ``first sequence + rank - first rank`` at ``offset``."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, sequences)
    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            gap = next((g for g in range(length, capacity + 1) if gaps.get(g)), None)
            if gap is not None:
                first, n = gaps[gap].pop()
                k = min(n, left)
                if k < n:
                    gaps[gap].append((first + k, n - k))
                out.append((length, rank, rank + k, first, capacity - gap))
                if gap > length:
                    gaps[gap - length].append((first, k))
                rank, left = rank + k, left - k
                continue
            each = capacity // length
            full, rest = divmod(left, each)
            for j in range(each if full else 0):
                out.append((length, rank, rank + full, opened, j * length))
                rank += full
            if full and capacity - each * length:
                gaps[capacity - each * length].append((opened, full))
            opened += full
            for j in range(rest):
                out.append((length, rank, rank + 1, opened, j * length))
                rank += 1
            if rest:
                if capacity - rest * length:
                    gaps[capacity - rest * length].append((opened, 1))
                opened += 1
            left = 0
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id long`` and ``offset long`` to rows with ``(key, piece, length)``; lengths 1 to ``capacity``.

    The pieces of a sequence lie gapless from offset 0. Order within equal lengths follows the key and
    piece in each source partition; repeated rows are packed each. No rows give no rows.
    """
    names, own_names = parts.columns, {key: "_key", "piece": "piece", "length": "length"}
    parts = parts.toDF(*[own_names.get(c, f"c{i}") for i, c in enumerate(names)])
    rows = staged(parts.withColumn("_source", (F.spark_partition_id() % MOST_SOURCES).cast("int")), "packing")
    spark = rows.sparkSession
    counts = staged(rows.groupBy("length", "_source").count(), "packing-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    by = defaultdict(list)
    for length, *run in plan(histogram, capacity):
        by[length].append(tuple(run))
    run_type = pa.struct([(x, pa.int64()) for x in ("lo", "hi", "seq", "at")])
    columns = [pa.array([*by], pa.int64()), pa.array([[dict(zip(("lo", "hi", "seq", "at"), r, strict=True)) for r in rs] for rs in by.values()], pa.list_(run_type))]
    runs = spark.createDataFrame(pa.table(columns, ["length", "_runs"]))  # an Arrow table, which needs no Python workers
    before = Window.partitionBy("length").orderBy("_source").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_source", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_source").orderBy("_key", "piece")
    # merge: the window has dealt and sorted the rows by these keys, and the starts, up to capacity x MOST_SOURCES rows, are no broadcast
    ranked = rows.withColumn("_own", F.row_number().over(own) - 1).join(starts.hint("merge"), ["length", "_source"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    run = F.filter("_runs", lambda x: (x.lo <= F.col("_rank")) & (F.col("_rank") < x.hi))[0]
    placed = ranked.join(F.broadcast(runs), "length").withColumn("_run", run)  # runs are bounded by the capacity
    return placed.select(
        *[F.col(own_names.get(c, f"c{i}")).alias(c) for i, c in enumerate(names)],
        (F.col("_run.seq") + F.col("_rank") - F.col("_run.lo")).alias("sequence_id"), F.col("_run.at").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token rows themselves, of pieces with ``ids``: ``(sequence_id, ids array<int>)``, at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x.ids)).alias("ids"))
