"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is its UTF-8 bytes read as one number in base 256, modulo a 120-bit prime. Those
of two chunks combine by a shift of the second one's length: f(ab) = f(a) 256^|b| + f(b). So chunks of
a huge document are hashed by many tasks. Texts with equal fingerprint and length are then compared
chunk by chunk, so no two texts are called equal by fingerprints alone. Only where that comparison finds
unlike texts of one fingerprint does their SHA-256 tell which are which.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import bounded_batches, normal_space, prefix, staged

#: Fixed value: the largest prime below 2^120.
PRIME = 2**120 - 119
#: Bytes that are hashed at once, and bytes from which a document's chunks go to several tasks.
CHUNK, HUGE = 1 << 16, 1 << 24
#: Characters that are compared at once.
COMPARE = 1 << 16


def fingerprint(data: bytes) -> int:
    return int.from_bytes(data, "big") % PRIME


def combine(left: int, right: int, right_bytes: int) -> int:
    return (left * pow(256, right_bytes, PRIME) + right) % PRIME


def _whole(data: bytes) -> bytes:
    f = 0
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        f = combine(f, fingerprint(part), len(part))
    return f.to_bytes(15, "big")


def _prints(texts: pa.Array) -> pa.Array:
    return pa.array([_whole((t.as_py() or "").encode()) for t in texts], pa.binary())


def _joined(parts: pa.Array) -> pa.Array:
    out = []
    for chunks in parts:
        f = 0
        for c in chunks.as_py():
            f = combine(f, int.from_bytes(c["f"], "big"), c["n"])
        out.append(f.to_bytes(15, "big"))
    return pa.array(out, pa.binary())


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", huge: int = HUGE) -> DataFrame:
    """One row ``(key, fingerprint binary, n_bytes, text_sha256)`` for each row, of the text with white space normalised.

    Null counts as empty. Documents of ``huge`` bytes or more are hashed in chunks by several tasks.
    """
    bounded_batches(df.sparkSession)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0))
    narrow = df.select(F.col(key).alias("_key"), normal_space(F.col(text)).alias("_text"), size.alias("_size"))
    last = [F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("text_sha256")]
    small = narrow.where(size < huge).select("_key", arrow_udf(_prints, "binary")("_text").alias("fingerprint"), *last)
    step = huge // 4
    chunks = (
        narrow.where(size >= huge)
        .withColumn("_row", F.monotonically_increasing_id())
        .select("_key", "_row", *last, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("_text") / step).cast("int") - 1))).alias("_no"), F.col("_text"))
        .select("_key", "_row", "n_bytes", "text_sha256", "_no", F.substring(F.col("_text"), F.col("_no") * step + 1, F.lit(step)).alias("_part"))
        .repartition(F.col("_row"), F.col("_no"))
        .select("_key", "_row", "n_bytes", "text_sha256", F.struct(F.col("_no").alias("no"), F.octet_length("_part").cast("long").alias("n"), arrow_udf(_prints, "binary")("_part").alias("f")).alias("_c"))
    )
    large = chunks.groupBy("_key", "_row", "n_bytes", "text_sha256").agg(F.array_sort(F.collect_list("_c")).alias("_cs"))
    large = large.select("_key", arrow_udf(_joined, "binary")("_cs").alias("fingerprint"), "n_bytes", "text_sha256")
    return small.unionByName(large).withColumnRenamed("_key", key)


def unequal(df: DataFrame, suspects: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Those ``(fingerprint, n_bytes)`` of ``suspects(key, fingerprint, n_bytes, text_sha256)`` whose texts are not all equal.

    Texts stream by chunk; equal chunks collapse before they are shuffled, so a group of any size sends
    one copy of each chunk from a task. A row meets its own fingerprint by key, null or not, and SHA-256, so
    rows that repeat a key, or have none, are compared too; repeated rows count once. No suspects give none.
    """
    p = prefix(df)
    rows = df.select(F.col(key).alias(f"{p}k"), normal_space(F.col(text)).alias("_text")).withColumn(f"{p}s", F.sha2("_text", 256))
    asked = suspects.select(key, "fingerprint", "n_bytes", "text_sha256").distinct()
    # merge: the same plan at every size
    pairs = rows.join(asked.hint("merge"), F.col(f"{p}k").eqNullSafe(asked[key]) & (F.col(f"{p}s") == F.col("text_sha256")))
    many = F.greatest(F.lit(0), F.ceil(F.length("_text") / COMPARE).cast("int") - 1)
    part = (
        pairs.select("fingerprint", "n_bytes", "_text", F.explode(F.sequence(F.lit(0), many)).alias("_no"))
        .select("fingerprint", "n_bytes", "_no", F.substring(F.col("_text"), F.col("_no") * COMPARE + 1, F.lit(COMPARE)).alias("_part"))
        .groupBy("fingerprint", "n_bytes", "_no", "_part").agg(F.count("*").alias("_copies"))
    )
    return part.groupBy("fingerprint", "n_bytes", "_no").count().where("count > 1").select("fingerprint", "n_bytes").distinct()


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", huge: int = HUGE) -> DataFrame:
    """One row for each row: ``(key, keep_id, group_size, kept, text_sha256)``.

    Rows whose texts are equal after each run of white space became one space form a group, null with
    empty. The smallest key stays; among rows that repeat a key in one group all are marked ``kept``
    (``deduplicate`` leaves one of them). Rows with a null key join a group but stay only if all of the
    group have none. An empty table gives no rows.
    """
    prints = staged(fingerprints(df, key, text, huge), "exact-prints")
    # counts are written before they are joined: only sides that are shuffled as they stand can be split where a group is hot
    same = staged(prints.groupBy("fingerprint", "n_bytes").agg(F.count("*").alias("_n")), "exact-counts")
    suspects = staged(prints.join(same.where("_n > 1"), ["fingerprint", "n_bytes"]).select(key, "fingerprint", "n_bytes", "text_sha256"), "exact-suspects")
    odd = staged(unequal(df, suspects, key, text), "exact-unequal")
    if odd.isEmpty():
        marked = prints.withColumn("_split", F.lit(""))
    else:
        marked = prints.join(odd.withColumn("_odd", F.lit(True)), ["fingerprint", "n_bytes"], "left").withColumn("_split", F.when(F.col("_odd"), F.col("text_sha256")).otherwise("")).drop("_odd")
    by = ["fingerprint", "n_bytes", "_split"]
    least = staged(marked.groupBy(*by).agg(F.min(key).alias("keep_id"), F.count("*").alias("group_size")), "exact-least")
    return marked.join(least, by).select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each group, with their columns as they were."""
    p = prefix(df)
    stay = groups(df, key, text).where("kept").select(F.col(key).alias(f"{p}k"), F.col("text_sha256").alias(f"{p}s")).distinct()
    rows = df.withColumn(f"{p}sha", F.sha2(normal_space(F.col(text)), 256))
    both = rows.join(stay.hint("merge"), F.col(key).eqNullSafe(F.col(f"{p}k")) & (F.col(f"{p}sha") == F.col(f"{p}s")), "left_semi")
    return both.dropDuplicates([key, f"{p}sha"]).drop(f"{p}sha")
