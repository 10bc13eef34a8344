"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import bounded_batches

#: Texts are cut near multiples of so many characters before the regex runs over them.
CHUNK_CHARS = 1 << 16
_SPACE = r"\p{White_Space}"
#: Between these two characters every match of the pattern ends: no branch goes on from text to white
#: space, from a letter to a digit or from a digit to a letter, and no branch looks behind.
_SAFE = regex.compile(rf"(?<=[^{_SPACE}])(?={_SPACE})|(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})")
#: White space runs this long would exhaust the regex engine's backtracking limit.
_LONG_RUN = regex.compile(rf"{_SPACE}{{50000,}}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens; built once a worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(f"ranks:{rank_file}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, chunk: int = CHUNK_CHARS):
    """Cuts ``text`` only where every match ends, so encoding piece by piece equals encoding the whole."""
    at = 0
    while len(text) - at > chunk:
        cut = _SAFE.search(text, at + chunk)
        if not cut or cut.start() >= len(text):
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc, text: str) -> np.ndarray:
    """The ids of a whole text, four bytes each."""
    ids: list[np.ndarray] = []
    plain = lambda t: ids.append(enc.encode_to_numpy(t, disallowed_special=()))
    for piece in safe_pieces(text):
        at = 0
        for run in _LONG_RUN.finditer(piece):
            # the pattern's own rule: a run keeps its last character for what follows it in the text
            end = run.end() if run.end() == len(piece) else run.end() - 1
            plain(piece[at : run.start()])
            ids.append(np.array(enc._encode_single_piece(piece[run.start() : end].encode()), np.uint32))
            at = end
        plain(piece[at:] if at else piece)
    return (ids[0] if len(ids) == 1 else np.concatenate(ids)).astype(np.int32)


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the token ids of the whole text; null counts as empty and gives no ids.

    Long texts are cut at safe boundaries first, so the regex works in bounded memory. Only the text
    column goes to Python; other columns, whatever their names, stay in the JVM. A column that is
    already named ``out`` is replaced. Repeated rows have equal ids, null keys pass, no rows give no rows.
    """

    bounded_batches(df.sparkSession)

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoding(rank_file, pattern)
        lists = [encode_text(enc, t.as_py() or "") for t in texts]
        ends = np.cumsum([0, *map(len, lists)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32), pa.int32()))

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes that the ids stand for (binary: ids may end inside a character); null gives none, and no rows give no rows. A column named ``out`` is replaced."""

    @arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        enc = encoding(rank_file, pattern)
        return pa.array([enc.decode_bytes(x.as_py() or []) for x in lists], pa.binary())

    return df.withColumn(out, raw(F.col(ids)))


def digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
