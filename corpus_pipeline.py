"""The corpus pipeline: from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import exact, near, packing, quality, substrings
from topicloom.llm.common import prefix, staged, table


#: Workers serve all stages, so the last one's memory of words is kept small.
CACHE_WORDS = 60_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model scores at 0.5 or more, as they were.

    Only the text is scored, null as empty, so of repeated rows all stay or none. A row without an id is
    scored like others. Columns of any names pass. Without documents or labels every score is 0.5, and
    all stay.
    """
    name = f"{prefix(docs)}score"
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out=name).where(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space, as it was: that of the smallest id.

    A null text counts as empty. Of rows that repeat the smallest id one stays; a row without an id stays
    only if its group has none with one. Columns of any names pass. No documents give none.
    """
    return exact.deduplicate(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, as it was: five-word shingles, similarity 0.8 or more, verified.

    SimHash fingerprints and anchor covering give candidates; prefix filtering adds those that are similar but
    have other fingerprints, so none is missed.
    The row of the smallest id stays; rows are told apart by a number of their own, so null and repeated
    ids lose nothing. Null, empty and wordless texts are copies of each other. Columns of any names pass.
    No documents give none.
    """
    return near.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also start earlier; those that lose every word go, and ``n_chars`` follows.

    Documents that lose nothing are as they were, null and empty texts too. A repeated row is treated as
    the row that it repeats; rows of one id with different texts are documents of their own. Columns of
    any names pass. No documents give none.
    """
    p = prefix(docs)
    n_words, n_removed, kept = names = (f"{p}words", f"{p}removed", f"{p}kept")
    found = substrings.remove_repeats(docs, names=names)
    cut = F.col(n_removed) > 0
    new = {"text": F.when(cut, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.where(~cut | (F.col(kept) != "")).withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of at most 2048 tokens.

    A null or empty text is one piece, its end mark. Repeated rows are packed each, and ids may be null.
    Other columns don't enter the result. No documents give no rows.
    """
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=CACHE_WORDS))


STAGES = [(f.__name__, f) for f in (quality_classifier, exact_dedup, simhash_dedup, substring_dedup, best_fit_packing)]

#: The classifier's training can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
