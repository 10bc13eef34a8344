"""Streaming: with frozen term statistics, assignment needs no state, so a stream of questions can be tagged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom import store
from topicloom.functions import text
from topicloom.operators import assign, lemmas


def tag_stream(questions: DataFrame, counts: DataFrame, stop, sink, checkpoint: str, lang: str = "en", noun_lemmas: DataFrame | None = None):
    """Starts a query that passes each micro-batch of ``questions(q_id, question)`` as ``(q_id, terms, tags)`` to ``sink(df, batch id)``.

    The terms made of ``counts`` are written once. ``noun_lemmas`` is the table ``(word, lemma)`` that the
    statistics were made with, if any; a chunker or a tagger shows in the statistics alone.
    """
    terms = store.staged(assign.model(counts, stop), "terms") if "sort_cnt" not in counts.columns else counts

    def batch(df: DataFrame, number: int) -> None:
        asked = df.select("q_id", "question", text.normalize(F.col("question"), lang).alias("normalized"))
        sink(assign.assign(asked if noun_lemmas is None else lemmas.lemmatize(asked, noun_lemmas), terms, stop), number)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
