"""Noun lemmas: plurals become singulars where the singular is a known word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import lexicon, text


def noun_lemmas(vocabulary: DataFrame, stop=(), known=()) -> DataFrame:
    """``(word, lemma)`` of those words of ``vocabulary(word)`` that have another lemma.

    Irregular forms come from the table. Else the rules of detachment are tried in order, and the first
    whose result is a word of the vocabulary (or of ``known``) holds. Stop words, words of up to three
    letters and the listed exceptions stay.
    """
    word = F.col("word")
    fine = vocabulary.where(word.isNotNull() & ~text.among(word, [*stop, *lexicon.NO_PLURALS])).select("word").distinct()
    tried = [F.when(F.endswith(word, F.lit(end)) & (F.length(word) > max(3, len(end))), F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(new))) for end, new in lexicon.NOUN_ENDINGS]
    regular = fine.where(~text.among(word, [*lexicon.NOUN_FORMS]) & ~F.endswith(word, F.lit("ss")) & F.rlike(word, F.lit("(s|men)$")))
    tries = regular.select("word", F.posexplode(F.array(*tried)).alias("i", "lemma")).where("lemma is not null")
    there = vocabulary.where(word.isNotNull()).select(word.alias("lemma")).distinct()
    if known:
        there = there.unionByName(vocabulary.sparkSession.createDataFrame([(w,) for w in known], "lemma string")).distinct()
    found = tries.join(there, "lemma").groupBy("word").agg(F.min_by("lemma", "i").alias("lemma"))
    table = F.create_map(*[F.lit(x) for pair in lexicon.NOUN_FORMS.items() for x in pair])
    odd = fine.where(text.among(word, [*lexicon.NOUN_FORMS])).select("word", F.element_at(table, word).alias("lemma"))
    return found.unionByName(odd).where("word <> lemma")


def vocabulary(questions: DataFrame) -> DataFrame:
    """The distinct words of ``questions(normalized)``."""
    return questions.select(F.explode(text.words(F.col("normalized"))).alias("word")).distinct()


def lemmatize(questions: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``questions`` with each word of ``normalized`` replaced by its lemma.

    Only questions that hold a word with another lemma are joined; the table is broadcast where Spark
    knows that it is small.
    """
    w = text.words(F.col("normalized"))
    met = questions.select("q_id", F.explode(F.array_distinct(w)).alias("word")).join(lemmas, "word")
    own = met.groupBy("q_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("_lemmas"))  # of one question
    both = questions.join(own, "q_id", "left")
    plain = F.array_join(F.transform(w, lambda x: F.coalesce(F.try_element_at("_lemmas", x), x)), " ")
    return both.withColumn("normalized", F.when(F.col("_lemmas").isNull(), F.col("normalized")).otherwise(plain)).drop("_lemmas")
