"""Term statistics: n-grams of chunks, counted, ranked and thinned out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import lexicon, text
from topicloom.store import spread, staged

MIN_PHRASE, MIN_UNIGRAM, MIN_VERB = 2, 5, 1
#: Where a term stands: question, chunk, trigrams (0) before bigrams (1), place. Orders as Spark orders structs.
PLACE = "struct<q:bigint,c:int,k:int,i:int>"


def forms_of(verbs) -> dict[str, str]:
    """A table form -> base; words of a plain list are their own base."""
    return dict(verbs) if isinstance(verbs, dict) else {v: v for v in verbs}


def cut_chunks(questions: DataFrame, stop, verbs, *more: str) -> DataFrame:
    """``(q_id, c, chunk array<string>)``, and the columns of ``more``: runs of words between stop words, verb forms and marks."""
    cut = text.chunks(text.words(F.col("normalized")), [*stop, *verbs])
    return questions.select("q_id", *more, F.posexplode(cut).alias("c", "chunk"))


def tag_verbs(questions: DataFrame, stop, verbs, *more: str) -> DataFrame:
    """``(q_id, i, term)``, and the columns of ``more``: bases of the verbs and of phrases of adverbs and a verb, without stop words and single letters."""
    forms = forms_of(verbs)
    if not forms:
        return questions.select("q_id", *more, F.lit(0).alias("i"), F.lit("").alias("term")).limit(0)
    found = questions.select("q_id", *more, F.inline(text.verb_words(text.words(F.col("normalized")), forms)))
    bases = found.sparkSession.createDataFrame([*forms.items()], "term string, base string")
    based = found.join(F.broadcast(bases), "term", "left").select("q_id", *more, "i", F.coalesce("base", "term").alias("term"))  # the caller's word table, no data
    return based.where(~text.among(F.col("term"), [*stop]) & (F.length("term") > 1))


def mine(questions: DataFrame, stop, verbs=None, chunker=None, tagger=None) -> DataFrame:
    """Occurrences ``(kind, term, ord)`` of phrases, unigrams and verbs in ``questions(q_id, normalized)``.

    ``ord`` tells where they stand (``PLACE``). ``chunker`` takes the questions to rows ``(q_id, c, chunk
    array<string>)`` and ``tagger`` to ``(q_id, i, term)``: any DataFrame function, so also ``mapInArrow`` or
    ``mapInPandas`` around a language model. By default chunks end at stop words, verbs and marks, and a column
    ``_n`` of the questions, how many times each is asked, goes with their occurrences.
    """
    verbs = forms_of(lexicon.verb_table() if verbs is None else verbs)
    more = ["_n"] if "_n" in questions.columns and not chunker and not tagger else []
    chunked = chunker(questions) if chunker else cut_chunks(questions, stop, verbs, *more)
    chunked = chunked.select("q_id", *more, "c", F.filter("chunk", lambda w: ~text.among(w, [*stop])).alias("chunk"))
    at = lambda c, k, i: F.struct(F.col("q_id").cast("bigint").alias("q"), c.cast("int").alias("c"), F.lit(k).alias("k"), i.cast("int").alias("i"))
    grams = lambda kind, n, k: F.transform(text.ngrams(F.col("chunk"), n), lambda t, i: F.struct(F.lit(kind).alias("kind"), t.alias("term"), at(F.col("c"), k, i).alias("ord")))
    rows = chunked.select(*more, F.inline(F.concat(grams("phrase", 3, 0), grams("phrase", 2, 1), grams("unigram", 1, 0))))
    spoken = tagger(questions) if tagger else tag_verbs(questions, stop, verbs, *more)
    spoken = spoken.select(*more, F.lit("verb").alias("kind"), "term", at(F.lit(0), 0, F.col("i")).alias("ord"))
    return rows.unionByName(spoken).where((F.col("kind") == "phrase") | (F.length("term") > 1))


def count(occurrences: DataFrame) -> DataFrame:
    """``(kind, term, cnt, first_seen)``; occurrences count, not documents."""
    n = F.sum("_n") if "_n" in occurrences.columns else F.count("*")
    return occurrences.groupBy("kind", "term").agg(n.alias("cnt"), F.min("ord").alias("first_seen"))


def statistics(questions: DataFrame, stop, verbs=None, chunker=None, tagger=None) -> DataFrame:
    """``count`` of ``mine``. Equal normalised questions are mined once: a term of theirs stands first where the first of them is.

    A chunker or a tagger may look at more than that, so they get every question.
    """
    if not chunker and not tagger:
        same = questions.groupBy("normalized").agg(F.min(F.struct("q_id"))["q_id"].alias("q_id"), F.count("*").alias("_n"))
        questions = staged(spread(same, "normalized"), "questions")
    return count(mine(questions, stop, verbs, chunker, tagger))


def frequent(counts: DataFrame) -> DataFrame:
    least = F.when(F.col("kind") == "phrase", MIN_PHRASE).when(F.col("kind") == "unigram", MIN_UNIGRAM).otherwise(MIN_VERB)
    return counts.where(F.col("cnt") > least)


def ranked(counts: DataFrame) -> DataFrame:
    """Adds ``rnk`` in each kind: by count, descending, then first seen. For reports; assignment needs no global rank.

    Places within a count are numbered by blocks of questions, so no task sorts a kind; the offsets of
    the blocks come from their sizes alone.
    """
    block = F.floor(F.col("first_seen.q") / 65536)
    sizes = counts.groupBy("kind", "cnt", block.alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("kind").orderBy(F.desc("cnt"), "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int")).drop("_n")
    by = Window.partitionBy("kind", "cnt", "_b").orderBy("first_seen")
    own = counts.withColumn("_b", block).withColumn("_own", F.row_number().over(by))
    return own.join(starts, ["kind", "cnt", "_b"]).withColumn("rnk", F.col("_start") + F.col("_own")).select(*counts.columns, "rnk")


def _joints(term, first_only: bool):
    """The two characters around each space of a phrase."""
    w = F.split(term, " ")
    ends = F.sequence(F.lit(1), F.lit(1) if first_only else F.size(w) - 1)
    return F.transform(ends, lambda i: F.concat(F.right(F.element_at(w, i), F.lit(1)), F.lit(" "), F.left(F.element_at(w, i + 1), F.lit(1))))


def without_subphrases(counts: DataFrame) -> DataFrame:
    """Drops phrases that are part of another phrase with the same count, as characters.

    Where a phrase lies in another one, its spaces meet spaces of the other. So the join is on the count
    and on the characters around the first space, which spreads the many phrases of the lowest counts.
    """
    phrases = counts.where("kind = 'phrase'")
    longer = phrases.select(F.col("cnt").alias("_n"), F.col("term").alias("_t"), F.explode(F.array_distinct(_joints(F.col("term"), False))).alias("_j"))
    part = (F.col("cnt") == F.col("_n")) & (_joints(F.col("term"), True)[0] == F.col("_j")) & (F.col("term") != F.col("_t")) & F.contains("_t", "term")
    return phrases.join(longer, part, "left_anti").unionByName(counts.where("kind <> 'phrase'"))


def sort_keys(counts: DataFrame) -> DataFrame:
    """``(term, sort_cnt)``: a verb's count overrides a unigram's, and that a phrase's; verbs of count one included."""
    rank = F.when(F.col("kind") == "verb", 3).when(F.col("kind") == "unigram", 2).otherwise(1)
    return counts.groupBy("term").agg(F.max_by("cnt", rank).alias("sort_cnt"))
