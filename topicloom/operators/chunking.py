"""Chunks and verbs found by statistics of neighbouring words, in place of word lists.

Chunks: words hold together where they meet more often than chance has it (normalised mutual
information) and neither is a hub, a word that many different words precede and many follow (branching
entropy): articles, prepositions and the like, whatever the language. Both come from one aggregate over
pairs of neighbours.

Verbs: a frame is the pair of words around a place. Frames in which known verbs make up most of what
occurs are verb frames, and words of which a good part stands in several of them are verbs too, round by
round, until none joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.store import staged

#: What stands before the first and after the last word; no word is empty.
BORDER = ""
#: Meetings of two words, thousandths of normalised mutual information between them, and of bits of both neighbours' entropies of a hub, at least.
MEETINGS, HOLD, HUB = 3, 100, 4000
#: Per cent of a frame that known verbs make up, and different ones in it; per cent of a word's places that are in verb frames, and different ones; rounds.
FRAME_SHARE, FRAME_VERBS, WORD_SHARE, WORD_FRAMES, ROUNDS = 60, 2, 20, 2, 10


def _words(questions: DataFrame) -> F.Column:
    """The words of a question; marks are borders between words."""
    return F.transform(text.words(F.col("normalized")), lambda w: F.when(w.rlike(r"[\p{L}\p{N}_]"), w).otherwise(BORDER))


def _milli(x) -> F.Column:
    return F.round(x * 1000).cast("bigint")


def pairs(questions: DataFrame) -> DataFrame:
    """``(a, b, n)``: how often word ``b`` follows word ``a`` in ``questions(normalized)``; borders are empty words."""

    def of(w):
        return F.transform(F.sequence(F.lit(0), F.size(w)), lambda i: F.struct(F.when(i > 0, F.get(w, i - 1)).otherwise(BORDER).alias("a"), F.when(i < F.size(w), F.get(w, i)).otherwise(BORDER).alias("b")))

    met = questions.where("normalized is not null").select(F.inline(text.let(_words(questions), of)))
    return met.where((F.col("a") != BORDER) | (F.col("b") != BORDER)).groupBy("a", "b").agg(F.count("*").alias("n"))


def _side(pairs_: DataFrame, own: str, to: str) -> DataFrame:
    """``(word, <to>_n, <to>_bits)``: how often a word has a neighbour on one side, and the entropy of which one, in thousandths of bits."""
    n = F.col("n")
    found = pairs_.where(F.col(own) != BORDER).groupBy(F.col(own).alias("word")).agg(F.sum("n").alias(f"{to}_n"), F.sum(n * F.log2(n)).alias("_s"))
    return found.select("word", f"{to}_n", _milli(F.log2(f"{to}_n") - F.col("_s") / F.col(f"{to}_n")).alias(f"{to}_bits"))


def branching(pairs_: DataFrame) -> DataFrame:
    """``(word, n, left_bits, right_bits)`` of every word: its number and how its neighbours on either side branch."""
    both = _side(pairs_, "b", "left").join(_side(pairs_, "a", "right"), "word")  # every word has a neighbour, if only a border, on either side
    return both.select("word", F.col("left_n").alias("n"), "left_bits", "right_bits")


def hubs(branching_: DataFrame, hub: int = HUB) -> DataFrame:
    return branching_.where(F.least("left_bits", "right_bits") >= hub).select("word")


def bonds(pairs_: DataFrame, branching_: DataFrame, least: int = MEETINGS, hold: int = HOLD, hub: int = HUB) -> DataFrame:
    """``(a, b, npmi)``: neighbours that hold together, with their normalised mutual information in thousandths."""
    total = pairs_.agg(F.sum("n").alias("_all"))
    side = lambda c: branching_.where(F.least("left_bits", "right_bits") < hub).select(F.col("word").alias(c), F.col("n").alias(f"n{c}"))
    met = pairs_.where((F.col("n") >= least) & (F.col("a") != BORDER) & (F.col("b") != BORDER)).join(side("a"), "a").join(side("b"), "b").crossJoin(F.broadcast(total))  # one row
    npmi = F.log(F.col("n") / F.col("na") * F.col("_all") / F.col("nb")) / F.log(F.col("_all") / F.col("n"))
    # two words that make up the whole corpus have no logarithm to divide by
    return met.select("a", "b", F.when(F.col("n") >= F.col("_all"), 1000).otherwise(_milli(npmi)).alias("npmi")).where(F.col("npmi") >= hold)


def statistical_chunks(questions: DataFrame, least: int = MEETINGS, hold: int = HOLD, hub: int = HUB) -> DataFrame:
    """A chunker for ``grams.mine``: ``(q_id, c, chunk array<string>)``, runs of words that hold together; hubs are left out.

    Statistics are of the questions themselves and written once. A null question has no chunks.
    """
    met = staged(pairs(questions), "word-pairs")
    known = staged(branching(met), "branching")
    tied = bonds(met, known, least, hold, hub).select("a", "b", F.lit(True).alias("tied"))
    each = questions.select("q_id", F.posexplode(_words(questions)).alias("i", "b"), _words(questions).alias("w"))
    each = each.select("q_id", "i", "b", F.coalesce(F.get("w", F.col("i") - 1), F.lit(BORDER)).alias("a")).where(F.col("b") != BORDER)
    each = each.join(hubs(known, hub).withColumnRenamed("word", "b"), "b", "left_anti").join(tied, ["a", "b"], "left")
    of = each.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("i", "b", F.coalesce("tied", F.lit(False)).alias("tied")))).alias("ws"))  # of one question
    joined = F.array_join(F.transform("ws", lambda x: F.concat(F.when(x.tied, F.lit(" ")).otherwise(F.lit("|")), x.b)), "")  # a word holds no mark
    cut = F.transform(F.split(F.substring(joined, 2, 1 << 30), r"\|"), lambda c: F.split(c, " "))
    return of.select("q_id", F.posexplode(cut).alias("c", "chunk"))


def frames(questions: DataFrame) -> DataFrame:
    """``(word, left, right, n)``: how often each word of ``questions(normalized)`` stands between two others; borders are empty words."""

    def of(w):
        side = lambda i: F.coalesce(F.get(w, i), F.lit(BORDER))
        return F.transform(w, lambda x, i: F.struct(x.alias("word"), side(i - 1).alias("left"), side(i + 1).alias("right")))

    met = questions.where("normalized is not null").select(F.inline(text.let(_words(questions), of)))
    return met.where(F.col("word") != BORDER).groupBy("word", "left", "right").agg(F.count("*").alias("n"))


def joining(frames_: DataFrame, verbs: DataFrame, frame_share: int = FRAME_SHARE, frame_verbs: int = FRAME_VERBS, word_share: int = WORD_SHARE, word_frames: int = WORD_FRAMES) -> DataFrame:
    """``(word)``: words that one round adds to ``verbs(word)``."""
    marked = frames_.join(verbs.select("word", F.lit(True).alias("verb")), "word", "left")
    own = F.when(F.col("verb"), F.col("n")).otherwise(0)
    good = marked.groupBy("left", "right").agg(F.sum("n").alias("a"), F.sum(own).alias("o"), F.count("verb").alias("k"))
    good = good.where((F.col("o") * 100 >= F.col("a") * frame_share) & (F.col("k") >= frame_verbs)).select("left", "right", F.lit(True).alias("good"))
    seen = marked.where("verb is null").join(good, ["left", "right"], "left").groupBy("word")
    seen = seen.agg(F.sum("n").alias("a"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("o"), F.count("good").alias("k"))
    return seen.where((F.col("o") * 100 >= F.col("a") * word_share) & (F.col("k") >= word_frames)).select("word")


def bootstrapped_verbs(questions: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, **shares) -> DataFrame:
    """``(word, round)``: the words of ``seeds(word)`` that occur, with round 0, and those that join, with their round.

    It ends when a round adds none, or after ``rounds``; one number a round reaches the driver.
    """
    own = staged(frames(questions), "frames")
    found = staged(seeds.select("word").distinct().join(own.select("word").distinct(), "word").select("word", F.lit(0).alias("round")), "verbs")
    for i in range(1, rounds + 1):
        new = staged(joining(own, found, **shares).select("word", F.lit(i).alias("round")), "verbs")
        if new.isEmpty():
            break
        found = staged(found.unionByName(new), "verbs")
    return found


def verb_tagger(verbs: DataFrame, forms: DataFrame | None = None):
    """A tagger for ``grams.mine``: the words of ``verbs(word)`` wherever they stand, by their bases in ``forms(word, base)`` where they have one."""

    def tag(questions: DataFrame) -> DataFrame:
        each = questions.select("q_id", F.posexplode(_words(questions)).alias("i", "word"))
        met = each.join(verbs.select("word").distinct(), "word")
        if forms is None:
            return met.select("q_id", "i", F.col("word").alias("term"))
        return met.join(forms, "word", "left").select("q_id", "i", F.coalesce("base", "word").alias("term"))

    return tag
