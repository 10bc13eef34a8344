"""Term assignment: an ordered path of topics and tags for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import grams
from topicloom.store import spread

ROOT = "Auto Ontology"
MASK = "~~~~"


def model(counts: DataFrame, stop) -> DataFrame:
    """The terms that assignment looks for: ``(term, k, c, f, sort_cnt)``; kind, count (negated) and first place give the order, verbs of count one are left out.

    Small next to the corpus: frequent terms only. Stage it (``store.staged``) where it is used more than once,
    so that statistics are computed once and Spark knows its size and broadcasts it only if it is small.
    """
    kept = grams.frequent(counts)
    thin = grams.without_subphrases(kept.where("kind <> 'verb'"))
    verbs = counts.where("kind = 'verb'")
    # a verb's count, those of count one included, overrides the count by which the same word is sorted
    own = F.when(F.col("kind") == "phrase", 0).when(F.col("kind") == "unigram", 1).otherwise(2)
    rows = thin.unionByName(verbs).groupBy("term").agg(F.collect_list(F.struct(own.alias("k"), (-F.col("cnt")).alias("c"), F.col("first_seen").alias("f"))).alias("xs"), F.max_by("cnt", own).alias("sort_cnt"))  # three at most
    rows = rows.select("term", "sort_cnt", F.inline("xs"))
    fine = (F.col("k") == 2) & (-F.col("c") > grams.MIN_VERB) | (F.col("k") < 2) & ~text.among(F.col("term"), [*stop])
    return rows.where(fine).select("term", "k", "c", "f", "sort_cnt")


def assign(questions: DataFrame, counts: DataFrame, stop, root: str = ROOT) -> DataFrame:
    """``(q_id, terms, tags)`` for ``questions(q_id, question, normalized)``; terms are leaf first, root last.

    Equal questions get their path once, which is then joined to each. ``questions`` are read three times, so
    stage them where they are dear.
    ``counts`` are term statistics or the ``model`` made of them. Terms that can match a question are found
    by an equi-join on its n-grams, so each question folds over its own few candidates: in order of kind,
    count and first appearance, each that still stands in the text is taken and masked. A verb that is left
    gives a tag (the rarest wins), else the only content word does. Terms inside other terms go, and the
    rest is sorted by ascending count.
    """
    terms = counts if "sort_cnt" in counts.columns else model(counts, stop)
    place = terms.schema["f"].dataType.simpleString()
    doc = text.words(F.col("normalized"))
    asked = "words" if "words" in questions.columns else "question"  # words apart, where a script has no spaces
    keys = ["normalized", asked]
    texts = spread(questions.select(*keys).distinct(), "normalized")
    held = spread(questions.select("normalized").distinct(), "normalized").select("normalized", F.explode(F.array_distinct(text.ngrams_up_to(doc, 3))).alias("term")).join(terms, "term")
    own = held.groupBy("normalized").agg(F.array_sort(F.collect_list(F.struct("k", "c", "f", "term", "sort_cnt"))).alias("cands"))
    base = texts.join(own, "normalized", "left").withColumn("cands", F.coalesce("cands", F.array().cast(f"array<struct<k:int,c:bigint,f:{place},term:string,sort_cnt:bigint>>")))
    start = F.struct(text.padded(F.array_join(doc, " ")).alias("d"), F.array().cast("array<struct<sort_cnt:bigint,i:int,term:string>>").alias("h"))

    def step(acc, t):
        hit = F.struct(t.sort_cnt.alias("sort_cnt"), F.size(acc.h).alias("i"), t.term.alias("term"))
        return F.when(F.contains(acc.d, text.padded(t.term)), F.struct(F.replace(acc.d, text.padded(t.term), F.lit(f" {MASK} ")).alias("d"), F.array_append(acc.h, hit).alias("h"))).otherwise(acc)

    folded = base.withColumn("s", F.aggregate(F.filter("cands", lambda t: t.k < 2), start, step))
    verbs = F.filter("cands", lambda t: (t.k == 2) & F.contains(F.col("s.d"), text.padded(t.term)))
    tag = F.when(F.size(verbs) > 0, F.element_at(verbs, -1).term).when(F.size("s.h") == 0, text.single_word_tag(F.col(asked), stop))
    left = F.filter("s.h", lambda t: ~F.exists("s.h", lambda u: (u.term != t.term) & F.contains(u.term, t.term)))
    path = F.concat(F.transform(F.array_sort(left), lambda t: t.term), F.array(F.lit(root)))
    found = folded.select(*[F.col(k).alias(f"_{k}") for k in keys], path.alias("terms"), F.when(tag.isNotNull(), F.array(tag)).otherwise(F.array().cast("array<string>")).alias("tags"))
    same = F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}")) & F.col(keys[1]).eqNullSafe(F.col(f"_{keys[1]}"))
    return questions.select("q_id", *keys).join(found, same).select("q_id", "terms", "tags")
