"""Lints of a topic tree: questions that their path doesn't lead to, and questions left at the root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import tree

COVERAGE = 50
#: Kinds of issues in the order of the report.
KINDS = ("UnreachableQuestions", "QuestionsAtRoot")
#: Where an issue stands in the report: kind, depth-first walk, FAQ, question.
ORDER = ("_kind", "_walk", "_faq", "_q")


def _issue(found: DataFrame, kind: str, walk) -> DataFrame:
    return found.select(F.lit(kind).alias("error_type"), "path", "question", "tags", F.lit(KINDS.index(kind)).alias("_kind"), walk.alias("_walk"), F.col("faq_ord").alias("_faq"), F.col("q_idx").alias("_q"))


def _unreachable(faqs: DataFrame, stop, synonyms, coverage: int, unmapped) -> DataFrame:
    plain = lambda c: F.array_join(text.without(text.analyzer_normalize(c), stop), " ")
    own = tree.along(tree.nodes(faqs, synonyms, unmapped), "name", "usage", "synonyms", "first_seen")
    shown = F.filter("ups", lambda x: x.usage != "organizer")
    names = F.transform(F.filter(shown, lambda x: x.depth > 1), lambda x: plain(x["name"]))
    own = own.select("node_id", F.col("ups.name").alias("_names"), F.col("ups.first_seen").alias("_walk"), names.alias("_own"), F.flatten(F.transform(shown, lambda x: F.transform(x.synonyms, plain))).alias("_extra"))
    tags = F.filter(F.transform("tags", plain), lambda x: x != "")
    path = F.array_distinct(F.concat("_own", tags))
    content = F.array_except(F.array_distinct(F.concat("_own", "_extra", tags)), F.array(F.lit("")))
    grams = text.ngrams_up_to(text.tokens(F.lower(plain(F.col("question")))), 4)
    base = tree.node_questions(faqs).drop("path").join(own, "node_id").withColumnRenamed("_names", "path")
    base = base.withColumn("_p", F.size(path)).withColumn("_c", content).withColumn("_m", F.size(F.array_intersect(F.col("_c"), grams)))
    missed = (F.size("_c") > 0) & (F.col("_p") > 0) & ~(F.col("_m") * 100 > (coverage - 1) * F.col("_p"))
    return _issue(base.where(missed), KINDS[0], F.col("_walk"))


def _at_root(faqs: DataFrame) -> DataFrame:
    found = tree.node_questions(faqs).where((F.size("path") == 1) & (F.size("tags") == 0)).withColumn("path", F.array().cast("array<string>"))
    return _issue(found, KINDS[1], F.array().cast("array<bigint>"))


def unreachable(faqs: DataFrame, stop=(), synonyms: DataFrame | None = None, coverage: int = COVERAGE, unmapped: DataFrame | None = None) -> DataFrame:
    """Questions of which too few path words occur: ``(error_type, path, question, tags)``.

    A question is reached when ceil(matched / path size x 100) >= coverage, so matched x 100 > (coverage - 1) x size.
    Names and synonyms are those of the nodes, which the first row to reach them fixes; organizer nodes
    don't count, nor the root's name (its synonyms do). An empty path counts as reached.
    """
    return _unreachable(faqs, stop, synonyms, coverage, unmapped).drop(*ORDER)


def at_root(faqs: DataFrame) -> DataFrame:
    """Questions at the root without a tag; their path is shown as empty."""
    return _at_root(faqs).drop(*ORDER)


def issues(faqs: DataFrame, stop=(), synonyms: DataFrame | None = None, unmapped: DataFrame | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """All issues, with the columns ``ORDER`` that tell their place in the report; ``limits`` keeps so many of a kind, the first ones."""
    found = [_unreachable(faqs, stop, synonyms, COVERAGE, unmapped), _at_root(faqs)]
    found = [df.orderBy(*ORDER).limit(limits[kind]) if limits and kind in limits else df for kind, df in zip(KINDS, found, strict=True)]
    return found[0].unionByName(found[1])


def summary(found: DataFrame) -> DataFrame:
    """One row of flags: errors 1 if any question is unreachable, suggestions 1 if any is at the root, total their sum."""
    flag = lambda kind: F.coalesce(F.max(F.when(F.col("error_type") == kind, 1).otherwise(0)), F.lit(0))
    out = found.agg(flag(KINDS[0]).alias("errors"), F.lit(0).alias("warnings"), flag(KINDS[1]).alias("suggestions"))
    return out.withColumn("total", F.col("errors") + F.col("suggestions"))
