"""The topic tree as a table of materialised paths, and the questions at its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text

FALLBACK_ROOT = "Auntology"


def with_root(faqs: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``faqs(ord, terms, ...)`` with one root: the common last term, else a synthetic one appended to every row.

    The root is that ``of`` other rows if given; a path that doesn't end with it gets it appended.
    """
    roots = (faqs if of is None else of).where(F.size("terms") > 0).agg(F.min(F.element_at("terms", -1)).alias("_lo"), F.max(F.element_at("terms", -1)).alias("_hi"))
    single = (F.col("_lo") == F.col("_hi")) & F.col("_lo").isNotNull()
    root = F.when(single, F.col("_lo")).otherwise(F.lit(FALLBACK_ROOT))
    has = single & (F.size("terms") > 0) & (F.try_element_at("terms", F.lit(-1)) == F.col("_lo"))
    return faqs.crossJoin(F.broadcast(roots)).withColumn("terms", F.when(has, F.col("terms")).otherwise(F.concat("terms", F.array(root)))).drop("_lo", "_hi")  # roots: one row


def node_id(path) -> F.Column:
    return F.sha2(F.array_join(path, "\u0001"), 256)


def _paths(rooted: DataFrame) -> F.Column:
    """Root-first keys of the terms: their names with marks, without synonyms and traits."""
    return F.transform(F.reverse("terms"), lambda t: text.parse_term(t).key)


def nodes(faqs: DataFrame, synonyms: DataFrame | None = None, unmapped: DataFrame | None = None) -> DataFrame:
    """``(node_id, parent_id, path, depth, name, usage, synonyms, has_faq, first_seen)``.

    ``faqs(ord, terms)`` create nodes, and so do paths without questions, ``unmapped(ord, terms)``, whose
    ``ord`` follow. The first row to reach a path fixes its synonyms; ``has_faq`` tells whether that row is a
    FAQ, and the root has it always. ``synonyms(term, synonyms)`` are added by name.
    """
    rows = with_root(faqs).select("ord", "terms", F.lit(True).alias("faq"))
    if unmapped is not None:
        rows = rows.unionByName(with_root(unmapped.select("ord", "terms"), faqs).select("ord", "terms", F.lit(False).alias("faq")))
    rooted = rows.withColumn("p", _paths(rows)).withColumn("raw", F.reverse("terms"))
    steps = rooted.select("ord", "faq", "p", "raw", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k")).withColumn("path", F.slice("p", F.lit(1), F.col("k")))
    steps = steps.withColumn("raw", F.element_at("raw", F.col("k")))
    found = steps.groupBy("path").agg(F.min("ord").alias("first_seen"), F.min_by(F.struct("faq", "raw"), "ord").alias("x"))
    up = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    out = found.withColumn("t", text.parse_term(F.col("x.raw"))).withColumn("own", F.col("t.synonyms"))
    if synonyms is not None:
        more = synonyms.groupBy("term").agg(F.array_distinct(F.flatten(F.collect_list("synonyms"))).alias("_more"))  # of one term
        out = out.withColumn("_name", F.col("t.name")).join(more, F.col("_name") == F.col("term"), "left")
        out = out.withColumn("own", F.array_sort(F.array_distinct(F.concat("own", F.coalesce("_more", F.array().cast("array<string>"))))))
    return out.select(
        node_id("path").alias("node_id"), F.when(F.size("path") > 1, node_id(up)).alias("parent_id"), "path", F.size("path").alias("depth"), "t.name", "t.usage", F.col("own").alias("synonyms"),
        (F.col("x.faq") | (F.size("path") == 1)).alias("has_faq"), "first_seen",
    )


def along(nodes_: DataFrame, *columns: str) -> DataFrame:
    """``(node_id, ups)``: an array of structs of the given columns of the nodes on each node's path, root first."""
    up = nodes_.select("node_id", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    up = up.select(F.col("node_id").alias("_id"), node_id(F.slice("path", F.lit(1), F.col("depth"))).alias("node_id"))
    of = nodes_.select("node_id", F.struct("depth", *columns).alias("x"))
    return up.join(of, "node_id").groupBy(F.col("_id").alias("node_id")).agg(F.array_sort(F.collect_list("x")).alias("ups"))  # of one path


def preorder(nodes_: DataFrame) -> DataFrame:
    """Adds ``preorder``: the first-seen ordinals along the path, which sort nodes as a depth-first walk does."""
    return nodes_.join(along(nodes_, "first_seen").select("node_id", F.col("ups.first_seen").alias("preorder")), "node_id")


def node_questions(faqs: DataFrame) -> DataFrame:
    """``(node_id, path, faq_ord, q_idx, question, tags)``: primaries and alternates (those marked ``||`` left out) at their deepest node; tags by name, each once."""
    rooted = with_root(faqs)
    rooted = rooted.withColumn("path", _paths(rooted))
    asked = F.concat(F.array(F.struct("question", "tags")), F.filter("alternates", lambda a: ~F.startswith(a.question, F.lit("||"))))
    out = rooted.select("path", F.col("ord").alias("faq_ord"), F.posexplode(asked).alias("q_idx", "x"))
    tags = F.array_distinct(F.transform("x.tags", lambda t: text.parse_term(t)["name"]))
    return out.select(node_id("path").alias("node_id"), "path", "faq_ord", "q_idx", "x.question", tags.alias("tags"))
