"""Pruning of the topic tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.store import staged


def path_groups(assigned: DataFrame) -> DataFrame:
    """``(path, n)``: primaries on each root-first path. Lists of ids are left out: they grow with the data."""
    return assigned.select(F.reverse("terms").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def empty_nodes_to_tags(assigned: DataFrame) -> DataFrame:
    """Inner nodes that hold no question of their own become tags, deepest first; root and leaf stay."""
    base = assigned.withColumn("path", F.reverse("terms"))
    prefixes = base.select("path").distinct().where(F.size("path") > 2).select("path", F.explode(F.sequence(F.lit(2), F.size("path") - 1)).alias("k"))
    prefixes = prefixes.select("path", "k", F.slice("path", F.lit(1), F.col("k")).alias("prefix"))
    taken = base.select(F.col("path").alias("prefix")).distinct()
    gone = prefixes.join(taken, "prefix", "left_anti").groupBy("path").agg(F.collect_set("k").alias("_gone"))
    both = base.join(gone, "path", "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    of = lambda ks: F.transform(ks, lambda k: F.element_at("path", k))
    stays = F.reverse(of(F.filter(F.sequence(F.lit(1), F.size("path")), lambda k: ~F.array_contains("_gone", k))))
    leaves = of(F.reverse(F.array_sort("_gone")))
    return both.select(*[c for c in assigned.columns if c not in ("terms", "tags")], stays.alias("terms"), F.concat("tags", leaves).alias("tags"))


def collapse_thin_nodes(assigned: DataFrame, least: int = 2) -> DataFrame:
    """Questions of a first-level node with fewer than ``least`` of them move to the root, with the node as a tag.

    Only the thin paths are joined, and only with first-level rows, so neither the root nor a well-filled
    path gathers anywhere.
    """
    first = F.size("terms") == 2
    thin = assigned.where(first).groupBy("terms").agg(F.count("*").alias("_n")).where(F.col("_n") < least).select(F.col("terms").alias("_t"))
    moved = assigned.where(first).join(thin, F.col("terms") == F.col("_t"), "left")
    keep = [c for c in assigned.columns if c not in ("terms", "tags")]
    gone = F.col("_t").isNotNull()
    moved = moved.select(*keep, F.when(gone, F.slice("terms", 2, 1)).otherwise(F.col("terms")).alias("terms"), F.when(gone, F.concat("tags", F.slice("terms", 1, 1))).otherwise(F.col("tags")).alias("tags"))
    return moved.unionByName(assigned.where(~first | F.col("terms").isNull()).select(*keep, "terms", "tags"))


def optimise(assigned: DataFrame) -> DataFrame:
    """Both steps. Each reads its input several times, so inputs are written to the shared folder first."""
    return collapse_thin_nodes(staged(empty_nodes_to_tags(staged(assigned, "optimise-in")), "optimise-nodes"))
