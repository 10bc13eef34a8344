"""Merkle manifest of a dataset, level by level in ordered blocks.

A leaf is a row's digest. The leaves of a group (a language, say) stand in the order of their keys; every
8 consecutive nodes become the digest of their digests, until one is left, the group's subroot, and
subroots become one root in the same way. A block is an ordered array of up to 512 nodes: ``transform``
over ``sequence`` and ``slice`` collapses a level of it, ``aggregate`` up to three levels, and the block
roots are the nodes of the next round. Proofs come down the same blocks: what a block's root needs to
reach the root is joined to the block once and ends the path of each of its nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import prefix, staged
from topicloom.operators.scans import positioned

FAN, LEVELS = 8, 3
#: Nodes of a block: a round collapses all the levels that it holds.
BLOCK = FAN**LEVELS
PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts' UTF-8, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*[field(c) for c in fields])


def _collapsed(nodes: Column) -> Column:
    """The level above an array of digests: each run of FAN as the digest of its concatenation; the last run may be shorter."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i, FAN), ""), 256))


def _levels(nodes: Column, levels: Column) -> Column:
    """The array of levels of a block, from its nodes up: as many above them as ``levels``, LEVELS at most."""
    steps = F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), F.lit(1), levels)
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.array_append(done, _collapsed(F.element_at(done, -1))))


def _height(n: Column) -> Column:
    """Levels that a block of a group of ``n`` nodes collapses in one round: all LEVELS where the group has several blocks."""
    return reduce(lambda out, k: out.when(n <= FAN**k, k), range(1, LEVELS), F.when(n <= 1, 0)).otherwise(LEVELS)


def _blocks(nodes: DataFrame, tag: str) -> DataFrame:
    """``(g, n, block, rows, lv)`` of ``nodes(g, n, pos, x struct<h, ...>)``: the rows of each block in order, and its levels."""
    at = (F.floor(F.col("pos") / BLOCK)).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct("pos", "x")))  # BLOCK at most: places are distinct
    got = nodes.groupBy("g", "n", at.alias("block")).agg(F.transform(rows, lambda r: r.x).alias("rows"))
    return staged(got.withColumn("lv", _levels(F.transform("rows", lambda x: x.h), _height(F.col("n")))), f"merkle-{tag}")


def _rounds(nodes: DataFrame, tag: str) -> list[DataFrame]:
    """The blocks of every round, from the leaves up; one number a round, the largest group's blocks, reaches the driver."""
    out = [_blocks(nodes, tag)]
    while (out[-1].agg(F.max("block")).first()[0] or 0) > 0:
        below = out[-1].where(F.col("n") > BLOCK)
        up = below.select("g", F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n"), F.col("block").alias("pos"), F.struct(F.element_at(F.element_at("lv", -1), 1).alias("h")).alias("x"))
        out.append(_blocks(up, f"{tag}-{len(out)}"))
    return out


def _root() -> Column:
    return F.element_at(F.element_at("lv", -1), 1)


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """``(g, root)`` of each group, from the round in which it has one block."""
    own = [b.where(F.col("n") <= BLOCK).select("g", _root().alias("root")) for b in rounds]
    return reduce(DataFrame.unionByName, own)


def _path(lv: Column, j: Column) -> Column:
    """What stands left and right of a block's node ``j`` (from 0) in its run, at each level below the block's root."""

    def beside(level: Column, k: Column) -> Column:
        at = F.floor(j / F.pow(F.lit(FAN), k)).cast("int")
        first = at - at % FAN
        return F.struct(F.array_join(F.slice(level, first + 1, at - first), "").alias("l"), F.array_join(F.slice(level, at + 2, first + FAN - 1 - at), "").alias("r"))

    return F.transform(F.slice(lv, F.lit(1), F.size(lv) - 1), beside)


def _below(blocks: DataFrame, tails: DataFrame) -> DataFrame:
    """``(g, block, tail)`` of the blocks of the round below: the path from each node of ``blocks`` to the root."""
    each = F.transform(F.element_at("lv", 1), lambda h, j: F.struct((F.col("block") * BLOCK + j).cast("bigint").alias("block"), F.concat(_path(F.col("lv"), j), F.col("tail")).alias("tail")))
    return blocks.join(tails, ["g", "block"]).select("g", F.inline(each))


def _tails(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``(g, block, tail)`` of the first round's blocks; ``tops(g, tail)`` has the path of each group's top to the root."""
    found = None
    for blocks in reversed(rounds):
        here = blocks.where(F.col("n") <= BLOCK).select("g", "block").join(tops, "g")
        here = here if found is None else here.unionByName(found)
        if blocks is rounds[0]:
            return here
        found = staged(_below(blocks, here), "merkle-tails")


def folded(start: Column, path: Column) -> Column:
    """The digest that a leaf leads to along a path."""
    return F.aggregate(path, start, lambda h, p: digest(p.l, h, p.r))


def manifest(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows(leaf, group, ...)`` with ``subroot, root, path``: the tree over all rows, and each row's siblings on the way to its root.

    Within a group leaves stand by the columns of ``order`` (nulls first); rows that are equal in them are
    told apart by their leaf, then by where they were read. Groups stand by name, bytewise, null first.
    ``path`` has for each level what stands left and right of the node; the columns of ``rows`` stay. An
    empty table gives no rows.
    """
    p = prefix(rows)
    order_ = [f"{p}g", *order, "leaf", f"{p}row"]
    own = rows.withColumn(f"{p}g", F.col(group)).withColumn(f"{p}row", F.monotonically_increasing_id())
    placed = positioned(own, *[F.asc_nulls_first(c) for c in order_], name=f"{p}pos").drop(f"{p}row")
    groups = placed.groupBy(f"{p}g").agg(F.min(f"{p}pos").alias(f"{p}start"), F.count("*").alias(f"{p}n"))
    groups = staged(positioned(groups, f"{p}start", name=f"{p}id"), "merkle-groups")
    # written, so Spark knows that the groups are few, or else can split a large one
    both = placed.join(groups.withColumnRenamed(f"{p}g", f"{p}name"), F.col(f"{p}g").eqNullSafe(F.col(f"{p}name")))
    x = F.struct(F.col("leaf").alias("h"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    nodes = both.select(F.col(f"{p}id").alias("g"), F.col(f"{p}n").alias("n"), (F.col(f"{p}pos") - F.col(f"{p}start")).alias("pos"), x.alias("x"))
    rounds = _rounds(nodes, "leaves")
    subroots = staged(_tops(rounds), "merkle-subroots")
    count = subroots.count()
    upper = _rounds(subroots.select(F.lit(0).cast("bigint").alias("g"), F.lit(count).cast("bigint").alias("n"), F.col("g").alias("pos"), F.struct(F.col("root").alias("h")).alias("x")), "groups")
    none = F.array().cast(PATH)
    first = _tails(upper, _tops(upper).select("g", none.alias("tail")))
    up = staged(_below(upper[0], first).select(F.col("block").alias("g"), "tail"), "merkle-group-paths")
    blocks = rounds[0].join(_tails(rounds, up), ["g", "block"]).join(subroots, "g").crossJoin(F.broadcast(_tops(upper).select(F.col("root").alias("top"))))  # one row
    each = F.transform("rows", lambda x, j: F.struct(x["row"].alias("row"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat(_path(F.col("lv"), j), F.col("tail")).alias("path")))
    out = blocks.select(F.inline(each))
    return out.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], "subroot", "root", "path")


def verified(manifest_: DataFrame, again: str = "again") -> DataFrame:
    """Adds ``proof_sha256, folded_root, verified``: whether ``again``, a leaf made anew of a row, leads to the root along the row's path.

    The proof's digest is that of the siblings from leaf to root, left to right; a row without any has the
    digest of nothing.
    """
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p.l, p.r)), "")
    out = manifest_.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", folded(F.col(again), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
