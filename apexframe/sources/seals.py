"""Seals: a hash tree over the digests of files or partitions, which tells what changed without reading what didn't.

Items lie in the tree by a hash of their names, so one more or less moves no other. Trees are tables; two are compared from the root down, and only
below nodes that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.scratch import stored

#: Children of a node are the hexadecimal digits; items of a lowest node, about.
FANOUT, BUCKET = 16, 64


def tree_depth(items: int) -> int:
    """Levels below the root for so many items."""
    depth = 0
    while BUCKET * FANOUT**depth < items:
        depth += 1
    return depth


def _place(name: Column, depth: int) -> Column:
    return F.substring(F.sha2(name.cast("binary"), 256), 1, depth) if depth else F.lit("")


def seal_tree(items: DataFrame, depth: int) -> DataFrame:
    """(level, prefix, digest, items): the tree of (name, digest); the root is level 0. Names must be unique and nothing null."""
    told = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name").isNull() | F.col("digest").isNull()).alias("null")).first()
    if told["null"] or items.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise DataValidationError("a seal needs named items, each once, with digests")
    entry = F.concat(F.octet_length("name").cast("string"), F.lit(":"), "name", F.lit("="), "digest")
    level = items.groupBy(_place(F.col("name"), depth).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("items"))
    levels = [stored(level.withColumn("level", F.lit(depth)), "seal")]
    for d in reversed(range(depth)):
        child = F.concat("prefix", F.lit("="), "digest")
        up = levels[-1].groupBy(F.substring("prefix", 1, d).alias("prefix") if d else F.lit("").alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("digest"), F.sum("items").alias("items"))  # FANOUT at most
        levels.append(stored(up.withColumn("level", F.lit(d)), "seal"))
    return reduce(DataFrame.unionByName, levels).select("level", "prefix", "digest", "items")


def root_of(tree: DataFrame) -> str:
    """The root's digest; that of no items is empty."""
    row = tree.where("level = 0").first()
    return row["digest"] if row else ""


def changed_items(before: DataFrame, after: DataFrame, tree_before: DataFrame, tree_after: DataFrame, depth: int) -> DataFrame:
    """(name, state) of the items that are added, removed or changed between two sealed tables; both trees have the same depth."""
    differing = None
    for level in range(depth + 1):
        at = [t.where(F.col("level") == level).select("prefix", F.col("digest").alias(c)) for t, c in ((tree_before, "a"), (tree_after, "b"))]
        both = at[0].join(at[1], "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
        if differing is not None:
            parent = F.substring("prefix", 1, level - 1) if level > 1 else F.lit("")
            both = both.withColumn("parent", parent).join(differing.withColumnRenamed("prefix", "parent"), "parent", "left_semi").drop("parent")
        differing = stored(both, "seal-differs")
        if not differing.take(1):
            break
    pick = lambda d, c: d.withColumn("prefix", _place(F.col("name"), depth)).join(differing, "prefix", "left_semi").select("name", F.col("digest").alias(c))
    both = pick(before, "a").join(pick(after, "b"), "name", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("name", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("state"))
