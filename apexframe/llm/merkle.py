"""A Merkle manifest of a table: a tree for each language, a tree over their roots, and a proof for each row.

1. A row's leaf is the digest of its fields; leaves get their places by ranges (:func:`positions`), so no language is held in a task.
2. Eight neighbours become a node, level by level, each level a written table an eighth as large. A node row has the digests of its run, the
   level and place it is found at, and the place it has in its parent's run.
3. A recursive query climbs from every leaf. The eight leaves of a run share all siblings above it, so they climb as one row that
   folds each of them for itself and appends the siblings once.
4. What is high in the tree is met by very many leaves: a node is stored once for each block of 4096 leaves below it, and the climb looks
   it up by place and block, so no key of the join is hot and the copies are a 4096th of the leaves a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import lookup, lower_az, positions, stored

FANOUT = 8
#: Leaves that share a stored copy of a node.
BLOCK_LEAVES = FANOUT**4

_CLIMB = f"""
WITH RECURSIVE climb(tree, run, block, level, height, at, folds, proof) AS (
  SELECT tree, run, block, level, height, at, folds, CAST('' AS BINARY) FROM {{start}}
  UNION ALL
  SELECT c.tree, c.run, c.block, c.level + 1, c.height, n.next,
         transform(c.folds, f -> unhex(sha2(CAST(concat(lower(hex(substring(n.digests, 1, 32 * CAST(c.at % {FANOUT} AS INT)))), lower(hex(f)),
                                                        lower(hex(substring(n.digests, 32 * CAST(c.at % {FANOUT} AS INT) + 33)))) AS BINARY), 256))),
         concat(c.proof, substring(n.digests, 1, 32 * CAST(c.at % {FANOUT} AS INT)), substring(n.digests, 32 * CAST(c.at % {FANOUT} AS INT) + 33))
  FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.level = c.level + 1 AND n.place = c.at DIV {FANOUT} AND n.block = c.block
)
SELECT tree, run, folds, proof FROM climb WHERE level = height
"""


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' concatenation, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def as_text(digests: Column) -> Column:
    """Digests, one after another, as lower-case hex text."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """A field of a leaf: its length in bytes, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _joined(digests: Column) -> Column:
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def _levels(first: DataFrame, leaves: int) -> DataFrame:
    """All levels over the first, nodes (tree, level, place, width, digests, digest); ``width`` is a level's number of nodes, ``leaves`` the most of any tree."""
    found, level, width = first, first, -(-leaves // FANOUT)
    while width > 1:
        run = F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run")  # FANOUT at most
        level = level.where("width > 1").groupBy("tree", "level", "width", F.expr(f"place DIV {FANOUT}").alias("up")).agg(run)
        level = level.select("tree", F.expr("level + 1").alias("level"), F.col("up").alias("place"), F.expr(f"(width + {FANOUT - 1}) DIV {FANOUT}").alias("width"), _joined(F.col("run.digest")).alias("digests"))
        level = stored(level.withColumn("digest", digest(as_text(F.col("digests")))), "tree-level")
        found, width = found.unionByName(level), -(-width // FANOUT)
    return found


def _copies(nodes: DataFrame, most: Column) -> DataFrame:
    """``nodes`` with ``block``: a row for each block of leaves under a node; ``most`` is the last block of its tree."""
    under = F.pow(F.lit(float(FANOUT)), F.col("level")).cast("long")
    first, last = F.floor(F.col("place") * under / BLOCK_LEAVES), F.floor(((F.col("place") + 1) * under - 1) / BLOCK_LEAVES)
    return nodes.withColumn("block", F.explode(F.sequence(first.cast("long"), F.least(last.cast("long"), most))))


def merkle_proofs(docs: DataFrame, tampered: Column, group_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """Returns id, leaf, subroot, root, proof_sha256, folded_root and verified for every row.

    ``tampered`` says which rows are tried with the A-Z of their text lower-cased: their folded root is recomputed from what they have
    become and the siblings of the untampered tree; it equals the root if the row is as it was.

    Edge cases: null fields are dashes in the leaf; a null group is a tree of its own and the first; a null id is in front of its group and never tampered
    with; rows of equal id are ordered by their leaves, and equal rows get places of their own; an only leaf is its subroot and an only subroot the root; a row
    without siblings at all has the digest of no bytes as its proof; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    name = lambda c: F.col(f"`{c}`")
    leaf = digest(*(field(name(c)) for c in fields))
    changed = digest(*(field(lower_az(name(c)) if c == text_col else name(c)) for c in fields))
    tree = F.coalesce(F.concat(F.lit("="), name(group_col)), F.lit("")).alias("tree")  # in order of bytes, null first
    rows = docs.select(tree, name(id_col).cast("long").alias("id"), leaf.alias("leaf"), F.when(tampered & name(id_col).isNotNull(), changed).alias("changed"))
    placed = positions(rows, ["tree"], ["id", "leaf"])
    members = F.array_sort(F.collect_list(F.struct("pos", "id", "leaf", F.coalesce("changed", "leaf").alias("tried")))).alias("members")  # FANOUT at most
    runs = stored(placed.groupBy("tree", "n", F.expr(f"pos DIV {FANOUT}").alias("run")).agg(members), "tree-runs")

    first = runs.where("n > 1").select("tree", F.lit(1).alias("level"), F.col("run").alias("place"), F.expr(f"(n + {FANOUT - 1}) DIV {FANOUT}").alias("width"), _joined(F.col("members.leaf")).alias("digests"))
    first = stored(first.withColumn("digest", digest(as_text(F.col("digests")))), "tree-level")
    nodes = _levels(first, runs.agg(F.max("n")).first()[0] or 0)

    # The upper tree: subroots are its leaves.
    alone = runs.where("n = 1").select("tree", F.lit(0).alias("low"), F.col("members")[0].leaf.alias("subroot"), F.lit(1).cast("long").alias("runs"))
    trees = alone.unionByName(nodes.where("width = 1").join(runs.groupBy("tree").agg(F.count(F.lit(1)).alias("runs")), "tree").select("tree", F.col("level").alias("low"), F.col("digest").alias("subroot"), "runs"))
    trees = stored(positions(trees, [], ["tree"], "rank", "trees"), "trees")
    count = trees.count()
    upper = trees.groupBy(F.expr(f"rank DIV {FANOUT}").alias("place"), "trees").agg(F.array_sort(F.collect_list(F.struct("rank", "subroot"))).alias("run")).where("trees > 1")
    upper = upper.select(F.lit("").alias("tree"), F.lit(1).alias("level"), "place", F.expr(f"(trees + {FANOUT - 1}) DIV {FANOUT}").alias("width"), _joined(F.col("run.subroot")).alias("digests"))
    upper = _levels(stored(upper.withColumn("digest", digest(as_text(F.col("digests")))), "tree-level"), count)
    top = upper.where("width = 1").select("digest").first() if count > 1 else trees.select("subroot").first()  # one digest
    root, high, left = F.lit(top[0] if top else b""), 0, count
    while left > 1:
        high, left = high + 1, -(-left // FANOUT)

    # What a climb looks up: (tree, level, place, block) -> the run's digests and the place in the next run.
    last_block = F.expr(f"(runs - 1) DIV {BLOCK_LEAVES // FANOUT}")
    own = nodes.join(trees.select("tree", "rank", "runs"), "tree")
    own = _copies(own, last_block).select("tree", "level", "place", "block", F.when(F.col("width") == 1, F.col("rank")).otherwise(F.col("place")).alias("next"), "digests")
    step = F.explode(F.sequence(F.lit(1), F.lit(high))).alias("level") if high else F.explode(F.array().cast("array<int>")).alias("level")
    ways = trees.select("tree", "low", "rank", "runs", step).withColumn("place", F.floor(F.col("rank") / F.pow(F.lit(float(FANOUT)), F.col("level"))).cast("long"))
    ways = ways.withColumn("block", F.expr(f"rank DIV {BLOCK_LEAVES}")).join(_copies(upper, F.lit(count // BLOCK_LEAVES).cast("long")).select("level", "place", "block", "digests"), ["level", "place", "block"])
    ways = ways.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    ways = ways.select("tree", (F.col("low") + F.col("level")).alias("level"), "place", "block", F.col("place").alias("next"), "digests")
    links = stored(own.unionByName(ways), "tree-nodes")

    known = lookup(runs, trees.select("tree", "low", "subroot", "rank", "runs"), "tree", "runs", ["run"], whole=True)
    digests, at = _joined(F.col("members.leaf")), lambda i: (i * 32).cast("int")
    before, after = lambda d, i: F.substring(d, F.lit(1), at(i)), lambda d, i: F.substring(d, at(i) + 33, F.lit(32 * FANOUT))
    known = known.withColumn("digests", digests)
    folds = F.when(F.col("n") == 1, F.col("members.tried")).otherwise(F.transform("members", lambda m, i: digest(as_text(before(F.col("digests"), i)), as_text(m.tried), as_text(after(F.col("digests"), i)))))
    begun = known.select(
        "tree", "run", F.expr(f"run DIV {BLOCK_LEAVES // FANOUT}").alias("block"), F.when(F.col("n") == 1, 0).otherwise(1).alias("level"), (F.col("low") + high).alias("height"),
        F.when(F.col("n") <= FANOUT, F.col("rank")).otherwise(F.col("run")).alias("at"), folds.alias("folds"),
    )
    begun = stored(begun, "tree-climb")
    limit = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the rows of all levels: more than its default at any real size
    try:
        climbed = stored(spark.sql(_CLIMB, start=begun, nodes=links), "tree-proofs")
    finally:
        spark.conf.set(limit, was)

    own_proof = F.transform("members", lambda m, i: F.concat(before(F.col("digests"), i), after(F.col("digests"), i)))
    ended = known.join(climbed, ["tree", "run"]).select("subroot", "proof", F.explode(F.arrays_zip("members", "folds", own_proof.alias("siblings"))).alias("m"))
    return ended.select(
        F.col("m.members.id").alias(id_col), as_text(F.col("m.members.leaf")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), as_text(root).alias("root"),
        F.sha2(as_text(F.concat("m.siblings", "proof")).cast("binary"), 256).alias("proof_sha256"), as_text(F.col("m.folds")).alias("folded_root"), (F.col("m.folds") == root).alias("verified"),
    )
