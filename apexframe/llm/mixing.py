"""Temperature mixing of sources, realised as budgeted block permutations.

Token shares p of the sources are raised to an exponent a and normalised: q ~ p^a
(a = 1 leaves the shares, a = 0 makes them equal). The exponent is found by bisection in sections:
one aggregate over the table of sources evaluates a whole grid of
exponents, and the grid is narrowed around the place where the target is met:

* ``entropy``: the entropy of q as a part of the largest possible one, ln(sources);
* ``even``: the part of the way from the natural entropy to the largest one, so that a target binds whatever the shares are;
* ``repeats``: no source is read more than that many times as often as the one read
  the least.

The budget (by default: the smallest in which every document is read at least once)
gives each source its tokens: whole epochs over its documents, then a part of one more.
Each epoch has its own permutation, by a seeded hash. The place of a document in its
source's stream decides the block: block b holds, of every source, the tokens from
b*K*q to (b+1)*K*q, so each block has the target weights. Documents without tokens weigh nothing and are dealt to
all blocks by a hash. Within a block the order is a
second permutation. Ranks are prefix sums over hash buckets, as many as the largest source needs, so a source that holds a
third of all rows is spread over all buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.llm.common import lookup, packed_rows, stored

GRID = 16
PASSES = 6
#: Parts of a source that meet its weight apart, and rows of a source that a bucket of its permutation holds on average.
SALTS = 64
BUCKET_ROWS = 8192


def word_tokens(text: Column) -> Column:
    """Tokens of a text for the shares: runs of non-space characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _evaluate(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy / ln(sources), largest over smallest q/p) for each exponent, in one aggregate."""
    live = sources.where("tokens > 0")
    aggs = [F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")]
    for i, a in enumerate(exponents):
        aggs += [F.sum(F.pow("p", F.lit(a))).alias(f"z{i}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"l{i}")]
    r = live.agg(*aggs).first()
    out = []
    for i, a in enumerate(exponents):
        # entropy of q = ln z - a * sum(p^a ln p) / z
        h = math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"]
        out.append((h / math.log(r.n) if r.n > 1 else 1.0, (r.hi / r.lo) ** (1 - a)))
    return out


def find_exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None, even: float | None = None) -> float:
    """An exponent in [0, 1]; ``sources`` has (tokens, p).

    With ``entropy``: the largest exponent (nearest to the natural shares) whose relative
    entropy is at least that; 0 if none is. With ``even``: the same for the entropy that lies that part of the way from the natural one to 1.
    With ``repeats``: the smallest exponent (nearest to equal shares) at which no source is read over that many times as often as another.
    """
    if sum(x is not None for x in (entropy, repeats, even)) != 1:
        raise ValueError("give one of entropy, repeats and even")
    if sources.where("tokens > 0").isEmpty():
        return 1.0
    if even is not None:
        natural = _evaluate(sources, [1.0])[0][0]
        entropy = natural + even * (1 - natural)
    # Both quantities fall as the exponent grows: `before` holds up to the place looked for.
    before = (lambda h, r: h >= entropy - 1e-12) if entropy is not None else (lambda h, r: r > repeats + 1e-12)
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        holds = [before(*x) for x in _evaluate(sources, grid)]
        if holds[-1]:
            return grid[-1]
        if not holds[0]:
            return grid[0]
        at = max(i for i, ok in enumerate(holds) if ok)
        low, high = grid[at], grid[at + 1]
    return low if entropy is not None else high


def _source_key(source_col: str) -> Column:
    """Null is a source of its own."""
    name = F.col(f"`{source_col}`")
    return F.concat(F.when(name.isNull(), "-").otherwise("+"), F.coalesce(name.cast("string"), F.lit("")))


def _permuted(seed: int, row_id: Column, body: Column) -> Column:
    """The place of a document in an epoch's permutation: a 63-bit hash; ``epoch`` is a column."""
    return F.xxhash64(F.lit(seed), F.col("epoch"), row_id, body).bitwiseAND(F.lit((1 << 63) - 1))


def _readings(docs: DataFrame, id_col: str, text_col: str, source_col: str, target: dict[str, float | None], budget: int | None, block_tokens: int, seed: int) -> DataFrame:
    """One row for each reading: id, source, key, epoch, h, tokens, block, q, exponent."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), _source_key(source_col).alias("key"), word_tokens(F.col(f"`{text_col}`")).alias("tokens"), F.xxhash64(F.col(f"`{text_col}`")).alias("body"))
    rows = stored(rows.withColumn("salt", F.pmod(F.xxhash64("id", "body"), F.lit(SALTS)).cast("int")), "mix-rows")
    # A source may hold a third of all rows: it meets its weight in SALTS parts, those that it has.
    parts = rows.groupBy("key", "salt").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).checkpoint()
    per = parts.groupBy("key").agg(F.sum("tokens").cast("double").alias("tokens"), F.sum("rows").alias("rows"))
    seen = per.agg(F.sum("tokens").alias("tokens"), F.max("rows").alias("rows")).first()
    total = seen.tokens or 0.0
    bits = min(20, max(4, math.ceil(math.log2((seen.rows or 1) / BUCKET_ROWS + 1))))
    sources = per.withColumn("p", F.col("tokens") / F.lit(max(total, 1.0))).checkpoint()
    a = find_exponent(sources, **target)
    z = sources.where("tokens > 0").agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weighted = sources.withColumn("q", F.when(F.col("tokens") > 0, F.pow("p", F.lit(a)) / F.lit(z)).otherwise(0.0))
    if budget is None:
        need = weighted.where("q > 0").agg(F.max(F.col("tokens") / F.col("q"))).first()[0] or 0.0
        budget = math.ceil(need - 1e-6)
    weighted = weighted.withColumn("share", F.round(F.col("q") * F.lit(float(budget)))).withColumn("share", F.when((F.col("share") < F.col("tokens")) & (F.col("share") + 1 >= F.col("tokens")), F.col("tokens")).otherwise(F.col("share")))
    epochs = F.greatest(F.lit(1), F.when(F.col("tokens") > 0, F.ceil(F.col("share") / F.col("tokens"))).otherwise(1)).cast("int")
    plan = weighted.withColumn("epochs", epochs).checkpoint()

    # One permutation of each source for each epoch it is read in.
    weights = parts.select("key", "salt").join(plan.select("key", "q", "share", F.col("tokens").alias("whole"), "epochs", F.lit(a).alias("exponent")), "key")
    read = rows.join(weights, ["key", "salt"]).drop("salt")
    read = read.select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    read = read.withColumn("h", _permuted(seed, F.col("id"), F.col("body"))).withColumn("bucket", F.shiftright("h", 63 - bits).cast("int"))
    sums = read.groupBy("key", "epoch", "bucket").agg(F.sum("tokens").alias("m"))
    base = sums.withColumn("base", F.sum("m").over(Window.partitionBy("key", "epoch").orderBy("bucket")) - F.col("m")).drop("m")
    within = Window.partitionBy("key", "epoch", "bucket").orderBy("h", "id")
    placed = read.join(base, ["key", "epoch", "bucket"])
    begins = F.col("base") + F.sum("tokens").over(within) - F.col("tokens")
    placed = placed.withColumn("begins", begins + F.col("epoch") * F.col("whole"))
    placed = placed.where((F.col("begins") < F.col("share")) | (F.col("epoch") == 0) & (F.col("share") >= F.col("whole")))
    blocks = max(1, math.ceil(budget / block_tokens))
    # What has no tokens weighs nothing: it is dealt to all blocks.
    dealt = F.pmod(F.xxhash64(F.lit(seed + 2), "h"), F.lit(blocks))
    block = F.when(F.col("tokens") > 0, F.floor(F.col("begins") / (F.col("q") * F.lit(float(block_tokens))))).otherwise(dealt).cast("bigint")
    placed = placed.withColumn("block", block)
    return placed


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy: float | None = None,
    repeats: float | None = None,
    even: float | None = None,
    budget: int | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 17,
) -> DataFrame:
    """The schedule: one row for each reading of a document.

    Exactly one of ``entropy``, ``repeats`` and ``even`` sets the target. Returns id, source, epoch (from 0), n_tokens, block, slot (place in the block, from 0),
    weight (the source's q) and exponent.

    Edge cases: a null source is a source of its own; null and empty texts have no
    tokens and are read once for each epoch that begins before them; a source
    without tokens has weight 0 and is read once, spread over all blocks. Rows that
    repeat an id are separate readings. With a budget under one epoch a source's stream is cut where
    its tokens are used up (the document that crosses the line is read). An empty
    table gives an empty result. Other columns are ignored.
    """
    placed = _readings(docs, id_col, text_col, source_col, {"entropy": entropy, "repeats": repeats, "even": even}, budget, block_tokens, seed)
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), F.col("h")), "h", "id")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "epoch", F.col("tokens").alias("n_tokens"), "block", (F.row_number().over(order) - 1).cast("bigint").alias("slot"), F.col("q").alias("weight"), "exponent")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = None, repeats: float | None = None, even: float | None = None, budget: int | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as :func:`mix_sources` reads it, all columns as they are.

    An epoch's permutation is cut at one hash for each source, so the texts need no shuffle:
    a table of (source, its cuts by epoch) decides, broadcast or looked up in parts.

    Edge cases: as in :func:`mix_sources`. Rows that repeat id and text share their place, so a cut keeps all of them; columns of
    any name, dots included, pass through.
    """
    placed = _readings(docs, id_col, text_col, source_col, {"entropy": entropy, "repeats": repeats, "even": even}, budget, 1 << 20, seed)
    cuts = placed.groupBy("key", "epoch").agg(F.max("h").alias("cut"), F.count(F.lit(1)).alias("n"))
    cuts = stored(cuts.groupBy("key").agg(F.collect_list(F.struct("epoch", "cut")).alias("cuts"), F.max("n").alias("n")), "mix-cuts")
    rows = packed_rows(docs, key=_source_key(source_col), id=F.col(f"`{id_col}`"), body=F.xxhash64(F.col(f"`{text_col}`")))
    found = lookup(rows, cuts, "key", "n", ["id", "body"])
    place = lambda c: F.xxhash64(F.lit(seed), c.epoch, F.col("id"), F.col("body")).bitwiseAND(F.lit((1 << 63) - 1))
    return found.select("row", F.explode(F.filter("cuts", lambda c: place(c) <= c.cut)).alias("read")).select("row.*")
