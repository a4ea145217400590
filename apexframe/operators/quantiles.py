"""Exact quantiles of any number of groups and probabilities at once, by narrowing ranges of values.

Equal values are one point with their number, so what follows grows with the distinct values. The ranks that the quantiles need are known from a count. A pass cuts each range that still holds a wanted rank into BINS by value (by the logarithm
of the distance from its least value in every other pass, for what clusters there), counts them in one combined aggregate, and keeps the bins that hold wanted
ranks. A bin of one value is done; when all others have few points, each is ordered by itself. No task ever holds a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.operators.sweeps import covering
from apexframe.scratch import stored

BINS = 1024
#: Points that may be ordered in one task.
LOCAL_ROWS = 100_000
#: After so many passes what is left is ordered whatever its size; each second one narrows a range BINS times at least.
MOST_PASSES = 40


def _nulls_alike(a: str, b: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def _bin(passes: int) -> Column:
    """The bin of ``v`` in [lo, hi]; it never falls as ``v`` rises."""
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, so that no width overflows
    if passes % 2:
        share = F.log1p(share * 2.0**50) / F.log1p(F.lit(2.0**50))
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float], count: str | None = None) -> DataFrame:
    """(keys, n, quantiles) with an array of the quantiles in the order of ``probabilities``, interpolated between neighbours as ``percentile`` does.

    Null values don't count, values that aren't finite are an error; null keys are keys; keys without a value are left out. A row stands for as many values as
    its ``count`` says, one without such a column.
    """
    v = F.col(value).cast("double")
    finite = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit("quantiles need finite values")).cast("double")).otherwise(v)
    weight = F.lit(1) if count is None else F.col(count)
    points = rows.where(F.col(value).isNotNull() & (weight > 0)).select(*keys, finite.alias("v"), weight.cast("long").alias("w"))
    points = points.groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    points = stored(points.withColumn("below", F.lit(0).cast("long")), "quantile-points")
    span = [F.sum("w").alias("count"), F.count(F.lit(1)).alias("points"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    spans = points.groupBy(*keys).agg(*span).withColumn("below", F.lit(0).cast("long"))
    spans = stored(spans.where("count > 0"), "quantile-spans")
    sizes = spans.select(*keys, F.col("count").alias("n"))
    at = sizes.select(*keys, "n", F.posexplode(F.array(*(F.lit(float(p)) for p in probabilities))).alias("place", "p")).withColumn("at", F.col("p") * (F.col("n") - 1))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil("at").alias("rank")))
    wanted = stored(at.select(*keys, F.explode(ends).alias("e")).select(*keys, F.col("e.rank").cast("long").alias("rank")).distinct(), "quantile-ranks")
    known: list[DataFrame] = []
    passes = 0
    while True:
        # ``spans``: ranges that hold wanted ranks, each named by how many values of its key lie below it.
        single = spans.where("lo = hi")
        known.append(_ranks_in(wanted, single, keys).select(*keys, "rank", F.col("of.lo").alias("v")))
        spans = spans.where("lo < hi")
        most = spans.agg(F.max("points")).first()[0]
        if most is None:
            break
        held = points.alias("p").join(spans.alias("s"), [*_nulls_alike("p", "s", keys), F.col("p.below") == F.col("s.below")]).select("p.*", "s.lo", "s.hi")
        if most <= LOCAL_ROWS or passes == MOST_PASSES:
            upto = F.sum("w").over(Window.partitionBy(*keys, "below").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            ranked = held.select(*keys, F.col("below").alias("of_span"), (F.col("below") + upto - F.col("w")).alias("below"), F.col("w").alias("count"), F.col("v").alias("lo"), F.col("v").alias("hi"))
            dealt = _ranks_in(wanted, spans, keys).select(*keys, "rank", F.col("from").alias("of_span"))
            known.append(_ranks_in(dealt, ranked, [*keys, "of_span"]).select(*keys, "rank", F.col("of.lo").alias("v")))
            break
        binned = held.withColumn("bin", _bin(passes))
        counts = binned.groupBy(*keys, "below", "bin").agg(*span)
        up = Window.partitionBy(*keys, "below").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS at most
        counts = stored(counts.withColumn("start", F.col("below") + F.coalesce(F.sum("count").over(up), F.lit(0))), "quantile-bins")
        hit = _ranks_in(wanted, counts.withColumn("below", F.col("start")), keys).select(*keys, F.col("from").alias("start")).distinct()
        kept = stored(counts.alias("c").join(hit.alias("h"), [*_nulls_alike("c", "h", keys), F.col("c.start") == F.col("h.start")]).select("c.*"), "quantile-kept")
        inside = binned.alias("b").join(kept.alias("k"), [*_nulls_alike("b", "k", keys), F.col("b.below") == F.col("k.below"), F.col("b.bin") == F.col("k.bin")])
        points = stored(inside.where("k.lo < k.hi").select(*(f"b.{k}" for k in keys), "b.v", "b.w", F.col("k.start").alias("below")), "quantile-points")
        spans = kept.select(*keys, "count", "points", "lo", "hi", F.col("start").alias("below"))
        passes += 1
    found = reduce(DataFrame.unionByName, known)
    at = at.withColumns({"low": F.floor("at").cast("long"), "high": F.ceil("at").cast("long")})
    found = stored(found, "quantile-values")
    joined = at
    for end in ("low", "high"):
        f = found.withColumnRenamed("v", f"v_{end}").alias("f")
        joined = joined.alias("a").join(f, [*_nulls_alike("a", "f", keys), F.col(f"a.{end}") == F.col("f.rank")]).select("a.*", f"f.v_{end}")
    value_at = F.when(F.col("low") == F.col("high"), F.col("v_low")).otherwise((F.col("high") - F.col("at")) * F.col("v_low") + (F.col("at") - F.col("low")) * F.col("v_high"))
    listed = joined.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("place", value_at.alias("q")))).alias("q"))  # one for each probability
    return listed.select(*keys, "n", F.col("q.q").alias("quantiles"))


def _ranks_in(wanted: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted ranks with the span [below, below + count) of their key that holds them, as ``from`` and ``of``; others are left out."""
    coded = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(f"__k{i}") for i, k in enumerate(keys)] or [F.lit("").alias("__k0")]
    names = [f"__k{i}" for i in range(max(1, len(keys)))]
    s = spans.select(*coded, F.col("below").alias("from"), (F.col("below") + F.col("count") - 1).alias("to"), F.struct("lo", "hi").alias("of"))
    return covering(wanted.select("*", *coded), s, names, "rank", "from", "to", "of").where("`from` is not null").drop(*names)
