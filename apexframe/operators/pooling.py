"""Pooling of car ledgers, the longest lead that meets the targets, and cluster bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ["events", "hits", "false_proposals", "unresolved", "exposure"]


def pooled_metrics(ledger: DataFrame, keys: list[str]) -> DataFrame:
    d = ledger.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in MEASURES), F.count_distinct("circuit").alias("circuits"), F.count_distinct("circuit", "car_id").alias("cars"))
    return d.select(*keys, "events", "hits", "false_proposals", "unresolved", "exposure", "circuits", "cars", F.try_divide(F.col("hits"), F.col("events")).alias("recall"), F.try_divide(F.col("false_proposals"), F.col("exposure")).alias("false_per_hour"))


def l_star(ledger: DataFrame, keys: list[str], recall: float, budget: Column, false_count: Column | None = None) -> DataFrame:
    """The longest lead whose pooled recall and false rate both pass, 0 if none does; leads pass independently."""
    false_count = F.col("false_proposals") if false_count is None else false_count
    d = ledger.withColumn("__false", false_count).groupBy(*keys, "lead").agg(F.sum("hits").alias("h"), F.sum("events").alias("e"), F.sum("__false").alias("f"), F.sum("exposure").alias("x"))
    passes = (F.col("h") >= (recall - 1e-12) * F.col("e")) & (F.col("e") > 0) & (F.col("f") <= (budget + 1e-12) * F.col("x"))
    return d.groupBy(*keys).agg(F.coalesce(F.max(F.when(passes, F.col("lead"))), F.lit(0.0)).alias("l_star"))


def _number(*parts) -> Column:
    """32 bits of a hash of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def _numbered(units: DataFrame) -> DataFrame:
    """(circuit, car_id, place, cars): cars numbered from 0 in their circuit."""
    w = Window.partitionBy("circuit")
    return units.select("circuit", "car_id").distinct().select("circuit", "car_id", (F.row_number().over(w.orderBy("car_id")) - 1).cast("long").alias("place"), F.count(F.lit(1)).over(w).alias("cars"))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt by circuit and place, not coalesced: each is small but stands for all draws. Circuits alone are too few to share the work by."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "circuit", "place")


def _weights(drawn: DataFrame, numbered: DataFrame) -> DataFrame:
    """(draw, circuit, car_id, weight): how often each place was drawn, with its car.

    Rows are dealt by circuit and place once, for the count and the join. The hint is needed: Spark takes exploded rows for as few as they were before, and would
    broadcast them.
    """
    counted = _spread(drawn).groupBy("draw", "circuit", "place").agg(F.count(F.lit(1)).alias("weight"))
    return counted.hint("merge").join(numbered.select("circuit", "place", "car_id"), ["circuit", "place"]).select("draw", "circuit", "car_id", "weight")


def hash_draws(units: DataFrame, draws: int, seed: str) -> DataFrame:
    """Weights of cars drawn with replacement inside their circuit, by a hash of (seed, draw, circuit, place).

    Returns (draw, circuit, car_id, weight > 0). The places of a circuit are its cars, so a draw keeps the circuit's size; a place draws a
    car's number, and numbers become cars by a join.
    """
    numbered = _numbered(units)
    places = _spread(numbered).select("circuit", "place", "cars", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = places.select("draw", "circuit", (_number(F.lit(seed), "draw", "circuit", "place") % F.col("cars")).alias("place"))
    return _weights(drawn, numbered)


def two_stage_draws(units: DataFrame, draws: int, seed: str) -> DataFrame:
    """Circuits drawn with replacement, then cars inside each drawn circuit; weights add up over the circuit's slots."""
    numbered = _numbered(units)
    circuits = numbered.select("circuit").distinct()
    circuits = circuits.select("circuit", (F.row_number().over(Window.orderBy("circuit")) - 1).cast("long").alias("slot"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))  # one row a circuit
    slots = circuits.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picked = slots.select("draw", "slot", (_number(F.lit(seed), F.lit("c"), "draw", "slot") % F.col("n")).alias("number"))
    picked = picked.join(circuits.select(F.col("slot").alias("number"), "circuit"), "number").select("draw", "slot", "circuit")
    places = _spread(numbered.select("circuit", "place", "cars")).join(F.broadcast(picked), "circuit")  # a row for each draw and slot
    drawn = places.select("draw", "circuit", (_number(F.lit(seed), "draw", "slot", "circuit", "place") % F.col("cars")).alias("place"))
    return _weights(drawn, numbered)


def bootstrap_l_star(ledger: DataFrame, weights: DataFrame, recall: float, budget: float) -> DataFrame:
    """L* of every draw, then mean and 2.5 / 97.5 percentiles; one join and two aggregates."""
    w = ledger.join(weights.hint("merge"), ["circuit", "car_id"])
    scaled = w.select("draw", "lead", *((F.col(m) * F.col("weight")).alias(m) for m in MEASURES))
    each = l_star(scaled, ["draw"], recall, F.lit(budget))
    q = F.percentile("l_star", F.array(F.lit(0.025), F.lit(0.975)))
    return each.agg(F.count(F.lit(1)).alias("draws"), F.avg("l_star").alias("m"), q.alias("q")).select("draws", F.col("m").alias("mean"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_bootstrap(ledger: DataFrame, weights: DataFrame, method: str, first: object, second: object, recall: float, budget: float) -> DataFrame:
    """L* of two methods on the same draws, and of their difference (first less second), one row.

    The ledger has a row for each car, lead and value of ``method``; the weights are joined to both methods, so a draw takes the same cars
    for each. Returns draws, the mean of the difference, the share of draws in which the first is longer, and 2.5 / 97.5
    percentiles of first, second and difference. A draw without a row of one method counts as 0 for it.
    """
    two = ledger.where(F.col(method).isin(first, second)).join(weights.hint("merge"), ["circuit", "car_id"])
    scaled = two.select("draw", method, "lead", *((F.col(m) * F.col("weight")).alias(m) for m in MEASURES))
    of = lambda v: F.coalesce(F.max(F.when(F.col(method) == F.lit(v), F.col("l_star"))), F.lit(0.0))
    each = l_star(scaled, ["draw", method], recall, F.lit(budget)).groupBy("draw").agg(of(first).alias("first"), of(second).alias("second"))
    each = each.withColumn("delta", F.col("first") - F.col("second"))
    cut = lambda c, i: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))[i]
    ends = [cut(c, i).alias(f"{c}_{end}") for c in ("first", "second", "delta") for i, end in enumerate(("low", "high"))]
    return each.agg(F.count(F.lit(1)).alias("draws"), F.avg("delta").alias("delta_mean"), F.avg((F.col("delta") > 0).cast("int")).alias("first_longer"), *ends)
