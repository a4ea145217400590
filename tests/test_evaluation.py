import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError, attach_partition, join_frames_targets, join_matched
from apexframe.operators import metrics as M
from apexframe.operators import pooling as L


def _plain_precision(p, y):
    total = 0.0
    for cut in sorted(set(p[y == 1])):
        total += y[p == cut].sum() * y[p >= cut].mean()
    return total / y.sum()


def test_evaluation_equals_plain_sums(spark):
    rng = np.random.default_rng(5)
    n = 400
    d = pd.DataFrame({"method": "m", "circuit": rng.choice(["a", "b"], n), "p": rng.integers(0, 41, n) / 40, "reference": 0.25, "evaluable": rng.random(n) < 0.8})
    d["y"] = (rng.random(n) < d.p).astype(float)
    for ranges in (1, 7, 1024):
        got = M.evaluate(spark.createDataFrame(d), ["method"], "circuit", score_ranges=ranges).toPandas()
        assert sorted(got.circuit.fillna("all")) == ["a", "all", "b"]
        for r in got.itertuples():
            part = d if r.scope == "pooled" else d[d.circuit == r.circuit]
            seen = part[part.evaluable]
            q = seen.p.clip(1e-12, 1 - 1e-12)
            bins = seen.groupby(np.minimum((seen.p * 10).astype(int), 9))
            assert (r.n, r.unresolved, r.events) == (len(seen), len(part) - len(seen), seen.y.sum())
            assert r.brier == pytest.approx(((seen.p - seen.y) ** 2).mean())
            assert r.skill == pytest.approx(1 - ((seen.p - seen.y) ** 2).mean() / ((0.25 - seen.y) ** 2).mean())
            assert r.log_score == pytest.approx(-(seen.y * np.log(q) + (1 - seen.y) * np.log(1 - q)).mean())
            assert r.ece == pytest.approx(sum(len(g) * abs(g.p.mean() - g.y.mean()) for _, g in bins) / len(seen))
            assert r.average_precision == pytest.approx(_plain_precision(seen.p.to_numpy(), seen.y.to_numpy()))


def test_evaluation_without_events_or_rows(spark):
    rows = spark.createDataFrame([("m", "a", 0.5, 0.0, 0.0, True), ("m", "b", 0.5, 0.0, 0.0, False)], "method string, circuit string, p double, y double, reference double, evaluable boolean")
    got = {r.scope: r for r in M.evaluate(rows, ["method"], "circuit").collect()}
    assert set(got) == {"unit", "pooled"} and got["unit"].circuit == "a"
    assert got["pooled"].unresolved == 1 and got["pooled"].average_precision is None and got["pooled"].skill is None
    assert M.evaluate(rows.where("false"), ["method"], "circuit").count() == 0


def test_matched_joins_refuse_what_does_not_match(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    right = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, w double")
    assert sorted(map(tuple, join_matched(left, right, ["k"]).collect())) == [(1, "a", 1.0), (2, "b", 2.0)]
    extra = right.unionByName(spark.createDataFrame([(3, 3.0)], right.schema))
    null = left.unionByName(spark.createDataFrame([(None, "c")], left.schema))
    for a, b in ((left, right.where("k = 1")), (left, extra), (left, right.unionByName(right)), (left.unionByName(left), right), (null, right), (left.where("false"), right.where("false"))):
        with pytest.raises(DataValidationError):
            join_matched(a, b, ["k"])
    assert join_matched(left.unionByName(left), extra, ["k"], many=True).count() == 4
    with pytest.raises(DataValidationError):
        join_matched(left, right.where("k = 1"), ["k"], many=True)
    with pytest.raises(DataValidationError):
        join_frames_targets(left.withColumn("next_event", F.lit(1)), right, ["k"])


def test_partitions_must_split_whole_units(spark):
    rows = spark.createDataFrame([("x", "1", 0), ("x", "1", 1), ("y", "2", 0)], "circuit string, car_id string, frame long")
    splits = spark.createDataFrame([("x", "x", "1", "test"), ("x", "y", "2", "fit")], "fold_test_circuit string, circuit string, car_id string, partition string")
    unit = ["circuit", "car_id"]
    assert sorted(r.partition for r in attach_partition(rows, splits, "x", unit).collect()) == ["fit", "test", "test"]
    other = F.when(F.col("circuit") == "y", F.lit("test")).otherwise(F.col("partition"))
    null = F.when(F.col("circuit") == "x", F.col("partition"))
    for bad in (splits.where("circuit = 'x'"), splits.withColumn("partition", other), splits.withColumn("partition", null), splits.unionByName(splits), splits.where("false")):
        with pytest.raises(DataValidationError):
            attach_partition(rows, bad, "x", unit)


def test_paired_draws_share_their_cars(spark):
    rng = np.random.default_rng(3)
    cars = [("c0" if i < 6 else "c1", f"k{i}") for i in range(10)]
    ledger = pd.DataFrame([(c, k, m, lead, 4, int(rng.integers(0, 5)), int(rng.integers(0, 3)), 0, 10.0) for c, k in cars for m in ("a", "b") for lead in (1.0, 2.0, 4.0)], columns=["circuit", "car_id", "method", "lead", *L.MEASURES])
    weights = L.hash_draws(spark.createDataFrame(cars, "circuit string, car_id string"), 40, "s")
    got = L.paired_bootstrap(spark.createDataFrame(ledger), weights, "method", "a", "b", 0.5, 0.12).first()
    plain = []
    for _, w in weights.toPandas().groupby("draw"):
        each = {}
        for m, rows in ledger.merge(w, on=["circuit", "car_id"]).groupby("method"):
            s = rows.assign(**{c: rows[c] * rows.weight for c in L.MEASURES}).groupby("lead")[L.MEASURES].sum()
            ok = s[(s.hits >= 0.5 * s.events - 1e-9) & (s.false_proposals <= 0.12 * s.exposure + 1e-9)]
            each[m] = ok.index.max() if len(ok) else 0.0
        plain.append((each["a"], each["b"]))
    a, b = np.array(plain).T
    assert got.draws == 40 and got.delta_mean == pytest.approx((a - b).mean()) and got.first_longer == pytest.approx((a > b).mean())
    for name, v in (("first", a), ("second", b), ("delta", a - b)):
        assert [got[f"{name}_low"], got[f"{name}_high"]] == pytest.approx(np.quantile(v, [0.025, 0.975]).tolist())


def test_draws_are_spread_and_never_broadcast(spark):
    """One circuit of many cars: draws are counted in many tasks, and the weights, whose size Spark can't tell, aren't broadcast to the ledger."""
    units = spark.range(64).select(F.concat(F.lit("c"), (F.col("id") % 1).cast("string")).alias("circuit"), F.format_string("k%d", "id").alias("car_id"))
    ledger = units.select("*", F.lit(1.0).alias("lead"), *(F.lit(1).alias(m) for m in L.MEASURES), F.lit(0.0).alias("delay"))
    for weights in (L.hash_draws(units, 20, "s"), L.two_stage_draws(units, 20, "s")):
        assert weights.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert weights.groupBy("draw").agg(F.sum("weight").alias("n")).select("n").distinct().collect() == [(64,)]
        for out in (L.bootstrap_l_star(ledger, weights, 0.5, 1.0), L.paired_bootstrap(ledger, weights, "delay", 0.0, 6.0, 0.5, 1.0)):
            joins = re.findall(r"(\w+Join) \[[^]]*(?:place|car_id)#", out._jdf.queryExecution().executedPlan().toString())
            assert joins == ["SortMergeJoin"] * 2  # by car, and by place
