"""Exact quantiles against numpy: one pass and many, ties, clusters, extreme values, null keys."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from apexframe.contracts import DataValidationError
from apexframe.operators import quantiles as Q
from apexframe.operators.features import robust_scaler, robust_transform

PROBABILITIES = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


def _groups():
    rng = np.random.default_rng(1)
    yield "normal", rng.normal(size=500)
    yield "ties", rng.choice([0.0, 1.0, 2.0], 700, p=[0.9, 0.05, 0.05])
    yield "one", np.full(40, -3.5)
    yield "alone", np.array([7.25])
    yield "clustered", np.r_[10.0 ** rng.uniform(-300, 300, 200), 1 + 1e-12 * rng.random(200)]
    yield "extreme", np.r_[-1.7e308, 1.7e308, rng.normal(size=60)]
    yield None, rng.integers(-5, 5, 90).astype(float)


@pytest.mark.parametrize(("local", "bins"), [(100_000, 1024), (3, 4)])
def test_quantiles_of_all_groups(spark, monkeypatch, local, bins):
    monkeypatch.setattr(Q, "LOCAL_ROWS", local)
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "MOST_PASSES", 6 if local == 3 else 40)
    groups = list(_groups())
    rows = spark.createDataFrame([(g, float(v)) for g, values in groups for v in values] + [("empty", None)], "g string, v double")
    got = {r.g: r for r in Q.exact_quantiles(rows, ["g"], "v", PROBABILITIES).collect()}
    assert set(got) == {g for g, _ in groups}
    for g, values in groups:
        assert got[g].n == len(values)
        at = np.array(PROBABILITIES) * (len(values) - 1)
        s, low, high = np.sort(values), np.floor(at).astype(int), np.ceil(at).astype(int)
        assert got[g].quantiles == pytest.approx(np.where(low == high, s[low], (high - at) * s[low] + (at - low) * s[high]).tolist(), rel=1e-12), g


def test_without_keys_rows_or_finite_values(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert Q.exact_quantiles(rows, [], "v", [0.5, 0.25]).first().quantiles == [5.0, 2.5]
    assert Q.exact_quantiles(rows.where("false"), [], "v", [0.5]).count() == 0
    for bad in ("double('NaN')", "double('Infinity')"):
        with pytest.raises(PySparkException):
            Q.exact_quantiles(rows.selectExpr(f"if(v = 3, {bad}, v) AS v"), [], "v", [0.5]).collect()


def test_scaling_uses_fit_rows_alone(spark):
    rows = spark.createDataFrame([(float(i), 2.0, i < 9) for i in range(20)], "x double, c double, fit boolean")
    scaler = robust_scaler(rows, ["x", "c"], rows.fit)
    assert sorted(map(tuple, scaler.collect())) == [("c", 2.0, 1.0), ("x", 4.0, 4.0)]
    assert sorted(r.x for r in robust_transform(rows, scaler, ["x", "c"]).collect()) == [(i - 4) / 4 for i in range(20)]
    with pytest.raises(DataValidationError):
        robust_transform(rows, scaler.where("feature = 'x'"), ["x", "c"])


def test_equal_values_are_one_point(spark, monkeypatch):
    monkeypatch.setattr(Q, "LOCAL_ROWS", 10)
    monkeypatch.setattr(Q, "_bin", lambda passes: pytest.fail("three values need no pass"))
    rows = spark.range(3000).selectExpr("cast(id % 3 as double) AS v", "1 + id % 2 AS times")
    assert Q.exact_quantiles(rows, [], "v", [0.25, 0.5, 1.0]).first()[:] == (3000, [0.0, 1.0, 2.0])
    values = np.repeat([0.0, 5.0, 5.0, 9.0], [1, 2, 3, 4])
    few = spark.createDataFrame([("a", 9.0, 4), ("a", 0.0, 1), ("a", 5.0, 2), ("a", 5.0, 3), ("a", 7.0, 0)], "g string, v double, times int")
    assert Q.exact_quantiles(few, ["g"], "v", [0.1, 0.5, 0.55, 0.9], "times").first().quantiles == pytest.approx(np.quantile(values, [0.1, 0.5, 0.55, 0.9]).tolist())
