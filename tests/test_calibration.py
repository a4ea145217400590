"""Grouped logistic fits against a plain bounded search, calibrated scores and distributions."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.operators import calibration as B
from apexframe.operators import metrics as M


def _loss(x, y, a, b):
    z = a * x + b
    return float((np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z).sum())


def _search(x, y, low, high):
    """The best slope by ternary search, each with its best intercept by ternary search: the loss is convex."""

    def narrow(f, a, b):
        for _ in range(120):
            c, d = a + (b - a) / 3, b - (b - a) / 3
            a, b = (a, d) if f(c) <= f(d) else (c, b)
        return (a + b) / 2

    best = lambda a: narrow(lambda b: _loss(x, y, a, b), -50.0, 50.0)
    slope = narrow(lambda a: _loss(x, y, a, best(a)), low, high)
    return slope, best(slope)


def _groups():
    rng = np.random.default_rng(2)
    for name, slope, shift, n in (("steep", 3.0, 1.0, 300), ("flat", 0.1, -2.0, 300), ("falling", -1.5, 0.0, 200), ("shifted", 1.0, 6.0, 400), (None, 0.8, 0.3, 50)):
        p = rng.uniform(0.01, 0.99, n)
        y = (rng.random(n) < 1 / (1 + np.exp(-(slope * np.log(p / (1 - p)) + shift)))).astype(float)
        yield name, p, y
    yield "same score", np.full(20, 0.25), np.r_[np.ones(5), np.zeros(15)]
    yield "parted", np.r_[np.linspace(0.1, 0.4, 10), np.linspace(0.6, 0.9, 10)], np.r_[np.zeros(10), np.ones(10)]


@pytest.mark.parametrize(("part", "low"), [(7, 0.0), (1_000_000, -50.0)])
def test_fits_of_all_groups_at_once(spark, monkeypatch, part, low):
    """Interior optima, slopes at their bounds, separable groups, null keys; groups met in parts are fitted alike."""
    monkeypatch.setattr(B, "PART_POINTS", part)
    groups = list(_groups())
    rows = [(g, float(a), 1, float(b)) for g, p, y in groups for a, b in zip(p, y, strict=True)] + [("none", 0.3, 1, 0.0), ("none", 0.6, 2, 0.0), ("all", 0.3, 4, 4.0)]
    got = {r.g: r for r in B.logistic_fits(spark.createDataFrame(rows, "g string, p double, n long, events double"), ["g"], slopes=(low, 50.0)).collect()}
    assert len(got) == len(groups) + 2
    for g, p, y in groups:
        x, r = np.log(p / (1 - p)), got[g]
        a, b = _search(x, y, low, 50.0)
        assert r.n == len(p) and r.events == y.sum() and low <= r.slope <= 50 and abs(r.intercept) <= 50
        assert _loss(x, y, r.slope, r.intercept) <= _loss(x, y, a, b) + 1e-6, g
        if g not in ("same score", "parted"):
            assert r.converged and (r.slope, r.intercept) == pytest.approx((a, b), abs=1e-4), g
    assert (got["none"].slope, got["none"].intercept) == (0.0, pytest.approx(math.log(0.5 / 3.5))) and got["all"].intercept == pytest.approx(math.log(4.5 / 0.5))
    assert got["falling"].slope == 0 if low == 0 else got["falling"].slope < -0.5


def test_steps_that_a_bound_cuts_still_go_downhill(spark):
    """Scores of a narrow range that say little: steps overshoot the bound of the slope. The gradient at the fit must be that of the best one."""
    rng, rows, points = np.random.default_rng(1), [], {}
    for g in range(40):
        x = rng.uniform(-2.2, -1.2, 60)
        k = rng.binomial(50, 1 / (1 + np.exp(-(rng.normal(0, 0.3) * x + rng.uniform(-4, 1))))).astype(float)
        p = 1 / (1 + np.exp(-x))
        points[g] = np.log(p / (1 - p)), k
        rows += [(g, float(a), 50, float(b)) for a, b in zip(p, k, strict=True)]
    got = B.logistic_fits(spark.createDataFrame(rows, "g int, p double, n long, events double"), ["g"]).collect()
    assert len(got) == 40 and all(r.converged for r in got) and {r.slope > 0 for r in got} == {True, False}
    for r in got:
        x, k = points[r.g]
        left = 50 / (1 + np.exp(-(r.slope * x + r.intercept))) - k
        assert abs(left.sum()) < 1e-5, r
        assert abs((left * x).sum()) < 1e-5 if r.slope > 0 else (left * x).sum() >= 0, r


def test_one_class_has_no_line_and_no_rows_have_no_fit(spark):
    points = spark.createDataFrame([("a", 0.2, 1, 1.0)], "g string, p double, n long, events double")
    only = B.logistic_fits(points, ["g"], one_class="null").first()
    assert only.slope is None and only.intercept is None
    assert B.logistic_fits(points.where("false"), ["g"]).count() == 0
    assert M.fit_platt(spark.createDataFrame([], "p double, y double")) == (0.0, 0.0)


SCORES = "k long, method string, partition string, input_valid_causal boolean, in_corridor boolean, raw_exit_probability_0p50s double, raw_exit_probability_1p50s double, raw_primary_neighborhood_probability double"
TARGETS = "k long, next_event_id string, time_to_next double, outcome_evaluable_0p50s boolean, outcome_evaluable_1p50s boolean"


def _frames(spark):
    rng = np.random.default_rng(4)
    rows, truth = [], []
    for k in range(240):
        p = float(rng.uniform(0, 1))
        truth.append((k, "e" if rng.random() < p else None, float(rng.uniform(0, 2)), k % 10 != 0, k % 5 != 0))
        rows += [(k, m, "calibration" if k < 160 else "test", k % 7 != 0, k % 11 != 0, p * 0.5, p if m == "a" else p * p, p * 0.25) for m in ("a", "b")]
    return spark.createDataFrame(rows, SCORES), spark.createDataFrame(truth, TARGETS)


def test_calibrators_see_calibration_rows_alone(spark):
    scores, targets = _frames(spark)
    fits = {(r.method, r.horizon): r for r in B.fit_horizon_calibrators(scores, targets, ["k"], [0.5, 1.5]).collect()}
    assert set(fits) == {(m, h) for m in "ab" for h in (0.5, 1.5)}
    s, t = scores.toPandas(), targets.toPandas().set_index("k")
    for (m, h), r in fits.items():
        name = f"{h:.2f}s".replace(".", "p")
        d = s[(s.method == m) & (s.partition == "calibration") & s.input_valid_causal & s.in_corridor & t.loc[s.k, f"outcome_evaluable_{name}"].to_numpy()]
        y = (t.loc[d.k, "next_event_id"].notna() & (t.loc[d.k, "time_to_next"] <= h)).to_numpy().astype(float)
        p = d[f"raw_exit_probability_{name}"].to_numpy()
        assert (r.n, r.events) == (len(d), y.sum())
        x = np.log(p / (1 - p))
        assert (r.slope, r.intercept) == pytest.approx(_search(x, y, 0.0, 50.0), abs=1e-4)
    poisoned = scores.withColumn("raw_exit_probability_0p50s", F.when(F.col("partition") == "test", 0.0).otherwise(F.col("raw_exit_probability_0p50s")))
    again = {(r.method, r.horizon): r.slope for r in B.fit_horizon_calibrators(poisoned, targets, ["k"], [0.5, 1.5]).collect()}
    assert again == {k: r.slope for k, r in fits.items()}
    with pytest.raises(DataValidationError):
        B.fit_horizon_calibrators(scores, targets.where("k > 0"), ["k"], [0.5, 1.5])
    with pytest.raises(DataValidationError):
        B.fit_horizon_calibrators(scores.withColumn("in_corridor", F.col("in_corridor") & (F.col("method") == "a")), targets, ["k"], [0.5, 1.5])
    with pytest.raises(DataValidationError):
        B.fit_horizon_calibrators(scores.withColumn("raw_exit_probability_0p50s", F.lit(1.5)), targets, ["k"], [0.5, 1.5])


def test_zero_stays_zero_and_scores_are_rescaled(spark):
    scores = spark.createDataFrame([(1, "a", "test", True, True, 0.0, 0.0, 0.0), (2, "a", "test", True, True, 0.2, 0.2, 0.1)], SCORES)
    flat = spark.createDataFrame([("a", h, 0.0, 0.0) for h in (0.5, 1.5)], "method string, horizon double, slope double, intercept double")
    got = {r.k: r for r in B.apply_horizon_calibrators(scores, flat, [0.5, 1.5]).collect()}
    assert (got[1].exit_probability_1p50s, got[1].proposal_score) == (0.0, 0.0)
    assert (got[2].exit_probability_1p50s, got[2].proposal_score) == (pytest.approx(0.5), pytest.approx(0.25))
    with pytest.raises(PySparkException):
        B.apply_horizon_calibrators(scores, flat.where("horizon = 0.5"), [0.5, 1.5]).collect()
    with pytest.raises(DataValidationError):
        B.apply_horizon_calibrators(scores.withColumn("next_event_id", F.lit("x")), flat, [0.5, 1.5])


def test_calibrated_mass_keeps_shares_and_adds_up(spark):
    mass = spark.createDataFrame([(0, "m", 1.0, "left", 0, 0.05), (0, "m", 1.0, "left", 1, 0.15), (0, "m", 2.0, "right", 2, 0.6), (1, "m", 2.0, "left", 0, 0.25), (1, "m", 2.0, "right", 3, 0.5)], "k long, method string, horizon double, side string, bin long, mass double")
    stay = spark.createDataFrame([(0, "m", 1.0, 0.8), (0, "m", 2.0, 0.4), (1, "m", 1.0, 1.0), (1, "m", 2.0, 0.25)], "k long, method string, horizon double, h_no_exit double")
    fits = spark.createDataFrame([("m", 1.0, 0.5, -0.2), ("m", 2.0, 0.5, -0.2)], "method string, horizon double, slope double, intercept double")
    after, left = B.calibrate_mass(mass, stay, fits, ["k"])
    whole, got = {}, {}
    for r in after.collect():
        whole[r.k, r.horizon] = whole.get((r.k, r.horizon), 0) + r.mass
        got[r.k, r.horizon, r.side, r.bin] = r.mass
    for r in left.collect():
        assert r.h_no_exit + whole.get((r.k, r.horizon), 0) == pytest.approx(1, abs=1e-12)
    expected = 1 / (1 + math.exp(-(0.5 * math.log(0.2 / 0.8) - 0.2)))
    assert whole[0, 1.0] == pytest.approx(expected) and got[0, 1.0, "left", 1] == pytest.approx(0.75 * expected) and (1, 1.0) not in whole
    for bad in (stay.withColumn("h_no_exit", F.lit(0.5)), stay.withColumn("method", F.lit("other"))):
        with pytest.raises(PySparkException):
            B.calibrate_mass(mass.withColumn("method", F.lit(bad.first().method)), bad, fits, ["k"])


def test_lines_of_every_scope(spark):
    rows = [("m", g, float(a), float(b), 0.3, i % 9 != 0) for g, p, y in _groups() if g in ("steep", "falling") for i, (a, b) in enumerate(zip(p, y, strict=True))] + [("m", "one", 0.5, 1.0, 0.3, True)]
    d = spark.createDataFrame(rows, "method string, circuit string, p double, y double, reference double, evaluable boolean")
    got = {r.circuit: r for r in M.evaluate(d, ["method"], "circuit", lines=True).collect()}
    seen = [r for r in rows if r[5]]
    for scope in ("steep", "falling", None):
        part = np.array([(r[2], r[3]) for r in seen if scope in (None, r[1])])
        x = np.log(part[:, 0] / (1 - part[:, 0]))
        assert (got[scope].calibration_slope, got[scope].calibration_intercept) == pytest.approx(_search(x, part[:, 1], -50.0, 50.0), abs=1e-4)
    assert got["one"].calibration_slope is None and got["one"].n == 1
