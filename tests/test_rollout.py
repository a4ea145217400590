import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.operators import geometry as G
from apexframe.operators import residual as D
from apexframe.operators import rollout as Q

INPUTS = ("v_long", "yaw_rate", "heading_error", "offset", "curvature", "fuel")
KEYS = ["circuit", "car_id", "frame_index"]


def _model(draws=1, noise=0.0):
    rng = np.random.default_rng(4)
    n = len(INPUTS)
    return D.ResidualModel(INPUTS, rng.normal(size=n), np.linspace(0.5, 2, n), rng.normal(size=(draws, 1 + n, 5)) * 0.05, np.stack([noise * np.eye(5)] * draws))


def _states(spark, n=40):
    rng = np.random.default_rng(5)
    rows = [("A" if i % 2 else "B", f"car_{i % 3}", i, float(7 + rng.normal()), float(rng.normal() * 4), float(abs(rng.normal()) * 6), float(rng.normal()), float(rng.normal()), *map(float, rng.normal(size=3)), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "circuit string, car_id string, frame_index long, x double, y double, v_long double, v_lat double, yaw double, yaw_rate double, a_long double, a_lat double, fuel double")


def _maps(spark):
    """Two circuits: squares of different sizes."""
    out = None
    for name, size in (("A", 1.0), ("B", 1.3)):
        for role, half in (("outer", 10.0), ("inner", 5.0), ("center", 7.5)):
            one = G.ring_segments(spark, G.square(half * size), role).withColumn("circuit", F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out.cache()


def _track(size, x, y):
    """(heading, offset, curvature) of the nearest side of a square that runs against the clock."""
    h = 7.5 * size
    p = [(-h, -h), (h, -h), (h, h), (-h, h)]
    best = None
    for i in range(4):
        a, b = np.array(p[i]), np.array(p[(i + 1) % 4])
        t = (b - a) / (2 * h)
        u = min(max((np.array([x, y]) - a) @ t / (2 * h), 0.0), 1.0)
        gap = round(float(np.hypot(*(np.array([x, y]) - a - u * (b - a)))), 9)
        if best is None or gap < best[0]:
            best = (gap, math.atan2(t[1], t[0]), float(t[0] * (y - a[1]) - t[1] * (x - a[0])))
    return best[1], best[2], (math.pi / 2) / (2 * h)


def _plain(state, size, model, draw, steps, dt=0.05):
    x, y, vl, vt, yaw, r, al, at = (state[c] for c in D.STATE)
    out = []
    for _ in range(steps):
        heading, offset, curvature = _track(size, x, y)
        error = (yaw - heading + math.pi) % (2 * math.pi) - math.pi
        z = np.r_[1.0, (np.array([vl, r, error, offset, curvature, state["fuel"]]) - model.center) / model.scale]
        d = z @ model.coefficients[draw]
        hl, ht = vl + (al + r * vt) * dt / 2, vt + (at - r * vl) * dt / 2
        mid = yaw + r * dt / 2
        x, y = x + (hl * math.cos(mid) - ht * math.sin(mid)) * dt, y + (hl * math.sin(mid) + ht * math.cos(mid)) * dt
        vl, vt, yaw, r, al, at = vl + (al + r * ht) * dt + d[0], vt + (at - r * hl) * dt + d[1], (yaw + r * dt + math.pi) % (2 * math.pi) - math.pi, r + d[2], al + d[3], at + d[4]
        out.append((x, y))
    return out


def test_paths_equal_a_plain_loop(spark):
    """State inputs and track inputs follow the car, others stay; two draws; a state with a null has no path."""
    states, model = _states(spark), _model(2)
    broken = states.limit(1).withColumn("frame_index", F.lit(999).cast("long")).withColumn("yaw", F.lit(None).cast("double"))
    got = {}
    for r in Q.residual_paths(states.unionByName(broken), model, KEYS, 0.4, _maps(spark), draws=2).orderBy("id", "step").collect():
        got.setdefault((r.id.frame_index, r.id.draw), []).append((r.x2, r.y2))
    assert len(got) == 80
    for s in states.collect():
        for draw in (0, 1):
            assert np.allclose(got[s.frame_index, draw], _plain(s, 1.0 if s.circuit == "A" else 1.3, model, draw, 8), atol=1e-9)


def test_noise_depends_on_keys_alone(spark):
    states, model = _states(spark), _model(3, 0.04)
    run = lambda s, d: sorted(map(tuple, Q.residual_paths(s, model, KEYS, 0.2, _maps(spark), 6, d).collect()))
    assert run(states, 1) == run(states.repartition(5), 1)
    assert run(states, 1) != run(states, 2)
    # One set of coefficients: noise of 0.2 in each target moves the second step by 0.2 times 0.05, and a little more by turns and accelerations.
    moved = Q.residual_paths(states, _model(1, 0.04), KEYS, 0.1, _maps(spark), 400, 1).where("step = 2").groupBy("id.frame_index").agg(F.stddev("x2").alias("s")).collect()
    assert len(moved) == 40 and all(0.008 < r.s < 0.015 for r in moved)



def test_mass_counts_draws(spark):
    rows = [(("A", "c", 1, k), t, side, b) for k, (t, side, b) in enumerate([(0.1, "left", 3), (0.2, "left", 3), (0.6, "right", 2), (0.9, "left", 4)])]
    exits = spark.createDataFrame(rows, "id struct<circuit:string,car_id:string,frame_index:long,draw:int>, exit_time double, exit_side string, exit_bin long")
    got = {(r.horizon, r.side, r.bin): r.mass for r in Q.exit_mass(exits, KEYS, [0.2, 1.0], 8).collect()}
    assert got == {(0.2, "left", 3): 0.25, (1.0, "left", 3): 0.25, (1.0, "right", 2): 0.125, (1.0, "left", 4): 0.125}


def _fold(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        x = rng.normal(size=6)
        d = 0.3 * x[0] - 0.1 * x[3] + rng.normal(size=5) * 0.1
        rows.append((f"C{i % 3}", f"car_{i % 12}", i, "calibration" if i % 12 == 5 else "fit", *map(float, x), *map(float, d), ["no_exit", "left", "right"][int(x[0] > 0.5) + int(x[0] > 1.2)]))
    return spark.createDataFrame(rows, "circuit string, car_id string, frame_index long, partition string, " + ", ".join(f"{c} double" for c in (*INPUTS, *D.TARGETS)) + ", label string")


def test_fold_models_see_fit_cars_only(spark):
    d = _fold(spark)
    fit = lambda rows: Q.fit_fold(rows, rows, list(INPUTS), ["v_long", "fuel"], [0.1, 10.0], 16, 3)
    models = fit(d)
    assert models.bayesian.coefficients.shape == (16, 7, 5) and models.twin.coefficients.shape == (1, 7, 5) and models.alpha in (0.1, 10.0)
    assert np.allclose(models.twin.coefficients[0], models.bayesian.coefficients.mean(0))
    spoiled = d.withColumn("d_v_long", F.when(F.col("partition") == "calibration", F.col("d_v_long") * -50).otherwise(F.col("d_v_long")))
    spoiled = spoiled.unionByName(d.where("frame_index < 100").withColumn("partition", F.lit("test")).withColumn("d_v_lat", F.lit(1e6)))
    again = fit(spoiled)
    assert np.allclose(again.bayesian.coefficients, models.bayesian.coefficients) and np.allclose(again.hazard, models.hazard)
    # The hazard's coefficients are those of unscaled inputs: at its optimum the penalised gradient on scaled ones is zero.
    rows = d.where("partition = 'fit'").toPandas()
    x = rows[["v_long", "fuel"]].to_numpy()
    q = np.percentile(x, [25, 50, 75], axis=0)
    z, scale = np.c_[np.ones(len(x)), (x - q[1]) / (q[2] - q[0])], q[2] - q[0]
    w = models.hazard.copy()
    e = np.exp(np.c_[np.zeros(len(x)), np.c_[np.ones(len(x)), x] @ w])
    p = e / e.sum(1, keepdims=True)
    grad = z.T @ (p[:, 1:] - np.stack([rows.label == "left", rows.label == "right"], 1)) / len(x)
    grad[1:] += w[1:] * scale[:, None]
    assert np.abs(grad).max() < 1e-7
    with pytest.raises(DataValidationError):
        fit(d.where("partition = 'fit'"))


def test_scores_of_methods(spark):
    """Every method scores every row; probabilities rise with the horizon; exits of the plain path decide the deterministic twin."""
    bayesian = _model(4, 0.01)
    models = Q.FoldModels(1.0, bayesian, bayesian.twin(), _model(), 1.0, np.full((3, 2), -0.5), ("v_long", "fuel"))
    methods = ["deterministic", "bayesian", "hazard"]
    maps, states = _maps(spark), _states(spark)
    placed = G.locate(states.select(F.col("frame_index").alias("id"), "circuit", "x", "y"), maps).select(F.col("id").alias("frame_index"), "in_corridor", "arclength_wrapped")
    rows = states.join(placed, "frame_index").withColumns({"input_valid_causal": F.lit(True), "hard_break": F.lit(False), "heading_error": F.lit(0.0), "offset": F.lit(0.0), "curvature": F.lit(0.0)})
    out = Q.score_fold(rows, models, maps, [0.5, 1.0], 2.5, KEYS, 8, 3, methods).cache()
    assert out.count() == 120 and out.select(*KEYS, "method").distinct().count() == 120 and Q.outcome_order(out, [0.5, 1.0]).count() == 0
    assert {(r.circuit, r.n_bins) for r in out.select("circuit", "n_bins").distinct().collect()} == {("A", 24), ("B", 32)}
    got = {(r.method, r.frame_index): r for r in out.collect()}
    inside = lambda x, y, s: max(abs(x), abs(y)) <= 10 * s + 1e-7 and max(abs(x), abs(y)) >= 5 * s - 1e-7
    left = 0
    for s in states.collect():
        size = 1.0 if s.circuit == "A" else 1.3
        path = [(s.x, s.y), *_plain(s, size, models.twin, 0, 20)]
        held = [inside(*p, size) for p in path]
        gone = any(held[i] and not held[i + 1] for i in range(20))
        # A step may also cut a corner of the hole and come back: such an exit the ends of the steps don't show.
        assert got["deterministic", s.frame_index].raw_exit_probability_1p00s >= gone
        left += gone
    assert 0 < left < 40
    assert {round(r.raw_exit_probability_1p00s * 8, 9) % 1 for k, r in got.items() if k[0] == "bayesian"} == {0.0}
    with pytest.raises(DataValidationError):
        Q.score_fold(rows, models, maps, [1.0], 2.5, KEYS, methods=["guess"])
    with pytest.raises(PySparkException):
        Q.score_fold(rows, models, maps.where("circuit = 'A'"), [1.0], 2.5, KEYS, methods=["constant_turn"]).collect()
