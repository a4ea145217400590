"""Residual models, hazard, forecasts, corridor geometry and Poisson limits against plain computations."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from apexframe.operators import forecast as C
from apexframe.operators import geometry as G
from apexframe.operators import hazard as H
from apexframe.operators import residual as D

def test_poisson_limits():
    assert H.poisson_upper(0, 0.95) == pytest.approx(-math.log(0.05), abs=1e-9)
    assert H.poisson_upper(1, 0.95) == pytest.approx(4.743864518, abs=1e-7)
    assert H.poisson_upper(10, 0.95) == pytest.approx(16.962219, abs=1e-5)
    n, mean = 100000, H.poisson_upper(100000, 0.95)
    assert (mean - n) / n**0.5 == pytest.approx(1.645, abs=0.02)


def test_rate_upper_edges(spark):
    rows = spark.createDataFrame([(0, 2.0), (0, 0.0), (None, 1.0)], "n long, e double")
    got = [r["rate_upper"] for r in H.rate_upper(rows, "n", "e").collect()]
    assert got[0] == pytest.approx(-math.log(0.05) / 2) and got[1:] == [None, None]


@pytest.fixture(scope="module")
def ring(spark):
    """A square track between half-widths 5 and 10, its centre line at 7.5."""
    parts = [G.ring_segments(spark, G.square(h), role) for h, role in ((10.0, "outer"), (5.0, "inner"), (7.5, "center"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def test_straight_exit_and_edges(spark, ring):
    # From (7.5, 0) outwards at 5: the wall at x = 10 is hit after 0.5, on the right of a centre line that runs against the clock.
    rows = spark.createDataFrame([(0, 7.5, 0.0, 5.0, 0.0, 0.0, 0.0), (1, 7.5, 0.0, 0.0, 0.0, 0.0, 0.0), (2, None, 0.0, 5.0, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0)], "id long, x double, y double, v_long double, v_lat double, yaw double, yaw_rate double")
    at = {(r.id, r.horizon): r for r in C.path_exits(rows, C.constant_paths(rows, 1.0, True), ring, [0.25, 0.5, 1.0], 2.5).collect()}
    assert at[0, 0.25].side == "none" and (at[0, 0.5].side, at[0, 0.5].bin, at[0, 1.0].exit_time) == ("right", 9, pytest.approx(0.5))  # 15 + 7.5 along the centre line
    assert at[1, 1.0].side == "none" and at[2, 1.0].side is None and at[3, 1.0].side == "none"
    assert C.path_exits(rows.limit(0), C.constant_paths(rows.limit(0), 1.0, False), ring, [0.5], 2.5).count() == 0


def test_turning_path_is_a_circle(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.5)], "id long, x double, y double, v_long double, v_lat double, yaw double, yaw_rate double")
    last = C.constant_paths(rows, 1.5, True).orderBy(F.desc("step")).first()
    assert (last.step, last.x2, last.y2) == (30, pytest.approx(4 * math.sin(0.75), abs=1e-3), pytest.approx(4 * (1 - math.cos(0.75)), abs=1e-3))


def test_exits_need_a_start_inside_and_an_uncovered_move(spark, ring):
    moves = [(0, -7.5, 0.0, 7.5, 0.0), (1, 0.0, 0.0, 7.5, 0.0), (2, 6.0, 0.0, 9.0, 0.0), (3, 7.5, -9.0, 7.5, 12.0), (4, 10.0, 0.0, 8.0, 0.0), (5, 10.0, -5.0, 10.0, 5.0), (6, 7.0, 0.0, 7.0, 0.0), (7, 5.0, -4.0, 5.0, 12.0)]
    got = {r.id: r for r in G.first_exit(spark.createDataFrame(moves, "id long, x double, y double, x2 double, y2 double"), ring).collect()}
    assert set(got) == {0, 3, 7}
    assert (got[0].fraction, got[0].hit_x, got[0].hit_y) == (pytest.approx(2.5 / 15), pytest.approx(-5), 0)
    assert got[3].fraction == pytest.approx(19 / 21)


def test_location_reference_features_and_roles(spark, ring):
    points = spark.createDataFrame([(0, 0.0, -6.0), (1, 0.0, -9.0), (2, 0.0, 0.0), (3, 7.5, -1.0), (0, 0.0, -6.0)], "id long, x double, y double")
    got = {r.id: r for r in G.locate(points, ring).collect()}
    assert [(got[i].local_side, got[i].centerline_segment, got[i].clearance, got[i].nearest_boundary) for i in range(4)] == [("left", 0, 1.0, "inner"), ("right", 0, 1.0, "outer"), ("left", 0, -5.0, "inner"), ("center", 1, 2.5, "outer")]
    assert got[0].arclength == got[0].arclength_wrapped == 7.5 and got[2].outside_depth == 5.0 and G.locate(points, ring).count() == 5
    (r,) = G.sample_segment(points.where("id = 3"), ring, F.lit(0)).collect()
    assert (r.segment, r.offset, r.heading) == (0, 6.5, 0.0) and r.curvature == pytest.approx(math.pi / 2 / 15)
    with pytest.raises(PySparkException, match="no such side"):
        G.sample_segment(points, ring, F.lit(9)).collect()
    with pytest.raises(PySparkException, match="finite"):
        G.locate(spark.createDataFrame([(0, math.nan, 0.0)], "id long, x double, y double"), ring).collect()
    assert {r.role: r.is_outer for r in G.corridor_roles(ring.where("role != 'center'")).collect()} == {"outer": True, "inner": False}
    with pytest.raises(PySparkException, match="different area"):
        G.corridor_roles(G.ring_segments(spark, G.square(3.0), "a").unionByName(G.ring_segments(spark, G.square(3.0), "b"))).collect()


def test_kinematics_turn_into_the_map(spark):
    half = math.sqrt(0.5)
    cols = "car string, k long, px double, py double, pz double, vx double, vy double, vz double, ax double, ay double, az double, qx double, qy double, qz double, qw double"
    # The vehicle turns by 90 degrees a frame about z; the map lies turned by 90 degrees too.
    rows = [("c", k, 2.0, 3.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, math.sin(k * math.pi / 4), math.cos(k * math.pi / 4)) for k in range(6)]
    got = G.map_kinematics(spark.createDataFrame(rows, cols), (1.0, 1.0, 0.0), (0.0, 0.0, half, half), ["car"], "k").orderBy("k").collect()
    assert (got[0].map_x, got[0].map_y) == (pytest.approx(2), pytest.approx(-1)) and (got[0].map_vx, got[0].map_vy) == (pytest.approx(0), pytest.approx(-1))
    assert (got[1].map_ax, got[1].map_ay) == (pytest.approx(1), pytest.approx(0)) and (got[1].forward_x, got[1].forward_y) == (pytest.approx(1), pytest.approx(0))
    assert [r.yaw for r in got] == pytest.approx([(k - 1) * math.pi / 2 for k in range(6)])
    with pytest.raises(PySparkException, match="unit"):
        G.map_kinematics(spark.createDataFrame([(*rows[0][:-1], 2.0)], cols), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), ["car"], "k").collect()


def test_row_identity(spark):
    row = spark.createDataFrame([("C1", 'a"b', 7)], "circuit string, car_id string, frame_index long")
    identity = row.select(C.row_identity(5, "C0", "m")).first()[0]
    assert row.select(C.row_seed(C.row_identity(5, "C0", "m"))).first()[0] == int.from_bytes(hashlib.sha256(identity.encode()).digest()[:8], "little")
    assert identity == 'row-seed-v1:{"base_seed":5,"car":"a\\"b","circuit":"C1","frame_index":7,"method":"m","outer_fold":"C0"}'


def _pairs(spark, seed=3):
    rng = np.random.default_rng(seed)
    circuits, cars = rng.integers(0, 3, 300), rng.integers(0, 4, 300)
    x = rng.normal(size=(300, 2)) * [3, 0.5] + [10, 0]
    y = x @ rng.normal(size=(2, 2)) + rng.normal(size=(300, 2)) + circuits[:, None]
    d = spark.createDataFrame([(f"C{c}", f"car{k}", *map(float, a), *map(float, b)) for c, k, a, b in zip(circuits, cars, x, y)], "circuit string, car_id string, a double, b double, s double, t double")
    return d, circuits, cars, x, y


def test_ridge_by_held_out_circuits(spark):
    d, circuits, cars, x, y = _pairs(spark)
    got = {(r["alpha"], r["validation_circuit"]): r["nll"] for r in D.select_ridge(d, ["a", "b"], [0.0, 3.0], ["s", "t"]).collect()}
    for alpha in (0.0, 3.0):
        for held in range(3):
            fit = circuits != held
            q = np.percentile(x[fit], [25, 50, 75], axis=0)
            z = np.c_[np.ones(300), (x - q[1]) / (q[2] - q[0])]
            w, clusters = np.zeros(300), 0
            for c in set(circuits[fit]):
                mine = set(cars[circuits == c])
                clusters += len(mine)
                for k in mine:
                    rows = (circuits == c) & (cars == k)
                    w[rows] = 1 / (2 * len(mine) * rows.sum())
            b = np.linalg.solve(clusters * (z.T * w) @ z + alpha * np.diag([0, 1, 1]), clusters * (z.T * w) @ y)
            r = y - z @ b
            cov = (r.T * w) @ r + 1e-9 * np.eye(2)
            v = r[~fit]
            nll = 0.5 * (2 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", v, np.linalg.inv(cov), v)).mean()
            assert got[alpha, f"C{held}"] == pytest.approx(nll, rel=1e-8)


def test_tuned_ridge_prefers_the_smaller_error(spark):
    d, *_ = _pairs(spark)
    got = D.tune_ridge(d, F.col("circuit") != "C0", ["a", "b"], [0.0, 1e6], ["s", "t"]).collect()
    assert [r["alpha"] for r in got if r["selected"]] == [min(got, key=lambda r: (r["mse"], r["alpha"]))["alpha"]]


def test_bayesian_draws_surround_the_plain_fit(spark):
    d, *_, x, y = _pairs(spark)
    model = D.fit_bayesian(d, ["a", "b"], 0.0, 64, 1, ["s", "t"])
    z = np.c_[np.ones(300), (x - model.center) / model.scale]
    plain = np.linalg.lstsq(z, y, rcond=None)[0]
    assert model.coefficients.shape == (64, 3, 2) and np.abs(model.twin().coefficients[0] - plain).max() < 0.5
    again = D.fit_bayesian(d.repartition(3), ["a", "b"], 0.0, 64, 1, ["s", "t"])
    assert np.allclose(again.coefficients, model.coefficients)


def test_hazard_has_no_gradient_left(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    labels = np.array(H.CLASSES)[np.where(x[:, 0] + rng.normal(size=400) > 1, 1, np.where(x[:, 1] + rng.normal(size=400) > 1, 2, 0))]
    d = spark.createDataFrame([(*map(float, a), str(s)) for a, s in zip(x, labels)], "a double, b double, label string")
    w = H.fit_side_hazard(d, ["a", "b"], l2=0.1)
    z = np.c_[np.ones(400), x]
    e = np.exp(np.c_[np.zeros(400), z @ w])
    p = e / e.sum(1, keepdims=True)
    gap = p[:, 1:] - np.stack([labels == "left", labels == "right"], 1)
    grad = z.T @ gap / 400
    grad[1:] += 0.1 * w[1:]
    assert np.abs(grad).max() < 1e-8
    out = H.horizon_probabilities(H.step_probabilities(d, ["a", "b"], w), {1.5: 30}).first()
    assert out["h_no_exit"] + out["h_left"] + out["h_right"] == pytest.approx(1)


def test_training_pairs_need_two_good_frames_in_a_row(spark):
    rows = [("c", "k", i, 0, float(t), ok, True, 10.0 + i, 0.5, 0.1, 0.2, 0.3, 0.0, 1.0, 0.01) for i, (t, ok) in enumerate([(0, True), (1, True), (2, False), (3, True), (3, True), (5, True)])]
    names = "circuit string, car_id string, frame_index long, continuous_segment_id long, time_seconds double, input_valid_causal boolean, in_corridor boolean, " + ", ".join(f"{c} double" for c in D.DESIGN)
    frames = spark.createDataFrame(rows, names)
    got = {r.frame_index: r for r in D.training_pairs(frames).collect()}
    assert set(got) == {0, 4} and got[0].design == [10.0, 0.5, 0.1, 0.2, 0.3, 0.0, 1.0, 0.01, 1.0] and got[4].dt == 2.0
    half_lat = 0.5 + (0.3 - 0.1 * 10.0) * 0.5
    assert got[0].targets[0] == pytest.approx(11.0 - (10.0 + (0.2 + 0.1 * half_lat))) and got[0].targets[2] == 0
    with pytest.raises(PySparkException):
        D.residual_design(frames, F.lit(0.0)).collect()
    with pytest.raises(PySparkException):
        D.residual_design(frames.withColumn("offset", F.lit(float("nan"))), F.lit(1.0)).collect()


def test_means_and_samples_of_residuals(spark):
    rng = np.random.default_rng(3)
    model = D.ResidualModel(("a", "b"), np.array([1.0, -2.0]), np.array([2.0, 0.5]), rng.normal(size=(3, 3, 2)), np.stack([np.array([[0.04, 0.01], [0.01, 0.09]])] * 3))
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(400)], "id long, a double, b double")
    x = np.array([(1.0, (r.a - 1) / 2, (r.b + 2) / 0.5) for r in rows.collect()])
    got = D.predict_mean(rows, model, ["s", "t"]).orderBy("id").toPandas()
    assert got[["mean_s", "mean_t"]].to_numpy() == pytest.approx(x @ model.coefficients.mean(0))
    sampled = D.sample_residuals(rows, model, ["id"], 6, 5, ["s", "t"])
    again = D.sample_residuals(rows.repartition(5), model, ["id"], 6, 5, ["s", "t"])
    assert sorted(map(tuple, sampled.collect())) == sorted(map(tuple, again.collect()))
    d = sampled.orderBy("draw", "id").toPandas()
    left = d[["s", "t"]].to_numpy() - np.concatenate([x @ model.coefficients[k % 3] for k in range(6)])
    assert np.cov(left.T) == pytest.approx(model.covariance[0], abs=0.012) and np.abs(left.mean(0)).max() < 0.025
    calm = D.sample_residuals(rows, model.twin(), ["id"], 1, 5, ["s", "t"]).orderBy("id").toPandas()
    assert calm[["s", "t"]].to_numpy() == pytest.approx(x @ model.coefficients.mean(0))


def test_samples_keep_columns_and_their_code_is_compiled(spark):
    rng = np.random.default_rng(4)
    roots = rng.normal(size=(3, 5, 5))
    model = D.ResidualModel(("a",), np.zeros(1), np.ones(1), rng.normal(size=(3, 2, 5)), roots @ roots.transpose(0, 2, 1))
    rows = spark.range(4).selectExpr("id", "double(id) AS a", "concat('n', id) AS name")
    out = D.sample_residuals(rows, model, ["id"], 5, 1, also=["name"])
    assert out.columns == ["id", "draw", *D.TARGETS, "name"] and out.count() == 20
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = D.sample_residuals(rows, model, ["id"], 5, 1)._jdf.queryExecution().debug().codegenToSeq()
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000  # Java interprets longer methods
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_newton_steps_read_rows_that_are_written(spark, monkeypatch):
    seen, plain = [], H.step_probabilities
    monkeypatch.setattr(H, "step_probabilities", lambda rows, *more: (seen.append(rows.inputFiles()), plain(rows, *more))[1])
    H.fit_side_hazard(spark.createDataFrame([(0.0, "left"), (1.0, "no_exit"), (2.0, "right"), (0.5, "no_exit")], "a double, label string"), ["a"], l2=0.1)
    assert len(seen) > 1 and all(seen)
