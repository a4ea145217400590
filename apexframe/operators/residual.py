"""Residual dynamics from moments: transitions, equal weights of cars, Bayesian bootstrap, ridge choice by held-out circuits.

Spark reduces rows to moments of z = (1, inputs, targets). What reaches the driver is one
row of moments for each circuit or each draw, however many frames and cars there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.contracts import require_columns
from apexframe.operators.quantiles import exact_quantiles
from apexframe.operators.timebase import UNIT
from apexframe.scratch import stored

#: The state of a car, in this order.
STATE = ["x", "y", "v_long", "v_lat", "yaw", "yaw_rate", "a_long", "a_lat"]
#: What a residual model predicts, in this order.
TARGETS = ["d_v_long", "d_v_lat", "d_yaw_rate", "d_a_long", "d_a_lat"]


def midpoint_velocity(v_long, v_lat, rate, a_long, a_lat, dt):
    """Body velocity after ``dt`` and at its half, by the explicit midpoint rule; works on columns and on arrays alike."""
    half_long, half_lat = v_long + (a_long + rate * v_lat) * dt * 0.5, v_lat + (a_lat - rate * v_long) * dt * 0.5
    return v_long + (a_long + rate * half_lat) * dt, v_lat + (a_lat - rate * half_long) * dt, half_long, half_lat


def transition_residuals(frames: DataFrame, dt: Column, order: str = "frame_index", keys: list[str] = UNIT, breaks: str = "continuous_segment_id", also: Sequence[str] = ()) -> DataFrame:
    """What the next frame of the same segment has beyond constant acceleration and turn rate.

    ``frames`` carries the body state (v_long, v_lat, yaw_rate, a_long, a_lat); ``dt`` may use lead columns
    through :func:`step_of`. Last rows of a segment and rows with a null in either frame have no transition. Columns named in ``also`` are kept.
    """
    w = Window.partitionBy(*keys, breaks).orderBy(order)
    body = STATE[2:4] + STATE[5:]
    d = frames.withColumn("dt", dt)
    for c in body:
        d = d.withColumn(f"next_{c}", F.lead(c).over(w))
    v_long, v_lat, _, _ = midpoint_velocity(*(F.col(c) for c in body), F.col("dt"))
    expected = [v_long, v_lat, F.col("yaw_rate"), F.col("a_long"), F.col("a_lat")]
    d = d.select(*keys, order, *also, "dt", *body, *((F.col(f"next_{c}") - e).alias(t) for t, c, e in zip(TARGETS, body, expected, strict=True)))
    return d.dropna(subset=["dt", *body, *TARGETS])


#: The inputs of the residual model besides the step's length, in this order.
DESIGN = ["v_long", "v_lat", "yaw_rate", "a_long", "a_lat", "heading_error", "offset", "curvature"]


def residual_design(features: DataFrame, dt: Column, name: str = "design") -> DataFrame:
    """``features`` with the inputs of the residual model as one array: DESIGN, then the step's length.

    Features that aren't finite, and steps that aren't finite and positive, are an error.
    """
    require_columns(features, DESIGN)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    values = F.array(*(F.col(c).cast("double") for c in DESIGN), dt.cast("double"))
    good = F.forall(values, lambda v: F.coalesce(finite(v), F.lit(False))) & (dt > 0)
    return features.withColumn(name, F.when(F.coalesce(good, F.lit(False)), values).otherwise(F.raise_error(F.lit("a design needs finite features and a positive step")).cast("array<double>")))


def training_pairs(features: DataFrame) -> DataFrame:
    """(car, frame, dt, design, targets) of consecutive frames of a segment that are both valid and inside, some time apart.

    ``features`` has DESIGN, time_seconds, input_valid_causal, in_corridor and continuous_segment_id; the targets are what the next frame has
    beyond the constant-turn step.
    """
    w = Window.partitionBy(*UNIT, "continuous_segment_id").orderBy("frame_index")
    usable = F.col("input_valid_causal") & F.col("in_corridor")
    d = features.withColumns({"step": F.lead("time_seconds").over(w) - F.col("time_seconds"), "usable": usable, "next_usable": F.lead(usable).over(w)})
    pairs = transition_residuals(d, F.col("step"), also=["usable", "next_usable", *(c for c in DESIGN if c not in STATE)])
    pairs = pairs.where("usable and next_usable and dt > 0 and dt < double('Infinity')")
    return residual_design(pairs, F.col("dt")).select(*UNIT, "frame_index", "dt", "design", F.array(*TARGETS).alias("targets"))


def moments(rows: DataFrame, inputs: list[str], targets: list[str], keys: list[str] = UNIT) -> DataFrame:
    """(keys, n, moments): means of all products of z = (1, inputs, targets), upper triangle by rows."""
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in [*inputs, *targets])]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z)))).alias("moments"))


def _square(packed, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = packed
    return out + np.triu(out, 1).T


def _weighted(weight: Column, size: int) -> Column:
    return F.array(*(F.sum(weight * F.col("moments")[i]) / F.sum(weight) for i in range(size * (size + 1) // 2)))


def _exponential(*key) -> Column:
    return -F.log((F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52))


def bayesian_bootstrap(cars: DataFrame, size: int, draws: int, seed: int) -> DataFrame:
    """(draw, clusters, moments): Dirichlet(1) weights of circuits times Dirichlet(1) weights of cars, ``draws`` times.

    Weights come from hashes of (seed, draw, circuit, car), so a lost task draws them again alike. ``size`` is the
    length of z. Both sums combine before they are shuffled.
    """
    d = cars.select("circuit", "car_id", "moments", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    d = d.withColumn("g", _exponential(F.lit(seed), "draw", "circuit", "car_id"))
    d = d.groupBy("draw", "circuit").agg(F.count(F.lit(1)).alias("cars"), _weighted(F.col("g"), size).alias("moments"))
    d = d.withColumn("g", _exponential(F.lit(seed), "draw", "circuit"))
    return d.groupBy("draw").agg(F.sum("cars").alias("clusters"), _weighted(F.col("g"), size).alias("moments"))


@dataclass(frozen=True)
class ResidualModel:
    """Coefficients (draws, 1 + inputs, targets) on scaled inputs, and process covariances (draws, targets, targets)."""

    inputs: tuple[str, ...]
    center: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    covariance: np.ndarray

    def twin(self) -> ResidualModel:
        """The deterministic twin: mean coefficients and no noise."""
        mean = self.coefficients.mean(0, keepdims=True)
        return ResidualModel(self.inputs, self.center, self.scale, mean, np.zeros((1, *self.covariance.shape[1:])))


def _scaling(center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The matrix that takes (1, x) to (1, (x - center) / scale)."""
    t = np.diag(np.concatenate([[1.0], 1 / scale]))
    t[0, 1:] = -center / scale
    return t


def solve_ridge(packed, n_inputs: int, n_targets: int, clusters: int, alpha: float, center: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ridge coefficients and residual covariance of one set of moments; the intercept isn't penalised."""
    s, k = _square(packed, 1 + n_inputs + n_targets), 1 + n_inputs
    t = _scaling(center, scale)
    g, m = t.T @ s[:k, :k] @ t, t.T @ s[:k, k:]
    penalty = alpha * np.eye(k)
    penalty[0, 0] = 0.0
    b = np.linalg.lstsq(clusters * g + penalty, clusters * m, rcond=None)[0]
    c = s[k:, k:] - b.T @ m - m.T @ b + b.T @ g @ b
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    return b, (vectors * np.maximum(values, 0)) @ vectors.T + 1e-9 * np.eye(n_targets)


def _linear(model: ResidualModel, beta: Callable[[int, int], Column], target: int) -> Column:
    """Target number ``target`` of the inputs at coefficients ``beta(input, target)`` on unscaled inputs, the intercept being input 0."""
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in model.inputs)]
    return reduce(lambda a, b: a + b, (beta(i, target) * x for i, x in enumerate(z)))


def predict_mean(rows: DataFrame, model: ResidualModel, targets: list[str] = TARGETS, prefix: str = "mean_") -> DataFrame:
    """``rows`` with the residual that the draws give on average, a column for each target; nulls where an input is null."""
    beta = _scaling(model.center, model.scale) @ model.coefficients.mean(0)
    return rows.withColumns({f"{prefix}{t}": _linear(model, lambda i, j: F.lit(float(beta[i, j])), k) for k, t in enumerate(targets)})


def _normal(*key) -> Column:
    """A standard normal number that depends on the key alone."""
    angle = F.pmod(F.xxhash64(F.lit("angle"), *key), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return F.sqrt(2 * _exponential(F.lit("radius"), *key)) * F.cos(2 * math.pi * angle)


def _draws_of(model: ResidualModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each draw's coefficients on unscaled inputs, and a root of its covariance."""
    t, out = _scaling(model.center, model.scale), []
    for b, c in zip(model.coefficients, model.covariance, strict=True):
        values, vectors = np.linalg.eigh((c + c.T) / 2)
        out.append((t @ b, vectors * np.sqrt(np.maximum(values, 0))))
    return out


def _each_draw(rows: DataFrame, draws: int, table: DataFrame, size: int) -> DataFrame:
    """A row for each of ``rows`` and draw, with the columns of ``table`` for the model's draw (``__of``)."""
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__of", (F.col("draw") % size).cast("int")).join(F.broadcast(table), "__of")


def sample_residuals(rows: DataFrame, model: ResidualModel, keys: list[str], draws: int, seed: int, targets: list[str] = TARGETS, also: Sequence[str] = ()) -> DataFrame:
    """A row for each of ``rows`` and draw: residuals of the draw's coefficients and noise of its covariance, a column for each target.

    Draws beyond the model's begin again with its first. Numbers come from hashes of (seed, keys, draw, target), so they don't depend on how rows are
    partitioned and a lost task draws them alike. The model's draws are broadcast: a small matrix each. Columns named in ``also`` are kept.
    """
    # Plain columns and no arrays: taking out so many elements makes code too long for Java to compile, and an array of noise is made anew for each.
    of, k, p = _draws_of(model), 1 + len(model.inputs), len(targets)
    names = [f"__b_{i}_{j}" for i in range(k) for j in range(p)] + [f"__r_{i}_{j}" for i in range(p) for j in range(p)]
    table = rows.sparkSession.createDataFrame([(d, *map(float, np.r_[b.ravel(), root.ravel()])) for d, (b, root) in enumerate(of)], "__of int not null, " + ", ".join(f"{n} double not null" for n in names))
    d = _each_draw(rows, draws, table, len(of)).withColumns({f"__noise_{j}": _normal(F.lit(seed), *keys, "draw", F.lit(j)) for j in range(p)})
    noise = lambda t: reduce(lambda a, b: a + b, (F.col(f"__r_{t}_{j}") * F.col(f"__noise_{j}") for j in range(p)))
    out = {name: _linear(model, lambda i, j: F.col(f"__b_{i}_{j}"), t) + noise(t) for t, name in enumerate(targets)}
    return d.select(*keys, "draw", *(c.alias(n) for n, c in out.items()), *also)


def _quartiles(rows: DataFrame, inputs: list[str], groups: list[Column]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Median and interquartile range (1 where it is 0) of the inputs over the rows of each condition, all at once.

    Values are counted before they are dealt to conditions, so a row isn't copied for each of them.
    """
    within = F.array_compact(F.array(*(F.when(g, F.lit(i)) for i, g in enumerate(groups))))
    each = F.array(*(F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(inputs)))
    counted = rows.select(within.alias("within"), F.explode(each).alias("x")).groupBy("within", "x.j", "x.v").agg(F.count(F.lit(1)).alias("times"))
    long = counted.select(F.explode("within").alias("i"), "j", "v", "times")
    got = {(r["i"], r["j"]): r["quantiles"] for r in exact_quantiles(long, ["i", "j"], "v", [0.25, 0.5, 0.75], "times").collect()}  # one row for each condition and input
    out = []
    for i in range(len(groups)):
        q = np.array([got.get((i, j), [0.0, 0.0, 1.0]) for j in range(len(inputs))], float)
        out.append((q[:, 1], np.where(q[:, 2] > q[:, 0], q[:, 2] - q[:, 0], 1.0)))
    return out


#: What several fits of the same rows share: moments of each car, scalings of the rows by the circuit left out (None: none).
Shared = tuple[DataFrame, dict[str | None, tuple[np.ndarray, np.ndarray]]]


def shared_by_fits(rows: DataFrame, inputs: list[str], targets: list[str] = TARGETS) -> Shared:
    """The moments, written, and all scalings in one pass over the rows. Circuits are tracks on a map: their number doesn't grow with the rows."""
    per_car = stored(moments(rows, inputs, targets), "car-moments")
    left_out = [None, *sorted(r.circuit for r in per_car.select("circuit").distinct().collect() if r.circuit is not None)]
    return per_car, dict(zip(left_out, _quartiles(rows, inputs, [F.lit(True) if c is None else F.col("circuit") != c for c in left_out]), strict=True))


def fit_bayesian(rows: DataFrame, inputs: list[str], alpha: float, draws: int = 256, seed: int = 20270927, targets: list[str] = TARGETS, shared: Shared | None = None) -> ResidualModel:
    """Residual dynamics with one ridge solution for each draw of the cluster bootstrap."""
    per_car, (center, scale) = (moments(rows, inputs, targets), _quartiles(rows, inputs, [F.lit(True)])[0]) if shared is None else (shared[0], shared[1][None])
    got = bayesian_bootstrap(per_car, 1 + len(inputs) + len(targets), draws, seed).orderBy("draw").collect()  # one row a draw
    if not got:
        raise ValueError("no transitions to fit on")
    fits = [solve_ridge(r["moments"], len(inputs), len(targets), r["clusters"], alpha, center, scale) for r in got]
    return ResidualModel(tuple(inputs), center, scale, np.stack([b for b, _ in fits]), np.stack([c for _, c in fits]))


def select_ridge(rows: DataFrame, inputs: list[str], alphas: list[float], targets: list[str] = TARGETS, shared: Shared | None = None) -> DataFrame:
    """(alpha, validation_circuit, nll, mean_nll, selected): Gaussian loss on each circuit left out of the fit.

    Cars weigh alike within circuits and circuits alike in the fit; the loss is the mean over the left-out rows. The smallest mean
    loss wins, ties go to the smaller alpha. Circuits are tracks on a map: their number doesn't grow with the rows.
    """
    size, k, p = 1 + len(inputs) + len(targets), len(inputs), len(targets)
    per_car = moments(rows, inputs, targets) if shared is None else shared[0]
    found = per_car.groupBy("circuit").agg(F.count(F.lit(1)).alias("cars"), _weighted(F.lit(1.0), size).alias("equal"), _weighted(F.col("n"), size).alias("by_row")).orderBy("circuit").collect()
    if len(found) < 2:
        raise ValueError("leaving one circuit out needs two")
    scalings = _quartiles(rows, inputs, [F.col("circuit") != r["circuit"] for r in found]) if shared is None else [shared[1][r["circuit"]] for r in found]
    out = []
    for held, (center, scale) in zip(found, scalings, strict=True):
        fit = [r for r in found if r is not held]
        mean, v, t = np.mean([r["equal"] for r in fit], axis=0), _square(held["by_row"], size), _scaling(center, scale)
        for alpha in alphas:
            b, cov = solve_ridge(mean, k, p, sum(r["cars"] for r in fit), alpha, center, scale)
            b = t @ b  # on unscaled inputs
            m = v[: k + 1, k + 1 :]
            r = v[k + 1 :, k + 1 :] - b.T @ m - m.T @ b + b.T @ v[: k + 1, : k + 1] @ b
            values, vectors = np.linalg.eigh(cov)
            values = np.maximum(values, max(values.max() * 1e-10, 1e-9))
            nll = 0.5 * (p * np.log(2 * np.pi) + np.log(values).sum() + np.trace((vectors / values) @ vectors.T @ r))
            out.append((float(alpha), held["circuit"], float(nll)))
    means = {a: float(np.mean([x[2] for x in out if x[0] == float(a)])) for a in alphas}
    best = min(alphas, key=lambda a: (means[a], a))
    return rows.sparkSession.createDataFrame([(a, c, x, means[a], a == float(best)) for a, c, x in out], "alpha double, validation_circuit string, nll double, mean_nll double, selected boolean")


def fit_tuned(rows: DataFrame, fit: Column, inputs: list[str], alphas: list[float], targets: list[str] = TARGETS, scaling: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[ResidualModel, float, dict[float, float]]:
    """Unweighted ridge on the rows in ``fit``, without noise, at the alpha of the least squared error on the others (ties: the smaller); that alpha; and all errors."""
    size, k, p = 1 + len(inputs) + len(targets), len(inputs), len(targets)
    d = rows.withColumn("in_fit", F.coalesce(fit, F.lit(False)))
    got = {r["in_fit"]: r for r in moments(d, inputs, targets, ["in_fit"]).collect()}
    if len(got) < 2:
        raise ValueError("tuning needs rows to fit on and rows to validate on")
    center, scale = _quartiles(d, inputs, [F.col("in_fit")])[0] if scaling is None else scaling
    v, t, mse, fits = _square(got[False]["moments"], size), _scaling(center, scale), {}, {}
    for alpha in alphas:
        fits[alpha] = solve_ridge(got[True]["moments"], k, p, got[True]["n"], alpha, center, scale)[0]
        b = t @ fits[alpha]
        m = v[: k + 1, k + 1 :]
        mse[alpha] = float(np.trace(v[k + 1 :, k + 1 :] - b.T @ m - m.T @ b + b.T @ v[: k + 1, : k + 1] @ b) / p)
    best = min(alphas, key=lambda a: (mse[a], a))
    return ResidualModel(tuple(inputs), center, scale, fits[best][None], np.zeros((1, p, p))), float(best), mse


def tune_ridge(rows: DataFrame, fit: Column, inputs: list[str], alphas: list[float], targets: list[str] = TARGETS) -> DataFrame:
    """(alpha, mse, selected) of :func:`fit_tuned`."""
    _, best, mse = fit_tuned(rows, fit, inputs, alphas, targets)
    return rows.sparkSession.createDataFrame([(float(a), e, a == best) for a, e in mse.items()], "alpha double, mse double, selected boolean")
