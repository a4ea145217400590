"""Forecasts by fitted residual models, rolled out in columns, and the models and scores of one fold.

States are dealt once; a task moves many of them, with all draws of a model beside each other, step by step in arrays, and hands on the moves that may touch
a boundary, so a forecast needs no further shuffle before its exits are counted. The number of draws is a parameter, not a size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError, require_columns
from apexframe.operators.features import horizon_column
from apexframe.operators.forecast import STEP, constant_paths, first_exits
from apexframe.operators.geometry import tangents
from apexframe.operators.hazard import fit_side_hazard, horizon_probabilities, step_probabilities
from apexframe.operators.release import compact_forecast, hazard_mass, score_methods
from apexframe.operators.residual import STATE, TARGETS, ResidualModel, _draws_of, _quartiles, _scaling, fit_bayesian, fit_tuned, midpoint_velocity, select_ridge, shared_by_fits
from apexframe.operators.timebase import UNIT
from apexframe.scratch import stored

#: Inputs that follow the place on the centre line during a forecast.
TRACK = ["heading_error", "offset", "curvature"]
#: Sides of all maps of a fold that are broadcast together.
MOST_SIDES = 100_000
#: Methods of a fold, by name.
METHODS = ["bayesian", "deterministic", "tuned", "constant_velocity", "constant_turn", "hazard"]


#: The numbers of XXH64, as in Spark's ``xxhash64``.
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Paths that take their steps together; their arrays stay in the processor's cache.
TOGETHER = 1 << 13


def _wrapped(angle: np.ndarray) -> np.ndarray:
    turn = np.fmod(angle + math.pi, 2 * math.pi)
    return np.where(turn < 0, np.fmod(turn + 2 * math.pi, 2 * math.pi), turn) - math.pi


def _hash_on(number, before: np.ndarray) -> np.ndarray:
    """``xxhash64`` of what gave ``before`` and an int more."""
    h = (before + _P5 + np.uint64(4)) ^ (np.asarray(number).astype(np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def _normals(angle: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Standard normal numbers of two hashes, as :func:`apexframe.operators.residual._normal` has them."""
    share = lambda h, more: ((h & np.uint64((1 << 52) - 1)).astype(float) + more) / float(1 << 52)
    return np.sqrt(2 * -np.log(share(radius, 0.5))) * np.cos(2 * math.pi * share(angle, 0.0))


def _nearest_side(sides: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The place in ``sides`` of the nearest one; ties, to nine digits, go to the lower side."""
    best, place = np.full(x.shape, np.inf), np.zeros(x.shape, np.int64)
    for i, s in enumerate(sides):
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        u = np.maximum(0.0, np.minimum(1.0, ((x - s["ax"]) * dx + (y - s["ay"]) * dy) / (s["length"] * s["length"])))
        gap = np.round(np.hypot(x - s["ax"] - u * dx, y - s["ay"] - u * dy), 9)
        nearer = gap < best
        best[nearer], place[nearer] = gap[nearer], i
    return place


def _beside(sides: np.ndarray, x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Whether a move's box may touch that of a side, as in :func:`apexframe.operators.geometry.first_exit`."""
    room = 1e-6 * (1 + np.maximum(np.maximum(np.abs(x), np.abs(y)), np.maximum(np.abs(x2), np.abs(y2))))
    low_x, high_x, low_y, high_y = np.minimum(x, x2) - 2 * room, np.maximum(x, x2) + 2 * room, np.minimum(y, y2) - 2 * room, np.maximum(y, y2) + 2 * room
    touches = np.zeros(x.shape, bool)
    for s in sides:
        apart = (high_x < min(s["ax"], s["bx"])) | (max(s["ax"], s["bx"]) < low_x) | (high_y < min(s["ay"], s["by"])) | (max(s["ay"], s["by"]) < low_y)
        touches |= ~apart
    return touches


def _sides(segments: DataFrame, roles: list[str]) -> dict[str | None, np.ndarray]:
    """The sides of these roles as arrays, for each circuit (None: the segments have none); more than MOST_SIDES are an error."""
    names = [f.name for f in segments.schema if f.name not in ("circuit", "role")]
    rows = segments.where(F.col("role").isin(roles)).select(*(["circuit"] if "circuit" in segments.columns else []), *names).orderBy("idx").limit(MOST_SIDES + 1).collect()
    if len(rows) > MOST_SIDES:
        raise DataValidationError(f"more than {MOST_SIDES} sides are too many to fold over; index the maps instead")
    kinds = np.dtype([(n, float) for n in names])
    found: dict[str | None, list[tuple]] = {}
    for r in rows:
        found.setdefault(r["circuit"] if "circuit" in r else None, []).append(tuple(r[n] for n in names))
    return {c: np.array(v, kinds) for c, v in found.items()}


def residual_paths(states: DataFrame, model: ResidualModel, keys: list[str], horizon: float, segments: DataFrame | None = None, draws: int = 1, seed: int = 0, dt: float = STEP, beside: bool = False) -> DataFrame:
    """(id, step, x, y, x2, y2) and the circuit, if the states have one: the moves of each state and draw, ``id`` being a struct of the keys and the draw.

    ``states`` has the keys, STATE and the model's inputs. A step goes by constant acceleration and turn rate, to which the model's residual at the step's
    first state is added, with noise of the draw's covariance; the noise depends on (seed, keys, draw, step) alone. With the map's ``segments`` the inputs of
    TRACK follow the nearest side of the centre line, and ``beside`` keeps only moves that may touch a boundary, without which none leaves. States with
    a null in STATE or in an input that stays are left out. Many paths take a step together, in arrays; Spark deals the states.
    """
    steps, noisy = round(horizon / dt), bool(np.abs(model.covariance).max() > 0)
    of = ["circuit"] if "circuit" in states.columns else []
    follows = segments is not None and bool(set(TRACK) & set(model.inputs))
    still = [c for c in model.inputs if c not in {*STATE, "dt", *(TRACK if follows else [])}]
    d = states.select(*dict.fromkeys([*keys, *of, *STATE, *still])).dropna(subset=[*STATE, *still])
    # Each narrow row becomes draws times steps of work, so the rows are spread first, however few files they come from.
    d = d.repartition(int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    names, moved = [f"key_{i}" for i in range(len(keys))], ["x", "y", "x2", "y2"]
    begun = [F.xxhash64(F.lit(kind), F.lit(seed), *keys).alias(f"hash_{kind}") for kind in ("angle", "radius")]
    d = d.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *(F.col(c).alias("of_circuit") for c in of), *begun, *(F.col(c).cast("double").alias(f"in_{c}") for c in dict.fromkeys([*STATE, *still])))
    passed = [*names, *(["of_circuit"] if of else [])]
    center = _sides(tangents(segments.where("role = 'center'")), ["center"]) if follows else None
    edges = _sides(segments, ["outer", "inner"]) if beside else None
    by_circuit = segments is not None and "circuit" in segments.columns
    coefficients = [_draws_of(model)[i % len(model.coefficients)] for i in range(draws)]
    beta, root = np.stack([b for b, _ in coefficients], -1), np.stack([r for _, r in coefficients], -1)  # the draw is the last axis

    def walk(s: dict[str, np.ndarray], hashes: list[np.ndarray], line: np.ndarray | None, ring: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        """(state, draw, step, x, y, x2, y2) of the moves of some states, each state a row and each draw a column."""
        hashes = [_hash_on(np.arange(draws), h[:, None]) for h in hashes]
        first, s = s, {c: np.broadcast_to(s[c][:, None], (len(s[c]), draws)) for c in s}
        for step in range(1, steps + 1):
            known = {**{c: first[c][:, None] for c in still}, **{c: s[c] for c in STATE}, "dt": dt}
            if line is not None:
                side = line[_nearest_side(line, s["x"], s["y"])]
                known |= {"heading_error": _wrapped(s["yaw"] - side["heading"]), "offset": side["tx"] * (s["y"] - side["ay"]) - side["ty"] * (s["x"] - side["ax"]), "curvature": side["curvature"]}
            z = [1.0, *(known[c] for c in model.inputs)]
            more = [sum((beta[i, t] * v for i, v in enumerate(z)), 0.0) for t in range(len(TARGETS))]
            if noisy:
                angle, radius = (_hash_on(step, h) for h in hashes)
                e = [_normals(_hash_on(k, angle), _hash_on(k, radius)) for k in range(len(TARGETS))]
                more = [m + sum((root[t, k] * v for k, v in enumerate(e)), 0.0) for t, m in enumerate(more)]
            v_long, v_lat, half_long, half_lat = midpoint_velocity(s["v_long"], s["v_lat"], s["yaw_rate"], s["a_long"], s["a_lat"], dt)
            middle = s["yaw"] + s["yaw_rate"] * (dt / 2)
            cos, sin = np.cos(middle), np.sin(middle)
            x, y, x2, y2 = s["x"], s["y"], s["x"] + (half_long * cos - half_lat * sin) * dt, s["y"] + (half_long * sin + half_lat * cos) * dt
            row, draw = np.nonzero(np.ones(x.shape, bool) if ring is None else _beside(ring, x, y, x2, y2))
            yield row, draw, np.full(len(row), step), x[row, draw], y[row, draw], x2[row, draw], y2[row, draw]
            s = {"x": x2, "y": y2, "v_long": v_long + more[0], "v_lat": v_lat + more[1], "yaw": _wrapped(s["yaw"] + s["yaw_rate"] * dt), "yaw_rate": s["yaw_rate"] + more[2], "a_long": s["a_long"] + more[3], "a_lat": s["a_lat"] + more[4]}

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            circuits = np.array(column("of_circuit").to_pylist() if by_circuit else [None] * batch.num_rows, object)
            values = {c: column(f"in_{c}").to_numpy(zero_copy_only=False) for c in dict.fromkeys([*STATE, *still])}
            hashes = [column(f"hash_{kind}").to_numpy(zero_copy_only=False).view(np.uint64) for kind in ("angle", "radius")]
            for circuit in dict.fromkeys(circuits.tolist()):
                if any(sides is not None and circuit not in sides for sides in (center, edges)):
                    raise DataValidationError("a circuit has no map")
                line, ring = (None if sides is None else sides[circuit] for sides in (center, edges))
                own, size = np.flatnonzero([c == circuit for c in circuits]), max(1, TOGETHER // draws)
                for some in (own[i : i + size] for i in range(0, len(own), size)):
                    with np.errstate(all="ignore"):  # a state may run off to infinity
                        moves = [np.concatenate(m) for m in zip(*walk({c: v[some] for c, v in values.items()}, [h[some] for h in hashes], line, ring), strict=True)]
                    at = pa.array(some[moves[0]])
                    yield pa.RecordBatch.from_arrays([*(column(c).take(at) for c in passed), *(pa.array(m.astype(np.int32)) for m in moves[1:3]), *(pa.array(m) for m in moves[3:])], [*passed, "draw", "step", *moved])

    kinds = [f"{c} {d.schema[c].dataType.simpleString()}" for c in passed] + ["draw int", "step int", *(f"{c} double" for c in moved)]
    d = d.mapInArrow(roll, ", ".join(kinds))
    return d.select(F.struct(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "draw").alias("id"), *(F.col("of_circuit").alias(c) for c in of), "step", *moved)


def exit_mass(exits: DataFrame, keys: list[str], horizons: list[float], draws: int = 1) -> DataFrame:
    """(keys, horizon, side, bin, mass): the share of a row's draws that have left by a horizon, at each side and bin; ``exits`` are those of ``first_exits``."""
    d = exits.select(*(F.col(f"id.{k}").alias(k) for k in keys), F.col("exit_side").alias("side"), F.col("exit_bin").cast("long").alias("bin"), "exit_time", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    return d.where(F.col("exit_time") <= F.col("horizon") + 1e-12).groupBy(*keys, "horizon", "side", "bin").agg((F.count(F.lit(1)) / F.lit(float(draws))).alias("mass"))


@dataclass(frozen=True)
class FoldModels:
    """What the fit cars of a fold give: ridge by left-out circuits, its Bayesian draws and their twin, the ridge tuned on calibration cars, the side hazard."""

    alpha: float
    bayesian: ResidualModel
    twin: ResidualModel
    tuned: ResidualModel
    tuned_alpha: float
    hazard: np.ndarray
    hazard_inputs: tuple[str, ...]


def fit_fold(transitions: DataFrame, hazard_rows: DataFrame, inputs: list[str], hazard_inputs: list[str], alphas: list[float], draws: int = 256, seed: int = 20270927, l2: float = 1.0) -> FoldModels:
    """Fits a fold's models; both tables carry the cars' ``partition``.

    Only cars of the partition ``fit`` are fitted on; those of ``calibration`` choose the tuned ridge. The hazard is fitted on inputs scaled by
    the fit rows' medians and quartiles; its coefficients are those of unscaled inputs. A partition without rows is an error.
    """
    for d in (transitions, hazard_rows):
        require_columns(d, ["partition"])
    there = {r.partition for r in transitions.where("partition in ('fit', 'calibration')").select("partition").distinct().collect()}  # two values
    if there != {"fit", "calibration"}:
        raise DataValidationError(f"a fold needs fit and calibration rows, not only {sorted(there)}")
    fit = transitions.where("partition = 'fit'")
    shared = shared_by_fits(fit, inputs)
    alpha = next(r.alpha for r in select_ridge(fit, inputs, alphas, shared=shared).where("selected").collect())  # the same alpha for each circuit
    bayesian = fit_bayesian(fit, inputs, alpha, draws, seed, shared=shared)
    tuned, tuned_alpha, _ = fit_tuned(transitions.where("partition in ('fit', 'calibration')"), F.col("partition") == "fit", inputs, alphas, scaling=shared[1][None])
    rows = hazard_rows.where("partition = 'fit'").dropna(subset=hazard_inputs)
    center, scale = _quartiles(rows, hazard_inputs, [F.lit(True)])[0]
    scaled = rows.select("label", *((F.col(c) - float(m)) / float(s) for c, m, s in zip(hazard_inputs, center, scale, strict=True))).toDF("label", *hazard_inputs)
    hazard = _scaling(center, scale) @ fit_side_hazard(scaled, hazard_inputs, l2=l2)
    return FoldModels(alpha, bayesian, bayesian.twin(), tuned, tuned_alpha, hazard, tuple(hazard_inputs))


def score_fold(rows: DataFrame, models: FoldModels, segments: DataFrame, horizons: list[float], segment: float, keys: list[str], draws: int = 256, seed: int = 20270927, methods: list[str] = METHODS, dt: float = STEP) -> DataFrame:
    """The scores of each method: exit probabilities at every horizon, and the best neighbourhood at the longest.

    ``rows`` has the keys (the circuit among them), the flags of a score, STATE, the inputs of the models, and ``arclength_wrapped``; ``segments`` the rings of
    every circuit. Every row gets a score of every method; one whose state has a null leaves nowhere. A method without a name here, a circuit
    without a map, and maps of more than MOST_SIDES sides in all are errors.
    """
    if unknown := sorted(set(methods) - set(METHODS)):
        raise DataValidationError(f"no such methods: {unknown}")
    maps = segments.groupBy("circuit").agg(F.count(F.lit(1)).alias("sides"), F.sum(F.when(F.col("role") == "center", F.col("length"))).alias("lap")).collect()  # one row a circuit
    if (sides := sum(r.sides for r in maps)) > MOST_SIDES:
        raise DataValidationError(f"{sides} sides are too many to fold over; index the maps instead")
    lap = F.create_map(*(F.lit(v) for r in maps for v in (r.circuit, float(r.lap))))[F.col("circuit")]
    n_bins = F.ceil(lap / segment)
    steps = {h: round(h / dt) for h in horizons}
    states = rows.withColumn("id", F.struct(*keys, F.lit(0).alias("draw")))

    def mass(method: str) -> DataFrame:
        if method == "hazard":
            inputs = list(models.hazard_inputs)
            step = step_probabilities(rows.select(*dict.fromkeys([*keys, *inputs, "arclength_wrapped", "v_long"])).dropna(subset=[*inputs, "arclength_wrapped", "v_long"]), inputs, models.hazard)
            return hazard_mass(horizon_probabilities(step, steps), keys, "arclength_wrapped", "v_long", horizons, lap, segment)
        if method.startswith("constant"):
            paths = constant_paths(states, max(horizons), method == "constant_turn", dt).withColumn("circuit", F.col("id.circuit"))
            return exit_mass(first_exits(paths, segments, segment, dt), keys, horizons)
        model = {"bayesian": models.bayesian, "deterministic": models.twin, "tuned": models.tuned}[method]
        n = draws if method == "bayesian" else 1
        return exit_mass(first_exits(residual_paths(rows, model, keys, max(horizons), segments, n, seed, dt, beside=True), segments, segment, dt), keys, horizons, n)

    flags = rows.select(*keys, "input_valid_causal", "in_corridor", "hard_break")
    # The mass is read for the probabilities and again for the neighbourhoods: written, no path is rolled out twice.
    return score_methods([compact_forecast(stored(mass(m), f"mass-{m}"), flags, keys, horizons, max(horizons), n_bins, m) for m in methods])


def outcome_order(scores: DataFrame, horizons: list[float]) -> DataFrame:
    """Scores whose exit probability falls from a horizon to a longer one, or isn't a probability; none are expected."""
    p = [F.col(horizon_column("raw_exit_probability", h)) for h in sorted(horizons)]
    falls = reduce(lambda a, b: a | b, (b < a - 1e-9 for a, b in zip(p, p[1:], strict=False)), F.lit(False))
    beyond = reduce(lambda a, b: a | b, ((c < -1e-9) | (c > 1 + 1e-9) | c.isNull() for c in p))
    return scores.where(falls | beyond).select(*UNIT, "method")
