"""Logistic calibration of many groups at once, and the probabilities and distributions that it rescales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError, forbid_future_columns, join_matched, require_columns
from apexframe.operators.features import horizon_column
from apexframe.scratch import stored

#: Raw probabilities are kept this far from 0 and 1.
CLIP = 1e-9
INTERCEPTS = (-50.0, 50.0)
#: Distinct scores of a group that one part of it holds.
PART_POINTS = 1_000_000


def log_odds(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(c / (1 - c))


def _same(a: str, b: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def _within(value: Column, bounds: tuple[float, float]) -> Column:
    return F.least(F.greatest(value, F.lit(bounds[0])), F.lit(bounds[1]))


def _newton_step(state: DataFrame, slopes: tuple[float, float], tolerance: float) -> DataFrame:
    """The next (slope, intercept) of each row of sums at the present ones.

    A parameter at a bound that its gradient pushes against stays there, and the other one steps alone. Where a bound cuts the step of one, the other's
    step is solved anew for the shorter one; else it could point uphill, and be halved to nothing far from the best fit. A step that raised
    the loss goes half the way back to where it started (``base_slope``, ``base_intercept``).
    """
    a, b = F.col("slope"), F.col("intercept")
    tiny = 1e-10 * (F.col("haa") + F.col("hbb")) + 1e-300
    haa, hbb, hab = F.col("haa") + tiny, F.col("hbb") + tiny, F.col("hab")
    held = lambda v, g, bounds: ((v <= bounds[0]) & (g > 0)) | ((v >= bounds[1]) & (g < 0))
    held_a, held_b = held(a, F.col("ga"), slopes), held(b, F.col("gb"), INTERCEPTS)
    det = haa * hbb - hab * hab
    da = F.when(held_a, 0.0).when(held_b, F.col("ga") / haa).otherwise((hbb * F.col("ga") - hab * F.col("gb")) / det)
    db = F.when(held_b, 0.0).when(held_a, F.col("gb") / hbb).otherwise((haa * F.col("gb") - hab * F.col("ga")) / det)
    a_in, b_in = _within(a - da, slopes), _within(b - db, INTERCEPTS)
    cut_a, cut_b = ~held_a & (a_in != a - da), ~held_b & (b_in != b - db)
    b_in = F.when(cut_a & ~held_b, _within(b - (F.col("gb") + hab * (a_in - a)) / hbb, INTERCEPTS)).otherwise(b_in)
    a_in = F.when(cut_b & ~cut_a & ~held_a, _within(a - (F.col("ga") + hab * (b_in - b)) / haa, slopes)).otherwise(a_in)
    fine = F.col("loss") <= F.col("base_loss") + 1e-12 * (1 + F.abs("loss"))
    free = F.when(held_a, 0.0).otherwise(F.abs("ga")) + F.when(held_b, 0.0).otherwise(F.abs("gb"))  # what is left of the gradient
    d = state.withColumn("fine", fine).withColumns({"a1": F.when(fine, a_in).otherwise((a + F.col("base_slope")) / 2), "b1": F.when(fine, b_in).otherwise((b + F.col("base_intercept")) / 2)})
    near = F.abs(F.col("a1") - F.when(F.col("fine"), a).otherwise(F.col("base_slope"))) + F.abs(F.col("b1") - F.when(F.col("fine"), b).otherwise(F.col("base_intercept")))
    return d.withColumns(
        {
            "converged": (near <= tolerance * (1 + F.abs("a1") + F.abs("b1"))) | (F.col("fine") & (free <= 1e-12 * F.col("n"))), "base_slope": F.when(F.col("fine"), a).otherwise(F.col("base_slope")), "base_intercept": F.when(F.col("fine"), b).otherwise(F.col("base_intercept")),
            "base_loss": F.when(F.col("fine"), F.col("loss")).otherwise(F.col("base_loss")), "slope": F.col("a1"), "intercept": F.col("b1"), "steps": F.col("steps") + 1,
        }
    )


def logistic_fits(points: DataFrame, keys: list[str], slopes: tuple[float, float] = (0.0, 50.0), one_class: str = "prior", most_steps: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(keys, n, events, slope, intercept, steps, converged): the logistic fit on the log-odds of ``p`` for every group.

    ``points`` has the keys, p, n (rows there) and events (ones among them). Slopes stay within ``slopes``, intercepts within +-50. A group of one class has no
    fit: by ``prior`` its slope is 0 and its intercept the log-odds of (events + 1/2) / (n + 1), by ``null`` it has nulls. Null keys are keys.

    All groups step together: a step is one combined aggregate over the points of the groups that still move, joined with the groups' present
    parameters; groups that have converged are out of it. Points are distinct log-odds, and a group of very many meets its parameters in parts.
    """
    x = points.select(*keys, log_odds(F.col("p")).alias("x"), F.col("n").cast("double").alias("n"), F.col("events").cast("double").alias("k"))
    x = stored(x.groupBy(*keys, "x").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "scores")
    sizes = x.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("events"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PART_POINTS)).cast("int").alias("parts"))
    rate = (F.col("events") + 0.5) / (F.col("n") + 1)
    single = (F.col("events") <= 0) | (F.col("events") >= F.col("n"))
    prior = F.log(rate / (1 - rate))
    if one_class == "null":
        alone = {"slope": F.when(~single, 1.0), "intercept": F.when(~single, prior)}
    else:
        alone = {"slope": F.when(single, 0.0).otherwise(1.0), "intercept": prior}
    begun = sizes.withColumns(alone | {"base_slope": F.lit(1.0), "base_intercept": prior, "base_loss": F.lit(float("inf")), "steps": F.lit(0), "converged": single})
    state = stored(begun, "fits")
    names = state.columns
    parts = sizes.where("parts > 1").select(*keys, "parts")
    if parts.take(1):
        cut = x.alias("x").join(parts.alias("s"), _same("x", "s", keys), "left").select("x.*", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
        x = stored(cut, "scores")
    else:
        x = x.withColumn("part", F.lit(0))
    done = [state.where("converged")]
    for _ in range(most_steps):
        moving = state.where("not converged")
        if not moving.take(1):
            break
        spread = moving.select(*keys, "slope", "intercept", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        at = x.alias("x").join(spread.alias("s"), [*_same("x", "s", keys), F.col("x.part") == F.col("s.part")]).withColumn("z", F.col("slope") * F.col("x.x") + F.col("intercept"))
        p = 1 / (1 + F.exp(-F.col("z")))
        at = at.select(*(F.col(f"x.{k}") for k in keys), F.col("x.x").alias("x"), F.col("x.n").alias("n"), F.col("x.k").alias("k"), "z", p.alias("q")).withColumns({"r": F.col("n") * F.col("q") - F.col("k"), "w": F.col("n") * F.col("q") * (1 - F.col("q"))})
        loss = F.col("n") * (F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))) - F.col("k") * F.col("z")
        sums = at.groupBy(*keys).agg(
            F.sum(loss).alias("loss"), F.sum(F.col("r") * F.col("x")).alias("ga"), F.sum("r").alias("gb"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("haa"), F.sum(F.col("w") * F.col("x")).alias("hab"), F.sum("w").alias("hbb"),
        )
        joined = moving.alias("m").join(sums.alias("g"), _same("m", "g", keys) or F.lit(True)).select("m.*", "loss", "ga", "gb", "haa", "hab", "hbb")
        state = stored(_newton_step(joined, slopes, tolerance).select(*names), "fits")
        done.append(state.where("converged"))
    done.append(state.where("not converged"))
    return reduce(DataFrame.unionByName, done).select(*keys, F.col("n").cast("long").alias("n"), F.col("events").cast("long").alias("events"), "slope", "intercept", "steps", "converged")


def require_probabilities(rows: DataFrame, p: str = "p", y: str = "y") -> None:
    """Raises DataValidationError unless every ``p`` is within [0, 1] and every ``y`` is 0 or 1; one aggregate."""
    ok = F.coalesce((F.col(p) >= 0) & (F.col(p) <= 1), F.lit(False))
    binary = F.coalesce(F.col(y).cast("double").isin(0.0, 1.0), F.lit(False))
    bad = rows.agg(F.count_if(~ok).alias("probabilities outside [0, 1]"), F.count_if(~binary).alias("labels that aren't binary")).first().asDict()
    if any(bad.values()):
        raise DataValidationError(f"{ {k: v for k, v in bad.items() if v} }")


def horizon_rows(scores: DataFrame, targets: DataFrame, on: list[str], horizons: list[float], prefix: str = "raw_exit_probability") -> DataFrame:
    """A row for each score row and horizon: the columns of ``scores`` but its probabilities, with horizon, p, y, actionable and evaluable.

    Every score row must have exactly one target, which several methods may share. y: the next event comes within the horizon.
    Actionable rows are valid and inside; evaluable ones are so and their outcome is known at the horizon.
    """
    known = [horizon_column("outcome_evaluable", h) for h in horizons]
    require_columns(scores, [*on, "method", "input_valid_causal", "in_corridor", *(horizon_column(prefix, h) for h in horizons)])
    joined = join_matched(scores, targets.select(*on, "next_event_id", "time_to_next", *known), on, many=True)
    soon = lambda h: F.col("next_event_id").isNotNull() & ~F.isnan("time_to_next") & (F.col("time_to_next") >= -1e-12) & (F.col("time_to_next") <= h + 1e-12)
    each = F.array(*(F.struct(F.lit(float(h)).alias("horizon"), F.col(horizon_column(prefix, h)).alias("p"), F.coalesce(soon(h), F.lit(False)).cast("double").alias("y"), F.col(k).alias("known")) for h, k in zip(horizons, known, strict=True)))
    kept = [c for c in scores.columns if "exit_probability_" not in c]
    actionable = F.col("input_valid_causal") & F.col("in_corridor")
    return joined.select(*kept, actionable.alias("actionable"), F.explode(each).alias("e")).select(*kept, "actionable", "e.horizon", "e.p", "e.y", (F.col("actionable") & F.col("e.known")).alias("evaluable"))


def fit_horizon_calibrators(scores: DataFrame, targets: DataFrame, on: list[str], horizons: list[float]) -> DataFrame:
    """A monotone fit for each method and horizon, on evaluable rows of the calibration partition alone.

    Raises DataValidationError without such rows for any of them, for probabilities outside [0, 1], or for score rows without a target.
    """
    rows = stored(horizon_rows(scores.where("partition = 'calibration'"), targets, on, horizons).where("evaluable").select("method", "horizon", "p", "y"), "calibration")
    require_probabilities(rows)
    fits = logistic_fits(rows.groupBy("method", "horizon", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events")), ["method", "horizon"])
    wanted = scores.select("method").distinct().withColumn("horizon", F.explode(F.array(*(F.lit(float(h)) for h in horizons))))
    if lost := wanted.join(fits, ["method", "horizon"], "left_anti").take(5):
        raise DataValidationError(f"no evaluable calibration rows for {[tuple(r) for r in lost]}")
    return fits


def calibrated(p: Column, slope: Column, intercept: Column) -> Column:
    """A raw 0 stays 0; what else there is keeps clear of 0 and 1."""
    return F.when(p > 0, _within(1 / (1 + F.exp(-(slope * log_odds(p) + intercept))), (CLIP, 1 - CLIP))).otherwise(0.0)


def apply_horizon_calibrators(scores: DataFrame, calibrators: DataFrame, horizons: list[float], primary: float | None = None) -> DataFrame:
    """``scores`` with exit_probability of each horizon and proposal_score, the neighbourhood's mass rescaled at the primary (last) horizon.

    A method without a calibrator for any horizon is an error, as are columns that tell the future.
    """
    forbid_future_columns(scores)
    primary = max(horizons) if primary is None else primary
    at = lambda c, h: F.max(F.when(F.col("horizon") == h, F.col(c))).alias(horizon_column(f"_{c}", h))
    wide = calibrators.groupBy("method").agg(*(at(c, h) for h in horizons for c in ("slope", "intercept")))  # a row for each method
    joined = scores.join(wide, "method", "left")
    missing = F.concat(F.lit("no calibrator for method "), F.coalesce("method", F.lit("null")))
    new = {}
    for h in horizons:
        slope, intercept = (F.col(horizon_column(f"_{c}", h)) for c in ("slope", "intercept"))
        value = F.when(slope.isNull() | intercept.isNull(), F.raise_error(missing).cast("double")).otherwise(calibrated(F.col(horizon_column("raw_exit_probability", h)), slope, intercept))
        new[horizon_column("exit_probability", h)] = value
    out = joined.withColumns(new)
    raw, after = F.col(horizon_column("raw_exit_probability", primary)), F.col(horizon_column("exit_probability", primary))
    score = F.when(raw > 0, _within(F.col("raw_primary_neighborhood_probability") * after / raw, (0.0, 1.0))).otherwise(0.0)
    return out.withColumn("proposal_score", score).select(*scores.columns, *new, "proposal_score")


def calibrate_mass(mass: DataFrame, stay: DataFrame, calibrators: DataFrame, on: list[str], no_exit: str = "h_no_exit", tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(mass, stay) with each distribution's whole exit mass calibrated: shares among places stay as they are, and all adds up to one.

    ``mass`` is sparse, (on, method, horizon, side, bin, mass); ``stay`` has a row for every (on, method, horizon). No mass stays none. What doesn't add up to
    one is an error.
    """
    keys = [*on, "method", "horizon"]
    totals = stay.select(*keys, F.col(no_exit).alias("stay")).join(mass.groupBy(*keys).agg(F.sum("mass").alias("total"), F.min("mass").alias("least")), keys, "left")
    totals = totals.join(calibrators.select("method", "horizon", "slope", "intercept"), ["method", "horizon"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    wrong = (F.abs(F.col("stay") + F.col("total") - 1) > tolerance) | (F.col("stay") < 0) | (F.coalesce("least", F.lit(0.0)) < 0) | F.col("slope").isNull()
    after = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("a distribution that isn't one, or that has no calibrator")).cast("double")).otherwise(calibrated(F.col("total"), F.col("slope"), F.col("intercept")))
    totals = stored(totals.select(*keys, "total", after.alias("after")), "calibrated-totals")
    scaled = mass.join(totals, keys).withColumn("mass", F.when(F.col("total") > 0, F.col("mass") * F.col("after") / F.col("total")).otherwise(0.0))
    return scaled.select(*mass.columns), totals.select(*keys, (1 - F.col("after")).alias(no_exit))
