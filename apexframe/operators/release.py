"""From forecasts to released scores, and the checks that ledgers and threshold grids must pass before they are pooled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.contracts import forbid_future_columns
from apexframe.operators.features import hazard_bin, horizon_column
from apexframe.operators.policy import neighborhood_candidates
from apexframe.operators.quantiles import exact_quantiles
from apexframe.operators.timebase import UNIT


def hazard_mass(rows: DataFrame, keys: list[str], arclength: str, speed: str, horizons: list[float], track: float | Column, width: float, scale: float = 1.0) -> DataFrame:
    """(keys, horizon, side, bin, mass): each side's whole mass at the bin reached half a horizon ahead.

    ``rows`` are those of :func:`apexframe.operators.hazard.horizon_probabilities`; ``scale`` turns a horizon into the speed's unit of time.
    """
    bins = reduce(lambda other, h: F.when(F.col("horizon") == h, hazard_bin(F.col(arclength), F.col(speed), h * scale, track, width)).otherwise(other), horizons, F.lit(None).cast("long"))
    both = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"h_{s}").alias("mass")) for s in ("left", "right")))
    return rows.select(*keys, "horizon", bins.alias("bin"), F.explode(both).alias("x")).select(*keys, "horizon", "x.side", "bin", "x.mass")


def compact_forecast(mass: DataFrame, keys: DataFrame, on: list[str], horizons: list[float], primary: float, n_bins: int | Column, method: str, radius: int = 1) -> DataFrame:
    """Score keys with the exit probability at each horizon and the best neighbourhood at the primary one.

    A key without mass has probability 0 and no candidate. A column that tells the future is an error.
    """
    forbid_future_columns(keys)
    row = F.struct(*on)
    totals = mass.groupBy(*on).agg(*(F.sum(F.when(F.col("horizon") == h, F.col("mass"))).alias(horizon_column("raw_exit_probability", h)) for h in horizons))
    best = neighborhood_candidates(mass.where(F.col("horizon") == primary).select(row.alias("row"), "side", "bin", "mass", F.lit(n_bins).cast("long").alias("n_bins")), radius)
    best = best.select("row.*", F.col("score").alias("raw_primary_neighborhood_probability"), F.col("side").alias("predicted_side"), F.col("bin").alias("predicted_bin"))
    zero = {horizon_column("raw_exit_probability", h): F.coalesce(horizon_column("raw_exit_probability", h), F.lit(0.0)) for h in horizons}
    return keys.join(totals, on, "left").join(best, on, "left").withColumns(zero).withColumns({"method": F.lit(method), "n_bins": F.lit(n_bins).cast("long")})


def mass_defects(mass: DataFrame, stay: DataFrame, on: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Keys and horizons whose exits and ``h_no_exit`` don't add up to one."""
    exits = mass.groupBy(*on, "horizon").agg(F.sum("mass").alias("exits"))
    total = F.coalesce("exits", F.lit(0.0)) + F.col("h_no_exit")
    return stay.join(exits, [*on, "horizon"], "left").where(F.abs(total - 1) > tolerance).select(*on, "horizon", total.alias("total"))


def score_methods(scored: list[DataFrame]) -> DataFrame:
    """The scores of all methods, one below the other; columns go by name."""
    return reduce(lambda a, b: a.unionByName(b), scored)


def abstention_reasons(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a score by their first reason: invalid input, then a hard break, then outside."""
    reason = F.when(~F.col("input_valid_causal"), "invalid").when(F.col("hard_break"), "hard_break").when(~F.col("in_corridor"), "outside")
    d = scores.select(*keys, reason.alias("reason"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in ("invalid", "hard_break", "outside")), F.count("reason").alias("abstentions"))


def estimable(budgets: Column, exposure: Column, minimum: float = 1.0) -> Column:
    """Whether a budget allows one false alert over the exposure at least."""
    return budgets * exposure + 1e-12 >= minimum


def complete_cells(cells: DataFrame, fold: str, on: list[str], folds: int) -> DataFrame:
    """Rows of the grid cells that every fold has exactly once and that all folds can estimate (``estimable``)."""
    good = cells.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fold).alias("f"), F.bool_and("estimable").alias("all"))
    return cells.join(good.where(F.col("all") & (F.col("f") == folds) & (F.col("n") == folds)).select(*on), on, "left_semi")


def grid_completeness(cells: DataFrame, fold: str, axes: dict[str, list]) -> DataFrame:
    """One row for each fold: cells of the full grid that are missing, unknown, or repeated."""
    names = list(axes)
    size = reduce(lambda n, v: n * len(v), axes.values(), 1)
    known = reduce(lambda a, b: a & b, (F.col(c).isin(*v) for c, v in axes.items()))
    per = cells.groupBy(fold, *names).agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.coalesce(known, F.lit(False)))
    return per.groupBy(fold).agg((F.lit(size) - F.count_if("known")).alias("missing"), F.count_if(~F.col("known")).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))


def ledger_defects(ledger: DataFrame, over: list[str]) -> DataFrame:
    """One row of counts of what a car ledger must not have; ``over`` are the leads and methods that share denominators.

    Counts are negative or null, exposures aren't positive, hits exceed events, keys repeat, or events or exposure change within a car.
    """
    counts = ["events", "hits", "false_proposals", "unresolved"]
    bad = reduce(lambda a, b: a | b, (F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) != F.floor(c)) for c in counts))
    positive = F.col("exposure").isNotNull() & ~F.isnan("exposure") & (F.col("exposure") > 0) & (F.col("exposure") < float("inf"))
    per = ledger.groupBy(*UNIT, *over).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.count_if(~positive).alias("dark"), F.count_if(F.col("hits") > F.col("events")).alias("over"), F.min("events").alias("e0"), F.max("events").alias("e1"), F.min("exposure").alias("x0"), F.max("exposure").alias("x1"))
    car = per.groupBy(*UNIT).agg(*(F.sum(c).alias(c) for c in ("bad", "dark", "over")), F.count_if(F.col("n") > 1).alias("repeated"), F.count(F.lit(1)).alias("cells"), ((F.min("e0") != F.max("e1")) | (F.min("x0") != F.max("x1"))).alias("uneven"))
    most = F.max("cells").over(Window.partitionBy())  # one row a car
    zero = lambda c: F.coalesce(c, F.lit(0))
    return car.withColumn("short", F.col("cells") < most).agg(
        F.count(F.lit(1)).alias("cars"), zero(F.sum("bad")).alias("bad_counts"), zero(F.sum("dark")).alias("bad_exposure"), zero(F.sum("over")).alias("hits_above_events"), zero(F.sum("repeated")).alias("repeated_keys"),
        F.count_if("uneven").alias("uneven_denominators"), F.count_if("short").alias("incomplete_cars"),
    )


def compare_derived(expected: DataFrame, found: DataFrame, on: list[str], measures: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Each expected row that is missing or differs: the keys and the measures that differ (all, if it is missing); null equals null only."""
    j = expected.join(found.select(*on, *(F.col(m).alias(f"_{m}") for m in measures), F.lit(True).alias("_found")), on, "left")
    same = lambda m: F.col(m).eqNullSafe(F.col(f"_{m}")) | F.coalesce(F.abs(F.col(m) - F.col(f"_{m}")) <= tolerance, F.lit(False))
    wrong = F.array_compact(F.array(*(F.when(F.col("_found").isNull() | ~same(m), m) for m in measures)))
    return j.select(*on, wrong.alias("differs")).where(F.size("differs") > 0)


def closest_active(thresholds: DataFrame, proposals: DataFrame, keys: list[str]) -> DataFrame:
    """The highest threshold with any proposal, and how many it has; keys without one keep a null."""
    counts = proposals.groupBy(*keys, "threshold").agg(F.count(F.lit(1)).alias("proposals"))
    top = counts.groupBy(*keys).agg(F.max("threshold").alias("closest_threshold"), F.max_by("proposals", "threshold").alias("proposals"))
    return thresholds.select(*keys).distinct().join(top, keys, "left") if keys else top


def runtime_summary(log: DataFrame, stage: str, rows: str, seconds: str) -> DataFrame:
    """Rows, seconds and rows a second of each stage of a log."""
    d = log.groupBy(stage).agg(F.count(F.lit(1)).alias("entries"), F.sum(rows).alias("rows"), F.sum(seconds).alias("seconds"))
    return d.select(stage, "entries", "rows", "seconds", F.try_divide("rows", "seconds").alias("rows_per_second"))


def kinematic_diagnostics(frames: DataFrame, keys: list[str], velocity: list[Column], forward: list[Column], acceleration: list[Column], derived: list[Column], fastest: float = 10.0, strongest: float = 0.5) -> DataFrame:
    """How well directions and accelerations of the frames agree, a row for each key.

    Alignment: the cosine between velocity and forward axis where both are finite, the speed is above ``fastest`` and the axis isn't zero. Error: the length
    of acceleration minus derived acceleration where both are finite; their cosine where both are longer than ``strongest``. Quantiles are exact;
    a key without usable rows has counts of zero and nulls.
    """
    dot = lambda a, b: reduce(lambda x, y: x + y, (i * j for i, j in zip(a, b, strict=True)))
    norm = lambda a: F.sqrt(dot(a, a))
    finite = lambda *vectors: reduce(lambda x, y: x & y, (c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for v in vectors for c in v))
    cosine = lambda a, b: dot(a, b) / (norm(a) * norm(b))
    usable = finite(acceleration, derived)
    gap = [a - b for a, b in zip(acceleration, derived, strict=True)]
    measures = {
        "alignment": F.when(finite(velocity, forward) & (norm(velocity) > fastest) & (norm(forward) > 0), cosine(velocity, forward)),
        "error": F.when(usable, norm(gap)),
        "cosine": F.when(usable & (norm(acceleration) > strongest) & (norm(derived) > strongest), cosine(acceleration, derived)),
    }
    long = frames.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), c.alias("v")) for m, c in measures.items()))).alias("x")).select(*keys, "x.*")
    q = exact_quantiles(long, [*keys, "measure"], "v", [0.01, 0.5, 0.95])
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    found = q.groupBy(*keys).agg(
        *(of(m, F.col("n")).alias(f"{m}_count") for m in measures), of("alignment", F.col("quantiles")[1]).alias("alignment_median"), of("alignment", F.col("quantiles")[0]).alias("alignment_p01"),
        of("error", F.col("quantiles")[1]).alias("error_median"), of("error", F.col("quantiles")[2]).alias("error_p95"), of("cosine", F.col("quantiles")[1]).alias("cosine_median"),
    )
    return frames.select(*keys).distinct().join(found, keys, "left").fillna(0, [f"{m}_count" for m in measures])


def segment_bins(segments: DataFrame, width: float = 25.0) -> DataFrame:
    """(circuit, track_length, sides, n_bins, bin, low, high): the bins of each circuit's centre line; the last one ends where the lap does.

    A lap within a hundred-thousandth of a whole number of bins has no sliver as its last bin.
    """
    lap = segments.where("role = 'center'").groupBy("circuit").agg(F.sum("length").alias("track_length"), F.count(F.lit(1)).alias("sides"))
    last = F.ceil(F.col("track_length") / width) - 1
    sliver = F.abs(F.col("track_length") - last * width) <= 1e-8 + 1e-5 * F.col("track_length")
    d = lap.withColumn("n_bins", F.greatest(F.lit(1), F.when(sliver, last).otherwise(last + 1)).cast("int"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    high = F.when((F.col("bin") == F.col("n_bins") - 1) & ~sliver, F.col("track_length")).otherwise((F.col("bin") + 1) * width)
    return d.select("*", (F.col("bin") * width).alias("low"), high.alias("high"))


def travel_direction(frames: DataFrame, keys: list[str], forward: tuple[Column, Column], tangent: tuple[Column, Column], speed: Column, slowest: float = 10.0) -> DataFrame:
    """Whether cars move along the map's order of points: the median, 1st percentile and positive share of heading times tangent.

    Only finite rows faster than ``slowest`` count; a key without any has nulls. Along it: a positive median and 95 % positive.
    """
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1])
    dot = (forward[0] * tangent[0] + forward[1] * tangent[1]) / F.nullif(length(forward) * length(tangent), F.lit(0.0))
    usable = (speed > slowest) & ~F.isnan(dot) & (F.abs(dot) < float("inf"))
    d = frames.select(*keys, F.when(usable, dot).alias("dot"))
    q = exact_quantiles(d, keys, "dot", [0.01, 0.5]).select(*keys, F.col("quantiles").alias("q"))
    m = d.groupBy(*keys).agg(F.count("dot").alias("n"), F.avg((F.col("dot") > 0).cast("double")).alias("positive")).join(q, keys, "left")
    return m.select(*keys, "n", F.col("q")[1].alias("median"), F.col("q")[0].alias("p01"), "positive", ((F.col("q")[1] > 0) & (F.col("positive") >= 0.95)).alias("same_direction"))
