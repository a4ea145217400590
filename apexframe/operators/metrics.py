"""Probability metrics by grouping sets, reliability bins, average precision, calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.operators.calibration import logistic_fits

#: Bounds of a calibration line's slope.
LINE_SLOPES = (-50.0, 50.0)


def bin_of(p: Column, n: int) -> Column:
    """The last bin includes 1."""
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("int")


def probability_metrics(rows: DataFrame, group: str, reference: float) -> DataFrame:
    """Brier, reference Brier, skill and log score, by group and pooled in one pass (``pooled`` tells which)."""
    p = F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12))
    m = rows.rollup(group).agg(
        F.grouping(group).alias("pooled"), F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        F.avg(F.pow(F.lit(reference) - F.col("y"), 2)).alias("ref"), F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("log_score"),
    )
    return m.select(group, F.col("pooled").cast("int").alias("pooled"), "n", "brier", F.col("ref").alias("reference_brier"), F.when(F.col("ref") > 0, 1 - F.col("brier") / F.col("ref")).alias("skill"), "log_score")


def reliability_bins(rows: DataFrame, group: str, n_bins: int = 10) -> DataFrame:
    """Dense (group, bin) table: count, mean probability, event frequency; empty bins stay, with nulls."""
    sums = rows.groupBy(group, bin_of(F.col("p"), n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    grid = rows.select(group).distinct().select(group, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return grid.join(sums, [group, "bin"], "left").select(group, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.col("mp").alias("mean_probability"), F.col("my").alias("event_frequency"))


def expected_calibration_error(rows: DataFrame, group: str, n_bins: int = 10) -> DataFrame:
    b = rows.groupBy(group, bin_of(F.col("p"), n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    return b.groupBy(group).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def _precision(at: DataFrame, by: list[str], score_ranges: int) -> DataFrame:
    """(by, average_precision) from distinct scores (by, p, n, events); null without events.

    Precision needs running sums over scores: they are taken inside ranges of the score, on top of the totals of the ranges above, so
    no window holds a group whole.
    """
    hits = at.select(*by, "p", "n", "events", bin_of(F.col("p"), score_ranges).alias("range"))
    totals = hits.groupBy(*by, "range").agg(F.sum("n").alias("n_above"), F.sum("events").alias("events_above"))
    above = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("n_above", "events_above")))
    inside = Window.partitionBy(*by, "range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("n_to", F.sum("n").over(inside)).withColumn("events_to", F.sum("events").over(inside)).alias("h")
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*by, "range"]]
    hits = hits.join(totals.alias("t"), same).select(*(f"h.{c}" for c in by), "events", ((F.col("events_above") + F.col("events_to")) / (F.col("n_above") + F.col("n_to"))).alias("precision"))
    return hits.groupBy(*by).agg(F.try_divide(F.sum(F.col("events") * F.col("precision")), F.sum("events")).alias("average_precision"))


def average_precision(rows: DataFrame, group: str, score_ranges: int = 1024) -> DataFrame:
    """Step average precision at distinct scores within [0, 1]; rows of a score are summed first."""
    at = rows.groupBy(group, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))
    positives = at.groupBy(group).agg(F.sum("events").cast("long").alias("positives")).alias("a")
    found = _precision(at, [group], score_ranges).alias("b")
    return positives.join(found, F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}"))).select("a.*", "average_precision")


def reliability_clusters(rows: DataFrame, units: list[str], n_bins: int = 10) -> DataFrame:
    """(units, method, horizon, bin, n, probability_sum, events): dense, so that a car without evaluable rows in a bin has zeros there.

    ``rows`` are those of :func:`apexframe.operators.calibration.horizon_rows`; every car, method and horizon among them has all bins.
    """
    keys = [*units, "method", "horizon"]
    sums = rows.where("evaluable").groupBy(*keys, bin_of(F.col("p"), n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("probability_sum"), F.sum("y").alias("events"))
    grid = rows.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return grid.join(sums, [*keys, "bin"], "left").select(*keys, "bin", zero("n").alias("n"), zero("probability_sum").alias("probability_sum"), zero("events").cast("long").alias("events"))


def evaluate(rows: DataFrame, keys: list[str], unit: str, n_bins: int = 10, score_ranges: int = 1024, lines: bool = False) -> DataFrame:
    """Held-out evaluation for each of ``keys`` (such as method and horizon), by ``unit`` and pooled.

    ``rows`` are actionable: p, y, reference (the rate known beforehand) and evaluable. Rows that aren't evaluable count only as
    unresolved. Returns scope (unit or pooled), the unit (null when pooled), n, unresolved, events, brier, reference_brier, skill (null
    without reference error), log_score, ece, average_precision (null without events); scopes with no evaluable row are left out. With ``lines`` also the
    calibration_intercept and calibration_slope of every scope, all fitted at once (null where only one class occurs).

    Rows shrink to distinct scores first, and everything follows from those.
    """
    ok, q = F.col("evaluable"), F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12))
    square = lambda c: F.sum(F.when(ok, F.pow(F.col(c) - F.col("y"), 2)))
    at = rows.groupBy(*keys, unit, "p").agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("unresolved"), F.sum(F.when(ok, F.col("y"))).alias("events"), square("p").alias("brier"), square("reference").alias("reference_brier"),
        F.sum(F.when(ok, -(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q)))).alias("log_score"),
    )
    sums = ["n", "unresolved", "events", "brier", "reference_brier", "log_score"]
    both = F.array(F.struct(F.lit("unit").alias("scope"), F.col(unit).alias("of")), F.struct(F.lit("pooled").alias("scope"), F.lit(None).cast(at.schema[unit].dataType).alias("of")))
    at = at.select(*keys, F.explode(both).alias("s"), "p", *sums).select(*keys, "s.scope", F.col("s.of").alias(unit), "p", *sums)
    by = [*keys, "scope", unit]
    at = at.groupBy(*by, "p").agg(*(F.sum(c).alias(c) for c in sums))

    bins = at.groupBy(*by, bin_of(F.col("p"), n_bins).alias("bin")).agg(*(F.sum(c).alias(c) for c in sums), F.sum(F.col("n") * F.col("p")).alias("expected"))
    gap = F.coalesce(F.abs(F.col("expected") - F.col("events")), F.lit(0.0))
    out = bins.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), F.sum(gap).alias("gap")).where("n > 0")

    ap = _precision(at.where("n > 0"), by, score_ranges).alias("a")

    out = out.alias("o").join(ap, [F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}")) for c in by])
    n = F.col("n")
    result = out.select(
        *(f"o.{c}" for c in by), "n", "unresolved", F.col("events").cast("long").alias("events"), (F.col("brier") / n).alias("brier"), (F.col("reference_brier") / n).alias("reference_brier"),
        F.when(F.col("reference_brier") > 0, 1 - F.col("brier") / F.col("reference_brier")).alias("skill"), (F.col("log_score") / n).alias("log_score"), (F.col("gap") / n).alias("ece"), "average_precision",
    )
    if not lines:
        return result
    fits = logistic_fits(at.where("n > 0").select(*by, "p", "n", "events"), by, slopes=LINE_SLOPES, one_class="null").alias("l")
    joined = result.alias("r").join(fits, [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by])
    return joined.select("r.*", F.col("l.intercept").alias("calibration_intercept"), F.col("l.slope").alias("calibration_slope"))


def monotonicity(rows: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Rows and adjacent pairs whose probability falls as the horizon grows, by group and pooled."""
    falls = [(F.col(b) < F.col(a) - 1e-12).cast("long") for a, b in zip(columns, columns[1:], strict=False)]
    pairs = sum(falls[1:], falls[0])
    m = rows.withColumn("falls", pairs).rollup(group).agg(F.grouping(group).cast("int").alias("pooled"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("falls") > 0).alias("bad_rows"), F.sum("falls").alias("bad_pairs"))
    return m


def reference_prevalence(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("events"), F.avg("y").alias("prevalence"))


def platt(p: Column, slope: float, intercept: float, clip: float = 1e-9) -> Column:
    """Monotone Platt scaling with fixed coefficients; a raw 0 stays 0."""
    c = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    out = 1 / (1 + F.exp(-(slope * F.log(c / (1 - c)) + intercept)))
    return F.when(p > 0, F.least(F.greatest(out, F.lit(clip)), F.lit(1 - clip))).otherwise(0.0)


def _points(rows: DataFrame) -> DataFrame:
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))


def fit_platt(rows: DataFrame) -> tuple[float, float]:
    """(slope, intercept) of one monotone fit over all rows; see :func:`logistic_fits`."""
    fit = logistic_fits(_points(rows), []).first()
    return fit["slope"], fit["intercept"]


def calibration_line(rows: DataFrame) -> tuple[float, float]:
    """(intercept, slope) of the logistic line through logit(p), the slope within [-50, 50]; NaN where only one class occurs."""
    fit = logistic_fits(_points(rows), [], slopes=LINE_SLOPES, one_class="null").first()
    return (math.nan, math.nan) if fit["slope"] is None else (fit["intercept"], fit["slope"])
