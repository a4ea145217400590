"""Causal support, features, training pairs, circular bins, splits by group, keyed joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.operators.quantiles import exact_quantiles
from apexframe.operators.timebase import UNIT, by_unit
from apexframe.scratch import stored

SEGMENT = [*UNIT, "continuous_segment_id"]


def horizon_column(prefix: str, horizon: float) -> str:
    """``outcome_evaluable`` and 0.25 give ``outcome_evaluable_0p25s``."""
    return f"{prefix}_{horizon:.2f}s".replace(".", "p")


def support_flags(frames: DataFrame, horizons: list[float]) -> DataFrame:
    """Input validity of each row, and for each horizon whether the segment lasts that long."""
    left = F.max("time_seconds").over(Window.partitionBy(*SEGMENT)) - F.col("time_seconds")
    valid = F.col("active") & (F.col("pit_status") == 0) & ~F.col("hard_break")
    return frames.select(*SEGMENT, "frame_index", valid.alias("input_valid_causal"), *((left + 1e-12 >= h).alias(horizon_column("outcome_evaluable", h)) for h in horizons))


def wrap_angle(a: Column) -> Column:
    """To [-pi, pi), by floored modulo."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def causal_features(frames: DataFrame) -> DataFrame:
    """Features of the present and the past from map yaw, velocity (vx, vy) and the track's heading.

    Yaw in [-pi, pi); its rate against the row before, 0 at a segment's first row and at any hard break; the velocity turned into the
    body's frame (along, and to the left); the heading error. Time that doesn't rise inside a segment is an error.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("frame_index")
    d = frames.withColumn("yaw", wrap_angle(F.col("yaw")))
    dt = F.col("time_seconds") - F.lag("time_seconds").over(w)
    rate = F.when(F.col("dt").isNull() | F.col("hard_break"), 0.0).when(F.col("dt") > 0, wrap_angle(F.col("yaw") - F.col("before")) / F.col("dt")).otherwise(F.raise_error(F.lit("time must rise inside a segment")).cast("double"))
    d = d.withColumns({"dt": dt, "before": F.lag("yaw").over(w)})
    along = F.col("vx") * F.cos("yaw") + F.col("vy") * F.sin("yaw")
    left = F.col("vy") * F.cos("yaw") - F.col("vx") * F.sin("yaw")
    return d.select(*SEGMENT, "frame_index", "yaw", rate.alias("yaw_rate"), along.alias("v_long"), left.alias("v_lat"), wrap_angle(F.col("yaw") - F.col("track_heading")).alias("heading_error"))


def robust_scaler(rows: DataFrame, columns: list[str], fit: Column, guard: float = 1e-12) -> DataFrame:
    """(feature, center, scale) over the rows to fit: median and interquartile range, 1 where that is too small."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")
    q = exact_quantiles(rows.where(fit).select(each).select("x.*"), ["feature"], "v", [0.25, 0.5, 0.75])
    iqr = F.col("quantiles")[2] - F.col("quantiles")[0]
    return q.select("feature", F.col("quantiles")[1].alias("center"), F.when(iqr > guard, iqr).otherwise(1.0).alias("scale"))


def robust_transform(rows: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the columns scaled: the distance from the center in scales. A column that wasn't fitted is an error."""
    known = {r["feature"]: r for r in scaler.where(F.col("feature").isin(columns)).collect()}  # one row for each column
    if lost := sorted(set(columns) - set(known)):
        raise DataValidationError(f"no scaling for {lost}")
    return rows.withColumns({c: (F.col(c) - F.lit(known[c]["center"])) / F.lit(known[c]["scale"]) for c in columns})


def residual_pairs(frames: DataFrame, value: str) -> DataFrame:
    """Consecutive valid rows of a segment inside the corridor: the value, the next one, and what persistence misses."""
    w = Window.partitionBy(*SEGMENT).orderBy("frame_index")
    usable = F.col("active") & (F.col("pit_status") == 0) & F.col("in_corridor")
    d = frames.withColumn("ok", usable)
    d = d.select(*SEGMENT, "frame_index", F.col(value).alias("x"), F.lead(value).over(w).alias("x_next"), (F.lead("time_seconds").over(w) - F.col("time_seconds")).alias("dt"), "ok", F.lead("ok").over(w).alias("ok_next"))
    d = d.where("ok and ok_next and dt > 0")
    return d.select(*SEGMENT, "frame_index", "x", "x_next", "dt", (F.col("x_next") - F.col("x")).alias("residual"))


def hazard_rows(frames: DataFrame, onsets: DataFrame) -> DataFrame:
    """Rows of a discrete-time hazard: the source row's label is the next row's onset side, else no_exit."""
    marks = onsets.where("qualified").select(*UNIT, F.col("start_frame").alias("frame_index"), F.lit(True).alias("onset"))
    d = frames.join(marks, [*UNIT, "frame_index"], "left")
    w = Window.partitionBy(*SEGMENT).orderBy("frame_index")
    valid = F.col("active") & (F.col("pit_status") == 0)
    d = d.withColumn("ok", valid).withColumn("ok_next", F.lead("ok").over(w)).withColumn("onset_next", F.coalesce(F.lead("onset").over(w), F.lit(False)))
    d = d.where("ok and in_corridor and ok_next")
    return d.select(*UNIT, "frame_index", F.when(F.col("onset_next"), F.col("local_side")).otherwise("no_exit").alias("label"))


def circular_distance(a: Column, b: Column, n: Column) -> Column:
    d = F.pmod(F.abs(a - b), n)
    return F.least(d, n - d)


def hazard_bin(arclength: Column, speed: Column, horizon: float, track: float | Column, width: float) -> Column:
    """The bin half a horizon ahead on a closed track."""
    bins = F.ceil(F.lit(track) / width)
    ahead = F.pmod(arclength + F.greatest(speed, F.lit(0.0)) * (horizon / 2), F.lit(track))
    return F.pmod(F.floor(ahead / width), bins).cast("long")


def loco_splits(units: DataFrame, fraction: float, seed: int, salt: str) -> DataFrame:
    """Leave one circuit out: each fold tests its own circuit; the others are ranked by a hash, the first go to calibration.

    ``units``: distinct (circuit, car_id). The number for calibration is the rounded (half up)
    share, at least one and not all. No group is ranked whole: units are counted in 65,536 ranges of the hash, and only those of
    the range that the cut falls into are ranked to find the last score that is taken.
    """
    folds = units.select(F.col("circuit").alias("fold_test_circuit")).distinct()
    # Folds are few (one for each circuit); each unit gets a row for each fold.
    per_unit = units.join(F.broadcast(folds.agg(F.sort_array(F.collect_set("fold_test_circuit")).alias("folds"))))
    d = per_unit.select(*UNIT, F.explode("folds").alias("fold_test_circuit"))
    score = F.sha2(F.concat(F.lit(f'["{salt}",{seed},"'), "fold_test_circuit", F.lit('","'), "circuit", F.lit('","'), "car_id", F.lit('"]')), 256)
    d = stored(d.withColumn("split_score", score).withColumn("own", F.col("circuit") == F.col("fold_test_circuit")), "splits")
    rest = d.where("not own").withColumn("range", F.conv(F.substring("split_score", 1, 4), 16, 10).cast("int"))
    counts = rest.groupBy("fold_test_circuit", "range").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("fold_test_circuit")
    counts = counts.withColumns({"n": F.sum("m").over(w), "upto": F.sum("m").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))})  # the ranges of a fold
    take = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(fraction) + 0.5)))
    cut = counts.where((F.col("upto") >= take) & (F.col("upto") - F.col("m") < take)).select("fold_test_circuit", "range", (take - F.col("upto") + F.col("m")).alias("left"))
    near = rest.join(F.broadcast(cut), ["fold_test_circuit", "range"]).withColumn("nth", F.row_number().over(w.orderBy("split_score")))
    last = near.where("nth = left").select("fold_test_circuit", F.col("split_score").alias("last"))  # one score for each fold
    part = F.when(F.col("own"), "test").when(F.col("split_score") <= F.col("last"), "calibration").otherwise("fit")
    return d.join(F.broadcast(last), "fold_test_circuit", "left").select("fold_test_circuit", *UNIT, part.alias("partition"), "split_score")
