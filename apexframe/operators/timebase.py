"""Clocks and grids: breaks and segments, cadence, causal resampling, flags mapped forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = ["circuit", "car_id"]


def by_unit(*order: str) -> Window:
    return Window.partitionBy(*UNIT).orderBy(*(order or ("frame_index",)))


def running(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ahead(value: Column | str, keys: list[str], *order: str, strictly: bool = False) -> Column:
    """The first non-null value at or after each row (after it, if ``strictly``) in the order given.

    A running window over the reverse order, which takes a row once; a frame that reaches to the last row is taken anew for every row.
    """
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1 if strictly else Window.currentRow)
    return F.last(value, ignorenulls=True).over(w)


def segment_ids(frames: DataFrame) -> DataFrame:
    """``continuous_segment_id``: running count of hard breaks, from 0; the first row always breaks."""
    return frames.withColumn("continuous_segment_id", F.sum(F.col("hard_break").cast("long")).over(running(by_unit())) - 1)


def reconstruct_axis(rows: DataFrame, cadence_cap: float = 0.05, gap_floor: float = 0.05, reset_tolerance: float = 0.05, jump: float = 5.0, distance_reset: float = -5.0) -> DataFrame:
    """Continuous time of each car from its lap clock.

    Needs current_lap_time, lap_number, last_lap_time, total_distance, result_status, x, y, z.
    The cadence is the median of same-lap steps strictly inside (0, cap); a gap is a step
    over max(floor, 5 * cadence), or one that isn't finite. A break still advances time by one cadence.
    """
    w = by_unit()
    prev = lambda c: F.lag(c).over(w)
    d = rows.withColumns(
        {
            "first_row": F.row_number().over(w) == 1,
            "d_lap": F.col("lap_number") - prev("lap_number"),
            "d_clock": F.col("current_lap_time") - prev("current_lap_time"),
            "d_distance": F.col("total_distance") - prev("total_distance"),
            "step": F.sqrt(F.pow(F.col("x") - prev("x"), 2) + F.pow(F.col("y") - prev("y"), 2) + F.pow(F.col("z") - prev("z"), 2)),
            "was_clock": prev("current_lap_time"),
            "d_status": (F.col("result_status") == 2) != (prev("result_status") == 2),
        }
    )
    usable = (F.col("d_lap") == 0) & (F.col("d_clock") > 0) & (F.col("d_clock") < cadence_cap)
    cadence = d.groupBy(*UNIT).agg(F.percentile(F.when(usable, F.col("d_clock")), F.lit(0.5)).alias("cadence"))
    d = d.join(cadence, UNIT)
    true = lambda c: F.coalesce(c, F.lit(False))
    d = d.withColumn("lap_boundary", true(F.col("d_lap") == 1))
    d = d.withColumn("clock_reset", true(((F.col("d_lap") == 0) & (F.col("d_clock") < -reset_tolerance)) | (F.col("d_lap") < 0) | (F.col("d_lap") > 1)))
    source_dt = F.when(F.col("d_lap") == 0, F.col("d_clock")).when(F.col("lap_boundary"), F.col("last_lap_time") - F.col("was_clock") + F.col("current_lap_time")).otherwise(F.col("cadence"))
    d = d.withColumn("source_dt", source_dt)
    infinite = F.isnan("source_dt") | (F.abs("source_dt") == float("inf"))
    d = d.withColumn("data_gap", ~F.col("first_row") & (infinite | (F.col("source_dt") > F.greatest(F.lit(gap_floor), 5 * F.col("cadence")))))
    d = d.withColumn("position_jump", true(F.col("step") > jump)).withColumn("distance_reset", true(F.col("d_distance") < distance_reset)).withColumn("status_transition", true(F.col("d_status")))
    d = d.withColumn("hard_break", F.col("first_row") | F.col("clock_reset") | F.col("data_gap") | F.col("position_jump") | F.col("distance_reset") | F.col("status_transition"))
    advance = F.when(F.col("first_row"), 0.0).when(F.col("hard_break"), F.col("cadence")).otherwise(F.greatest("source_dt", F.lit(0.0)))
    d = d.withColumn("time_seconds", F.sum(advance).over(running(w))).withColumn("artifact_seed", F.col("hard_break") | F.col("lap_boundary"))
    return segment_ids(d).drop("first_row", "d_lap", "d_clock", "d_distance", "step", "was_clock", "d_status")


def timing_diagnostics(frames: DataFrame) -> DataFrame:
    """Counters for each car; the first row's break isn't counted."""
    return frames.groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("n_frames"),
        (F.count_if("hard_break") - 1).alias("n_hard_breaks"),
        F.count_if("artifact_seed").alias("n_artifact_seeds"),
        F.count_if("active").alias("n_active"),
        F.count_if(F.col("pit_status") != 0).alias("n_pit"),
        (F.max("time_seconds") - F.min("time_seconds")).alias("span_seconds"),
    )


def axis_diagnostics(axis: DataFrame) -> DataFrame:
    """What :func:`reconstruct_axis` met in each car: samples, cadence and its rate, and a count of every kind of break; the first row's break isn't counted."""
    counts = {f"{c}_count": F.count_if(c) for c in ("lap_boundary", "clock_reset", "data_gap", "position_jump", "distance_reset", "status_transition")}
    d = axis.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("sample_count"), F.max("cadence").alias("median_source_dt"), *(c.alias(n) for n, c in counts.items()), (F.count_if("hard_break") - 1).alias("hard_break_count"))
    return d.withColumn("estimated_source_hz", F.try_divide(F.lit(1.0), "median_source_dt"))


def causal_grid(frames: DataFrame, step: float) -> DataFrame:
    """Grid points start + i * step of each segment: (unit, segment, i, target_time)."""
    ends = frames.groupBy(*UNIT, "continuous_segment_id").agg(F.min("time_seconds").alias("start"), F.max("time_seconds").alias("stop"))
    last = F.floor((F.col("stop") - F.col("start")) / F.lit(step) + 1e-9).cast("int")
    return ends.select(*UNIT, "continuous_segment_id", F.posexplode(F.sequence(F.lit(0), last)).alias("grid_index", "i"), "start").select(*UNIT, "continuous_segment_id", "grid_index", (F.col("start") + F.col("i") * F.lit(step)).alias("target_time"))


def causal_resample(frames: DataFrame, step: float) -> DataFrame:
    """Zero-order hold: each grid point takes the last frame at or before it, with its age (as-of backward, one shuffle)."""
    grid = causal_grid(frames, step)
    keys = [*UNIT, "continuous_segment_id"]
    left = frames.select(*keys, F.col("time_seconds").alias("at"), F.lit(0).alias("kind"), F.col("frame_index").alias("source"), F.col("time_seconds").alias("source_time"), F.lit(None).cast("int").alias("grid_index"))
    right = grid.select(*keys, F.col("target_time").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("double").alias("source_time"), "grid_index")
    w = running(Window.partitionBy(*keys).orderBy("at", "kind", "source", "grid_index"))
    held = left.unionByName(right).withColumn("source_index", F.last("source", ignorenulls=True).over(w)).withColumn("held_time", F.last("source_time", ignorenulls=True).over(w))
    return held.where("kind = 1").select(*keys, "grid_index", F.col("at").alias("target_time"), "source_index", (F.col("at") - F.col("held_time")).alias("source_age"))


def flags_forward(frames: DataFrame, flag: str, step: float) -> DataFrame:
    """Grid points that are the first at or after a flagged frame of their segment; later flags are dropped (as-of forward)."""
    keys = [*UNIT, "continuous_segment_id"]
    grid = causal_grid(frames, step).select(*keys, F.col("target_time").alias("at"), F.lit(1).alias("kind"), "grid_index")
    marks = frames.where(F.col(flag)).select(*keys, F.col("time_seconds").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("grid_index"))
    mapped = grid.unionByName(marks).withColumn("goal", ahead("grid_index", keys, "at", "kind", "grid_index"))
    return mapped.where("kind = 0 and goal is not null").groupBy(*keys, F.col("goal").alias("grid_index")).agg(F.count(F.lit(1)).alias("n_flags"))
