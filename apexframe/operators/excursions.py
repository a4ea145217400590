"""Excursions from the corridor by gaps and islands, qualified or rejected with a reason."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.operators.sweeps import covering
from apexframe.operators.timebase import UNIT, ahead, by_unit, running


@dataclass(frozen=True)
class ExcursionConfig:
    gap_merge: float = 0.25
    min_depth: float = 0.5
    min_duration: float = 0.2
    min_lead_in: float = 0.0
    artifact: float = 0.25
    edge: float = 0.5
    bin_width: float = 25.0
    exclude_truncated: bool = True


def artifact_proximity(frames: DataFrame, radius: float) -> DataFrame:
    """``near_artifact``: an artifact seed lies within the radius of the row; with the times of the seeds at or before and at or after it."""
    seed = F.when(F.col("artifact_seed"), F.col("time_seconds"))
    before = F.last(seed, ignorenulls=True).over(running(by_unit("time_seconds", "frame_index")))
    d = frames.withColumns({"seed_before": before, "seed_after": ahead(seed, UNIT, "time_seconds", "frame_index")})
    near = (F.col("time_seconds") - F.col("seed_before") <= radius + 1e-12) | (F.col("seed_after") - F.col("time_seconds") <= radius + 1e-12)
    return d.withColumn("near_artifact", F.coalesce(near, F.lit(False)))


def _kept(mark: Column, value: Column, w: Window) -> Column:
    """``value`` of the last marked row so far, nulls too; a table of many runs needs no window (and sort) of its own for each kind of run."""
    return F.last(F.when(mark, F.struct(value.alias("value"))), ignorenulls=True).over(running(w))["value"]


def _known(frames: DataFrame) -> DataFrame:
    return frames.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in UNIT)))


def _prepared(frames: DataFrame) -> DataFrame:
    """Frames of known cars with what a run's first and last row tell, from one sort backwards and one forwards.

    A car's time must not fall and the rows of a segment must follow each other, as its frames go on.
    """
    back, w = Window.partitionBy(*UNIT).orderBy(F.desc("frame_index")), by_unit()
    following, before = (lambda c: F.lag(c).over(back)), (lambda c: F.lead(c).over(back))
    d = _known(frames).withColumns(
        {
            **{f"next_{n}": following(c) for n, c in (("frame", "frame_index"), ("time", "time_seconds"), ("segment", "continuous_segment_id"), ("active", "active"))},
            **{f"last_{n}": before(c) for n, c in (("frame", "frame_index"), ("time", "time_seconds"), ("segment", "continuous_segment_id"), ("active", "active"))},
            "pit_ahead": ahead(F.when(F.col("pit_status") != 0, F.col("frame_index")), UNIT, "frame_index"),
            "seed_after": ahead(F.when(F.col("artifact_seed"), F.col("time_seconds")), UNIT, "frame_index"),
        }
    )
    # Runs of active rows, not split at breaks.
    begins = lambda last, now: F.coalesce(~F.col(now) | (F.coalesce(last, F.lit(False)) != F.col(now)), F.lit(False))
    first, final, same = F.col("last_frame").isNull(), F.col("next_frame").isNull(), F.col("continuous_segment_id").eqNullSafe
    d = d.withColumn("active_end", _kept(final | begins("active", "next_active"), F.col("time_seconds"), back))
    # Clean time before a row: back to the last row that is dirty, or to the row after a break.
    clean = F.col("active") & (F.col("pit_status") == 0) & F.col("in_corridor")
    dirty = F.when(~clean, F.struct("frame_index", "next_frame", "next_time"))
    dt = F.col("time_seconds") - F.col("last_time")
    whole, earlier = (w.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, -1))
    d = d.withColumns(
        {
            "cadence": F.percentile(F.when(dt > 0, dt), F.lit(0.5)).over(whole),
            "active_start": _kept(first | begins("last_active", "active") | F.col("last_time").isNull(), F.col("time_seconds"), w),
            "segment_first": F.last(F.when(first | ~same(F.col("last_segment")), F.struct("frame_index", "time_seconds")), ignorenulls=True).over(running(w)),
            "seed_before": F.last(F.when(F.col("artifact_seed"), F.col("time_seconds")), ignorenulls=True).over(running(w)),
            "last_dirty": F.last(dirty, ignorenulls=True).over(earlier),
        }
    )
    d = d.withColumn("clean_from", F.greatest("segment_first.frame_index", F.coalesce(F.col("last_dirty.frame_index") + 1, F.lit(0))))
    clean_time = F.when(F.col("clean_from") == F.col("segment_first.frame_index"), F.col("segment_first.time_seconds")).when(F.col("clean_from") == F.col("last_dirty.next_frame"), F.col("last_dirty.next_time"))
    return d.withColumns({"clean_time": clean_time, "segment_first": F.col("segment_first.frame_index"), "segment_ends": final | ~same(F.col("next_segment")), "outside": ~F.col("in_corridor") & F.col("active")})


def _spans(prepared: DataFrame, config: ExcursionConfig) -> DataFrame:
    """Outside rows with the number of the merged run they belong to, over the whole car."""
    w = by_unit()
    out = prepared.where("outside").withColumn("before", F.lag("frame_index").over(w)).withColumn("before_time", F.lag("time_seconds").over(w)).withColumn("before_segment", F.lag("continuous_segment_id").over(w))
    gap = F.greatest(F.lit(0.0), F.col("time_seconds") - F.col("before_time") - F.col("cadence"))
    adjacent = F.col("frame_index") == F.col("before") + 1
    joins = F.coalesce((F.col("continuous_segment_id") == F.col("before_segment")) & (adjacent | (gap <= config.gap_merge + 1e-12)), F.lit(False))
    return out.withColumn("run", F.sum((~joins).cast("long")).over(running(w)))


def excursion_candidates(frames: DataFrame, config: ExcursionConfig) -> DataFrame:
    """One row for each candidate, qualified or with the first reason against it; all windows share the car's partitioning, and no frame is joined back.

    A car's time must not fall and the rows of a segment must follow each other, as its frames go on.
    """
    rows = _spans(_prepared(frames), config)
    begun = {
        "start_time": "time_seconds", "side_at_onset": "local_side", "arclength_at_onset": "centerline_arclength_wrapped_m", "cadence": "cadence", "segment_first": "segment_first",
        "active_start": "active_start", "active_end": "active_end", "clean_time": "clean_time", "pit_ahead": "pit_ahead", "seed_before": "seed_before", "seed_after": "seed_after",
    }
    begun = F.struct(*(F.col(c).alias(n) for n, c in begun.items()), (F.col("pit_status") != 0).alias("start_in_pit"))
    ended = F.struct(F.col("time_seconds").alias("end_time"), F.col("segment_ends").alias("end_truncated"))
    runs = rows.groupBy(*UNIT, "continuous_segment_id", "run").agg(
        F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.min_by(begun, "frame_index").alias("begun"), F.max_by(ended, "frame_index").alias("ended"),
        F.max(F.struct(F.col("outside_depth_m").alias("depth"), (-F.col("frame_index")).alias("frame"))).alias("deepest"), F.count(F.lit(1)).alias("n_outside"),
    )
    runs = runs.select(*UNIT, "continuous_segment_id", "run", "start_frame", "end_frame", "n_outside", "begun.*", "ended.*", F.col("deepest.depth").alias("max_depth"), (-F.col("deepest.frame")).alias("max_depth_frame"))
    # Whether pit rows lie in the span (gaps included) and artifacts near it: the nearest ones around its first row tell.
    reach, known = config.artifact + 1e-12, lambda c: F.coalesce(c, F.lit(False))
    pit = known(F.col("pit_ahead") <= F.col("end_frame"))
    artifact = known(F.col("seed_before") >= F.col("start_time") - reach) | known(F.col("seed_after") <= F.col("end_time") + reach)
    e = runs.withColumns({"pit_overlap": pit, "artifact_near": artifact})
    e = e.withColumn("duration", F.col("end_time") - F.col("start_time") + F.col("cadence"))
    e = e.withColumn("lead_in", F.when(F.col("start_in_pit"), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.col("start_time") - F.col("clean_time"), F.lit(0.0)))))
    e = e.withColumn("start_truncated", F.col("start_frame") == F.col("segment_first"))
    near_edge = (F.col("start_time") - F.col("active_start") + 1e-12 < config.edge) | (F.col("active_end") - F.col("end_time") + 1e-12 < config.edge)
    truncated = lambda c: F.lit(config.exclude_truncated) & F.col(c)
    reason = (
        F.when(F.col("max_depth") < config.min_depth, "max_depth_below_threshold").when(F.col("duration") < config.min_duration, "duration_below_threshold")
        .when(truncated("start_truncated"), "start_truncated").when(truncated("end_truncated"), "end_truncated").when(near_edge, "segment_edge_proximity")
        .when(F.col("pit_overlap"), "pit_overlap").when(F.col("artifact_near"), "artifact_proximity").when(F.col("lead_in") + 1e-12 < config.min_lead_in, "insufficient_lead_in").otherwise("")
    )
    e = e.withColumn("rejection_reason", reason).withColumn("qualified", F.col("rejection_reason") == "")
    name = F.format_string("%s:%s:excursion_candidate_%04d", "circuit", "car_id", "run")
    return e.select(
        *UNIT, name.alias("candidate_event_id"), "continuous_segment_id", "start_frame", "end_frame", "start_time", "end_time", F.round("duration", 6).alias("duration"),
        F.round("max_depth", 6).alias("max_depth"), "max_depth_frame", "n_outside", (F.col("end_frame") - F.col("start_frame") + 1 - F.col("n_outside")).alias("n_gap"),
        "side_at_onset", F.floor(F.col("arclength_at_onset") / config.bin_width).cast("long").alias("segment_bin_at_onset"), "start_truncated", "end_truncated",
        "pit_overlap", "artifact_near", F.round("lead_in", 6).alias("lead_in"), "rejection_reason", "qualified",
    )


def label_frames(frames: DataFrame, candidates: DataFrame, config: ExcursionConfig) -> DataFrame:
    """Frames with the candidate that covers them, and whether they count as exposure; a car's candidates don't overlap."""
    d = artifact_proximity(frames, config.artifact).select(*UNIT, "frame_index", (F.col("active") & (F.col("pit_status") == 0) & ~F.col("near_artifact")).alias("eligible_exposure"))
    c = candidates.select(*UNIT, "start_frame", "end_frame", F.struct("candidate_event_id", "qualified").alias("of"))
    joined = covering(d, c, UNIT, "frame_index", "start_frame", "end_frame", "of")
    qualified = F.col("of.qualified")
    onset = F.coalesce(qualified & (F.col("frame_index") == F.col("start_frame")), F.lit(False))
    return joined.select(*UNIT, "frame_index", F.col("of.candidate_event_id").alias("candidate_event_id"), F.when(qualified, F.col("of.candidate_event_id")).alias("qualifying_event_id"), onset.alias("onset"), "eligible_exposure")


def next_events(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Each frame with the first qualified event of its segment at or after it (as-of forward; null if none)."""
    keys = [*UNIT, "continuous_segment_id"]
    info = F.struct("candidate_event_id", "start_time", "side_at_onset", "segment_bin_at_onset")
    marks = events.where("qualified").select(*keys, F.col("start_time").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("frame_index"), info.alias("e"))
    rows = frames.select(*keys, F.col("time_seconds").alias("at"), F.lit(0).alias("kind"), "frame_index", F.lit(None).cast(marks.schema["e"].dataType).alias("e"))
    found = rows.unionByName(marks).withColumn("next", ahead("e", keys, "at", "kind", "frame_index")).where("kind = 0")
    return found.select(*keys, "frame_index", F.col("next.candidate_event_id").alias("next_event_id"), F.round(F.col("next.start_time") - F.col("at"), 6).alias("time_to_next"), F.col("next.side_at_onset").alias("next_side"), F.col("next.segment_bin_at_onset").alias("next_bin"))


def project_events(grid: DataFrame, events: DataFrame) -> DataFrame:
    """Each qualified event with the first grid point of its segment at or after its onset, and the delay."""
    keys = [*UNIT, "continuous_segment_id"]
    points = grid.select(*keys, F.col("target_time").alias("at"), F.lit(1).alias("kind"), "grid_index", F.lit(None).cast("string").alias("candidate_event_id"), F.col("target_time").alias("p"))
    marks = events.where("qualified").select(*keys, F.col("start_time").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("grid_index"), "candidate_event_id", F.lit(None).cast("double").alias("p"))
    found = points.unionByName(marks).withColumns({"goal": ahead("grid_index", keys, "at", "kind"), "goal_time": ahead("p", keys, "at", "kind")})
    return found.where("kind = 0").select("candidate_event_id", F.col("goal").alias("grid_index"), F.round(F.col("goal_time") - F.col("at"), 6).alias("projection_delay"))


def interval_exposure(frames: DataFrame, edge: float, artifact: float) -> DataFrame:
    """Seconds of valid driving for each known car: before buffers, and without run edges and artifact surroundings; one sort backwards and one forwards.

    A car's time must not fall as its frames go on.
    """
    back, w = Window.partitionBy(*UNIT).orderBy(F.desc("frame_index")), by_unit()
    following = lambda c, n=1: F.lag(c, n).over(back)
    seed = F.when(F.col("artifact_seed"), F.col("time_seconds"))
    d = _known(frames).select(
        *UNIT, "frame_index", F.col("time_seconds").alias("t0"), following("time_seconds").alias("t1"), following("time_seconds", 2).alias("t2"), F.lead("time_seconds").over(back).alias("last_t0"),
        (F.col("active") & following("active")).alias("pair"), (following("active") & following("active", 2)).alias("next_pair"), (F.lead("active").over(back) & F.col("active")).alias("last_pair"),
        following("hard_break").alias("breaks"), ((F.col("pit_status") != 0) | (following("pit_status") != 0)).alias("pit"), seed.alias("seed"), ahead(seed, UNIT, "frame_index", strictly=True).alias("after"),
    )
    # Runs of pairs; a run's end is met first, as rows come backwards. A row whose next one has no time is no interval.
    begins = lambda last, now: F.coalesce(~F.col(now) | ~F.coalesce(last, F.lit(False)), F.lit(False))
    d = d.withColumn("run_end", _kept(F.col("t2").isNull() | begins("pair", "next_pair"), F.col("t1"), back)).where("t1 is not null")
    last_pair = F.when(F.col("t0").isNotNull(), F.col("last_pair"))
    # The nearest seeds around an interval decide whether any overlaps it (strictly).
    d = d.withColumns({"run_start": _kept(F.col("last_t0").isNull() | begins(last_pair, "pair"), F.col("t0"), w), "before": F.last("seed", ignorenulls=True).over(running(w))})
    valid = F.col("pair") & ~F.col("breaks") & (F.col("t1") > F.col("t0")) & ~F.col("pit")
    safe = (F.col("t0") >= F.col("run_start") + edge - 1e-12) & (F.col("t1") <= F.col("run_end") - edge + 1e-12)
    hit = F.coalesce(F.col("t0") < F.col("before") + artifact, F.lit(False)) | F.coalesce(F.col("t1") > F.col("after") - artifact, F.lit(False))
    buffered = valid & safe & ~hit
    span = F.col("t1") - F.col("t0")
    return d.groupBy(*UNIT).agg(
        F.round(F.coalesce(F.sum(F.when(valid, span)), F.lit(0.0)), 6).alias("prebuffer_seconds"), F.count_if(valid).alias("prebuffer_intervals"),
        F.round(F.coalesce(F.sum(F.when(buffered, span)), F.lit(0.0)), 6).alias("buffered_seconds"), F.count_if(buffered).alias("buffered_intervals"),
    )
