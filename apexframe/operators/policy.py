"""The causal alert policy: candidates, the proposal automaton, labels, thresholds, delays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError, join_matched
from apexframe.operators.features import circular_distance
from apexframe.operators.quantiles import exact_quantiles
from apexframe.operators.timebase import UNIT, ahead
from apexframe.scratch import stored

PROPOSAL_SCHEMA = "circuit string, car_id string, threshold double, proposal_number long, proposal_time double, predicted_side string, predicted_bin long, n_bins long, resolution_time double, resolution_type string, unresolved boolean"


@dataclass(frozen=True)
class ProposalConfig:
    """``timely`` closes a proposal when its horizon ends, as a timer does, before a later row is looked at; else the row decides how it closes."""

    horizon: float = 1.5
    persistence: int = 3
    rearm: float = 1.0
    timely: bool = False


class Row(NamedTuple):
    """A score row as the watch takes it, in time order within a car."""

    time: float
    score: float
    side: str
    bin: int
    bins: int
    valid: bool
    inside: bool
    broken: bool

    def grave(self) -> str | None:
        """What the row shows whatever the threshold, the gravest first; None if it is loud or quiet."""
        if self.broken:
            return "break"
        if not self.inside:
            return "outside"
        return None if self.valid else "blind"

    def sight(self, threshold: float) -> str:
        """What the row shows at a threshold."""
        return self.grave() or ("loud" if self.score + 1e-15 >= threshold else "quiet")


class Watch(NamedTuple):
    """State of one car at one threshold.

    ``phase`` is watching, open or resting. ``run`` is (side, bin, length) of the row of loud sights so far, ``proposal`` the
    open one as (number, time, side, bin, bins), ``rested_since`` the begin of the quiet spell that ends the rest.
    """

    phase: str = "watching"
    number: int = 0
    run: tuple | None = None
    proposal: tuple | None = None
    rested_since: float | None = None

    def closed(self, at: float, kind: str, unresolved: bool) -> tuple | None:
        return None if self.proposal is None else (*self.proposal, at, kind, unresolved)


def coded(watch: Watch) -> str:
    """A state as text; floats come back as they were."""
    return json.dumps(watch)


def decoded(text: str) -> Watch:
    phase, number, run, proposal, since = json.loads(text)
    return Watch(phase, number, run and tuple(run), proposal and tuple(proposal), since)


def elapsed(watch: Watch, now: float, config: ProposalConfig) -> tuple[Watch, tuple] | None:
    """The rest that follows an open proposal whose horizon is over by ``now``, and the proposal; None if there is none."""
    if watch.phase != "open" or now + 1e-12 < (ends := watch.proposal[1] + config.horizon):
        return None
    return Watch("resting", watch.number, rested_since=ends), watch.closed(ends, "horizon_elapsed", False)


def advance(watch: Watch, row: Row, threshold: float, config: ProposalConfig) -> tuple[Watch, tuple | None]:
    """The state after ``row``, and the proposal that it closes."""
    return _after(watch, row, row.sight(threshold), config)


def _after(watch: Watch, row: Row, sight: str, config: ProposalConfig) -> tuple[Watch, tuple | None]:
    """:func:`advance` by what the row shows. Most rows change nothing, so a state is made only where it differs."""
    phase, number = watch.phase, watch.number
    if phase == "open" and config.timely and (done := elapsed(watch, row.time, config)):
        return _after(done[0], row, sight, config)[0], done[1]  # a resting car closes nothing more
    if sight == "break":
        stays = phase == "watching" and row.inside
        after = Watch("watching", number) if stays else Watch("resting", number, rested_since=row.time if row.inside and row.valid else None)
        return after, watch.closed(row.time, "hard_break", True)
    if phase == "open":
        if sight == "outside":
            return Watch("resting", number), watch.closed(row.time, "outside_observed", False)
        ends = watch.proposal[1] + config.horizon
        if row.time + 1e-12 < ends:
            return watch, None
        return Watch("resting", number, rested_since=ends), watch.closed(ends, "horizon_elapsed", False)
    if sight == "outside" or (sight == "blind" and phase == "resting"):
        return watch if phase == "resting" and watch.rested_since is None else Watch("resting", number), None
    if phase == "resting":
        if watch.rested_since is None:
            return Watch("resting", number, rested_since=row.time), None
        if row.time - watch.rested_since + 1e-12 < config.rearm:
            return watch, None
    if sight != "loud":
        return watch if phase == "watching" and watch.run is None else Watch("watching", number), None
    # Loud, while watching or at the end of a rest.
    place = (row.side, row.bin)
    length = 1 + (watch.run[2] if watch.run is not None and watch.run[:2] == place else 0)
    if length < config.persistence:
        return Watch("watching", number, (*place, length)), None
    return Watch("open", number + 1, proposal=(number + 1, row.time, *place, row.bins)), None


class Car:
    """The watches of one car at several thresholds; time must rise with every row."""

    def __init__(self, thresholds: list[float], config: ProposalConfig):
        self.thresholds, self.config = thresholds, config
        self.watches = [Watch() for _ in thresholds]
        self.time: float | None = None

    def feed(self, row: Row) -> list[tuple]:
        """Proposals that the row closes, each after its threshold."""
        if self.time is not None and not row.time > self.time:
            raise DataValidationError("rows of a car must come in strictly increasing time")
        self.time, out, grave, score = row.time, [], row.grave(), row.score + 1e-15
        for i, threshold in enumerate(self.thresholds):
            self.watches[i], done = _after(self.watches[i], row, grave or ("loud" if score >= threshold else "quiet"), self.config)
            if done is not None:
                out.append((threshold, *done))
        return out

    def finish(self) -> list[tuple]:
        """Proposals that are open when the stream ends."""
        return [(t, *w.closed(self.time, "stream_end", True)) for t, w in zip(self.thresholds, self.watches, strict=True) if w.proposal is not None]


#: Cells of mass that a task takes, about.
PART_CELLS = 250_000
#: Columns of a score row in the order of :class:`Row`.
ROW = ["time_seconds", "proposal_score", "predicted_side", "predicted_bin", "n_bins", "input_valid_causal", "in_corridor", "hard_break"]


def run_alerts(scores: DataFrame, thresholds: list[float], config: ProposalConfig) -> DataFrame:
    """Proposals of every car at every threshold.

    Cars are partitioned and sorted once; a task takes some 200,000 rows of whole cars at a time, see :mod:`apexframe.operators.alert_lanes`. Cars too long for one task are spread over
    many, see :func:`apexframe.operators.alert_ranges.run_long_alerts`; the result is the same.
    """
    from apexframe.operators import alert_ranges  # it builds on this module

    long = stored(scores.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > alert_ranges.RANGE_ROWS).select(*UNIT), "long-cars")
    if not long.take(1):
        return _run_whole(scores, thresholds, config)
    scores = stored(scores.select(*UNIT, "frame_index", *ROW), "scores")
    short = _run_whole(scores.join(long, UNIT, "left_anti"), thresholds, config)
    return short.unionByName(alert_ranges.run_long_alerts(scores.join(long, UNIT, "left_semi"), thresholds, config))


def _run_whole(scores: DataFrame, thresholds: list[float], config: ProposalConfig) -> DataFrame:
    from apexframe.operators import alert_lanes  # it builds on this module

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins in alert_lanes.chunks(batches):
            yield alert_lanes.replay(rows, begins, thresholds, config)

    rows = scores.select("frame_index", *alert_lanes.COLUMNS[:-1], alert_lanes.sight())
    rows = rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "frame_index").select(*alert_lanes.COLUMNS)
    return rows.mapInPandas(replay, PROPOSAL_SCHEMA)


def label_proposals(proposals: DataFrame, events: DataFrame, horizon: float, tolerance: int = 1) -> DataFrame:
    """Each proposal with the first qualified event in its observable window: the next event of its car, if that comes in time."""
    info = F.struct(F.col("start_time").alias("event_time"), "candidate_event_id", "side_at_onset", F.col("segment_bin_at_onset").alias("event_bin"))
    e = events.where("qualified").select(*UNIT, F.col("start_time").alias("at"), F.lit(1).alias("kind"), "candidate_event_id", info.alias("e"))
    p = proposals.withColumn("until", F.least(F.col("proposal_time") + horizon, F.coalesce("resolution_time", F.lit(float("inf")))))
    p = p.withColumns({"at": F.col("proposal_time") - 1e-12, "kind": F.lit(0), "candidate_event_id": F.lit(None).cast("string")})
    j = p.unionByName(e, allowMissingColumns=True).withColumn("next", ahead("e", UNIT, "at", "kind", "candidate_event_id")).where("kind = 0")
    j = j.withColumn("next", F.when(F.col("next.event_time") <= F.col("until") + 1e-12, F.col("next"))).drop("candidate_event_id", "e").select("*", "next.*")
    matched = F.col("candidate_event_id").isNotNull()
    distance = circular_distance(F.col("predicted_bin"), F.col("event_bin"), F.col("n_bins"))
    j = j.withColumn("correct_side", F.coalesce(F.col("predicted_side") == F.col("side_at_onset"), F.lit(False))).withColumn("within_tolerance", F.coalesce(distance <= tolerance, F.lit(False))).withColumn("exact_segment", F.coalesce(F.col("correct_side") & (distance == 0), F.lit(False)))
    j = j.withColumn("localized_hit", F.col("correct_side") & F.col("within_tolerance"))
    return j.select(
        *UNIT, "threshold", "proposal_number", "proposal_time", "resolution_type", F.col("candidate_event_id").alias("matched_event_id"),
        (F.col("event_time") - F.col("proposal_time")).alias("lead"), "correct_side", "exact_segment", "within_tolerance", "localized_hit",
        (~matched & F.col("unresolved")).alias("unresolved_censored"), F.when(matched, ~F.col("localized_hit")).otherwise(~F.col("unresolved")).alias("false_proposal"),
    )


def with_exact_bin(labels: DataFrame, proposals: DataFrame, events: DataFrame) -> DataFrame:
    """Labels with the side and bin of the matched event and whether the proposal named that very bin, whatever its side; false and nulls without a match.

    Every label needs its proposal, and every matched id exactly one qualified event; anything else is an error.
    """
    known = events.where("qualified").select(F.col("candidate_event_id").alias("matched_event_id"), F.col("side_at_onset").alias("matched_side_at_onset"), F.col("segment_bin_at_onset").alias("matched_segment_bin"))
    key = [*UNIT, "threshold", "proposal_number"]
    d = join_matched(labels, proposals.select(*key, "predicted_bin"), key)
    found = join_matched(d.where("matched_event_id is not null"), known, ["matched_event_id"], many=True)
    d = found.unionByName(d.where("matched_event_id is null"), allowMissingColumns=True)
    return d.withColumn("exact_bin", F.coalesce(F.col("predicted_bin") == F.col("matched_segment_bin"), F.lit(False))).drop("predicted_bin")


def delayed(labels: DataFrame, delays: list[float], keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Labels under added latency, with the columns ``keep``: a hit whose lead no longer suffices turns false; unresolved ones stay."""
    d = labels.select("*", F.explode(F.array(*map(F.lit, delays))).alias("delay"))
    left = F.col("lead") - F.col("delay")
    hit = F.col("localized_hit") & (left >= -1e-12)
    return d.select(*UNIT, "threshold", "proposal_number", *keep, "delay", left.alias("effective_lead"), F.coalesce(hit, F.lit(False)).alias("localized_hit"), "unresolved_censored", F.when(F.col("matched_event_id").isNotNull(), ~F.coalesce(hit, F.lit(False))).otherwise(F.col("false_proposal")).alias("false_proposal"))


def detection_summary(labels: DataFrame, events: DataFrame, exposure_hours: DataFrame, leads: list[float]) -> DataFrame:
    """Recall by distinct events and false proposals an hour, for each threshold and lead; ``exposure_hours`` and the event count are one row each."""
    d = labels.select("*", F.explode(F.array(*map(F.lit, leads))).alias("required_lead"))
    timely = F.when(F.col("localized_hit") & (F.col("lead") >= F.col("required_lead") - 1e-12), F.col("matched_event_id"))
    sums = d.groupBy("threshold", "required_lead").agg(F.count_distinct(timely).alias("hits"), F.count_if("false_proposal").alias("false_proposals"), F.count_if("unresolved_censored").alias("unresolved"))
    one = events.where("qualified").agg(F.count(F.lit(1)).alias("events")).join(F.broadcast(exposure_hours.select("hours")))
    s = sums.join(F.broadcast(one))
    return s.select("threshold", "required_lead", "events", "hits", "false_proposals", "unresolved", F.try_divide(F.col("hits"), F.col("events")).alias("recall"), F.try_divide(F.col("false_proposals"), F.col("hours")).alias("false_per_hour"))


def threshold_grid(scores: DataFrame, column: str, bulk: int = 100, tail: int = 401, low: float = 2.0, high: float = 6.0) -> DataFrame:
    """Distinct candidate thresholds: bulk quantiles, tail quantiles 1 - 10^-x, and 0 and 1."""
    qs = [0.99 * i / (bulk - 1) for i in range(bulk)] + [1 - 10 ** -(low + (high - low) * i / (tail - 1)) for i in range(tail)]
    found = exact_quantiles(scores, [], column, qs)
    both = F.concat("quantiles", F.array(F.lit(0.0), F.lit(1.0)))
    return found.select(F.explode(F.array_distinct(both)).alias("threshold"))


def operating_points(summary: DataFrame, budgets: list[float], keys: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """For each lead and budget (and ``keys``, such as the method) the threshold of best recall within the budget; ties go to the higher threshold."""
    d = summary.select("*", F.explode(F.array(*map(F.lit, budgets))).alias("budget")).where(F.col("false_per_hour") <= F.col("budget") + 1e-12)
    w = Window.partitionBy(*keys, "required_lead", "budget").orderBy(F.col("recall").desc_nulls_last(), F.desc("threshold"))
    return d.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*keys, "required_lead", "budget", "threshold", "recall", "false_per_hour")


def neighborhood_candidates(mass: DataFrame, radius: int = 1) -> DataFrame:
    """The best side and bin by mass within a circular radius; ties go left, then to the low bin.

    ``mass``: (row, side, bin, n_bins, mass) in long form; side unknown is no candidate. It is written and counted, then dealt by row into parts of about
    ``PART_CELLS``, so that a task's sums don't grow with the table; they and the choice need no further shuffle.
    """
    cells = stored(mass.where(F.col("side") != "unknown").select("row", "side", "bin", "n_bins", "mass"), "mass-cells")
    parts = max(int(mass.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // PART_CELLS))
    d = cells.repartition(parts, "row").select("row", "side", "n_bins", "mass", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("o"), "bin")
    d = d.groupBy("row", "side", F.pmod(F.col("bin") + F.col("o"), F.col("n_bins")).alias("bin")).agg(F.round(F.sum("mass"), 9).alias("score"))  # so that sums tie whatever their order
    w = Window.partitionBy("row").orderBy(F.desc("score"), "side", "bin")
    return d.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
