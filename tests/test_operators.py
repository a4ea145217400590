"""Small fixtures with hand-computed results."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError, duplicated_keys, forbid_future_columns, key_set_difference, require_columns
from apexframe.operators import excursions as X
from apexframe.operators import features as V
from apexframe.operators import geometry as G
from apexframe.operators import metrics as M
from apexframe.operators import policy as P
from apexframe.operators import pooling as L
from apexframe.operators import timebase as T
from apexframe.sources.integrity import validate_manifest


def axis_rows(spark, clock, laps=None, last=None, total=None, status=None, x=None):
    n = len(clock)
    laps, last, total, status, x = laps or [1] * n, last or [math.inf] * n, total or [float(i) for i in range(n)], status or [2] * n, x or [0.0] * n
    rows = [("A", "car_0", i, laps[i], float(clock[i]), float(last[i]), float(total[i]), status[i], float(x[i]), 0.0, 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "circuit string, car_id string, frame_index long, lap_number long, current_lap_time double, last_lap_time double, total_distance double, result_status int, x double, y double, z double")


def ordered(df, *names):
    got = df.orderBy("frame_index").collect()
    return [[r[n] for r in got] for n in names]


def test_axis_crosses_a_lap_boundary(spark):
    a = T.reconstruct_axis(axis_rows(spark, [0, 0.01, 0.02, 0, 0.01], [1, 1, 1, 2, 2], [math.inf] * 3 + [0.03] * 2))
    t, lap, broken = ordered(a, "time_seconds", "lap_boundary", "hard_break")
    assert t == pytest.approx([0, 0.01, 0.02, 0.03, 0.04]) and lap == [False] * 3 + [True, False] and broken == [True] + [False] * 4


def test_axis_breaks_at_a_clock_reset(spark):
    a = T.reconstruct_axis(axis_rows(spark, [0, 0.04, 0.08, 0, 0.04]))
    assert ordered(a, "clock_reset", "hard_break") == [[False] * 3 + [True, False], [True, False, False, True, False]]


def test_cadence_leaves_out_long_steps(spark):
    a = T.reconstruct_axis(axis_rows(spark, [0, 0.06, 0.12, 0.13, 0.14]))
    cadence, gaps = ordered(a, "cadence", "data_gap")
    assert cadence[0] == pytest.approx(0.01) and gaps == [False, True, True, False, False]


def test_physical_breaks(spark):
    a = T.reconstruct_axis(axis_rows(spark, [0, 0.01, 0.02, 0.03], total=[0, 0.1, -10, -9.9], status=[2, 2, 3, 3], x=[0, 0.1, 10, 10.1]))
    assert ordered(a, "hard_break", "position_jump", "distance_reset", "status_transition") == [[True, False, True, False], *[[False, False, True, False]] * 3]


def test_resampling_holds_the_last_source(spark):
    rows = [("A", "c", i, float(t), 0) for i, t in enumerate([0, 0.03, 0.06, 0.09, 0.12])]
    f = spark.createDataFrame(rows, "circuit string, car_id string, frame_index long, time_seconds double, continuous_segment_id long")
    got = T.causal_resample(f, 0.05).orderBy("grid_index").collect()
    assert [r.source_index for r in got] == [0, 1, 3] and [r.source_age for r in got] == pytest.approx([0, 0.02, 0.01])


def excursion_frames(spark, depths, step=0.05, pit=(), seed=(), breaks=()):
    rows = [("A", "c", i, i * step, d == 0, float(d), True, int(i in pit), i == 0 or i in breaks, i in seed, "left", 126.0) for i, d in enumerate(depths)]
    f = spark.createDataFrame(rows, "circuit string, car_id string, frame_index long, time_seconds double, in_corridor boolean, outside_depth_m double, active boolean, pit_status int, hard_break boolean, artifact_seed boolean, local_side string, centerline_arclength_wrapped_m double")
    return T.segment_ids(f)


def test_excursions_merge_over_short_gaps(spark):
    f = excursion_frames(spark, [0] * 5 + [0.6, 0.7] + [0] * 2 + [0.8] * 5 + [0] * 5)
    got = X.excursion_candidates(f, X.ExcursionConfig(gap_merge=0.10, min_depth=0.5, min_duration=0.2, min_lead_in=0.2, artifact=0.0, edge=0.0)).collect()
    assert len(got) == 1
    e = got[0]
    assert (e.start_frame, e.end_frame, e.n_outside, e.n_gap, e.max_depth, e.segment_bin_at_onset, e.qualified) == (5, 13, 7, 2, 0.8, 5, True)


@pytest.mark.parametrize(
    ("depths", "extra", "reasons"),
    [
        ([0] * 6 + [0.1, 0.2, 0.1, 0.2, 0.1] + [0] * 5, {}, ["max_depth_below_threshold"]),
        ([0.8] * 4 + [0] * 10 + [0.9] * 5, {}, ["start_truncated", "end_truncated"]),
        ([0] * 20, {}, []),
        ([0] * 5 + [0.8] * 5 + [0] * 6 + [0.9] * 5 + [0] * 4, {"pit": {7}, "seed": {14}}, ["pit_overlap", "artifact_proximity"]),
    ],
)
def test_rejections(spark, depths, extra, reasons):
    got = X.excursion_candidates(excursion_frames(spark, depths, **extra), X.ExcursionConfig(gap_merge=0.10, edge=0.0)).orderBy("start_frame").collect()
    assert [r.rejection_reason for r in got] == reasons


def test_exposure_drops_edges(spark):
    f = excursion_frames(spark, [0] * 21, step=0.1)
    r = X.interval_exposure(f, edge=0.5, artifact=0.25).first()
    assert (r.prebuffer_intervals, r.buffered_intervals) == (20, 10) and r.prebuffer_seconds == pytest.approx(2.0)


def replay(rows, threshold=0.8, **config):
    car = P.Car([threshold], P.ProposalConfig(**config))
    closed = [p for r in rows for p in car.feed(P.Row(*r))] + car.finish()
    return [p[1:] for p in closed]


def score_rows(n, invalid=(), outside=(), broken=()):
    return [(i * 0.05, 0.9, "left", 3, 10, i not in invalid, i not in outside, i in broken) for i in range(n)]


def test_automaton_opens_on_the_third_score():
    (p,) = replay(score_rows(6))
    assert p[1] == pytest.approx(0.10) and p[6:] == ("stream_end", True)


def test_automaton_resets_and_is_censored_by_a_break():
    (p,) = replay(score_rows(8, invalid={1}, broken={6}))
    assert p[1] == pytest.approx(0.20) and p[5] == pytest.approx(0.30) and p[6:] == ("hard_break", True)


def test_automaton_rearms_after_quiet_time():
    assert [p[1] for p in replay(score_rows(32), horizon=0.15, rearm=1.0)] == pytest.approx([0.10, 1.35])


def test_automaton_rejects_late_rows():
    with pytest.raises(DataValidationError):
        replay([*score_rows(3), score_rows(1)[0]])
    with pytest.raises(DataValidationError):
        replay([*score_rows(3), score_rows(3)[2]])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.booleans(), st.booleans(), st.booleans()), max_size=40), st.integers(1, 4))
def test_automaton_never_overlaps(rows, persistence):
    closed = replay([(i * 0.3, s, "left", 0, 3, v, o, b) for i, (s, v, o, b) in enumerate(rows)], 0.5, persistence=persistence)
    assert all(a[5] <= b[1] + 1e-9 for a, b in zip(closed, closed[1:], strict=False))
    assert [c[0] for c in closed] == list(range(1, len(closed) + 1))


def test_neighborhood_wraps_and_prefers_left(spark):
    rows = [(0, "left", 4, 0.2), (0, "left", 0, 0.3), (0, "left", 1, 0.1), (0, "right", 2, 0.5), (0, "unknown", 1, 0.9)]
    m = spark.createDataFrame(rows, "row long, side string, bin long, mass double").withColumn("n_bins", F.lit(5).cast("long"))
    r = P.neighborhood_candidates(m).first()
    assert (r.side, r.bin, r.score) == ("left", 0, 0.6)


def test_neighborhoods_take_parts_by_the_number_of_cells(spark, monkeypatch):
    """More cells mean more parts, not larger ones; the choice doesn't depend on them."""
    m = spark.range(400).select(F.expr("id div 4").alias("row"), F.expr("if(id % 4 < 2, 'left', 'right')").alias("side"), F.expr("(id * 7) % 5").alias("bin"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("mass")).withColumn("n_bins", F.lit(5).cast("long"))
    whole = sorted(map(tuple, P.neighborhood_candidates(m).collect()))
    monkeypatch.setattr(P, "PART_CELLS", 10, raising=False)
    assert P.neighborhood_candidates(m).rdd.getNumPartitions() == 40
    assert sorted(map(tuple, P.neighborhood_candidates(m).collect())) == whole and len(whole) == 100


def test_ece_and_metrics(spark):
    d = spark.createDataFrame([("g", 0.0, 0.1), ("g", 0.0, 0.2), ("g", 1.0, 0.7), ("g", 1.0, 0.9)], "g string, y double, p double")
    assert M.expected_calibration_error(d, "g", 2).first().ece == pytest.approx(0.175)
    pooled = M.probability_metrics(d, "g", 0.25).where("pooled = 1").first()
    assert pooled.brier == pytest.approx((0.01 + 0.04 + 0.09 + 0.01) / 4, abs=1e-6)


def test_one_class_calibrator(spark):
    d = spark.createDataFrame([(0.0, 0.3), (0.0, 0.6)], "y double, p double")
    slope, intercept = M.fit_platt(d)
    assert slope == 0.0 and math.isfinite(intercept)


def test_longest_lead(spark):
    rows = [("A", "c", lead, 10, hits, 2, 0, 2.0) for lead, hits in zip([0.25, 0.5, 1.0, 1.5], [6, 6, 5, 4], strict=True)]
    d = spark.createDataFrame(rows, "circuit string, car_id string, lead double, events long, hits long, false_proposals long, unresolved long, exposure double")
    assert L.l_star(d, ["circuit"], 0.5, F.lit(2.0)).first().l_star == 1.0
    assert L.l_star(d.withColumn("hits", F.lit(4)), ["circuit"], 0.5, F.lit(2.0)).first().l_star == 0.0


def test_draws_keep_each_circuits_size(spark):
    units = spark.createDataFrame([(c, f"car_{i}") for c in "AB" for i in range(3)], "circuit string, car_id string")
    got = L.hash_draws(units, 20, "s").groupBy("draw", "circuit").agg(F.sum("weight").alias("n")).select("n").distinct().collect()
    assert [r.n for r in got] == [3]


def test_first_exit_finds_a_fast_crossing(spark):
    ring = G.ring_segments(spark, G.square(10.0), "outer").unionByName(G.ring_segments(spark, G.square(5.0), "inner"))
    move = spark.createDataFrame([(1, -7.5, 0.0, 7.5, 0.0)], "id long, x double, y double, x2 double, y2 double")
    r = G.first_exit(move, ring).first()
    assert r.fraction == pytest.approx(2.5 / 15, abs=1e-6) and r.hit_x == pytest.approx(-5.0)


def test_circular_distance(spark):
    d = spark.createDataFrame([(b,) for b in (0, 1, 8, 9)], "b long").select(V.circular_distance(F.col("b"), F.lit(9), F.lit(10)).alias("d"))
    assert [r.d for r in d.collect()] == [1, 2, 1, 0]


def test_contracts(spark):
    d = spark.createDataFrame([(1, 2), (1, 3)], "a long, next_b long")
    with pytest.raises(DataValidationError):
        require_columns(d, ["a", "z"])
    with pytest.raises(DataValidationError):
        forbid_future_columns(d)
    assert duplicated_keys(d, ["a"]).first().n == 2
    r = key_set_difference(d, d.where("next_b = 2"), ["a", "next_b"]).first()
    assert (r.left_only, r.right_only, r.shared, r.repeated) == (1, 0, 1, 0)


def test_manifest_states(spark):
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, bytes long, sha256 string")
    listed = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y"), ("c", 3, "q"), ("d", 1, "x"), ("e", 1, "x"), ("e", 1, "x")], "path string, bytes long, sha256 string")
    got = {r.path: r.state for r in validate_manifest(listed, files).collect()}
    assert got == {"a": "ok", "b": "size", "c": "digest", "d": "missing", "e": "duplicate"}
