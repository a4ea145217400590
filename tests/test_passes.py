"""Excursions, exposure and the ledger in few passes: shapes of plans, and rows against plain loops."""

import random

from apexframe.operators import excursions as X
from apexframe.operators import operating as O
from apexframe.plans.surrogate import tele
from twins import DATA

FRAMES = "circuit string, car_id string, frame_index long, time_seconds double, continuous_segment_id long, in_corridor boolean, outside_depth_m double, active boolean, pit_status int, artifact_seed boolean, hard_break boolean, local_side string, centerline_arclength_wrapped_m double"



def _nodes(df, name: str) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count(name)


def _frames(spark, cars=150, seed=3):
    rng, rows = random.Random(seed), []
    for car in range(cars):
        time, segment, before = 0.0, -1, None
        for i in range(rng.randint(1, 60)):
            time += rng.choice([0.0, 0.5, 0.5, 1.0])
            active, seed_row = rng.random() < 0.9, rng.random() < 0.08
            broken = i == 0 or active != before or rng.random() < 0.05
            segment, before = segment + broken, active
            inside = rng.random() < 0.6
            rows.append((f"c{car % 2}", str(car), i, time, segment, inside, 0.0 if inside else rng.choice([0.4, 0.8, 1.6]), active, int(rng.random() < 0.05), seed_row, broken, rng.choice(["left", "right"]), float(i)))
    rows.append((None, None, 0, 0.0, 0, False, 1.0, True, 0, False, True, "left", 0.0))
    return spark.createDataFrame(rows, FRAMES)


def _cars(rows):
    cars = {}
    for r in sorted((r for r in rows if r.car_id is not None), key=lambda r: (r.car_id, r.frame_index)):
        cars.setdefault((r.circuit, r.car_id), []).append(r)
    return cars


def test_candidates_and_exposure_take_one_shuffle_and_no_join(spark):
    frames = tele(spark, DATA)
    before = _nodes(frames, "Exchange hashpartitioning")
    assert before == 1
    for df in (X.excursion_candidates(frames, X.ExcursionConfig()), X.interval_exposure(frames, 0.5, 0.25)):
        assert _nodes(df, "Exchange hashpartitioning") == before + 1
        assert _nodes(df, "Join") == 0


def test_exposure_by_hand(spark):
    frames, edge, artifact = _frames(spark), 1.0, 0.4
    want = {}
    for key, rows in _cars(frames.collect()).items():
        pairs = [a.active and b.active for a, b in zip(rows, rows[1:])]
        runs = []
        for i, pair in enumerate(pairs):
            runs.append(runs[-1] if i and pair and pairs[i - 1] else i)
        seeds, out = [r.time_seconds for r in rows if r.artifact_seed], [0.0, 0, 0.0, 0]
        for i, (a, b) in enumerate(zip(rows, rows[1:])):
            if not pairs[i] or b.hard_break or not b.time_seconds > a.time_seconds or a.pit_status or b.pit_status:
                continue
            own = [j for j, r in enumerate(runs) if r == runs[i]]
            out[0], out[1] = out[0] + b.time_seconds - a.time_seconds, out[1] + 1
            safe = a.time_seconds >= rows[own[0]].time_seconds + edge - 1e-12 and b.time_seconds <= rows[own[-1] + 1].time_seconds - edge + 1e-12
            if safe and not any(a.time_seconds < s + artifact and b.time_seconds > s - artifact for s in seeds):
                out[2], out[3] = out[2] + b.time_seconds - a.time_seconds, out[3] + 1
        want[key] = [round(v, 6) for v in out]
    got = {(r.circuit, r.car_id): [r.prebuffer_seconds, r.prebuffer_intervals, r.buffered_seconds, r.buffered_intervals] for r in X.interval_exposure(frames, edge, artifact).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {k: v for k, v in want.items() if v[1]}
    assert sum(v[3] for v in want.values()) > 20
    assert all(k[1] is not None for k in got)


def test_candidates_by_hand(spark):
    config = X.ExcursionConfig(gap_merge=0.5, min_depth=0.5, min_duration=0.2, min_lead_in=0.5, artifact=0.4, edge=1.0)
    frames, want = _frames(spark), {}
    for key, rows in _cars(frames.collect()).items():
        steps = sorted(d for a, b in zip(rows, rows[1:]) if (d := b.time_seconds - a.time_seconds) > 0)
        cadence = (steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 2 if steps else None
        runs = []
        for r in rows:
            if r.in_corridor or not r.active:
                continue
            last = runs[-1][-1] if runs else None
            near = last is not None and (r.frame_index == last.frame_index + 1 or (cadence is not None and max(0.0, r.time_seconds - last.time_seconds - cadence) <= 0.5 + 1e-12))
            if last is not None and last.continuous_segment_id == r.continuous_segment_id and near:
                runs[-1].append(r)
            else:
                runs.append([r])
        for n, run in enumerate(runs, 1):
            a, b = run[0], run[-1]
            segment = [r.frame_index for r in rows if r.continuous_segment_id == a.continuous_segment_id]
            lo, hi = a.frame_index, a.frame_index
            while lo and rows[lo - 1].active:
                lo -= 1
            while hi + 1 < len(rows) and rows[hi + 1].active:
                hi += 1
            dirty = [r.frame_index for r in rows[: a.frame_index] if not (r.active and not r.pit_status and r.in_corridor)]
            clean = max(segment[0], dirty[-1] + 1 if dirty else 0)
            lead_in = 0.0 if a.pit_status else max(0.0, a.time_seconds - rows[clean].time_seconds)
            pit = any(r.pit_status for r in rows[a.frame_index : b.frame_index + 1])
            seed = any(r.artifact_seed and a.time_seconds - 0.4 - 1e-12 <= r.time_seconds <= b.time_seconds + 0.4 + 1e-12 for r in rows)
            edge = a.time_seconds - rows[lo].time_seconds + 1e-12 < 1.0 or rows[hi].time_seconds - b.time_seconds + 1e-12 < 1.0
            want[(*key, n)] = (a.frame_index, b.frame_index, max(r.outside_depth_m for r in run), len(run), a.local_side, a.frame_index == segment[0], b.frame_index == segment[-1], pit, seed, round(lead_in, 6), edge)
    got = {(r.circuit, r.car_id, int(r.candidate_event_id[-4:])): r for r in X.excursion_candidates(frames, config).collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        *plain, edge = want[key]
        assert (r.start_frame, r.end_frame, r.max_depth, r.n_outside, r.side_at_onset, r.start_truncated, r.end_truncated, r.pit_overlap, r.artifact_near, r.lead_in) == tuple(plain)
        if r.rejection_reason in ("pit_overlap", "artifact_proximity", "insufficient_lead_in", ""):
            assert not edge
        if r.rejection_reason == "segment_edge_proximity":
            assert edge
    assert {r.rejection_reason for r in got.values()} >= {"", "segment_edge_proximity", "pit_overlap", "artifact_proximity", "insufficient_lead_in"}


def test_an_event_hit_twice_counts_once_at_its_longest_lead(spark):
    labels = spark.createDataFrame(
        [("A", "1", "m", 0.1, "e", 2.0, True, False, False), ("A", "1", "m", 0.1, "e", 0.5, True, False, False), ("A", "1", "m", 0.1, "f", 9.0, False, True, False), ("A", "1", "m", 0.1, None, None, False, True, False), ("A", "1", "m", 0.1, "g", None, True, False, False)],
        "circuit string, car_id string, method string, threshold double, matched_event_id string, lead double, localized_hit boolean, false_proposal boolean, unresolved_censored boolean",
    )
    cars = spark.createDataFrame([("A", "1", 3, 10.0)], "circuit string, car_id string, events long, exposure double")
    summary = O.threshold_summary(labels, cars, [0.5, 1.0, 3.0], [0.1])
    assert {r.required_lead: (r.hits, r.false_proposals) for r in summary.collect()} == {0.5: (1, 2), 1.0: (1, 2), 3.0: (0, 2)}
    cells = O.choose_cells(summary, [0.2])
    ledger = O.heldout_ledger(cells, O.seal(cells), labels, cars)
    assert {r.required_lead: (r.hits, r.false_proposals) for r in ledger.collect()} == {0.5: (1, 2), 1.0: (1, 2), 3.0: (0, 2)}
    mine = O.threshold_summary(labels, cars, [0.5, 1.0, 3.0], [0.1])
    assert "Expand" not in mine._jdf.queryExecution().optimizedPlan().toString()
