"""Event-time alerts: any order of rows within the bound, timers, late rows, restart and drain equal the batch replay."""

import random

import pandas as pd
import pytest

from apexframe.operators.policy import ProposalConfig, run_alerts
from apexframe.streaming.timed import drain, timed_alerts

CONFIG = ProposalConfig(horizon=4.0, persistence=2, rearm=1.0, timely=True)
SCHEMA = "circuit string, car_id string, frame_index long, time_seconds double, proposal_score double, predicted_side string, predicted_bin long, n_bins long, input_valid_causal boolean, in_corridor boolean, hard_break boolean"


def _rows(seed, cars=5, n=120):
    rng, out = random.Random(seed), []
    for c in range(cars):
        t = 10.0
        for i in range(n):
            t = round(t + rng.choice([0.25, 0.5, 1.0]), 3)
            out.append(("C", f"k{c}", i, t, rng.choice([0.2, 0.9]), "left", rng.choice([0, 0, 1]), 3, rng.random() < 0.9, rng.random() < 0.95, rng.random() < 0.03))
    return out


def _run(spark, path, checkpoint, sink):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = timed_alerts(stream, 0.5, CONFIG).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def _keys(df):
    return sorted(map(tuple, df.select("car_id", "proposal_number", "proposal_time", "resolution_time", "resolution_type", "unresolved").collect()))


def test_stream_with_timers_equals_batch(spark, tmp_path):
    rows = sorted(_rows(1), key=lambda r: (r[3] + random.Random(r[2]).uniform(0, 3.0)))  # within the bound of 4
    paths = [str(tmp_path / x) for x in ("in", "cp", "out")]

    def put(part):
        spark.createDataFrame(pd.DataFrame(part, columns=[c.split()[0] for c in SCHEMA.split(", ")]), SCHEMA).coalesce(1).write.mode("append").parquet(paths[0])

    size = len(rows) // 3
    put(rows[:size])
    put(rows[size : 2 * size])
    _run(spark, *paths)
    put(rows[2 * size :])
    # Restarted from its checkpoint; a car that has been silent for long is closed by its timer, and a row from long ago is late.
    _run(spark, *paths)
    batch = _keys(run_alerts(spark.createDataFrame(rows, SCHEMA), [0.5], CONFIG))
    out = spark.read.parquet(paths[2])
    assert out.where("late_time is not null").count() == 0
    got = _keys(out.drop("late_time").unionByName(drain(spark, paths[1], 0.5, CONFIG)))
    # Of a car that fell silent, a timer may have closed what a batch leaves open to its end.
    closed = {r[:2] for r in got if r[4] == "horizon_elapsed"}
    timed = [(*r[:3], r[2] + CONFIG.horizon, "horizon_elapsed", False) if r[4] == "stream_end" and r[:2] in closed else r for r in batch]
    assert got == timed and len(got) > 20 and sum(a != b for a, b in zip(batch, timed, strict=True)) < 5


def test_timer_closes_without_a_further_row_and_late_rows_come_out(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "cp", "out")]
    row = lambda car, i, t, score: ("C", car, i, t, score, "left", 0, 3, True, True, False)
    parts = [[row("a", i, 10.0 + i / 2, 0.9) for i in range(4)], [row("b", i, 40.0 + i, 0.2) for i in range(3)], [row("b", 3, 37.0, 0.2), row("b", 4, 50.0, 0.2)], [row("b", 5, 39.0, 0.2), row("b", 6, 45.9, 0.2)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(paths[0])
        _run(spark, *paths)
    out = spark.read.parquet(paths[2])
    closed = out.where("late_time is null").collect()
    assert [(r.car_id, r.proposal_time, r.resolution_time, r.resolution_type) for r in closed] == [("a", 10.5, 14.5, "horizon_elapsed")]
    # After 50 all up to 46 is settled: 45.9 comes out, 39 is older than Spark's watermark of 42.
    assert [r.late_time for r in out.where("late_time is not null").collect()] == [45.9]


@pytest.mark.parametrize("timely", [False, True])
def test_a_row_after_the_horizon_decides_only_without_timers(spark, timely):
    config = ProposalConfig(4.0, 1, 1.0, timely)
    rows = [("C", "a", 0, 10.0, 0.9, "left", 0, 3, True, True, False), ("C", "a", 1, 20.0, 0.9, "left", 0, 3, True, False, False)]
    got = run_alerts(spark.createDataFrame(rows, SCHEMA), [0.5], config).first()
    assert (got.resolution_time, got.resolution_type) == ((14.0, "horizon_elapsed") if timely else (20.0, "outside_observed"))
