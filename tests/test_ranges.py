"""Alerts of split cars against the replay of whole ones."""

import numpy as np
import pandas as pd
import pytest

from apexframe.contracts import DataValidationError
from apexframe.operators import alert_ranges, policy
from apexframe.operators.alert_ranges import possible_states, range_function
from apexframe.operators.policy import Car, ProposalConfig, Row, Watch, run_alerts
from apexframe.plans import registry
from twins import DATA

CONFIG = ProposalConfig(horizon=1.5, persistence=3, rearm=1.0)
SCHEMA = "circuit string, car_id string, frame_index long, time_seconds double, proposal_score double, predicted_side string, predicted_bin long, n_bins long, input_valid_causal boolean, in_corridor boolean, hard_break boolean"


def _cars(seed, cars, n, calm=0.0):
    """Rows of several tempers: mostly loud, mostly quiet, blind or broken; ``calm`` is the share of cars that are loud all the time."""
    rng, out = np.random.default_rng(seed), []
    for c in range(cars):
        quiet, blind, outside, broken = (0, 0, 0, 0) if c < calm * cars else rng.choice([0.02, 0.2, 0.6], 4) * [1, 0.3, 0.2, 0.1]
        t = np.cumsum(rng.choice([0.05, 0.05, 0.3, 2.0], n, p=[0.6, 0.3, 0.08, 0.02]))
        places = rng.choice([0, 1], n, p=[0.95, 0.05]) if c % 2 else np.zeros(n, int)
        out.append(pd.DataFrame({
            "circuit": f"C{c % 2}", "car_id": f"k{c}", "frame_index": np.arange(n), "time_seconds": t, "proposal_score": np.where(rng.random(n) < quiet, 0.1, 0.9), "predicted_side": "left", "predicted_bin": places, "n_bins": 3,
            "input_valid_causal": rng.random(n) >= blind, "in_corridor": rng.random(n) >= outside, "hard_break": rng.random(n) < broken,
        }))
    return pd.concat(out)


def _plain(d, thresholds):
    found = []
    for key, rows in d.groupby(["circuit", "car_id"]):
        car = Car(thresholds, CONFIG)
        for r in rows.sort_values("frame_index").itertuples():
            found += [(*key, *p) for p in car.feed(Row(*r[4:]))]
        found += [(*key, *p) for p in car.finish()]
    return sorted(found)


def test_functions_cover_every_state_a_car_comes_in():
    d = _cars(1, 12, 400, calm=0.2)
    for _, rows in d.groupby("car_id"):
        rows = [Row(*r[4:]) for r in rows.itertuples()]
        whole = Car([0.5], CONFIG)
        states = [(whole.watches[0], whole.feed(r) and 0) for r in rows]
        numberless = alert_ranges._numberless
        for at in range(2, 400, 7):
            low = rows[at - 2].time - alert_ranges.context_reach(CONFIG)
            context = [r for i, r in enumerate(rows[:at]) if r.time >= low or i >= at - 2]
            function = range_function(possible_states(context, 0.5, CONFIG), rows[at : at + 20], 0.5, CONFIG)
            first = numberless(states[at][0])
            last = states[at + 20][0] if at + 20 < 400 else whole.watches[0]
            assert function[first] == (numberless(last), last.number - states[at][0].number)


@pytest.mark.parametrize("size", [2, 23, 150])
def test_split_cars_give_the_alerts_of_whole_ones(spark, monkeypatch, size):
    """Ranges shorter than the past that matters, and longer ones; short and long cars together."""
    monkeypatch.setattr(alert_ranges, "RANGE_ROWS", size)
    d = pd.concat([_cars(3, 6, 300, calm=0.3), _cars(4, 2, 20).assign(circuit="S")])
    got = run_alerts(spark.createDataFrame(d, SCHEMA), [0.5, 0.05], CONFIG)
    assert sorted(map(tuple, got.collect())) == _plain(d, [0.5, 0.05])


def test_time_must_rise_across_ranges_too(spark, monkeypatch):
    monkeypatch.setattr(alert_ranges, "RANGE_ROWS", 10)
    d = _cars(5, 1, 40)
    d.loc[20, "time_seconds"] = d.loc[19, "time_seconds"]
    with pytest.raises(Exception, match="strictly increasing"):
        run_alerts(spark.createDataFrame(d, SCHEMA), [0.5], CONFIG).collect()
    assert issubclass(DataValidationError, ValueError) and Watch() == Watch("watching")


def test_short_ranges_share_frames():
    class Rows:
        def mapInPandas(self, run, schema):  # noqa: N802
            return list(run(iter([])))

    got = alert_ranges._mapped(Rows(), lambda frames: ((str(i), i) for i in range(25_000)), "a string, b long")
    assert [len(f) for f in got] == [10_000, 10_000, 5_000] and list(got[2].columns) == ["a", "b"] and got[2].b.iloc[-1] == 24_999


def test_alerts_of_exact_bins_are_made_once(spark, monkeypatch):
    made, run = [], policy.run_alerts
    monkeypatch.setattr(policy, "run_alerts", lambda *a: (made.append(1), run(*a))[1])
    assert registry.QUERIES["exact_bins"](spark, DATA).count() > 0 and len(made) == 1
