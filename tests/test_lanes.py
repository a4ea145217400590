"""Alerts of many cars in lanes against the automaton that takes a car's rows one by one."""

import numpy as np
import pandas as pd
import pytest

from apexframe.contracts import DataValidationError
from apexframe.operators import alert_lanes as N
from apexframe.operators import policy as P


def _cars(rng, lengths):
    n = sum(lengths)
    rows = pd.DataFrame({"circuit": "C", "car_id": np.repeat([f"k{i}" for i in range(len(lengths))], lengths), "time_seconds": np.cumsum(rng.choice([0.5, 1.0, 2.0, 7.0], n)), "proposal_score": rng.random(n)})
    rows["predicted_side"] = rng.choice(["left", "right"], n, p=[0.95, 0.05])
    rows["predicted_bin"], rows["n_bins"] = rng.choice([0, 1], n, p=[0.9, 0.1]), 3
    flags = pd.DataFrame({"broken": rng.random(n) < 0.04, "inside": rng.random(n) < 0.95, "valid": rng.random(n) < 0.95})
    grave = np.select([flags.broken, ~flags.inside, ~flags.valid], [1, 2, 3], 0)
    rows["sight"] = grave + 4 * flags.inside + 8 * flags.valid
    return rows, flags


@pytest.mark.parametrize("persistence", [1, 3])
@pytest.mark.parametrize("timely", [False, True])
@pytest.mark.parametrize("few", [1, 8, 1000])
def test_lanes_give_the_proposals_of_single_cars(monkeypatch, persistence, timely, few):
    monkeypatch.setattr(N, "FEW_CARS", few)
    rng, config, thresholds = np.random.default_rng(7), P.ProposalConfig(4.0, persistence, 1.5, timely), [0.05, 0.2, 0.9]
    rows, flags = _cars(rng, [*rng.integers(1, 90, 60), 400, 1])
    want = []
    for (circuit, car_id), own in rows.groupby(["circuit", "car_id"]):
        car = P.Car(thresholds, config)
        for i, r in own.iterrows():
            want += [(circuit, car_id, *p) for p in car.feed(P.Row(r.time_seconds, r.proposal_score, r.predicted_side, r.predicted_bin, r.n_bins, *flags.loc[i, ["valid", "inside", "broken"]]))]
        want += [(circuit, car_id, *p) for p in car.finish()]
    got = N.replay(rows, N._begins(rows), thresholds, config)
    assert len(want) > 200
    assert {p[9] for p in want} == {"hard_break", "outside_observed", "horizon_elapsed", "stream_end"}
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(want)


def test_chunks_keep_cars_whole(monkeypatch):
    monkeypatch.setattr(N, "CHUNK_ROWS", 50)
    rows, _ = _cars(np.random.default_rng(1), [30, 30, 70, 1, 1, 40])
    found = list(N.chunks(rows[i : i + 16] for i in range(0, len(rows), 16)))
    assert len(found) > 2
    pd.testing.assert_frame_equal(pd.concat([r for r, _ in found], ignore_index=True), rows)
    assert [len(set(r.car_id)) for r, _ in found] == [len(b) for _, b in found]
    assert sum(len(b) for _, b in found) == 6


def test_lanes_refuse_rows_out_of_order():
    rows, _ = _cars(np.random.default_rng(2), [5, 5])
    rows.loc[7, "time_seconds"] = rows.loc[6, "time_seconds"]
    with pytest.raises(DataValidationError):
        N.replay(rows, N._begins(rows), [0.5], P.ProposalConfig())
