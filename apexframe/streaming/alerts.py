"""The alert policy as a stateful stream: the same transitions as the batch replay."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from apexframe.operators.policy import PROPOSAL_SCHEMA, ROW, Car, ProposalConfig, Row
from apexframe.operators.timebase import UNIT


def stream_alerts(scores: DataFrame, threshold: float, config: ProposalConfig) -> DataFrame:
    """Closed proposals of a stream of score rows; each car's watch is the state.

    Rows of a batch are sorted by car and time; a row that isn't later than the car's last one is an error, as in batch. A proposal
    still open when the stream ends isn't emitted: only the end of a batch replay can call that "stream_end".
    """
    names = [c.split()[0] for c in PROPOSAL_SCHEMA.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        car = pickle.loads(state.get[0]) if state.exists else Car([threshold], config)
        rows = pd.concat(list(frames)).sort_values("frame_index")[ROW]
        out = [(*key, *p) for row in rows.itertuples(index=False, name=None) for p in car.feed(Row(*row))]
        state.update((pickle.dumps(car),))
        yield pd.DataFrame(out, columns=names)

    return scores.groupBy(*UNIT).applyInPandasWithState(step, PROPOSAL_SCHEMA, "watch binary", "append", GroupStateTimeout.NoTimeout)
