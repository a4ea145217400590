"""The alert policy in event time: rows in any order within a bound, proposals closed by timers, late rows aside, and a drain at the end."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from apexframe.operators.policy import PROPOSAL_SCHEMA, ROW, ProposalConfig, Row, Watch, advance, coded, decoded, elapsed
from apexframe.operators.timebase import UNIT

#: A closed proposal, or a late row, which has its time in ``late_time`` and no proposal.
TIMED_SCHEMA = PROPOSAL_SCHEMA + ", late_time double"
NAMES = [c.split()[0] for c in TIMED_SCHEMA.split(", ")]
STATE = "car string"
#: Seconds that event time is ahead of a car's clock, as Spark takes rows at its first watermark, the epoch, for late.
AHEAD = 86_400
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TimedCar:
    """One car: the watch, the time of the last row fed, the time up to which all is settled, the rows that wait for their turn, and the timer that is set."""

    def __init__(self, threshold: float, config: ProposalConfig, text: str | None = None):
        self.threshold, self.config = threshold, config
        watch, self.fed, self.settled, waiting, *timer = json.loads(text) if text else (None, None, None, [], None)
        self.timer = timer[0] if timer else None  # states of older checkpoints don't name it
        self.watch = decoded(watch) if watch else Watch()
        self.waiting = [Row(*r) for r in waiting]

    def text(self) -> str:
        return json.dumps([coded(self.watch), self.fed, self.settled, self.waiting, self.timer])

    def take(self, rows: list[Row]) -> list[float]:
        """Puts rows in order; returns the times of those that come too late."""
        late = [r.time for r in rows if self._late(r)]
        self.waiting = sorted([*self.waiting, *(r for r in rows if not self._late(r))], key=lambda r: r.time)
        return late

    def _late(self, row: Row) -> bool:
        return self.settled is not None and row.time <= self.settled

    def release(self, until: float) -> list[tuple]:
        """Feeds what waits up to ``until`` and closes a proposal whose horizon is over by then."""
        out, due = [], bisect_right(self.waiting, until, key=lambda r: r.time)
        ready, self.waiting = self.waiting[:due], self.waiting[due:]
        for row in ready:
            if self.fed is not None and row.time <= self.fed:
                continue  # two rows at one time: the first counts
            self.watch, done = advance(self.watch, row, self.threshold, self.config)
            self.fed = row.time
            out += [done] if done else []
        if done := elapsed(self.watch, until, self.config):
            self.watch, closed = done
            out.append(closed)
        self.settled = until if self.settled is None else max(self.settled, until)
        return out

    def next_time(self) -> float | None:
        """When something is due: the next row, or the end of the open horizon."""
        due = [self.waiting[0].time] if self.waiting else []
        if self.watch.proposal is not None:
            due.append(self.watch.proposal[1] + self.config.horizon)
        return min(due, default=None)

    def finish(self) -> list[tuple]:
        """All that waits, and what is open at the last row: the stream's end."""
        last = self.waiting[-1].time if self.waiting else self.fed
        out = self.release(last) if last is not None else []
        closed = self.watch.closed(last, "stream_end", True)
        return out + ([closed] if closed else [])


class AlertProcessor(StatefulProcessor):
    """Keeps a :class:`TimedCar` for each key; rows are fed once the watermark is within ``lateness`` of them."""

    def __init__(self, threshold: float, config: ProposalConfig, lateness: float):
        self.threshold, self.config, self.lateness = threshold, config, lateness

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("car", STATE)

    def _car(self) -> TimedCar:
        held = self.state.get()
        return TimedCar(self.threshold, self.config, held[0] if held else None)

    def _step(self, key: tuple, car: TimedCar, watermark: int, late: list[float], fired: int | None = None) -> Iterator[pd.DataFrame]:
        """Each call of the handle goes to the JVM and back, so the timer that is set is known from the state."""
        proposals = car.release(watermark / 1000 - AHEAD + self.lateness) if watermark > 0 else []
        due = car.next_time()
        timer = None if due is None else max(watermark + 1, int((due + AHEAD - self.lateness) * 1000) + 1)
        if timer != car.timer:
            if car.timer not in (None, fired):
                self.handle.deleteTimer(car.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        car.timer = timer
        self.state.update((car.text(),))
        rows = [(*key, self.threshold, *p, None) for p in proposals] + [(*key, self.threshold, *([None] * (len(NAMES) - 4)), t) for t in late]
        if rows:
            yield pd.DataFrame(rows, columns=NAMES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        car = self._car()
        late = car.take([Row(*r) for pdf in rows for r in pdf[ROW].itertuples(index=False, name=None)])
        yield from self._step(key, car, timerValues.getCurrentWatermarkInMs(), late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._step(key, self._car(), timerValues.getCurrentWatermarkInMs(), [], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def timed_alerts(scores: DataFrame, threshold: float, config: ProposalConfig, lateness: float | None = None) -> DataFrame:
    """Closed proposals and late rows (TIMED_SCHEMA) of a stream of score rows that come in any order; times aren't negative.

    Rows up to ``lateness`` (one horizon) behind the newest row are put in order; later ones, up to twice as late, come out with their
    ``late_time``; even later ones are dropped and counted by Spark. A proposal closes when its horizon is over in event time, with no need for another row of its
    car (``timely`` of the policy), so where a batch replay ends a silent car's proposal with ``stream_end``, the stream may have closed it. What is still open or waiting when the stream stops is given by :func:`drain`. The state goes to RocksDB.
    """
    lateness = config.horizon if lateness is None else lateness
    scores.sparkSession.conf.set(PROVIDER, ROCKS)
    timed = scores.withColumn("event_time", F.timestamp_micros(((F.col("time_seconds") + AHEAD) * 1e6).cast("long"))).withWatermark("event_time", f"{int(2 * lateness * 1000)} milliseconds")
    processor = AlertProcessor(threshold, _timely(config), lateness)
    return timed.groupBy(*UNIT).transformWithStateInPandas(statefulProcessor=processor, outputStructType=TIMED_SCHEMA, outputMode="Append", timeMode="EventTime")


def drain(spark: SparkSession, checkpoint: str, threshold: float, config: ProposalConfig) -> DataFrame:
    """What a stopped stream still held, from its checkpoint: waiting rows are fed, and an open proposal ends with ``stream_end``."""
    held = spark.read.format("statestore").option("stateVarName", "car").load(checkpoint).select("key.*", F.col("value.car").alias("car"))
    timely, names = _timely(config), NAMES[:-1]

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(*key, threshold, *p) for *key, text in pdf.itertuples(index=False, name=None) for p in TimedCar(threshold, timely, text).finish()], columns=names)

    return held.mapInPandas(finish, PROPOSAL_SCHEMA)


def _timely(config: ProposalConfig) -> ProposalConfig:
    return ProposalConfig(config.horizon, config.persistence, config.rearm, True)
