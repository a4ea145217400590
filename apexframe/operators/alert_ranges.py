"""The alert automaton over cars of any length: ranges of rows as functions of the state they start in.

1. A car's rows are cut into ranges of bounded size, which tasks take apart from each other.
2. A range does not know its first state, but only few are possible: a proposal opened at a row within one horizon before the range, a rest that began within
   the rest's length or that such a proposal left, a run of loud rows, or nothing. Those rows come along as context. The range is replayed for all of them at
   once; states that become equal go on as one, which they soon do. The result is a table from first to last state and the number of proposals opened.
3. The tables of a car, one row a range, are composed in order: every range gets the state it really starts in.
4. The ranges are replayed from there and give the proposals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.operators.policy import PROPOSAL_SCHEMA, ROW, Car, ProposalConfig, Row, Watch, advance, coded, decoded
from apexframe.operators.timebase import UNIT
from apexframe.ranks import positions
from apexframe.scratch import stored

#: Rows of a range, two at least.
RANGE_ROWS = 100_000
#: Rows of a frame that a task hands back.
FRAME_ROWS = 10_000
_PLACE = [*UNIT, "__range"]


def possible_states(context: list[Row], threshold: float, config: ProposalConfig) -> list[Watch]:
    """All states a car may be in after ``context``, the rows within :func:`context_reach` before a range; numbers are zero."""
    found = [Watch()]
    if not context:
        return found
    last = context[-1]
    found += [Watch(run=(last.side, last.bin, n)) for n in range(1, config.persistence)]
    found.append(Watch("resting"))
    for row in context:
        found.append(Watch("resting", rested_since=row.time))
        if row.sight(threshold) == "loud":
            found.append(Watch("open", proposal=(0, row.time, row.side, row.bin, row.bins)))
            found.append(Watch("resting", rested_since=row.time + config.horizon))
    return found


def context_reach(config: ProposalConfig) -> float:
    """Seconds before the last but one row of the past in which a proposal may have opened that still matters."""
    return config.horizon + config.rearm + 1e-9


def _numberless(watch: Watch) -> Watch:
    return watch._replace(number=0, proposal=None if watch.proposal is None else (0, *watch.proposal[1:]))


def range_function(states: list[Watch], rows: list[Row], threshold: float, config: ProposalConfig) -> dict[Watch, tuple[Watch, int]]:
    """For each first state the last one and how many proposals were opened on the way."""
    groups: dict[Watch, list[list]] = {s: [[s, 0]] for s in states}  # present state -> [first state, opened]
    for row in rows:
        after: dict[Watch, list[list]] = {}
        for state, members in groups.items():
            new, _ = advance(state, row, threshold, config)
            if new.number:
                for m in members:
                    m[1] += 1
            after.setdefault(_numberless(new), []).extend(members)
        groups = after
    return {first: (state, n) for state, members in groups.items() for first, n in members}


def _groups(frames: Iterator[pd.DataFrame], keys: list[str], names: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    rows = (r for pdf in frames for r in pdf[[*keys, *names]].itertuples(index=False, name=None))
    n = len(keys)
    for key, group in groupby(rows, lambda r: r[:n]):
        yield key, (r[n:] for r in group)


def _in_order(rows: list[Row], before: Row | None) -> None:
    for a, b in zip([before, *rows] if before else rows, rows if before else rows[1:], strict=False):
        if not b.time > a.time:
            raise DataValidationError("rows of a car must come in strictly increasing time")


def run_long_alerts(scores: DataFrame, thresholds: list[float], config: ProposalConfig, range_rows: int | None = None) -> DataFrame:
    """Proposals as :func:`apexframe.operators.policy.run_alerts` gives them, with each car spread over many tasks, ``range_rows`` (RANGE_ROWS) rows each."""
    size = range_rows or RANGE_ROWS
    placed = positions(scores.select(*UNIT, "frame_index", *ROW), UNIT, ["frame_index"], "__pos", "__n")
    placed = stored(placed.withColumn("__range", F.expr(f"__pos DIV {size}")), "alert-rows")
    # Where the past that matters to a range begins: a row for each range.
    last_two = F.expr(f"__pos % {size} >= {size - 2}")
    ends = placed.groupBy(*_PLACE).agg(F.max("time_seconds").alias("last"), F.min(F.when(last_two, F.col("time_seconds"))).alias("second"), F.max("__pos").alias("__end"), F.max("__n").alias("__n"))
    ends = stored(ends, "alert-ranges")
    need = ends.where("__end + 1 < __n").select(*UNIT, (F.col("__range") + 1).alias("__for"), (F.col("second") - context_reach(config)).alias("low"))
    # A range's rows are context of every later range whose past reaches back into it, nearly always of the next one alone.
    met = ends.alias("e").join(need.alias("n"), [F.col(f"e.{k}") == F.col(f"n.{k}") for k in UNIT] + [F.col("n.__for") > F.col("e.__range"), (F.col("n.low") <= F.col("e.last")) | (F.col("n.__for") == F.col("e.__range") + 1)])
    met = met.select(*(f"e.{k}" for k in _PLACE), "n.__for", "n.low")
    context = placed.join(met, _PLACE).where((F.col("time_seconds") >= F.col("low")) | ((F.col("__for") == F.col("__range") + 1) & last_two))
    own = placed.withColumn("__past", F.lit(False))
    rows = own.drop("__n").unionByName(context.withColumn("__range", F.col("__for")).withColumn("__past", F.lit(True)).drop("__for", "low", "__n"))

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for key, group in _groups(frames, _PLACE, ["__past", *ROW]):
            past, mine = [], []
            for old, *row in group:
                (past if old else mine).append(Row(*row))
            _in_order(mine, past[-1] if past else None)
            for threshold in thresholds:
                for first, (last, opened) in range_function(possible_states(past, threshold, config) if key[-1] else [Watch()], mine, threshold, config).items():
                    yield *key, threshold, coded(first), coded(last), opened

    # Ranges are dealt to as many tasks as the session has partitions, as Python's share of the work is large where the bytes are few.
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *_PLACE).sortWithinPartitions(*_PLACE, "__pos")
    table = stored(_mapped(rows, tables, "circuit string, car_id string, __range long, threshold double, first string, last string, opened long"), "alert-functions")

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for key, group in _groups(frames, [*UNIT, "threshold"], ["__range", "first", "last", "opened"]):
            state, number = coded(Watch()), 0
            for at, function in groupby(group, lambda r: r[0]):
                step = {first: (last, n) for _, first, last, n in function}
                if state not in step:
                    raise AssertionError(f"range {at} of {key} can't start in {state}")
                yield *key[:-1], at, key[-1], state, number
                state, number = step[state][0], number + step[state][1]

    starts = table.repartition(parts, *UNIT, "threshold").sortWithinPartitions(*UNIT, "threshold", "__range")
    starts = _mapped(starts, compose, "circuit string, car_id string, __range long, threshold double, state string, number long")
    starts = starts.groupBy(*_PLACE).agg(F.collect_list(F.struct("threshold", "state", "number")).alias("starts"))  # a state for each threshold

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for key, group in _groups(frames, _PLACE, ["starts", "__end", *ROW]):
            begun, ends_here, *_ = next(group)
            car, known = Car(thresholds, config), {s["threshold"]: s for s in begun}
            car.watches = [_numbered(decoded(known[t]["state"]), known[t]["number"]) for t in thresholds]
            for _, _, *row in group:
                yield from ((*key[:-1], *p) for p in car.feed(Row(*row)))
            if ends_here:
                yield from ((*key[:-1], *p) for p in car.finish())

    blank = {"time_seconds": F.lit(0.0), "proposal_score": F.lit(0.0), "predicted_side": F.lit("")} | {c: F.lit(False) for c in ROW[5:]}
    last_range = (F.col("__end") + 1 == F.col("__n")).alias("__end")
    begins = starts.join(ends.select(*_PLACE, last_range), _PLACE).withColumns(blank | {"frame_index": F.lit(-1), "__pos": F.lit(-1), "predicted_bin": F.lit(0), "n_bins": F.lit(0)})
    mine = own.drop("__past", "__n").withColumns({"starts": F.lit(None).cast(begins.schema["starts"].dataType), "__end": F.lit(False)})
    both = mine.unionByName(begins.select(*(F.col(c).cast(mine.schema[c].dataType) for c in mine.columns)))
    return _mapped(both.repartition(parts, *_PLACE).sortWithinPartitions(*_PLACE, "__pos"), replay, PROPOSAL_SCHEMA)


def _mapped(rows: DataFrame, each: Callable[[Iterator[pd.DataFrame]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``each`` makes of a task's frames, in frames of FRAME_ROWS; one for each short range would cost far more than its rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = each(frames)
        while batch := list(islice(found, FRAME_ROWS)):
            yield pd.DataFrame(batch, columns=names)

    return rows.mapInPandas(run, schema)


def _numbered(watch: Watch, number: int) -> Watch:
    return watch._replace(number=number, proposal=None if watch.proposal is None else (number, *watch.proposal[1:]))
