"""The alert automaton over many whole cars at once: the n-th rows of all cars are one step in arrays, a lane for each car and threshold.

The rules are those of :func:`apexframe.operators.policy.advance`, which takes over where few cars are still under way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.operators.policy import PROPOSAL_SCHEMA, Car, ProposalConfig, Row, Watch
from apexframe.operators.timebase import UNIT

#: Rows that a task takes at once, about; a car stays whole.
CHUNK_ROWS = 200_000
#: Cars below which their rows are taken one by one.
FEW_CARS = 8
_NONE, _BREAK, _OUTSIDE, _BLIND = range(4)
_WATCHING, _OPEN, _RESTING = range(3)
_PHASES = ("watching", "open", "resting")
_KINDS = ("hard_break", "outside_observed", "horizon_elapsed", "stream_end")
_UNRESOLVED = np.array([True, False, False, True])
#: Columns that :func:`replay` takes, in order of UNIT and frame_index.
COLUMNS = [*UNIT, "time_seconds", "proposal_score", "predicted_side", "predicted_bin", "n_bins", "sight"]


def sight() -> Column:
    """What a row shows whatever the threshold, as a number: the gravest (see :meth:`apexframe.operators.policy.Row.grave`), 4 if inside, 8 if valid; null counts as false."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    grave = F.when(holds("hard_break"), _BREAK).when(~holds("in_corridor"), _OUTSIDE).when(~holds("input_valid_causal"), _BLIND).otherwise(_NONE)
    return (grave + 4 * holds("in_corridor").cast("int") + 8 * holds("input_valid_causal").cast("int")).alias("sight")


def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole cars, with the place each car begins at."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) >= CHUNK_ROWS:
            rows = pd.concat(held, ignore_index=True)
            last = _begins(rows)[-1]
            if last:
                yield (whole := rows[:last]), _begins(whole)
            held = [rows[last:].reset_index(drop=True)]
    if sum(map(len, held)):
        rows = pd.concat(held, ignore_index=True)
        yield rows, _begins(rows)


def _begins(rows: pd.DataFrame) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in UNIT:
        codes = pd.factorize(rows[c])[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def replay(rows: pd.DataFrame, begins: np.ndarray, thresholds: list[float], config: ProposalConfig) -> pd.DataFrame:
    """Proposals of the cars that begin at the places given."""
    time, score, side, bins, code = (rows[c].to_numpy() for c in ("time_seconds", "proposal_score", "predicted_side", "predicted_bin", "sight"))
    later = np.ones(len(rows), bool)
    later[1:] = time[1:] > time[:-1]
    later[begins] = True
    if not later.all():
        raise DataValidationError("rows of a car must come in strictly increasing time")
    grave, inside, valid, places = code & 3, code & 4 > 0, code & 8 > 0, pd.factorize(rows["predicted_side"])[0]
    length = np.diff(np.append(begins, len(rows)))
    order = np.argsort(-length, kind="stable")  # so that the cars under way are the first lanes
    begins, length = begins[order], length[order]
    limits = np.asarray(thresholds, float)[:, None]
    shape = (len(thresholds), len(begins))
    phases, numbers, run_rows, run_lengths, opened = np.zeros(shape, np.int8), np.zeros(shape, np.int64), np.full(shape, -1), np.zeros(shape, np.int64), np.full(shape, -1)
    rests, rest_since = np.zeros(shape, bool), np.zeros(shape)
    found: list[tuple] = []  # arrays of threshold, row that opened, number, time, kind

    def close(mask: np.ndarray, at: np.ndarray, kind: int) -> None:
        if mask.any():
            t, n = np.nonzero(mask)
            found.append((t, opened[t, n], numbers[t, n], np.broadcast_to(at, mask.shape)[t, n], np.full(len(t), kind)))

    step, under_way = 0, len(begins)
    while (under_way := np.searchsorted(-length[:under_way], -step)) >= FEW_CARS:
        at = begins[:under_way] + step
        phase, number, run_row, run_length, open_row, rest, since = (a[:, :under_way] for a in (phases, numbers, run_rows, run_lengths, opened, rests, rest_since))
        now, shows = time[at], grave[at]
        proposed = phase == _OPEN
        ends = time[open_row] + config.horizon  # of an open proposal
        over = proposed & (now + 1e-12 >= ends)
        if config.timely and over.any():
            close(over, ends, 2)
            phase[over], rest[over] = _RESTING, True
            since[over] = ends[over]
            proposed, over = proposed & ~over, np.zeros_like(over)
        watching, resting = phase == _WATCHING, phase == _RESTING
        broken, outside, blind = shows == _BREAK, shows == _OUTSIDE, shows == _BLIND

        left = proposed & outside
        over &= ~(broken | outside)
        close(proposed & broken, now, 0)
        close(left, now, 1)
        close(over, ends, 2)
        halted = broken & ~(watching & inside[at])
        lost = left | (~broken & ~proposed & (outside | (blind & resting)))
        free = ~broken & ~proposed & ~lost
        starts_rest = free & resting & ~rest
        awake = free & (watching | (resting & rest & ~(now - since + 1e-12 < config.rearm)))
        loud = awake & (shows == _NONE) & (score[at] + 1e-15 >= limits)
        same = loud & (run_row >= 0) & (places[run_row] == places[at]) & (bins[run_row] == bins[at])
        run = np.where(loud, 1 + np.where(same, run_length, 0), 0)
        begun = loud & (run >= config.persistence)

        # Only rows that change something are written.
        quiet = (broken & ~halted) | awake
        phase[quiet] = _WATCHING
        phase[begun] = _OPEN
        phase[halted | lost | over] = _RESTING
        rest[quiet | lost] = False
        rest[halted] = np.broadcast_to(inside[at] & valid[at], rest.shape)[halted]
        rest[over | starts_rest] = True
        since[halted | starts_rest] = np.broadcast_to(now, since.shape)[halted | starts_rest]
        since[over] = ends[over]
        number[begun] += 1
        open_row[begun] = np.broadcast_to(at, open_row.shape)[begun]
        running = loud & ~begun
        run_row[quiet | lost | halted] = -1
        run_row[running] = np.broadcast_to(at, run_row.shape)[running]
        run_length[running] = run[running]
        step += 1

    # Cars that have ended, and the few that go on.
    ended = phases == _OPEN
    ended[:, :under_way] = False
    close(ended, time[begins + length - 1], 3)
    size, alone = rows["n_bins"].to_numpy(), []
    for lane in range(under_way):
        first, last, car = begins[lane], begins[lane] + length[lane], Car(thresholds, config)
        for i in range(len(thresholds)):
            number, r, o = int(numbers[i, lane]), run_rows[i, lane], opened[i, lane]
            run = (side[r], bins[r], int(run_lengths[i, lane])) if r >= 0 else None
            proposal = (number, time[o], side[o], bins[o], size[o]) if phases[i, lane] == _OPEN else None
            car.watches[i] = Watch(_PHASES[phases[i, lane]], number, run, proposal, rest_since[i, lane] if rests[i, lane] else None)
        left = zip(*(a[first + step : last].tolist() for a in (time, score, side, bins, size, valid, inside, grave == _BREAK)), strict=True)
        closed, key = [p for row in left for p in car.feed(Row(*row))], tuple(rows.loc[first, UNIT])
        alone += [(*key, *p) for p in closed + car.finish()]
    return _proposals(rows, thresholds, found, alone)


def _proposals(rows: pd.DataFrame, thresholds: list[float], found: list[tuple], alone: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PROPOSAL_SCHEMA.split(", ")]
    one_by_one = pd.DataFrame(alone, columns=names)
    if not found:
        return one_by_one
    threshold, row, number, at, kind = (np.concatenate(a) for a in zip(*found, strict=True))
    of = rows.iloc[row].reset_index(drop=True)
    together = pd.DataFrame(
        {
            **{c: of[c] for c in UNIT}, "threshold": np.asarray(thresholds, float)[threshold], "proposal_number": number, "proposal_time": of["time_seconds"], "predicted_side": of["predicted_side"],
            "predicted_bin": of["predicted_bin"], "n_bins": of["n_bins"], "resolution_time": at, "resolution_type": np.array(_KINDS, object)[kind], "unresolved": _UNRESOLVED[kind],
        }
    )
    return pd.concat([together, one_by_one], ignore_index=True) if alone else together
