"""Contracts between operators: required columns, key sets, and leak guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prefixes of columns that tell the future; none may reach a causal table.
FUTURE_PREFIXES = ("next_", "time_to_next", "outcome_", "qualifying_", "candidate_")


class DataValidationError(ValueError):
    """The input breaks an operator's contract."""


def require_columns(df: DataFrame, names) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise DataValidationError(f"missing columns: {missing}")


def forbid_future_columns(df: DataFrame, prefixes=FUTURE_PREFIXES) -> None:
    if leaks := [c for c in df.columns if c.startswith(tuple(prefixes))]:
        raise DataValidationError(f"columns that tell the future: {leaks}")


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _keys_on_both(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either side, with how often each side has them (null: never)."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__b"))
    return a.join(b, keys, "full")


def join_matched(left: DataFrame, right: DataFrame, keys: list[str], many: bool = False) -> DataFrame:
    """``left`` with the columns of ``right``; raises DataValidationError unless every left row has exactly one match.

    Without ``many`` the match is one-to-one and both sides must hold the same keys, neither of them none; with ``many`` several
    left rows may share a key, and ``right`` may have more. A key with a null matches nothing, so it raises. The check is one
    aggregate over the keys of both sides, made before the join; repeated keys are counted where they lie.
    """
    require_columns(left, keys)
    require_columns(right, keys)
    n = lambda c: F.count_if(c)
    found = _keys_on_both(left, right, keys).agg(
        n(F.col("__b").isNull()).alias("unmatched"), n(F.col("__a").isNull()).alias("unused"), n(F.col("__a") > 1).alias("repeated_left"), n(F.col("__b") > 1).alias("repeated_right"), F.count(F.lit(1)).alias("keys"),
    ).first()
    wrong = ["unmatched", "repeated_right"] + ([] if many else ["unused", "repeated_left"])
    if bad := {c: found[c] for c in wrong if found[c]}:
        raise DataValidationError(f"join on {keys}: {bad}")
    if not found["keys"] and not many:
        raise DataValidationError(f"join on {keys}: both sides are empty")
    return left.join(right, keys)


def join_frames_targets(frames: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with their targets, one to one; frames may not hold columns that tell the future."""
    forbid_future_columns(frames)
    return join_matched(frames, targets, keys)


def attach_partition(rows: DataFrame, splits: DataFrame, fold: str, unit: list[str]) -> DataFrame:
    """``rows`` with fold_test_circuit and partition of one fold; raises DataValidationError for a split that isn't one.

    A unit has one partition out of fit, calibration and test; the fold's circuit is the whole of test and nothing else is;
    every row's unit is assigned.
    """
    require_columns(splits, ["fold_test_circuit", "partition", *unit])
    chosen = splits.where(F.col("fold_test_circuit") == fold).select(*unit, "fold_test_circuit", "partition")
    known = F.coalesce(F.col("partition").isin("fit", "calibration", "test"), F.lit(False))
    found = chosen.agg(F.count(F.lit(1)).alias("n"), F.count_if(~known).alias("unknown"), F.count_if((F.col("circuit") == fold) != (F.col("partition") == "test")).alias("leaked")).first()
    if not found["n"]:
        raise DataValidationError(f"no fold {fold}")
    if found["unknown"] or found["leaked"]:
        raise DataValidationError(f"fold {fold}: {found['unknown']} unknown partitions, {found['leaked']} units on the wrong side of the test")
    return join_matched(rows, chosen, unit, many=True)


def key_set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys only on the left, only on the right, on both, and repeated on either side; one join pass."""
    both = _keys_on_both(left, right, keys)
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return both.agg(
        n(F.col("__b").isNull()).alias("left_only"),
        n(F.col("__a").isNull()).alias("right_only"),
        n(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("shared"),
        n((F.col("__a") > 1) | (F.col("__b") > 1)).alias("repeated"),
    )
