"""Exits of states that move on by a kinematic rule: row identities, paths, and the first exit by horizon.

A state becomes one row for each step of its path; positions are running sums over the steps, moves pass the
corridor's first-exit rule, and the earliest exit of a state is its outcome. All of it is column work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.operators.geometry import first_exit, locate

STEP = 0.05


def row_identity(seed: int, fold: str, method: str, prefix: str = "row-seed-v1:") -> Column:
    """Identity of a score row: compact JSON with sorted names, over circuit, car_id and frame_index."""
    fields = F.struct(F.lit(seed).alias("base_seed"), F.col("car_id").alias("car"), "circuit", "frame_index", F.lit(method).alias("method"), F.lit(fold).alias("outer_fold"))
    return F.concat(F.lit(prefix), F.to_json(fields))


def row_seed(identity: Column) -> Column:
    """The first eight bytes of the identity's SHA-256 as a little-endian number."""
    digest = F.sha2(identity, 256)
    swapped = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in reversed(range(8))))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def constant_paths(states: DataFrame, horizon: float, turns: bool, dt: float = STEP) -> DataFrame:
    """(id, step, x, y, x2, y2): the moves of states (id, x, y, v_long, v_lat, yaw, yaw_rate) whose body velocity stays.

    ``turns``: the yaw rate stays too, and a step goes along the heading at its middle; otherwise the heading stays. States with a null are left out.
    """
    steps = round(horizon / dt)
    rate = F.col("yaw_rate") if turns else F.lit(0.0)
    d = states.na.drop(subset=["x", "y", "v_long", "v_lat", "yaw", "yaw_rate"]).select("id", "x", "y", "v_long", "v_lat", "yaw", rate.alias("rate"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    mid = F.col("yaw") + F.col("rate") * ((F.col("step") - 0.5) * dt)
    d = d.withColumns({"mx": (F.col("v_long") * F.cos(mid) - F.col("v_lat") * F.sin(mid)) * dt, "my": (F.col("v_long") * F.sin(mid) + F.col("v_lat") * F.cos(mid)) * dt})
    upto = Window.partitionBy("id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"x2": F.col("x") + F.sum("mx").over(upto), "y2": F.col("y") + F.sum("my").over(upto)})
    return d.select("id", "step", (F.col("x2") - F.col("mx")).alias("x"), (F.col("y2") - F.col("my")).alias("y"), "x2", "y2")


def first_exits(paths: DataFrame, segments: DataFrame, segment: float, dt: float = STEP) -> DataFrame:
    """(id, exit_time, exit_side, exit_bin): where each path of moves (id, step, x, y, x2, y2) first leaves; paths that stay are left out.

    The side and the bin (of ``segment`` metres along the centre line) are those of the exit point. If the segments have circuits, so have the paths.
    """
    of = ["circuit"] if "circuit" in segments.columns else []
    moves = paths.withColumn("id", F.struct("id", "step", *of))
    found = first_exit(moves, segments).select(F.col("id.id").alias("id"), *(F.col(f"id.{c}").alias(c) for c in of), ((F.col("id.step") - 1 + F.col("fraction")) * dt).alias("exit_time"), F.col("hit_x").alias("x"), F.col("hit_y").alias("y"))
    first = found.groupBy("id", *of).agg(F.min(F.struct("exit_time", "x", "y")).alias("e")).select("id", *of, "e.*")
    placed = locate(first.withColumn("id", F.struct("id", "exit_time")), segments)
    side = F.when(F.col("local_side") == "center", "unknown").otherwise(F.col("local_side"))
    return placed.select(F.col("id.id").alias("id"), F.col("id.exit_time").alias("exit_time"), side.alias("exit_side"), F.floor(F.col("arclength_wrapped") / segment).alias("exit_bin"))


def path_exits(states: DataFrame, paths: DataFrame, segments: DataFrame, horizons: list[float], segment: float, dt: float = STEP) -> DataFrame:
    """(id, horizon, side, bin, exit_time): where each state has left by the horizon; side ``none`` and nulls where it hasn't.

    The side and the bin are those of :func:`first_exits`. States without a path have null in all but the horizon.
    """
    exits = first_exits(paths, segments, segment, dt)
    has_path = paths.select("id").distinct().withColumn("moves", F.lit(True))
    d = states.select("id").join(has_path, "id", "left").join(exits, "id", "left").select("*", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    gone = F.col("exit_time") <= F.col("horizon") + 1e-12
    return d.select("id", "horizon", F.when(gone, F.col("exit_side")).when(F.col("moves"), "none").alias("side"), F.when(gone, F.col("exit_bin")).alias("bin"), F.when(gone, F.col("exit_time")).alias("exit_time"))
