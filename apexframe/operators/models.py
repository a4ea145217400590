"""Residual models from sufficient statistics: Spark sums, the driver solves a small system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.operators.timebase import UNIT


def sufficient_statistics(rows: DataFrame, inputs: list[str], target: str, keys: list[str] = UNIT) -> DataFrame:
    """Mean products of (1, inputs) with themselves and with the target, for each car; every car weighs the same later."""
    d = rows.withColumn("one", F.lit(1.0))
    names = ["one", *inputs]
    aggs = [F.avg(F.col(a) * F.col(b)).alias(f"g_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    aggs += [F.avg(F.col(a) * F.col(target)).alias(f"m_{a}") for a in names]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)


def ridge_fit(statistics: DataFrame, inputs: list[str], alpha: float) -> np.ndarray:
    """Coefficients (intercept first, not penalised) of the equally weighted cars; one aggregate row reaches the driver."""
    names = ["one", *inputs]
    columns = [f"g_{a}_{b}" for i, a in enumerate(names) for b in names[i:]] + [f"m_{a}" for a in names]
    row = statistics.agg(*(F.sum(c).alias(c) for c in columns)).first()
    g = np.array([[row[f"g_{min(a, b, key=names.index)}_{max(a, b, key=names.index)}"] for b in names] for a in names], float)
    m = np.array([row[f"m_{a}"] for a in names], float)
    penalty = alpha * np.eye(len(names))
    penalty[0, 0] = 0.0
    return np.linalg.solve(g + penalty, m)


def predict_linear(rows: DataFrame, inputs: list[str], coefficients, name: str = "prediction") -> DataFrame:
    out = F.lit(float(coefficients[0]))
    for c, w in zip(inputs, coefficients[1:], strict=True):
        out = out + F.col(c) * F.lit(float(w))
    return rows.withColumn(name, out)


def constant_turn_forecast(states: DataFrame, horizon: float, steps: int) -> DataFrame:
    """Positions after ``horizon`` at constant speed and turn rate, by midpoint steps (id, x, y, speed, heading, turn)."""
    dt = horizon / steps
    x, y = F.col("x"), F.col("y")
    for i in range(steps):
        mid = F.col("heading") + F.col("turn") * F.lit((i + 0.5) * dt)
        x, y = x + F.col("speed") * F.cos(mid) * F.lit(dt), y + F.col("speed") * F.sin(mid) * F.lit(dt)
    return states.select("id", x.alias("x"), y.alias("y"), (F.col("heading") + F.col("turn") * F.lit(horizon)).alias("heading"))
