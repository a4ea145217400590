"""Competing exits as a three-class softmax, fitted by Newton steps whose sums Spark takes; and exact Poisson limits."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.scratch import stored

#: Classes of a step; the first one is the reference class.
CLASSES = ["no_exit", "left", "right"]


def _logits(inputs: list[str], w: np.ndarray) -> list[Column]:
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in inputs)]
    return [sum((z[i] * F.lit(float(w[i, c])) for i in range(1, len(z))), z[0] * F.lit(float(w[0, c]))) for c in range(2)]


def step_probabilities(rows: DataFrame, inputs: list[str], w: np.ndarray) -> DataFrame:
    """Adds p_no_exit, p_left and p_right of one step."""
    a, b = _logits(inputs, w)
    d = rows.withColumn("_a", a).withColumn("_b", b).withColumn("_top", F.greatest(F.lit(0.0), "_a", "_b"))
    total = F.exp(-F.col("_top")) + F.exp(F.col("_a") - F.col("_top")) + F.exp(F.col("_b") - F.col("_top"))
    d = d.withColumn("_log", F.log(total) + F.col("_top"))
    out = [F.exp(x - F.col("_log")).alias(f"p_{c}") for c, x in zip(CLASSES, (F.lit(0.0), F.col("_a"), F.col("_b")), strict=True)]
    return d.select(*(F.col(f"`{c}`") for c in rows.columns), *out)


def horizon_probabilities(rows: DataFrame, steps: dict[float, int]) -> DataFrame:
    """A row for each horizon (its number of steps given): no exit n times in a row, the rest shared as the step's sides are."""
    d = rows.withColumn("_h", F.explode(F.array(*(F.struct(F.lit(float(h)).alias("horizon"), F.lit(n).alias("n")) for h, n in steps.items()))))
    stay, leave = F.pow("p_no_exit", F.col("_h.n")), F.col("p_left") + F.col("p_right")
    share = lambda c: F.coalesce((1 - stay) * F.try_divide(F.col(c), leave), F.lit(0.0))
    kept = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("p_")]
    return d.select(*kept, F.col("_h.horizon").alias("horizon"), stay.alias("h_no_exit"), share("p_left").alias("h_left"), share("p_right").alias("h_right"))


def fit_side_hazard(rows: DataFrame, inputs: list[str], label: str = "label", l2: float = 1.0, iterations: int = 30, tolerance: float = 1e-9) -> np.ndarray:
    """Coefficients (1 + inputs, left and right) of the mean log loss plus l2 / 2 times the squared non-intercepts.

    Each Newton step is one aggregate over label and inputs, which are written once, so that no step makes the rows anew; a step that raises the loss
    is halved. Rows with a null input or another label don't count.
    """
    k = 1 + len(inputs)
    d = stored(rows.where(F.col(label).isin(*CLASSES)).dropna(subset=inputs).select(F.col(label).alias("_label"), *inputs), "hazard-fit")
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in inputs)]
    p, y = [F.col("p_left"), F.col("p_right")], [(F.col("_label") == c).cast("double") for c in CLASSES[1:]]
    hit = F.when(F.col("_label") == "left", F.col("p_left")).when(F.col("_label") == "right", F.col("p_right")).otherwise(F.col("p_no_exit"))
    sums = [F.avg(-F.log(F.greatest(hit, F.lit(1e-300)))).alias("loss")]
    sums += [F.avg((p[c] - y[c]) * z[i]).alias(f"g{c}_{i}") for c in range(2) for i in range(k)]
    sums += [F.avg(p[c] * ((1.0 if c == e else 0.0) - p[e]) * z[i] * z[j]).alias(f"h{c}{e}_{i}_{j}") for c in range(2) for e in range(c, 2) for i in range(k) for j in range(i, k)]
    ridge = np.tile(np.r_[0.0, np.full(k - 1, l2)], 2)
    w = before = np.zeros(2 * k)
    last = np.inf
    for _ in range(iterations):
        r = step_probabilities(d, inputs, w.reshape(2, k).T).agg(*sums).first()
        if r["loss"] is None:
            raise ValueError("no rows to fit on")
        loss = r["loss"] + 0.5 * float(ridge @ (w * w))
        if loss > last + 1e-12:
            w = (w + before) / 2
            continue
        grad = np.array([r[f"g{c}_{i}"] for c in range(2) for i in range(k)]) + ridge * w
        if np.abs(grad).max() < tolerance:
            break
        hess = np.array([[r[f"h{min(c, e)}{max(c, e)}_{min(i, j)}_{max(i, j)}"] for e in range(2) for j in range(k)] for c in range(2) for i in range(k)])
        before, last = w, loss
        w = w - np.linalg.solve(hess + np.diag(ridge) + 1e-12 * np.eye(2 * k), grad)
    return w.reshape(2, k).T


def _at_most(n: int, mean: float) -> float:
    """P(X <= n) for a Poisson X whose mean exceeds n; terms far below n don't count in double precision."""
    i = np.arange(max(0, n - 60 * int((n + 1) ** 0.5) - 200), n + 1, dtype=float)
    terms = n * np.log(mean) - mean - lgamma(n + 1)
    # From n downwards each term is the one above it times i / mean.
    falling = np.concatenate([[0.0], np.cumsum(np.log(i[:0:-1]) - np.log(mean))]) if len(i) > 1 else np.zeros(1)
    return float(np.exp(terms + falling).sum())


def poisson_upper(n: int, confidence: float) -> float:
    """The mean at which n events or fewer have probability 1 - confidence."""
    low, high = float(n), n + 20 * (n + 1) ** 0.5 + 20
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if _at_most(n, middle) > 1 - confidence else (low, middle)
    return (low + high) / 2


def rate_upper(rows: DataFrame, count: str, exposure: str, confidence: float = 0.95, name: str = "rate_upper") -> DataFrame:
    """Adds the exact one-sided upper limit of a rate; null where the exposure isn't positive or the count is null or negative."""

    @F.pandas_udf("double")
    def limit(n: pd.Series) -> pd.Series:
        known = {x: poisson_upper(int(x), confidence) for x in n.dropna().unique() if x >= 0}
        return n.map(known)

    return rows.withColumn(name, F.when(F.col(exposure) > 0, limit(F.col(count).cast("double")) / F.col(exposure)))
