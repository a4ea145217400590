"""Joins of points with intervals inside a group by one sweep: a union, a sort and running windows, linear in both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covering(rows: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, info: str) -> DataFrame:
    """``rows`` with ``low``, ``high`` and ``info`` of the interval [low, high] that their ``at`` lies in, nulls if in none.

    The interval begun last is the only one that may cover a row, as intervals of equal ``keys`` don't overlap; such that do are an error. Rows with
    null keys or places keep nulls.
    """
    begun = intervals.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*keys, low, high])))
    begun = begun.select(*keys, F.col(low).alias("__at"), F.lit(0).alias("__kind"), F.struct(low, high, info).alias("__open"))
    points = rows.withColumns({"__at": F.col(at), "__kind": F.lit(1)})
    w = Window.partitionBy(*keys).orderBy("__at", "__kind")
    before = F.last("__open", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = points.unionByName(begun, allowMissingColumns=True).withColumn("__before", before)
    inside = F.col("__before")[high] >= F.col("__at")
    # An interval that begins inside the one before it stops the query; the others leave with this filter.
    point = F.when(F.col("__kind") == 1, True).when(inside, F.raise_error(F.lit("intervals overlap")).cast("boolean")).otherwise(False)
    return d.where(point).select(*rows.columns, *(F.when(inside, F.col("__before")[c]).alias(c) for c in (low, high, info)))
