"""Places of rows in groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apexframe.scratch import stored


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos", total: str = "n") -> DataFrame:
    """``df`` with ``name``, a row's place from 0 by ``order`` among those of equal ``group``, and ``total``, the rows of its group.

    No task holds a group: rows are written once with a number that breaks ties (so that a task that is run again deals them as before, and nothing is
    computed twice to find the ranges), then dealt and sorted by ranges of (group, order) and written with their running number; each (group, range)
    starts where the ranges before it end. That table has a row for each group and for each range a group goes on in. Nulls are first;
    rows that tie get places in an order that is fixed once written.
    """
    dealt = stored(df.withColumn("__tie", F.monotonically_increasing_id()), "numbered")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.rdd.getNumPartitions())
    dealt = dealt.repartitionByRange(parts, *group, *order, "__tie").sortWithinPartitions(*group, *order, "__tie").drop("__tie")
    dealt = stored(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "positions")
    starts = dealt.groupBy(*group, "__part").agg(F.min("__seq").alias("__from"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn("__before", before).withColumn("__total", F.sum("__n").over(Window.partitionBy(*group)))
    starts = starts.select(*(F.col(g).alias(f"__{i}") for i, g in enumerate(group)), F.col("__part").alias("__range"), "__from", "__before", "__total")
    same = [F.col(g).eqNullSafe(F.col(f"__{i}")) for i, g in enumerate(group)]
    joined = dealt.join(starts, [*same, F.col("__part") == F.col("__range")])
    return joined.select(*df.columns, (F.col("__before") + F.col("__seq") - F.col("__from")).alias(name), F.col("__total").alias(total))
