"""Telemetry, scores and probability rows derived from the given tables; one hour stands for one second."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apexframe.operators.timebase import running
from apexframe.scratch import stored

LAP = 24.0
N_BINS = 3


#: Tables that the running query has written, by name; None outside of such a query.
_written: ContextVar[dict[str, DataFrame] | None] = ContextVar("written", default=None)

View = Callable[[SparkSession, str], DataFrame]


def once(view: View) -> View:
    """A view that a query using it several times writes to the shared folder and reads from there (see :func:`materialising`)."""

    @wraps(view)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = _written.get()
        if tables is None:
            return view(spark, sf_dir)
        if view.__name__ not in tables:
            tables[view.__name__] = stored(view(spark, sf_dir), view.__name__.strip("_"))
        return tables[view.__name__]

    return get


def materialising(query: View) -> View:
    """A query whose shared views are computed once; nothing is kept for the next query."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _written.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _written.reset(token)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@once
def tele(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of cars (users) on circuits (user_id % 4); see each column's rule below.

    All windows are those of a user by time, one shuffle and one sort; a user's circuit and car follow from the id.
    """
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = e.select("user_id", "ts", "event_id", "value", "event_type", us.alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    d = d.withColumn("active", F.col("event_type") != "error")
    d = d.withColumns({"first_us": F.min("us").over(whole), "frame_index": F.row_number().over(w).cast("long") - 1, "us_before": F.lag("us").over(w), "active_before": F.lag("active").over(w)})
    t, before = ((F.col(c) - F.col("first_us")) / F.lit(3.6e9) for c in ("us", "us_before"))
    lap = lambda c: F.floor(F.col(c) / LAP).cast("long")
    d = d.withColumns({"t": t, "t_before": before}).withColumns({"lap_number": lap("t"), "lap_before": lap("t_before")})
    d = d.withColumn("hard_break", F.col("t_before").isNull() | (F.col("t") - F.col("t_before") > 24) | (F.col("active") != F.col("active_before")))
    d = d.withColumn("continuous_segment_id", F.sum(F.col("hard_break").cast("long")).over(running(w)) - 1)  # as segment_ids has it
    return d.select(
        F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string")).alias("circuit"), F.concat(F.lit("car_"), F.col("user_id").cast("string")).alias("car_id"),
        "frame_index", F.col("t").alias("time_seconds"), "lap_number", (F.col("t") - LAP * F.col("lap_number")).alias("current_lap_time"), F.lit(LAP).alias("last_lap_time"),
        (F.col("value") < 60).alias("in_corridor"), (F.greatest(F.col("value") - 60, F.lit(0.0)) / 10).alias("outside_depth_m"), "active",
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("pit_status"), F.when(F.col("k") % 2 == 0, "left").otherwise("right").alias("local_side"),
        (F.col("k") * 10.0).alias("centerline_arclength_wrapped_m"), "value", "k", "user_id",
        "hard_break", (F.col("hard_break") | F.coalesce(F.col("lap_number") != F.col("lap_before"), F.lit(False))).alias("artifact_seed"), "continuous_segment_id",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tele(spark, sf_dir)
    return t.select("circuit", "car_id", "frame_index", "time_seconds", "in_corridor", "hard_break", F.least(F.col("value") / 100, F.lit(1.0)).alias("proposal_score"), F.when(F.col("user_id") % 2 == 0, "left").otherwise("right").alias("predicted_side"), (F.col("k") % N_BINS).alias("predicted_bin"), F.lit(N_BINS).cast("long").alias("n_bins"), (F.col("active") & (F.col("pit_status") == 0)).alias("input_valid_causal"))


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, y, p): labels joined with documents; p rises with the length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    q = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return q.join(d, "doc_id").select("doc_id", "lang", "source", "y", "n_chars", (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))
