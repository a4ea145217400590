"""Sweeps against brute force, and on one long session."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from apexframe.operators.policy import label_proposals
from apexframe.operators.sweeps import covering
from apexframe.operators.timebase import ahead


def test_covering_against_all_pairs(spark):
    rng, intervals, rows = random.Random(1), [], []
    for key in ("a", "b", None):
        at = 0
        for i in range(40):
            low = at + rng.randrange(1, 6)
            at = low + rng.randrange(0, 9)
            intervals.append((key, low, at, f"{key}{i}"))
        rows += [(key, rng.choice([None, *range(-5, at + 9)]), i) for i in range(300)]
    found = covering(spark.createDataFrame(rows, "k string, at long, id long"), spark.createDataFrame(intervals, "k string, low long, high long, of string"), ["k"], "at", "low", "high", "of")
    plain = [(k, a, i, *next(((lo, hi, o) for q, lo, hi, o in intervals if None not in (k, a) and q == k and lo <= a <= hi), (None, None, None))) for k, a, i in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain))


def test_overlapping_intervals_are_an_error(spark):
    intervals = spark.createDataFrame([("a", 1, 5, "x"), ("a", 5, 6, "y")], "k string, low long, high long, of string")
    with pytest.raises(PySparkException):
        covering(spark.createDataFrame([("a", 9)], "k string, at long"), intervals, ["k"], "at", "low", "high", "of").collect()


def test_ahead(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, i * 10])) for k in "xy" for i in range(50)]
    d = spark.createDataFrame(rows, "k string, i long, v long").select("*", ahead("v", ["k"], "i").alias("a"), ahead("v", ["k"], "i", strictly=True).alias("s"))
    for r in d.collect():
        later = [(i, v) for k, i, v in rows if k == r.k and i >= r.i and v is not None]
        assert r.a == (later[0][1] if later else None)
        later = [(i, v) for i, v in later if i > r.i]
        assert r.s == (later[0][1] if later else None)


def test_one_session_of_many_frames_and_events(spark):
    """300,000 frames under 30,000 intervals, and 100,000 proposals against 30,000 events, in one car."""
    frames = spark.range(300_000).select(F.lit("C").alias("k"), F.col("id").alias("at"))
    intervals = spark.range(30_000).select(F.lit("C").alias("k"), (F.col("id") * 10).alias("low"), (F.col("id") * 10 + 4).alias("high"), F.col("id").alias("of"))
    assert covering(frames, intervals, ["k"], "at", "low", "high", "of").agg(F.count("of"), F.sum("of")).first() == (150_000, 5 * sum(range(30_000)))
    car = {"circuit": F.lit("C"), "car_id": F.lit("1")}
    events = spark.range(30_000).withColumns(car | {"start_time": F.col("id") * 10.0, "qualified": F.lit(True), "candidate_event_id": F.col("id").cast("string"), "side_at_onset": F.lit("left"), "segment_bin_at_onset": F.lit(0).cast("long")}).drop("id")
    proposals = spark.range(100_000).withColumns(car | {"threshold": F.lit(0.1), "proposal_number": F.col("id"), "proposal_time": F.col("id") * 3.0, "predicted_side": F.lit("left"), "predicted_bin": F.lit(0).cast("long"), "n_bins": F.lit(3).cast("long"), "resolution_time": F.col("id") * 3.0 + 5, "resolution_type": F.lit("horizon_elapsed"), "unresolved": F.lit(False)}).drop("id")
    labels = label_proposals(proposals, events, 4.0)
    expected = sum((-(-3 * i // 10)) * 10 <= 3 * i + 4 and -(-3 * i // 10) < 30_000 for i in range(100_000))
    assert labels.agg(F.count_if("localized_hit"), F.count(F.lit(1))).first() == (expected, 100_000)
