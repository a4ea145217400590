import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.operators import policy as P
from apexframe.operators.release import kinematic_diagnostics, segment_bins
from apexframe.sources.integrity import source_provenance
from apexframe.sources.tables import significant


def test_provenance_hashes_compact_ascii_json(spark):
    files = [("u", "d", "r", "c", "b/\U0001f600\n", 'q"\\é', 7, "ff"), ("u", "d", "r", "c", "a/\x7f\x01", "t\t", 9, "00"), ("v", "d", "r", "e", "x", "y", 0, "11")]
    rows = spark.createDataFrame(files, "unit string, dataset string, revision string, circuit_directory string, upstream_path string, filename string, bytes long, sha256 string")
    got = {r.unit: r for r in source_provenance(rows, ["unit"]).collect()}
    for unit, session in (("u", "d@r:c"), ("v", "d@r:e")):
        text = json.dumps(sorted([f[4], f[5], f[6], f[7]] for f in files if f[0] == unit), ensure_ascii=True, separators=(",", ":"))
        assert got[unit].source_session_id == session and got[unit].source_unit_sha256 == hashlib.sha256(text.encode()).hexdigest()
    mixed = rows.withColumn("revision", F.when(F.col("bytes") == 9, "other").otherwise(F.col("revision")))
    with pytest.raises(PySparkException):
        source_provenance(mixed, ["unit"]).collect()


def test_significant_digits_as_c_writes_them(spark):
    values = [0.0, -0.0, 1.0, -2.5, 123456789.0, 1234567891.0, 999999999.6, 0.0001, 0.00012345678912, 0.000099999999996, 1e-5, 1.5e-300, -7.25e22, 1e100, float("inf"), float("-inf"), float("nan"), None, 3.14159265358979, 100.0, 1e9]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in d.select("i", significant(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [None if v is None or v != v else f"{v:.9g}" for v in values]


def test_exact_bin_needs_known_events(spark):
    labels = spark.createDataFrame([("c", "k", 0.1, 0, "e1"), ("c", "k", 0.1, 1, "e2"), ("c", "k", 0.1, 2, None)], "circuit string, car_id string, threshold double, proposal_number long, matched_event_id string")
    proposals = labels.drop("matched_event_id").withColumn("predicted_bin", F.lit(4).cast("long"))
    events = spark.createDataFrame([("e1", True, "left", 4), ("e2", True, "right", 5), ("e3", False, "left", 4)], "candidate_event_id string, qualified boolean, side_at_onset string, segment_bin_at_onset long")
    got = {r.proposal_number: (r.matched_side_at_onset, r.matched_segment_bin, r.exact_bin) for r in P.with_exact_bin(labels, proposals, events).collect()}
    assert got == {0: ("left", 4, True), 1: ("right", 5, False), 2: (None, None, False)}
    for wrong in (events.where("candidate_event_id != 'e2'"), events.unionByName(events.where("candidate_event_id = 'e1'")), events.withColumn("qualified", F.col("candidate_event_id") != "e1")):
        with pytest.raises(DataValidationError):
            P.with_exact_bin(labels, proposals, wrong).collect()


def test_last_bin_ends_with_the_lap(spark):
    sides = spark.createDataFrame([(c, "center", i, x) for c, xs in (("a", [30.0, 30.0]), ("b", [25.0, 25.0]), ("d", [50.0, 1e-6]), ("e", [3.0])) for i, x in enumerate(xs)], "circuit string, role string, idx int, length double")
    got = {}
    for r in segment_bins(sides).orderBy("circuit", "bin").collect():
        got.setdefault(r.circuit, []).append((r.low, r.high))
    assert got == {"a": [(0, 25), (25, 50), (50, 60)], "b": [(0, 25), (25, 50)], "d": [(0, 25), (25, 50)], "e": [(0, 3)]}


def test_diagnostics_of_a_key_without_usable_rows(spark):
    d = spark.createDataFrame([("a", 20.0, 1.0, 3.0), ("a", 40.0, -1.0, 1.0), ("b", 1.0, 1.0, None)], "circuit string, v double, f double, a double")
    zero, one = F.lit(0.0), F.lit(1.0)
    got = {r.circuit: r for r in kinematic_diagnostics(d, ["circuit"], [F.col("v"), zero], [F.col("f"), zero], [F.col("a"), zero, zero], [one, zero, zero]).collect()}
    assert (got["a"].alignment_count, got["a"].alignment_median, got["a"].error_median, got["a"].cosine_count, got["a"].cosine_median) == (2, 0.0, 1.0, 2, 1.0)
    assert (got["b"].alignment_count, got["b"].error_count, got["b"].alignment_median, got["b"].error_p95) == (0, 0, None, None)
