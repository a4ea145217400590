"""Released scores, ledger and grid checks, on fixtures small enough to count by hand."""

import math

import pytest
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.operators import metrics as M
from apexframe.operators import release as E

LEDGER = "circuit string, car_id string, lead double, events long, hits long, false_proposals long, unresolved long, exposure double"


def test_hazard_mass_lies_at_one_bin(spark):
    d = spark.createDataFrame([(1, 95.0, 20.0, 1.5, 0.2, 0.1), (2, 5.0, -50.0, 0.5, 0.0, 0.3)], "row long, arc double, v double, horizon double, h_left double, h_right double")
    got = {(r.row, r.side): (r.bin, r.mass) for r in E.hazard_mass(d, ["row"], "arc", "v", [0.5, 1.5], 100.0, 25.0).collect()}
    assert got == {(1, "left"): (0, 0.2), (1, "right"): (0, 0.1), (2, "left"): (0, 0.0), (2, "right"): (0, 0.3)}


def test_compact_scores(spark):
    mass = spark.createDataFrame([(1, 1.5, "left", 0, 0.2), (1, 1.5, "left", 4, 0.3), (1, 1.5, "right", 2, 0.4), (1, 0.5, "right", 2, 0.1)], "row long, horizon double, side string, bin long, mass double")
    keys = spark.createDataFrame([(1,), (2,)], "row long")
    got = {r.row: r for r in E.compact_forecast(mass, keys, ["row"], [0.5, 1.5], 1.5, 5, "m").collect()}
    a, b = got[1], got[2]
    assert (a.raw_exit_probability_0p50s, round(a.raw_exit_probability_1p50s, 9), a.predicted_side, a.predicted_bin, a.raw_primary_neighborhood_probability) == (0.1, 0.9, "left", 0, 0.5)
    assert (b.raw_exit_probability_1p50s, b.predicted_side, b.method, b.n_bins) == (0.0, None, "m", 5)
    with pytest.raises(DataValidationError):
        E.compact_forecast(mass, keys.withColumn("next_event_id", F.lit("x")), ["row"], [1.5], 1.5, 5, "m")
    stay = spark.createDataFrame([(1, 1.5, 0.1), (1, 0.5, 0.8)], "row long, horizon double, h_no_exit double")
    assert [(r.horizon, round(r.total, 6)) for r in E.mass_defects(mass, stay, ["row"]).collect()] == [(0.5, 0.9)]


def test_abstentions_go_to_their_first_reason(spark):
    rows = [(True, False, True), (False, True, False), (True, True, False), (True, False, False)]
    d = spark.createDataFrame([("a", *r) for r in rows], "car string, input_valid_causal boolean, hard_break boolean, in_corridor boolean")
    assert E.abstention_reasons(d, ["car"]).first()[1:] == (4, 1, 1, 1, 3)


def test_cells_and_grids(spark):
    cells = spark.createDataFrame([("A", 1.0, True), ("B", 1.0, True), ("A", 2.0, True), ("B", 2.0, False), ("A", 3.0, True), ("A", 4.0, True), ("A", 4.0, True)], "fold string, lead double, estimable boolean")
    assert sorted((r.fold, r.lead) for r in E.complete_cells(cells, "fold", ["lead"], 2).collect()) == [("A", 1.0), ("B", 1.0)]
    got = {r.fold: tuple(r)[1:] for r in E.grid_completeness(cells, "fold", {"lead": [1.0, 2.0, 4.0]}).collect()}
    assert got == {"A": (0, 1, 1), "B": (1, 0, 0)}


def test_ledger_defects(spark):
    good = [("A", "a", x, 3, 2, 1, 0, 1.0) for x in (0.5, 1.0)]
    assert tuple(E.ledger_defects(spark.createDataFrame(good, LEDGER), ["lead"]).first()) == (1, 0, 0, 0, 0, 0, 0)
    bad = [*good, ("A", "b", 0.5, 3, 4, 1, 0, 1.0), ("A", "c", 0.5, 3, 1, -1, None, 0.0), ("A", "c", 1.0, 4, 1, 0, 0, math.nan), ("B", "d", 0.5, 1, 1, 0, 0, 2.0), ("B", "d", 0.5, 1, 1, 0, 0, 2.0)]
    assert tuple(E.ledger_defects(spark.createDataFrame(bad, LEDGER), ["lead"]).first()) == (4, 1, 2, 1, 1, 1, 2)
    assert E.ledger_defects(spark.createDataFrame([], LEDGER), ["lead"]).first().cars == 0


def test_comparison_names_what_differs(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5), (3, 3.0, 1), (4, None, 1)], "k long, x double, n long")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, None), (2, 2.1, 5), (4, None, None)], "k long, x double, n long")
    assert {r.k: r.differs for r in E.compare_derived(a, b, ["k"], ["x", "n"]).collect()} == {2: ["x"], 3: ["x", "n"], 4: ["n"]}


def test_highest_threshold_with_a_proposal(spark):
    p = spark.createDataFrame([("a", 0.1), ("a", 0.4), ("a", 0.4)], "car string, threshold double")
    keys = spark.createDataFrame([("a",), ("b",)], "car string")
    assert sorted(tuple(r) for r in E.closest_active(keys, p, ["car"]).collect()) == [("a", 0.4, 2), ("b", None, None)]


def test_travel_direction(spark):
    d = spark.createDataFrame([("A", 1.0, 0.0, 20.0)] * 20 + [("A", -1.0, 0.0, 5.0), ("B", -1.0, 0.0, 20.0), ("C", 0.0, 0.0, 20.0)], "circuit string, x double, y double, v double")
    got = {r.circuit: tuple(r)[1:] for r in E.travel_direction(d, ["circuit"], (F.col("x"), F.col("y")), (F.lit(2.0), F.lit(0.0)), F.col("v")).collect()}
    assert got == {"A": (20, 1.0, 1.0, 1.0, True), "B": (1, -1.0, -1.0, 0.0, False), "C": (0, None, None, None, None)}


def test_calibration_line(spark):
    rows = [(p, float(i < round(100 * q))) for p, q in ((0.2, 0.1), (0.5, 0.5), (0.8, 0.9)) for i in range(100)]
    intercept, slope = M.calibration_line(spark.createDataFrame(rows, "p double, y double"))
    assert intercept == pytest.approx(0, abs=1e-6) and slope == pytest.approx(math.log(9) / math.log(4), rel=1e-6)
    assert all(math.isnan(v) for v in M.calibration_line(spark.createDataFrame([(0.2, 1.0), (0.4, 1.0)], "p double, y double")))


def test_runtime(spark):
    log = spark.createDataFrame([("a", 10, 2.0), ("a", 20, 3.0), ("b", 5, 0.0)], "stage string, n long, s double")
    assert sorted(tuple(r) for r in E.runtime_summary(log, "stage", "n", "s").collect()) == [("a", 2, 30, 5.0, 6.0), ("b", 1, 5, 0.0, None)]
