import pytest

from apexframe.contracts import DataValidationError
from apexframe.operators import operating as O
from apexframe.operators.features import loco_splits

LABELS = "circuit string, car_id string, method string, threshold double, matched_event_id string, lead double, localized_hit boolean, false_proposal boolean, unresolved_censored boolean"
CARS = "circuit string, car_id string, events long, exposure double"


def _tables(spark):
    labels = [("A", "1", "m", 0.1, "e1", 2.0, True, False, False), ("A", "1", "m", 0.1, None, None, False, True, False), ("A", "1", "m", 0.5, "e1", 2.0, True, False, False), ("B", "2", "m", 0.5, "f1", 0.5, True, False, False),
              ("B", "2", "m", 0.5, None, None, False, False, True), ("B", "2", "m", 0.1, None, None, False, True, False), ("A", "1", "n", 0.1, None, None, False, True, False)]
    return spark.createDataFrame(labels, LABELS), spark.createDataFrame([("A", "1", 2, 10.0)], CARS), spark.createDataFrame([("B", "2", 1, 5.0), ("B", "3", 0, 5.0)], CARS)


def test_cells_are_chosen_on_calibration_cars_and_kept(spark):
    labels, calibration, test = _tables(spark)
    cells = O.choose_cells(O.threshold_summary(labels, calibration, [0.0, 1.0], [0.1, 0.5]), [0.01, 0.2])
    got = {(r.method, r.required_lead, r.budget): (r.threshold, r.state) for r in cells.collect()}
    assert got["m", 1.0, 0.2] == (0.5, "active") and got["m", 0.0, 0.01] == (None, "not_estimable") and got["n", 0.0, 0.2] == (0.5, "active") and len(got) == 8
    ledger = {(r.car_id, r.method, r.required_lead, r.budget): r for r in O.heldout_ledger(cells, O.seal(cells), labels, test).collect()}
    assert len(ledger) == 16
    row = ledger["2", "m", 0.0, 0.2]
    assert (row.hits, row.false_proposals, row.unresolved, row.abstained) == (1, 0, 1, False) and ledger["2", "m", 1.0, 0.2].hits == 0
    assert ledger["2", "m", 0.0, 0.01].abstained and ledger["3", "m", 0.0, 0.2].hits == 0


def test_cells_that_were_not_sealed_are_refused(spark):
    labels, calibration, test = _tables(spark)
    cells = O.choose_cells(O.threshold_summary(labels, calibration, [0.0], [0.1, 0.5]), [0.2])
    sealed = O.seal(cells)
    assert sealed == O.seal(cells.orderBy("method", ascending=False))
    for other in (cells.withColumn("threshold", cells.threshold / 2), cells.where("method = 'm'"), cells.unionByName(cells)):
        with pytest.raises(DataValidationError):
            O.heldout_ledger(other, sealed, labels, test)
    twice = cells.unionByName(cells)
    with pytest.raises(DataValidationError):
        O.heldout_ledger(twice, O.seal(twice), labels, test)


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 1.0])
def test_splits_take_the_first_by_score(spark, fraction):
    units = spark.createDataFrame([(f"c{i % 3}", f"k{i}") for i in range(40)] + [("lone", "x")], "circuit string, car_id string")
    d = loco_splits(units, fraction, 1, "s").toPandas()
    assert len(d) == 4 * 41
    for fold, rows in d.groupby("fold_test_circuit"):
        assert (rows[rows.circuit == fold].partition == "test").all()
        rest = rows[rows.circuit != fold].sort_values("split_score")
        take = max(1, min(len(rest) - 1, int(len(rest) * fraction + 0.5)))
        assert rest.partition.tolist() == ["calibration"] * take + ["fit"] * (len(rest) - take)
