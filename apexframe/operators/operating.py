"""Operating points chosen on calibration cars, sealed, and the ledger of held-out cars at the sealed thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError, require_columns
from apexframe.operators.policy import operating_points
from apexframe.operators.release import estimable
from apexframe.operators.timebase import UNIT
from apexframe.scratch import stored

CELL = ["method", "required_lead", "budget"]


def _by_event(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, matched_event_id, best_lead, false_proposals, unresolved): the longest lead of an event's hits, so that it counts once whatever the lead required."""
    hit = F.when(F.col("localized_hit") & F.col("matched_event_id").isNotNull(), F.col("lead"))
    return labels.groupBy(*keys, "matched_event_id").agg(F.max(hit).alias("best_lead"), F.count_if("false_proposal").alias("false_proposals"), F.count_if("unresolved_censored").alias("unresolved"))


def _timely(need: str):
    return F.col("best_lead") >= F.col(need) - 1e-12


def threshold_summary(labels: DataFrame, cars: DataFrame, leads: list[float], thresholds: list[float]) -> DataFrame:
    """(method, threshold, required_lead, events, hits, false_proposals, exposure, recall, false_per_hour) over the cars given.

    ``labels`` are those of :func:`apexframe.operators.policy.label_proposals` with their method, ``cars`` have events and exposure. Dense: a
    threshold without proposals has none.
    """
    mine = labels.join(cars.select(*UNIT), UNIT, "left_semi")
    each = _by_event(mine, ["method", "threshold"]).select("*", F.explode(F.array(*map(F.lit, leads))).alias("required_lead"))
    found = each.groupBy("method", "threshold", "required_lead").agg(F.count_if(_timely("required_lead")).alias("hits"), F.sum("false_proposals").alias("false_proposals"))
    grid = labels.select("method").distinct().select("method", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).select("*", F.explode(F.array(*map(F.lit, leads))).alias("required_lead"))
    whole = cars.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum("exposure"), F.lit(0.0)).alias("exposure"))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    d = grid.join(found, ["method", "threshold", "required_lead"], "left").join(F.broadcast(whole))
    d = d.select("method", "threshold", "required_lead", "events", zero("hits"), zero("false_proposals"), "exposure")
    return d.withColumns({"recall": F.try_divide(F.col("hits"), F.col("events")), "false_per_hour": F.try_divide(F.col("false_proposals"), F.col("exposure"))})


def choose_cells(summary: DataFrame, budgets: list[float], minimum: float = 1.0) -> DataFrame:
    """(method, required_lead, budget, threshold, state): a row for every cell; ``threshold`` is null unless the state is ``active``.

    ``not_estimable``: the exposure doesn't allow ``minimum`` false alerts within the budget; ``no_threshold``: none keeps the budget.
    """
    summary = stored(summary, "summary")  # a row for each method, threshold and lead
    cells = summary.groupBy("method", "required_lead").agg(F.max("exposure").alias("exposure")).select("*", F.explode(F.array(*map(F.lit, budgets))).alias("budget"))
    best = operating_points(summary, budgets, ["method"]).select(*CELL, F.col("threshold").alias("best"))
    d = cells.join(best, CELL, "left")
    state = F.when(~estimable(F.col("budget"), F.col("exposure"), minimum), "not_estimable").when(F.col("best").isNull(), "no_threshold").otherwise("active")
    return d.withColumn("state", state).select(*CELL, F.when(F.col("state") == "active", F.col("best")).alias("threshold"), "state")


def seal(cells: DataFrame) -> str:
    """A digest of the cells, whatever their order: of a row for each of few methods, leads and budgets."""
    text = F.to_json(F.struct(*CELL, "threshold", "state"), {"ignoreNullFields": "false"})
    return cells.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256)).first()[0]


def heldout_ledger(cells: DataFrame, sealed: str, labels: DataFrame, cars: DataFrame) -> DataFrame:
    """A row for every held-out car and cell: events, hits, false_proposals, unresolved, exposure, abstained.

    ``cells`` must be those of the seal, with each cell once; labels must have been made at every active threshold. A cell without threshold abstains: its
    hits and false proposals are zero.
    """
    require_columns(labels, [*UNIT, "method", "threshold"])
    if seal(cells) != sealed:
        raise DataValidationError("the operating cells aren't those that were sealed")
    if cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise DataValidationError("a cell occurs more than once")
    few = F.broadcast(cells)  # methods x leads x budgets
    mine = labels.join(F.broadcast(cells.select("method", "threshold").distinct()), ["method", "threshold"], "left_semi").join(cars.select(*UNIT), UNIT, "left_semi")
    each = _by_event(mine, [*UNIT, "method", "threshold"]).join(few, ["method", "threshold"])
    found = each.groupBy(*UNIT, *CELL).agg(F.count_if(_timely("required_lead")).alias("hits"), F.sum("false_proposals").alias("false_proposals"), F.sum("unresolved").alias("unresolved"))
    listed = cells.agg(F.collect_list(F.struct(*CELL, "threshold", "state")).alias("cells"))
    dense = cars.select(*UNIT, "events", "exposure").join(F.broadcast(listed)).select(*UNIT, "events", "exposure", F.explode("cells").alias("c")).select(*UNIT, "c.*", "events", "exposure")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    d = dense.join(found, [*UNIT, *CELL], "left")
    return d.select(*UNIT, *CELL, "threshold", "state", "events", zero("hits"), zero("false_proposals"), zero("unresolved"), "exposure", (F.col("state") != "active").alias("abstained"))
