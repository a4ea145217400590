"""Registry of the core queries; their SQL twins are in :mod:`apexframe.plans.oracles`.

The number of the operator in the blueprint stands beside each query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apexframe.contracts import attach_partition, join_frames_targets, key_set_difference
from apexframe.operators import alert_ranges as A
from apexframe.operators import calibration as B
from apexframe.operators import excursions as X
from apexframe.operators import features as V
from apexframe.operators import forecast as C
from apexframe.operators import geometry as G
from apexframe.operators import hazard as H
from apexframe.operators import map_index as I
from apexframe.operators import metrics as M
from apexframe.operators import models as R
from apexframe.operators import operating as O
from apexframe.operators import policy as P
from apexframe.operators import pooling as L
from apexframe.operators import release as E
from apexframe.operators import residual as D
from apexframe.operators import rollout as Q
from apexframe.operators import timebase as T
from apexframe.plans.oracles import ORACLES
from apexframe.plans.surrogate import N_BINS, materialising, once, prob, scores, table, tele
from apexframe.scratch import scratch_path, stored
from apexframe.sources import compact, maps, seals
from apexframe.sources.integrity import source_provenance, unit_digests, validate_manifest
from apexframe.sources.tables import natural_key, publish, read_table, significant_columns
from apexframe.streaming import timed as S

CONFIG = X.ExcursionConfig(gap_merge=12.0, min_depth=1.0, min_duration=6.0, min_lead_in=0.0, artifact=2.0, edge=12.0, exclude_truncated=False)
POLICY = P.ProposalConfig(horizon=30.0, persistence=1, rearm=10.0)
GRID_STEP = 6.0
THRESHOLDS = [0.05, 0.1, 0.2, 0.4]
LEADS = [1.0, 6.0, 12.0, 24.0]
BUDGETS = [0.002, 0.005, 0.02, 0.1]
DELAYS = [0.0, 2.0, 6.0]
DRAWS = 200
UNIT = T.UNIT


@once
def _events(spark, d):
    return X.excursion_candidates(tele(spark, d), CONFIG)


def _events_binned(spark, d):
    """Events with bins of the surrogate scores' circle."""
    return _events(spark, d).withColumn("segment_bin_at_onset", F.col("segment_bin_at_onset") % N_BINS)


def _rounded(rows: DataFrame, *cols: str) -> DataFrame:
    """Six digits, for comparison with a twin; operators don't round."""
    return rows.withColumns({c: F.round(c, 6) for c in cols})


@once
def _proposals(spark, d):
    return P.run_alerts(scores(spark, d), THRESHOLDS, POLICY)


@once
def _labels(spark, d):
    return P.label_proposals(_proposals(spark, d), _events_binned(spark, d), POLICY.horizon)


@once
def _exposure(spark, d):
    return X.interval_exposure(tele(spark, d), CONFIG.edge, CONFIG.artifact)


def _units(spark, d):
    return tele(spark, d).select(*UNIT).distinct()


def _ledger(spark, d):
    """One row for each car and lead at threshold 0.1."""
    labels = _labels(spark, d).where("threshold = 0.1").withColumn("leads", F.array(*map(F.lit, LEADS))).withColumn("need", F.explode("leads"))
    hit = F.when(F.col("localized_hit") & (F.col("lead") >= F.col("need") - 1e-12), F.col("matched_event_id"))
    found = labels.groupBy(*UNIT, F.col("need").alias("lead")).agg(F.count_distinct(hit).alias("hits"), F.count_if("false_proposal").alias("false_proposals"), F.count_if("unresolved_censored").alias("unresolved"))
    events = _events(spark, d).groupBy(*UNIT).agg(F.count_if("qualified").alias("events"))
    base = _exposure(spark, d).select(*UNIT, F.col("prebuffer_seconds").alias("exposure"), F.explode(F.array(*map(F.lit, LEADS))).alias("lead"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.join(events, UNIT, "left").join(found, [*UNIT, "lead"], "left").select(*UNIT, "lead", z("events"), z("hits"), z("false_proposals"), z("unresolved"), "exposure")


def _mass(spark, d):
    """Long forecast mass from line items: a row for each order, side by return flag, bin by line number."""
    li = table(spark, d, "lineitem")
    side = F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "R", "right").otherwise("unknown")
    return li.groupBy(F.col("l_orderkey").alias("row"), side.alias("side"), (F.col("l_linenumber") % 5).cast("long").alias("bin")).agg(F.round(F.sum(F.col("l_quantity").cast("double") / 100), 6).alias("mass")).withColumn("n_bins", F.lit(5).cast("long"))


def _points(spark, d):
    at = lambda i, scale=1.0: F.element_at("embedding", i).cast("double") * scale
    more = {f"e{i}": at(i) for i in range(4, 15)}
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), at(1, 30).alias("x"), at(2, 30).alias("y"), at(3, 30).alias("z"), at(4, 30).alias("w"), *(c.alias(n) for n, c in more.items()))


def _rings(spark):
    """The map: two boundaries and a centre line, as a circuit's files would give them."""
    return G.ring_segments(spark, G.square(10.0), "outer").unionByName(G.ring_segments(spark, G.square(5.0), "inner")).unionByName(G.ring_segments(spark, G.square(7.5), "center"))


def _kinematics(spark, d):
    p = _points(spark, d)
    norm = F.sqrt(F.col("e10") * F.col("e10") + F.col("e11") * F.col("e11") + F.col("e12") * F.col("e12") + F.col("e13") * F.col("e13"))
    frames = p.select("label", "id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), *(F.col(f"e{i}").alias(n) for i, n in zip(range(4, 10), ("vx", "vy", "vz", "ax", "ay", "az"), strict=True)), *((F.col(f"e{10 + i}") / norm).alias(f"q{c}") for i, c in enumerate("xyzw")))
    k = G.map_kinematics(frames, (1.0, 2.0, 3.0), (0.0, 0.0, 0.6, 0.8), ["label"], "id")
    return _rounded(k, *(c for c in k.columns if c not in ("label", "id")))


def _exits(spark, d, turns):
    p = _points(spark, d)
    states = p.select("id", "x", "y", F.abs("z").alias("v_long"), F.lit(0.0).alias("v_lat"), F.col("w").alias("yaw"), (F.col("z") / 20).alias("yaw_rate"))
    return _rounded(C.path_exits(states, C.constant_paths(states, 1.5, turns), _rings(spark), [0.25, 0.5, 1.0, 1.5], 2.5), "exit_time")


def _acceleration(spark, d):
    t = tele(spark, d)
    grid = T.causal_resample(t, GRID_STEP)
    source = t.select(*UNIT, F.col("frame_index").alias("source_index"), "value", "outside_depth_m")
    grid = grid.join(source, [*UNIT, "source_index"])
    out = G.grid_acceleration(grid, UNIT, "continuous_segment_id", "grid_index", "target_time", ["value", "outside_depth_m"])
    return _rounded(out.select(*UNIT, "continuous_segment_id", "grid_index", "value_rate", "outside_depth_m_rate"), "value_rate", "outside_depth_m_rate")


def _horizons(rows: DataFrame) -> DataFrame:
    for h in (500, 1500, 3000):
        rows = rows.withColumn(f"p{h}", F.col("n_chars") / (F.col("n_chars") + float(h)) * F.when(F.col("doc_id") % 7 == 0, h / 3000.0).otherwise(1.0))
    return rows


def _axis_rows(spark, d):
    t = tele(spark, d)
    return t.select(*UNIT, "frame_index", "lap_number", "current_lap_time", "last_lap_time", F.col("centerline_arclength_wrapped_m").alias("total_distance"), F.col("pit_status").alias("result_status"), (F.col("outside_depth_m") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))


def _axis_of(spark, d):
    return T.reconstruct_axis(_axis_rows(spark, d), cadence_cap=24.0, gap_floor=24.0, reset_tolerance=0.05, jump=20.0, distance_reset=-900.0)


def _axis(spark, d):
    a = _axis_of(spark, d)
    return a.select(*UNIT, "frame_index", F.round("cadence", 6).alias("cadence"), "lap_boundary", "clock_reset", "data_gap", "position_jump", "distance_reset", "status_transition", "hard_break", "artifact_seed", F.round("time_seconds", 5).alias("time_seconds"), "continuous_segment_id")


def _loco(spark, d):
    return V.loco_splits(_units(spark, d), 0.2, 20270927, "surrogate-v1")


def _key_check(spark, d):
    """Frames against those with a next event, with strangers added on the right and some keys repeated."""
    t = tele(spark, d)
    right = X.next_events(t, _events(spark, d)).where("next_event_id is not null").select(*UNIT, "frame_index")
    strangers = t.where("frame_index % 11 = 0").select(*UNIT, (F.col("frame_index") + 1_000_000).alias("frame_index"))
    again = right.where("frame_index % 7 = 0")
    return key_set_difference(t.select(*UNIT, "frame_index"), right.unionByName(strangers).unionByName(again), [*UNIT, "frame_index"])


def _moments(spark, d):
    m = R.sufficient_statistics(V.residual_pairs(tele(spark, d), "outside_depth_m"), ["x", "dt"], "residual")
    return m.withColumns({c: F.round(c, 4) for c in m.columns if c[:2] in ("g_", "m_")})


def _ridge(spark, d):
    pairs = V.residual_pairs(tele(spark, d), "outside_depth_m")
    stats = R.sufficient_statistics(pairs, ["x", "dt"], "residual")
    coef = R.ridge_fit(stats, ["x", "dt"], 1.0)
    return R.predict_linear(pairs, ["x", "dt"], coef).select(*UNIT, "frame_index", F.round("prediction", 4).alias("prediction"))


def _cohort(spark, d):
    t = tele(spark, d).groupBy("circuit").agg(F.count_distinct("car_id").alias("cars"), F.count(F.lit(1)).alias("frames"))
    e = _events(spark, d).groupBy("circuit").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("qualified").alias("qualified"))
    x = _exposure(spark, d).groupBy("circuit").agg(F.round(F.sum("prebuffer_seconds"), 4).alias("prebuffer_seconds"), F.round(F.sum("buffered_seconds"), 4).alias("buffered_seconds"))
    return t.join(e, "circuit", "left").join(x, "circuit", "left")


def _frontier(spark, d):
    ledger = _ledger(spark, d).withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS))))
    return L.l_star(ledger, ["budget"], 0.1, F.col("budget"))


def _states(spark, d):
    return _points(spark, d).select("id", "x", "y", (F.abs("z") / 10).alias("speed"), (F.col("w") / 10).alias("heading"), (F.col("z") / 100).alias("turn"))


def _robust(spark, d):
    return _rounded(V.robust_scaler(tele(spark, d), ["value", "outside_depth_m", "current_lap_time"], F.col("active")), "center", "scale")


def _scaled(spark, d):
    """Frames scaled by the active ones of their table."""
    names = ["value", "outside_depth_m", "current_lap_time"]
    t = tele(spark, d)
    return _rounded(V.robust_transform(t, V.robust_scaler(t, names, F.col("active")), names).select(*KEY, *names), *names)


def _projection(spark, d):
    t = tele(spark, d)
    return X.project_events(T.causal_grid(t, GRID_STEP), _events(spark, d))


def _features(spark, d):
    t = tele(spark, d).withColumns({"yaw": F.col("centerline_arclength_wrapped_m") / 100, "vx": F.col("value") / 10, "vy": F.col("outside_depth_m"), "track_heading": F.col("k") / 20.0})
    out = V.causal_features(t)
    return _rounded(out, "yaw", "yaw_rate", "v_long", "v_lat", "heading_error")


def _bins(spark, d):
    t = tele(spark, d)
    b = V.hazard_bin(F.col("centerline_arclength_wrapped_m"), F.col("value"), 1.5, 1000.0, 25.0)
    return t.select(*UNIT, "frame_index", b.alias("hazard_bin"), V.circular_distance(b, F.lit(3), F.lit(40)).alias("distance"))


def _exposure_split(spark, d):
    x = _exposure(spark, d).join(_loco(spark, d), UNIT)
    return x.groupBy("fold_test_circuit", "partition").agg(F.count(F.lit(1)).alias("cars"), F.round(F.sum("prebuffer_seconds"), 4).alias("seconds"))


def _partitions(spark, d):
    n = X.next_events(tele(spark, d), _events(spark, d))
    j = attach_partition(n, _loco(spark, d), "C0", UNIT)
    return j.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.count("next_event_id").alias("with_event"), F.round(F.sum("time_to_next"), 3).alias("total_time_to_next"))


def _frame_target(spark, d):
    t = tele(spark, d).select(*UNIT, "frame_index", "hard_break")
    n = X.next_events(tele(spark, d), _events(spark, d)).select(*UNIT, "frame_index", "next_event_id", "time_to_next")
    return join_frames_targets(t, n, [*UNIT, "frame_index"])


def _semi(spark, d):
    calm = _loco(spark, d).where("fold_test_circuit = 'C1' and partition = 'calibration'").select(*UNIT)
    return _events(spark, d).join(calm, UNIT, "left_semi").select(*UNIT, "candidate_event_id", "qualified")


def _summary(spark, d):
    hours = _exposure(spark, d).agg(F.round(F.sum("prebuffer_seconds"), 4).alias("hours"))
    return _rounded(P.detection_summary(_labels(spark, d), _events_binned(spark, d), hours, LEADS), "recall", "false_per_hour")


def _calibrated(spark, d):
    return prob(spark, d).select("doc_id", F.round(M.platt(F.col("p"), 1.25, -0.5), 6).alias("p_calibrated"))


def _fitted(spark, d):
    rows = prob(spark, d)
    slope, intercept = M.fit_platt(rows)
    return rows.groupBy("lang").agg(F.round(F.avg(M.platt(F.col("p"), slope, intercept)), 6).alias("mean_calibrated"), F.round(F.avg("y"), 6).alias("rate"))


def _reliability_boot(spark, d):
    p = prob(spark, d)
    per = p.groupBy(F.col("lang").alias("circuit"), F.col("source").alias("car_id"), M.bin_of(F.col("p"), 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))
    w = L.hash_draws(per.select("circuit", "car_id").distinct(), 50, "r")
    each = per.join(w, ["circuit", "car_id"]).groupBy("draw", "bin").agg((F.sum(F.col("events") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("f"))
    q = F.percentile("f", F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy("bin").agg(F.count(F.lit(1)).alias("draws"), F.avg("f").alias("m"), q.alias("q")).select("bin", "draws", F.round("m", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


BODY = ["v_long", "v_lat", "yaw_rate"]
ALPHAS = [0.0, 0.01, 0.1, 1.0, 10.0, 100.0]
SEED = 20270927


def _transitions(spark, d):
    """Body states of the telemetry; a frame stands for one 20 Hz step. The query adds a nudge, as many values end in a five where they are rounded."""
    body = {"v_long": F.col("value") / 10, "v_lat": F.col("outside_depth_m") / 10, "yaw_rate": (F.col("k") - 50) / 500.0, "a_long": F.col("outside_depth_m") / 5, "a_lat": (F.col("k") - 50) / 50.0}
    return D.transition_residuals(tele(spark, d).withColumns(body), F.lit(0.05))


def _training_pairs(spark, d):
    """Pairs of the telemetry, with bodies as in the transitions; design and targets as columns of their own."""
    t = tele(spark, d).withColumns({"v_long": F.col("value") / 10, "v_lat": F.col("outside_depth_m") / 10, "yaw_rate": (F.col("k") - 50) / 500.0, "a_long": F.col("outside_depth_m") / 5, "a_lat": (F.col("k") - 50) / 50.0,
                                    "heading_error": F.col("k") / 20.0, "offset": F.col("centerline_arclength_wrapped_m") / 100, "curvature": F.col("value") / 1000, "input_valid_causal": F.col("active") & (F.col("pit_status") == 0)})
    pairs = D.training_pairs(t)
    design = {f"x{i}": F.round(F.col("design")[i], 6) for i in range(len(D.DESIGN) + 1)}
    targets = {c: F.round(F.col("targets")[i] + 1e-9, 6) for i, c in enumerate(D.TARGETS)}
    return pairs.withColumns(design | targets).select(*KEY, *design, *targets)


def _bayesian_mean(spark, d):
    """Spread of the bootstrapped coefficients, by input and target."""
    m = D.fit_bayesian(_transitions(spark, d), BODY, 1.0, 256, SEED)
    mean, sd, names = m.coefficients.mean(0), m.coefficients.std(0), ["intercept", *BODY]
    rows = [(a, b, float(mean[i, j]), float(sd[i, j])) for i, a in enumerate(names) for j, b in enumerate(D.TARGETS)]
    return _rounded(spark.createDataFrame(rows, "input string, target string, mean double, spread double"), "mean", "spread")


def _residual_samples(spark, d):
    """Four draws of the residuals of every transition, beside their mean."""
    rows = stored(_transitions(spark, d).dropna(subset=KEY), "transitions")
    model = D.fit_bayesian(rows, BODY, 1.0, 64, SEED)
    means = [f"mean_{t}" for t in D.TARGETS]
    return _rounded(D.sample_residuals(D.predict_mean(rows, model), model, KEY, 4, SEED, also=means), *D.TARGETS, *means)


def _side_hazard(spark, d):
    key = [*UNIT, "frame_index"]
    t = tele(spark, d).select(*key, (F.col("value") / 100).alias("level"), (F.col("k") / 100.0).alias("place"))
    rows = stored(V.hazard_rows(tele(spark, d), _events(spark, d)).join(t, key), "hazard-rows")
    w = H.fit_side_hazard(rows, ["level", "place"], l2=0.01)
    out = H.horizon_probabilities(H.step_probabilities(rows, ["level", "place"], w), {6.0: 1, 24.0: 4})
    return _rounded(out.select(*key, "label", "horizon", "h_no_exit", "h_left", "h_right"), "h_no_exit", "h_left", "h_right")


def _rate_upper(spark, d):
    found = _ledger(spark, d).groupBy("circuit", "lead").agg(F.sum("false_proposals").alias("false_proposals"), F.sum("exposure").alias("exposure"))
    return _rounded(H.rate_upper(found, "false_proposals", "exposure"), "exposure", "rate_upper")


KEY = [*UNIT, "frame_index"]
#: Fixed coefficients (intercept, level, place) of the sides of two hazards; a fitted one has no SQL twin.
HAZARDS = {"hazard": [[-2.0, -2.5], [1.0, 0.5], [0.25, -0.5]], "twin": [[-1.5, -1.5], [0.5, 0.5], [0.0, 0.0]]}
HORIZON_STEPS = {6.0: 1, 12.0: 2, 24.0: 4}


def _hazard_rows_at(spark, d, weights):
    t = tele(spark, d).select(*KEY, "centerline_arclength_wrapped_m", "value", (F.col("value") / 100).alias("level"), (F.col("k") / 100.0).alias("place"))
    return H.horizon_probabilities(H.step_probabilities(t, ["level", "place"], np.array(weights)), HORIZON_STEPS)


def _hazard_mass(spark, d, weights=HAZARDS["hazard"]):
    return E.hazard_mass(_hazard_rows_at(spark, d, weights), KEY, "centerline_arclength_wrapped_m", "value", list(HORIZON_STEPS), 1000.0, 25.0, 0.25)


def _compact(spark, d, method="hazard"):
    keys = scores(spark, d).select(*KEY, "input_valid_causal", "in_corridor", "hard_break")
    out = E.compact_forecast(_hazard_mass(spark, d, HAZARDS[method]), keys, KEY, list(HORIZON_STEPS), 24.0, 40, method)
    return _rounded(out, *(c for c in out.columns if c.startswith("raw_")))


def _mass_defects(spark, d):
    """Mass that isn't one: line items whose forecast stands for too much, against a stay of 0.5."""
    m = _mass(spark, d).select("row", F.lit(1.5).alias("horizon"), "mass")
    stay = m.select("row", "horizon").distinct().withColumn("h_no_exit", F.lit(0.5))
    return E.mass_defects(m, stay, ["row"]).withColumn("total", F.round("total", 6))


def _delay_ledger(spark, d):
    labels = _labels(spark, d).where("threshold = 0.1").select("*", F.explode(F.array(*map(F.lit, DELAYS))).alias("delay"))
    labels = labels.select("*", F.explode(F.array(*map(F.lit, LEADS))).alias("need"))
    left = F.round(F.col("lead") - F.col("delay"), 6)
    hit = F.when(F.col("localized_hit") & (left >= F.col("need") - 1e-12), F.col("matched_event_id"))
    wrong = F.when(F.col("matched_event_id").isNotNull(), ~F.coalesce(F.col("localized_hit") & (left >= -1e-12), F.lit(False))).otherwise(F.col("false_proposal"))
    found = labels.groupBy(*UNIT, "delay", F.col("need").alias("lead")).agg(F.count_distinct(hit).alias("hits"), F.count_if(wrong).alias("false_proposals"))
    base = _ledger(spark, d).drop("hits", "false_proposals").withColumn("delay", F.explode(F.array(*map(F.lit, DELAYS))))
    return base.join(found, [*UNIT, "delay", "lead"], "left").fillna(0, ["hits", "false_proposals"])


def _cells(spark, d):
    """A cell for each circuit, lead and budget, with whether its exposure allows one false alert."""
    x = _exposure(spark, d).groupBy("circuit").agg(F.round(F.sum("prebuffer_seconds"), 4).alias("exposure"))
    cells = x.withColumn("lead", F.explode(F.array(*map(F.lit, LEADS)))).withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS))))
    return cells.withColumn("estimable", E.estimable(F.col("budget"), F.col("exposure"), 10.0))


def _flawed_ledger(spark, d):
    """The ledger with defects by rule of the car's number: negative and missing counts, no exposure, too many hits, repeated and missing rows, changing denominators."""
    n = F.substring_index("car_id", "_", -1).cast("long")
    x = _ledger(spark, d).withColumn("n", n)
    first = F.col("lead") == LEADS[0]
    x = x.withColumns({
        "hits": F.when((F.col("n") % 13 == 1) & first, -1).when(F.col("n") % 13 == 2, F.col("events") + 1).otherwise(F.col("hits")),
        "unresolved": F.when((F.col("n") % 13 == 3) & first, None).otherwise(F.col("unresolved")),
        "exposure": F.when(F.col("n") % 13 == 4, 0.0).when((F.col("n") % 13 == 5) & first, F.col("exposure") + 1.0).otherwise(F.col("exposure")),
    }).where(~((F.col("n") % 13 == 6) & first))
    return x.unionByName(x.where("n % 13 = 7")).drop("n")


def _flawed_cells(spark, d):
    """Estimable cells, with some repeated and some of an unknown lead added."""
    c = _cells(spark, d).where("estimable")
    return c.unionByName(c.where(F.col("lead") == LEADS[1])).unionByName(c.where(F.col("lead") == LEADS[2]).withColumn("lead", F.lit(99.0)))


def _recomputed(spark, d):
    """Cars whose false proposals of the longest and shortest lead, recomputed from the labels with a delay, differ from the ledger."""
    late = _delay_ledger(spark, d).where("delay = 6").select(*UNIT, "lead", "hits", "false_proposals")
    return E.compare_derived(_ledger(spark, d), late, [*UNIT, "lead"], ["hits", "false_proposals"]).withColumn("differs", F.concat_ws(",", "differs"))


def _npz(spark, d):
    t = tele(spark, d)
    files = compact.pack_arrays(t, F.concat(F.lit("cars/"), "car_id", F.lit("/lap_data.npz")), "frame_index", ["current_lap_time", "lap_number", "value"])
    back = compact.array_rows(compact.read_arrays(files), {"clock": ("current_lap_time", 0), "lap_number": ("lap_number", 0), "value": ("value", 0)})
    return back.select(F.element_at(F.split("path", "/"), -2).alias("car_id"), F.col("sample").alias("frame_index"), F.round("clock", 6).alias("clock"), F.col("lap_number").cast("long").alias("lap_number"), F.round("value", 6).alias("value"))


def _pcd(spark, d):
    t = tele(spark, d).select("car_id", "frame_index", F.round("value", 4).alias("x"), F.round("outside_depth_m", 4).alias("y"), F.col("k").cast("double").alias("z"))
    clouds = maps.read_clouds(maps.cloud_text(t, ["car_id"], "frame_index").withColumnRenamed("car_id", "path"))
    return maps.cloud_points(clouds).withColumnsRenamed({"path": "car_id", "point": "frame_index"})


def _metadata(spark, d):
    first = tele(spark, d).where("frame_index = 0").select("car_id", "user_id", F.round("value", 3).alias("v"), "k")
    line = lambda *parts: F.concat(*(F.lit(p) if p not in ("v", "k", "car_id") else F.col(p).cast("string") for p in parts))
    turn = F.concat(F.lit("clockwise: "), F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"))
    text = F.concat_ws("\n", line("# pose"), line("trackname: ", "car_id"), turn, line("frequency_history: 20"), line("timestep_history: 0.05"), line("starting_pose_origin:"), line("- ", "v"), line("- ", "k"), line("- -1.5e0"), line("starting_pose_quaternion:"), *(line(f"- {q}") for q in ("0", "0.0", "0", "1")))
    got = maps.require_clean(maps.read_metadata(first.select(F.col("car_id").alias("path"), text.alias("text"))))
    return got.select("path", "trackname", "clockwise", "frequency_hz", "timestep_seconds", *(F.col("origin")[i].alias(f"origin_{i}") for i in range(3)), F.col("quaternion")[3].alias("w"))


def _direction(spark, d):
    turn = F.col("k") / 50.0
    return _rounded(E.travel_direction(tele(spark, d), ["circuit"], (F.cos(turn), F.sin(turn)), (F.lit(1.0), F.lit(0.5)), F.col("value")), "median", "p01", "positive")


def _calibration_line(spark, d):
    intercept, slope = M.calibration_line(prob(spark, d))
    return prob(spark, d).agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(round(intercept, 5)).alias("intercept"), F.lit(round(slope, 5)).alias("slope"))


@once
def _method_scores(spark, d):
    return E.score_methods([_compact(spark, d, m) for m in HAZARDS])


@once
def _calibrators(spark, d):
    """Fits of the calibration cars of fold C0, for both hazards and three horizons."""
    scored = attach_partition(_method_scores(spark, d), _loco(spark, d), "C0", UNIT)
    return B.fit_horizon_calibrators(scored, _targets(spark, d), KEY, list(HORIZON_STEPS))


def _targets(spark, d):
    events = X.next_events(tele(spark, d), _events(spark, d)).select(*KEY, "next_event_id", "time_to_next")
    return events.join(V.support_flags(tele(spark, d), list(HORIZON_STEPS)).drop("input_valid_causal"), KEY)


def _car_reliability(spark, d):
    """Cars of the test circuit C0, at the calibrated probabilities of both methods."""
    scored = B.apply_horizon_calibrators(_method_scores(spark, d).where("circuit = 'C0'"), _calibrators(spark, d), list(HORIZON_STEPS))
    rows = B.horizon_rows(scored, _targets(spark, d), KEY, list(HORIZON_STEPS), "exit_probability")
    return _rounded(M.reliability_clusters(rows, UNIT), "probability_sum")


def _calibrated_scores(spark, d):
    out = B.apply_horizon_calibrators(_method_scores(spark, d), _calibrators(spark, d), list(HORIZON_STEPS))
    names = [V.horizon_column("exit_probability", h) for h in HORIZON_STEPS] + ["proposal_score"]
    return _rounded(out.select(*KEY, "method", *names), *names)


def _calibrated_mass(spark, d):
    rows = _hazard_rows_at(spark, d, HAZARDS["hazard"]).withColumn("method", F.lit("hazard"))
    mass = _hazard_mass(spark, d).withColumn("method", F.lit("hazard"))
    after, stay = B.calibrate_mass(mass, rows.select(*KEY, "method", "horizon", "h_no_exit"), _calibrators(spark, d), KEY)
    return _rounded(after.join(stay, [*KEY, "method", "horizon"]).drop("method"), "mass", "h_no_exit")


def _alerts(found):
    return found.select(*UNIT, "proposal_number", F.round("proposal_time", 6).alias("proposal_time"), "predicted_side", "predicted_bin", F.round("resolution_time", 6).alias("resolution_time"), "resolution_type", "unresolved")


TIMELY = P.ProposalConfig(POLICY.horizon, POLICY.persistence, POLICY.rearm, timely=True)


def _streamed(spark, d):
    """The scores as a stream, all in one batch, until it has nothing more to do; then what it still held."""
    rows, sink, checkpoint = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    scores(spark, d).select(*UNIT, "frame_index", *P.ROW).write.parquet(rows)
    stream = spark.readStream.schema(spark.read.parquet(rows).schema).parquet(rows)
    query = S.timed_alerts(stream, 0.1, TIMELY).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.read.schema(S.TIMED_SCHEMA).parquet(sink).where("late_time is null").drop("late_time")
    return _alerts(closed.unionByName(S.drain(spark, checkpoint, 0.1, TIMELY)))


@once
def _two_methods(spark, d):
    """Labels of the alerts as they come, and of the same six seconds late."""
    plain = _labels(spark, d).withColumn("method", F.lit("plain"))
    late = P.delayed(_labels(spark, d), [6.0], ["matched_event_id"]).withColumn("lead", F.round("effective_lead", 6)).withColumn("method", F.lit("late"))
    names = [*UNIT, "method", "threshold", "proposal_number", "matched_event_id", "lead", "localized_hit", "false_proposal", "unresolved_censored"]
    return plain.select(*names).unionByName(late.select(*names))


@once
def _fold_cars(spark, d):
    """Cars of fold C0 with their partition, events and exposure."""
    cars = _loco(spark, d).where("fold_test_circuit = 'C0'").select(*UNIT, "partition")
    events = _events(spark, d).groupBy(*UNIT).agg(F.count_if("qualified").alias("events"))
    exposure = _exposure(spark, d).select(*UNIT, F.col("prebuffer_seconds").alias("exposure"))
    return cars.join(exposure, UNIT).join(events, UNIT, "left").withColumn("events", F.coalesce("events", F.lit(0)))


def _cars(spark, d, partition):
    return _fold_cars(spark, d).where(F.col("partition") == partition).drop("partition")


@once
def _operating_cells(spark, d):
    """Chosen on the calibration cars of fold C0."""
    return O.choose_cells(O.threshold_summary(_two_methods(spark, d), _cars(spark, d, "calibration"), LEADS, THRESHOLDS), BUDGETS, 4.0)


@once
def _heldout(spark, d):
    cells = _operating_cells(spark, d)
    return O.heldout_ledger(cells, O.seal(cells), _two_methods(spark, d), _cars(spark, d, "test"))


def _heldout_frontier(spark, d):
    ledger = _heldout(spark, d).withColumnRenamed("required_lead", "lead")
    return L.l_star(ledger, ["method", "budget"], 0.1, F.col("budget"))


def _map_files(spark, d):
    """(manifest, files): a circuit for each region, as squares whose size goes by its key, each ring a cloud of its own."""
    r = table(spark, d, "region").select(F.col("r_name").alias("circuit"), (F.col("r_regionkey") + 1.0).alias("n"))
    rings = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(file).alias("file"), (F.lit(a) * F.col("n") + F.lit(b)).alias("half")) for role, file, a, b in (("boundary", "one", 1.0, 8.0), ("boundary", "two", 0.5, 4.0), ("center", "line", 0.75, 6.0))))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("point"), F.lit(float(x)).alias("sx"), F.lit(float(y)).alias("sy")) for i, (x, y) in enumerate(G.square(1.0))))).alias("c")
    p = r.select("circuit", F.explode(rings).alias("r")).select("circuit", "r.*", corner).select("circuit", "role", F.concat_ws("/", "circuit", "file").alias("path"), "c.point", (F.col("c.sx") * F.col("half")).alias("x"), (F.col("c.sy") * F.col("half")).alias("y"), F.lit(0.0).alias("z"))
    files = maps.cloud_text(p, ["circuit", "role", "path"], "point")
    manifest = files.select("circuit", "role", "path", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return manifest, files.select("path", "text")


def _on_maps(spark, d):
    names = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("circuit"))
    points = _points(spark, d).withColumn("key", F.pmod("id", F.lit(5))).join(F.broadcast(names), "key").select("circuit", "id", "x", "y")
    return _rounded(I.locate_on_maps(points, I.corridors(*_map_files(spark, d))), "clearance", "outside_depth", "arclength", "arclength_wrapped")


def _sealed(spark, d):
    """Users' events sealed, then some users gone, some new and some with one event altered."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    n = F.pmod("user_id", F.lit(17))
    later = e.where(n != 3).withColumn("event_type", F.when((n == 5) & (F.pmod("event_id", F.lit(2)) == 0), "altered").otherwise(F.col("event_type")))
    later = later.withColumn("user_id", F.when(n == 7, F.col("user_id") + 1_000_000).otherwise(F.col("user_id")))
    items = [stored(unit_digests(x, ["user_id"], ["event_id", "event_type", "props"]).select(F.col("user_id").cast("string").alias("name"), "digest"), "digests") for x in (e, later)]
    depth = max(1, seals.tree_depth(items[0].count()))
    trees = [seals.seal_tree(x, depth) for x in items]
    return seals.changed_items(*items, *trees, depth)


def _manifest_states(spark, d):
    """A manifest of a file for each car, some of them gone, altered, of another size or listed twice, against the files."""
    n = F.element_at(F.split("car_id", "_"), 2).cast("long") % 7
    files = tele(spark, d).groupBy("car_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%06d %d", "frame_index", "k"))), "\n").alias("text"))
    listed = files.withColumn("again", F.explode(F.when(n == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    manifest = listed.select(F.col("car_id").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    changed = F.when(n == 2, F.concat("text", F.lit("x"))).when(n == 3, F.concat(F.substring("text", 1, 1 << 30).substr(F.lit(2), F.length("text")), F.lit("x"))).otherwise(F.col("text"))
    there = files.where(n != 1).select(F.col("car_id").alias("path"), changed.alias("text"))
    return validate_manifest(manifest, there.select("path", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))


def _published(spark, d):
    """Customers published in three formats and read back by name, with a filter and some of the columns."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")
    found = []
    for kind in ("parquet", "csv", "jsonl"):
        path = f"{scratch_path(spark, 'published')}.{kind}"
        publish(rows, path)
        back = read_table(spark, path, "c_custkey long, c_acctbal double, c_mktsegment string" if kind != "parquet" else None, ["c_custkey", "c_acctbal"], "c_mktsegment = 'BUILDING'")
        found.append(back.withColumn("kind", F.lit(kind)))
    return found[0].unionByName(found[1]).unionByName(found[2])


#: Coefficients of a residual model (intercept and BODY, by target); a fitted one has no SQL twin.
ROLLOUT = [[0.01, -0.02, 0.005, 0.1, -0.1], [-0.01, 0.002, 0.001, -0.05, 0.02], [0.005, -0.01, 0.0, 0.02, -0.03], [0.02, 0.01, -0.02, -0.1, 0.05]]


def _at_points(spark, d):
    """Points as states of cars on the circuits of the map files, with what models and scores need."""
    p = _points(spark, d)
    return p.select(F.concat(F.lit("C"), F.pmod("id", F.lit(4)).cast("string")).alias("circuit"), F.concat(F.lit("car_"), "label").alias("car_id"), F.col("id").alias("frame_index"), "id", "x", "y", F.abs("z").alias("v_long"), F.lit(0.0).alias("v_lat"),
                    F.col("w").alias("yaw"), (F.col("z") / 20).alias("yaw_rate"), (F.col("e5") * 10).alias("a_long"), (F.col("e6") * 10).alias("a_lat"), (F.abs("z") / 10).alias("level"), (F.pmod("id", F.lit(100)) / 100.0).alias("place"))


def _rollout(spark, d):
    model = D.ResidualModel(tuple(BODY), np.zeros(3), np.ones(3), np.array([ROLLOUT]), np.zeros((1, 5, 5)))
    paths = Q.residual_paths(_at_points(spark, d).drop("circuit"), model, ["id"], 0.5)
    return _rounded(paths.select(F.col("id.id").alias("id"), "step", "x2", "y2"), "x2", "y2")


def _track_frames(spark, d):
    return tele(spark, d).withColumns({"v_long": F.col("value") / 10, "v_lat": F.col("outside_depth_m") / 10, "yaw_rate": (F.col("k") - 50) / 500.0, "a_long": F.col("outside_depth_m") / 5, "a_lat": (F.col("k") - 50) / 50.0,
                                       "heading_error": F.col("k") / 20.0 - 2.5, "offset": F.col("centerline_arclength_wrapped_m") / 100 - 5, "curvature": F.col("value") / 1000})


def _fold_models(spark, d, draws=32):
    """Models of fold C0, from the cars of the other circuits."""
    split = _loco(spark, d)
    rows = D.transition_residuals(_track_frames(spark, d), F.lit(0.05), also=Q.TRACK)
    t = tele(spark, d).select(*KEY, (F.col("value") / 100).alias("level"), (F.col("k") / 100.0).alias("place"))
    hazard = V.hazard_rows(tele(spark, d), _events(spark, d)).join(t, KEY)
    rows, hazard = (stored(attach_partition(x, split, "C0", UNIT), "fold-rows") for x in (rows, hazard))
    return Q.fit_fold(rows, hazard, [*BODY, *Q.TRACK], ["level", "place"], ALPHAS, draws, SEED, 0.01)


def _circuit_rings(spark, d):
    """The rings of the map files, with circuits named as the telemetry's."""
    names = table(spark, d, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("of"))
    return stored(I.corridors(*_map_files(spark, d)).join(F.broadcast(names), F.col("circuit") == F.col("name")).drop("circuit", "name").withColumnRenamed("of", "circuit"), "rings")


def _fold_scores(spark, d):
    """Six methods at the points, by the models of fold C0; 32 draws."""
    rings, points = _circuit_rings(spark, d), _at_points(spark, d)
    placed = G.locate(points.select("id", "circuit", "x", "y"), rings).select("id", "in_corridor", "arclength_wrapped")
    track = G.track_features(points.select("id", "circuit", "x", "y"), rings.where("role = 'center'")).select("id", "offset", "heading", "curvature")
    error = F.pmod(F.col("yaw") - F.col("heading") + np.pi, F.lit(2 * np.pi)) - np.pi
    rows = points.join(placed, "id").join(track, "id").withColumns({"heading_error": error, "input_valid_causal": F.lit(True), "hard_break": F.lit(False)}).drop("id", "heading")
    out = Q.score_fold(stored(rows, "fold-states"), _fold_models(spark, d), rings, [0.25, 0.5, 1.0], 2.5, KEY, 32, SEED)
    return _rounded(out, *(c for c in out.columns if c.startswith("raw_")))


def _kinematic_diagnostics(spark, d):
    c, k = F.col("value"), F.col("k") / 50.0
    t = tele(spark, d).withColumn("next", F.lead("value").over(Window.partitionBy(*UNIT).orderBy("frame_index")))
    out = E.kinematic_diagnostics(t, ["circuit"], [c, c / 2], [F.cos(k), F.sin(k)], [c / 50, k, F.lit(0.1)], [F.col("next") / 50, F.lit(1.0), F.lit(0.0)])
    return _rounded(out, *(x for x in out.columns if not x.endswith("_count") and x != "circuit"))


def _provenance(spark, d):
    """Files of each customer: its orders, as a manifest would list them."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("größe/"), F.col("o_orderkey").cast("string"))
    m = o.select(F.col("o_custkey").cast("long").alias("unit"), F.lit("set").alias("dataset"), F.lit("r1").alias("revision"), F.concat(F.lit("dir_"), F.pmod("o_custkey", F.lit(5)).cast("string")).alias("circuit_directory"),
                 name.alias("upstream_path"), F.concat(F.col("o_orderkey").cast("string"), F.lit('"x"')).alias("filename"), F.col("o_orderkey").cast("long").alias("bytes"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    return source_provenance(m, ["unit"])


def _csv_digits(spark, d):
    """Values of the events over many powers of ten, with nine significant digits."""
    e = table(spark, d, "events").select("event_id", (F.col("value") * F.pow(F.lit(10.0), F.pmod("event_id", F.lit(21)) - 8) * F.when(F.pmod("event_id", F.lit(2)) == 0, 1).otherwise(-1)).alias("value"))
    path = f"{scratch_path(spark, 'digits')}.csv"
    publish(significant_columns(e), path)
    return read_table(spark, path, "event_id long, value string")


def _exact_bins(spark, d):
    out = P.with_exact_bin(_labels(spark, d), _proposals(spark, d), _events_binned(spark, d))
    return out.select(*UNIT, "threshold", "proposal_number", "matched_event_id", "matched_side_at_onset", "matched_segment_bin", "exact_bin")


def _stacked(spark, d):
    """Three horizons against the language's own rate; every eleventh document is unresolved."""
    rows = _horizons(prob(spark, d))
    rates = M.reference_prevalence(prob(spark, d), ["lang"]).select("lang", F.col("prevalence").alias("reference"))
    stacked = rows.select("lang", "y", (F.col("doc_id") % 11 != 0).alias("evaluable"), F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"p{h}").alias("p")) for h in (500, 1500, 3000)))).alias("s"))
    return stacked.select("lang", "y", "evaluable", "s.*").join(F.broadcast(rates), "lang")


def _lines(spark, d):
    out = M.evaluate(_stacked(spark, d), ["horizon"], "lang", lines=True)
    fitted = {c: F.round(c, 5) for c in ("calibration_intercept", "calibration_slope")}
    return out.select("horizon", "scope", "lang", "n", "events", *fitted).withColumns(fitted)


def _evaluation(spark, d):
    out = M.evaluate(_stacked(spark, d), ["horizon"], "lang")
    return _rounded(out, "brier", "reference_brier", "skill", "log_score", "ece", "average_precision")


def _paired(spark, d):
    """Alerts as they come against alerts six seconds late, on the same draws."""
    out = L.paired_bootstrap(_delay_ledger(spark, d), L.hash_draws(_units(spark, d), DRAWS, "p"), "delay", 0.0, 6.0, 0.1, 0.1)
    return _rounded(out, *(c for c in out.columns if c != "draws"))


def _runtime(spark, d):
    log = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("rows"), F.round("value", 4).alias("seconds"))
    return E.runtime_summary(log, "event_type", "rows", "seconds").withColumns({"seconds": F.round("seconds", 4), "rows_per_second": F.round("rows_per_second", 6)})


QUERIES = {
    "tele_frames": lambda s, d: tele(s, d).select(*UNIT, "frame_index", F.round("time_seconds", 6).alias("time_seconds"), "lap_number", "in_corridor", F.round("outside_depth_m", 6).alias("outside_depth_m"), "active", "pit_status", "local_side", "hard_break", "artifact_seed", "continuous_segment_id"),
    "timebase_axis": _axis,  # 15, 17
    "axis_diagnostics": lambda s, d: _rounded(T.axis_diagnostics(_axis_of(s, d)), "median_source_dt", "estimated_source_hz"),  # 16
    "timing_diagnostics": lambda s, d: _rounded(T.timing_diagnostics(tele(s, d)), "span_seconds"),  # 16
    "causal_resample": lambda s, d: _rounded(T.causal_resample(tele(s, d), GRID_STEP), "target_time", "source_age"),  # 18
    "source_flags_forward": lambda s, d: T.flags_forward(tele(s, d), "artifact_seed", GRID_STEP),  # 19
    "map_kinematics": _kinematics,  # 21
    "grid_acceleration": _acceleration,  # 20
    "signed_area": lambda s, d: _rounded(G.signed_area(G.rings_of(_points(s, d), "label", "id"), "label"), "area"),  # 22
    "corridor_locate": lambda s, d: _rounded(G.locate(_points(s, d), _rings(s)), "clearance", "outside_depth", "arclength", "arclength_wrapped"),  # 25-27
    "circuit_maps": lambda s, d: _rounded(I.corridors(*_map_files(s, d)), "length", "start"),  # 6, 23
    "maps_locate": _on_maps,  # 6, 25-27
    "segment_exit": lambda s, d: _rounded(G.first_exit(_points(s, d).select("id", (F.col("x") * 1.2).alias("x"), (F.col("y") * 1.2).alias("y"), (F.col("x") + F.col("z")).alias("x2"), (F.col("y") + F.col("w")).alias("y2")), _rings(s)), "fraction", "hit_x", "hit_y"),  # 28
    "track_features": lambda s, d: _rounded(G.track_features(_points(s, d), _rings(s).where("role = 'center'")), "offset", "heading", "curvature", "arclength"),  # 29
    "track_reference": lambda s, d: _rounded(G.sample_segment(_points(s, d), _rings(s), (F.col("id") % 4).cast("int")), "offset", "heading", "curvature"),  # 24, 55
    "quaternion_yaw": lambda s, d: _points(s, d).select("id", F.round(G.yaw_of([F.col(f"e{i}") for i in range(10, 14)]), 6).alias("yaw")),  # 54
    "row_identities": lambda s, d: tele(s, d).select(*KEY, C.row_identity(SEED, "C0", "bayesian").alias("identity")).withColumn("seed", C.row_seed(F.col("identity")).cast("string")),  # 79
    "excursion_candidates": _events,  # 31-38
    "excursion_frames": lambda s, d: X.label_frames(tele(s, d), _events(s, d), CONFIG),  # 34, 39
    "interval_exposure": _exposure,  # 40
    "frame_target_join": _frame_target,  # 41, 44, 47
    "partition_attach": _partitions,  # 42, 43
    "exposure_join": _exposure_split,  # 45
    "events_semi_join": _semi,  # 46
    "key_set_check": _key_check,  # 48
    "next_event_targets": lambda s, d: X.next_events(tele(s, d), _events(s, d)),  # 49
    "event_projection": _projection,  # 49
    "causal_features": _features,  # 56
    "robust_scaler": _robust,  # 57, 67
    "robust_scaled": _scaled,  # 57
    "support_flags": lambda s, d: V.support_flags(tele(s, d), [6.0, 24.0]),  # 58
    "residual_pairs": lambda s, d: _rounded(V.residual_pairs(tele(s, d), "outside_depth_m"), "dt", "residual"),  # 59, 62
    "hazard_rows": lambda s, d: V.hazard_rows(tele(s, d), _events(s, d)),  # 63
    "circular_bins": _bins,  # 64, 65
    "loco_splits": _loco,  # 66
    "cluster_sufficient_stats": _moments,  # 68
    "ridge_fit": _ridge,  # 70, 71
    "constant_turn_forecast": lambda s, d: _rounded(R.constant_turn_forecast(_states(s, d), 1.5, 6), "x", "y", "heading"),  # 61, 76
    "transition_residuals": lambda s, d: _transitions(s, d).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in D.TARGETS}),  # 60, 62
    "residual_training_pairs": _training_pairs,  # 59, 60, 62
    "ridge_loco": lambda s, d: _rounded(D.select_ridge(_transitions(s, d), BODY, ALPHAS), "nll", "mean_nll"),  # 73
    "ridge_tuned": lambda s, d: _rounded(D.tune_ridge(_transitions(s, d), F.pmod(F.xxhash64(*UNIT), F.lit(5)) > 0, BODY, ALPHAS), "mse"),  # 74
    "side_hazard": _side_hazard,  # 75
    "constant_velocity_exits": lambda s, d: _exits(s, d, False),  # 76
    "constant_turn_exits": lambda s, d: _exits(s, d, True),  # 76
    "bayesian_residual": _bayesian_mean,  # 69, 72
    "residual_samples": _residual_samples,  # 71, 72
    "rate_upper": _rate_upper,  # 94
    "neighborhood_candidates": lambda s, d: _rounded(P.neighborhood_candidates(_mass(s, d)), "score"),  # 81
    "platt_fit": _fitted,  # 85, 87
    "apply_calibrator": _calibrated,  # 89
    "probability_metrics": lambda s, d: _rounded(M.probability_metrics(prob(s, d), "lang", 0.8), "brier", "reference_brier", "skill", "log_score"),  # 90, 95
    "performance_evaluation": _evaluation,  # 95
    "ece_bins": lambda s, d: _rounded(M.expected_calibration_error(prob(s, d), "lang"), "ece"),  # 91
    "average_precision": lambda s, d: _rounded(M.average_precision(prob(s, d), "lang"), "average_precision"),  # 93
    "monotonicity": lambda s, d: M.monotonicity(_horizons(prob(s, d)), ["p3000", "p1500", "p500"], "lang"),  # 96
    "reference_prevalence": lambda s, d: M.reference_prevalence(prob(s, d), ["lang"]).withColumn("prevalence", F.round("prevalence", 9)),  # 52, 88
    "reliability_bins": lambda s, d: _rounded(M.reliability_bins(prob(s, d), "lang"), "mean_probability", "event_frequency"),  # 97
    "reliability_clusters": lambda s, d: _rounded(M.reliability_bins(prob(s, d), "source", 5), "mean_probability", "event_frequency"),  # 98
    "alert_state_machine": lambda s, d: _alerts(P.run_alerts(scores(s, d), [0.1], POLICY)),  # 99, 100
    "timely_alerts": lambda s, d: _alerts(P.run_alerts(scores(s, d), [0.1], TIMELY)),  # 99
    "streamed_alerts": _streamed,  # 99, streaming
    "split_alerts": lambda s, d: _alerts(A.run_long_alerts(scores(s, d), [0.1], POLICY, 64)),  # 99
    "proposal_labels": lambda s, d: _rounded(_labels(s, d), "proposal_time", "lead"),  # 50, 51
    "detection_summary": _summary,  # 101
    "operating_points": lambda s, d: _rounded(P.operating_points(_summary(s, d), BUDGETS), "recall", "false_per_hour"),  # 102, 104
    "threshold_grid": lambda s, d: P.threshold_grid(scores(s, d), "proposal_score").select(F.round("threshold", 9).alias("threshold")).distinct(),  # 103
    "synthetic_delay": lambda s, d: _rounded(P.delayed(_labels(s, d).where("threshold = 0.1"), DELAYS), "effective_lead"),  # 106, 111
    "car_contributions": _ledger,  # 105
    "pooled_metrics": lambda s, d: _rounded(L.pooled_metrics(_ledger(s, d), ["lead"]), "exposure", "recall", "false_per_hour"),  # 110, 120
    "l_star": lambda s, d: L.l_star(_ledger(s, d), ["circuit"], 0.1, F.lit(0.1)),  # 108, 124
    "l_star_least_favorable": lambda s, d: L.l_star(_ledger(s, d), ["circuit"], 0.1, F.lit(0.1), F.col("false_proposals") + F.col("unresolved")),  # 109
    "warning_frontier": _frontier,  # 123
    "operating_cells": _operating_cells,  # 104
    "heldout_ledger": _heldout,  # 105
    "heldout_frontier": _heldout_frontier,  # 105, 123
    "cohort_summary": _cohort,  # 125, 129
    "bootstrap_l_star": lambda s, d: _rounded(L.bootstrap_l_star(_ledger(s, d), L.hash_draws(_units(s, d), DRAWS, "w"), 0.1, 0.1), "mean", "low", "high"),  # 113, 114
    "paired_bootstrap": _paired,  # 115
    "bootstrap_two_stage": lambda s, d: _rounded(L.bootstrap_l_star(_ledger(s, d), L.two_stage_draws(_units(s, d), DRAWS, "t"), 0.1, 0.1), "mean", "low", "high"),  # 116
    "reliability_bootstrap": _reliability_boot,  # 117
    "npz_round_trip": _npz,  # 1, 2, 10
    "pcd_round_trip": _pcd,  # 5
    "metadata_parse": _metadata,  # 4
    "natural_order": lambda s, d: _units(s, d).select(*UNIT, F.row_number().over(Window.partitionBy("circuit").orderBy(natural_key(F.col("car_id")))).alias("place")),  # 14
    "travel_direction": _direction,  # 30
    "compare_derived": _recomputed,  # 53, 120
    "hazard_mass": lambda s, d: _rounded(_hazard_mass(s, d), "mass"),  # 80
    "compact_forecast": _compact,  # 82
    "mass_defects": _mass_defects,  # 82
    "method_scores": _method_scores,  # 83
    "horizon_calibrators": lambda s, d: _calibrators(s, d).drop("steps", "converged").withColumns({c: F.round(c, 5) for c in ("slope", "intercept")}),  # 87
    "calibrated_scores": _calibrated_scores,  # 89
    "calibrated_mass": _calibrated_mass,  # 86
    "car_reliability": _car_reliability,  # 98
    "evaluation_lines": _lines,  # 92, 95
    "calibration_line": _calibration_line,  # 92
    "estimability": _cells,  # 104
    "abstention_reasons": lambda s, d: E.abstention_reasons(scores(s, d), UNIT),  # 105
    "closest_active_threshold": lambda s, d: E.closest_active(_units(s, d), _labels(s, d), UNIT),  # 107
    "delay_l_star": lambda s, d: L.l_star(_delay_ledger(s, d), ["circuit", "delay"], 0.1, F.lit(0.1)),  # 111, 121
    "complete_cells": lambda s, d: E.complete_cells(_cells(s, d), "circuit", ["lead", "budget"], 4),  # 112
    "ledger_defects": lambda s, d: E.ledger_defects(_flawed_ledger(s, d), ["lead"]),  # 118
    "runtime_summary": _runtime,  # 126
    "grid_completeness": lambda s, d: E.grid_completeness(_flawed_cells(s, d), "circuit", {"lead": LEADS, "budget": BUDGETS}),  # 132
    "manifest_states": _manifest_states,  # 3
    "published_tables": _published,  # 7, 8, 9, 11
    "sealed_changes": _sealed,  # 133, 134, 138
    "residual_rollout": _rollout,  # 71, 83
    "fold_scores": _fold_scores,  # 83, 84
    "exact_bins": _exact_bins,  # 51
    "kinematic_diagnostics": _kinematic_diagnostics,  # 30
    "map_bins": lambda s, d: _rounded(E.segment_bins(I.corridors(*_map_files(s, d))), "track_length", "low", "high"),  # 30
    "source_provenance": _provenance,  # 13
    "significant_digits": _csv_digits,  # 9
    "content_hashes": lambda s, d: unit_digests(table(s, d, "events"), ["user_id"], ["event_id", "event_type", "props"]),  # 12, 13
}

#: Queries that use telemetry, events, labels or exposure several times write each once.
SEVERAL = (
    "proposal_labels detection_summary operating_points synthetic_delay car_contributions pooled_metrics l_star l_star_least_favorable warning_frontier cohort_summary paired_bootstrap bootstrap_l_star bootstrap_two_stage "
    "compare_derived closest_active_threshold delay_l_star ledger_defects rate_upper frame_target_join partition_attach exposure_join events_semi_join key_set_check event_projection side_hazard next_event_targets excursion_frames "
    "horizon_calibrators calibrated_scores calibrated_mass car_reliability alert_state_machine split_alerts timely_alerts streamed_alerts robust_scaled operating_cells heldout_ledger heldout_frontier fold_scores exact_bins"
).split()
QUERIES |= {name: materialising(QUERIES[name]) for name in SEVERAL}
