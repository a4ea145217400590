"""forecasts in arrays give the numbers of the columns, and only moves that may leave are handed on."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from apexframe.operators import residual as D
from apexframe.operators import rollout as Q
from apexframe.operators.forecast import first_exits
from test_rollout import KEYS, _maps, _model, _states


def test_noise_is_that_of_columns(spark):
    """The hash goes on from the keys' own, and the normal numbers are those of the column function."""
    rows = spark.range(40).select((F.col("id") * 7 - 99).alias("key"), F.concat(F.lit("ü"), "id").alias("name"), (F.col("id") % 5).cast("int").alias("draw"), (F.col("id") % 3 + 1).cast("int").alias("step"), (F.col("id") % 4).cast("int").alias("k"))
    got = rows.select("*", *(F.xxhash64(F.lit(kind), F.lit(9), "key", "name").alias(kind) for kind in ("angle", "radius")), D._normal(F.lit(9), "key", "name", "draw", "step", "k").alias("normal"), F.xxhash64(F.lit("angle"), F.lit(9), "key", "name", "draw").alias("next")).toPandas()
    begun = [got[kind].to_numpy().view(np.uint64) for kind in ("angle", "radius")]
    assert (Q._hash_on(got["draw"].to_numpy(), begun[0]) == got["next"].to_numpy().view(np.uint64)).all()
    for c in ("draw", "step", "k"):
        begun = [Q._hash_on(got[c].to_numpy(), h) for h in begun]
    assert np.allclose(Q._normals(*begun), got["normal"], rtol=1e-12, atol=1e-12)


def test_moves_beside_a_boundary_are_all_that_leave(spark):
    """The exits of the moves that are handed on are those of all moves, though they are few; states without a map are an error."""
    states, maps, model = _states(spark, 60), _maps(spark), _model(3, 0.01)
    every, few = (Q.residual_paths(states, model, KEYS, 1.0, maps, 4, 3, beside=b).cache() for b in (False, True))
    assert every.count() == 60 * 4 * 20 and 0 < few.count() < every.count() / 4
    exits = [sorted(map(tuple, first_exits(p, maps, 2.5).collect())) for p in (every, few)]
    assert exits[0] and exits[0] == exits[1]
    with pytest.raises(PySparkException):
        Q.residual_paths(states, model, KEYS, 0.1, maps.where("circuit = 'A'")).collect()


def test_shared_moments_and_scalings_give_the_same_fits(spark):
    """One pass over the rows serves the choice of alpha and both fits."""
    rng = np.random.default_rng(8)
    rows = [(f"C{i % 3}", f"car_{i % 12}", *map(float, rng.normal(size=2 + len(D.TARGETS)))) for i in range(240)]
    d = spark.createDataFrame(rows, "circuit string, car_id string, a double, b double, " + ", ".join(f"{t} double" for t in D.TARGETS))
    shared = D.shared_by_fits(d, ["a", "b"])
    assert set(shared[1]) == {None, "C0", "C1", "C2"}
    ridge = [sorted(map(tuple, D.select_ridge(d, ["a", "b"], [0.1, 1.0], shared=s).collect())) for s in (None, shared)]
    models = [D.fit_bayesian(d, ["a", "b"], 1.0, 8, 1, shared=s) for s in (None, shared)]
    assert [r[:2] + r[4:] for r in ridge[0]] == [r[:2] + r[4:] for r in ridge[1]] and np.allclose([r[2:4] for r in ridge[0]], [r[2:4] for r in ridge[1]])
    assert (models[0].center == models[1].center).all() and (models[0].scale == models[1].scale).all() and np.allclose(models[0].coefficients, models[1].coefficients)
