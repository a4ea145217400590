import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.operators import map_index as I
from apexframe.operators.geometry import locate
from apexframe.sources.maps import cloud_text


def _ring(n, radius, seed, dx=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a = 2 * math.pi * i / n
        r = radius * (1 + 0.15 * math.sin(3 * a)) + 0.01 * radius * rng.random()
        out.append((dx + r * math.cos(a), r * math.sin(a)))
    return out


def _files(spark, maps):
    """maps: circuit -> list of (role, file, ring)."""
    rows = [(c, role, f"{c}/{name}", i, x, y, 0.0) for c, rings in maps.items() for role, name, ring in rings for i, (x, y) in enumerate(ring)]
    files = cloud_text(spark.createDataFrame(rows, "circuit string, role string, path string, point int, x double, y double, z double"), ["circuit", "role", "path"], "point")
    manifest = files.select("circuit", "role", "path", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return manifest, files.select("path", "text")


def _map(n, size, dx=0.0):
    return [("boundary", "b", _ring(n, 0.5 * size, 1, dx)), ("boundary", "a", _ring(n, size, 2, dx)), ("center", "c", _ring(n, 0.75 * size, 3, dx)), ("start", "d", [(0.0, 0.0)])]


def test_index_says_what_folding_over_all_sides_says(spark):
    """Two circuits of 40 and 200 points a ring; points inside, near, far and very far, and on vertices."""
    maps = {"small": _map(40, 10.0), "large": _map(200, 400.0, 1000.0)}
    manifest, files = _files(spark, maps)
    rings = I.corridors(manifest, files)
    rng, points = np.random.default_rng(5), []
    for c, (size, dx) in {"small": (10.0, 0.0), "large": (400.0, 1000.0)}.items():
        points += [(c, len(points) + i, float(dx + x * size), float(y * size)) for i, (x, y) in enumerate(rng.normal(scale=0.8, size=(200, 2)))]
        points += [(c, len(points) + i, float(dx + x * size), float(y * size)) for i, (x, y) in enumerate(rng.normal(scale=100, size=(20, 2)))]
        points += [(c, len(points) + i, *v) for i, v in enumerate(maps[c][0][2][:10] + maps[c][2][2][:10])]
    d = spark.createDataFrame(points, "circuit string, id long, x double, y double")
    got = {r.id: r for r in I.locate_on_maps(d, rings).collect()}
    assert len(got) == len(points)
    for c in maps:
        for r in locate(d.where(F.col("circuit") == c).drop("circuit"), rings.where(F.col("circuit") == c).drop("circuit")).collect():
            found = got[r.id]
            assert found.circuit == c and (found.in_corridor, found.in_hole, found.nearest_boundary, found.centerline_segment, found.local_side) == (r.in_corridor, r.in_hole, r.nearest_boundary, r.centerline_segment, r.local_side), r
            assert (found.clearance, found.arclength, found.arclength_wrapped) == pytest.approx((r.clearance, r.arclength, r.arclength_wrapped), abs=1e-6)


def test_maps_that_are_not_what_the_manifest_says(spark):
    manifest, files = _files(spark, {"c": _map(12, 10.0)})
    assert I.corridors(manifest, files).groupBy("role").count().count() == 3
    same = {"c": [("boundary", "a", _ring(12, 10.0, 1)), ("boundary", "b", [(x + 50, y) for x, y in _ring(12, 10.0, 1)]), ("center", "c", _ring(12, 7.0, 3))]}
    flat = {"c": [("boundary", "a", _ring(12, 10.0, 1)), ("boundary", "b", [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]), ("center", "c", _ring(12, 7.0, 3))]}
    cases = [
        (manifest, files.where("path != 'c/c'")), (manifest, files.withColumn("text", F.concat("text", F.lit(" ")))), (manifest.where("role != 'center'"), files), (manifest.where("path != 'c/a'"), files),
        (manifest.unionByName(manifest.where("path = 'c/c'")), files), _files(spark, same), _files(spark, flat),
    ]
    for m, f in cases:
        with pytest.raises(DataValidationError):
            I.corridors(m, f)
    broken = files.withColumn("text", F.regexp_replace("text", "DATA ascii", "DATA binary"))
    m = manifest.drop("bytes", "sha256").join(broken, "path").select("circuit", "role", "path", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    with pytest.raises(DataValidationError):
        I.corridors(m.where("role != 'start'"), broken)


def test_points_without_a_map(spark):
    manifest, files = _files(spark, {"c": _map(12, 10.0)})
    rings = I.corridors(manifest, files)
    with pytest.raises(DataValidationError):
        I.locate_on_maps(spark.createDataFrame([("other", 1, 0.0, 0.0)], "circuit string, id long, x double, y double"), rings)
    with pytest.raises(PySparkException):
        I.locate_on_maps(spark.createDataFrame([("c", 1, float("nan"), 0.0)], "circuit string, id long, x double, y double"), rings).collect()
