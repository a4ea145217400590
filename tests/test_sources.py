"""Readers and writers: round trips, and what is wrong with broken files."""

import io

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from apexframe import scratch
from apexframe.contracts import DataValidationError
from apexframe.sources import compact, maps, tables

CLOUD = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z w\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 2\nDATA ascii\n1 2 3 4\n5 6e0 -7 8\n"
POSE = "# pose\ntrackname: Some Track\nclockwise: true\nfrequency_history: 20\ntimestep_history: 0.05\nstarting_pose_origin:\n- 1\n- 2.5\n- -3e0\nstarting_pose_quaternion:\n- 0\n- 0\n- 0\n- 1\n"


def archive(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def car(n=4, **changed) -> dict[str, bytes]:
    sizes = {a: (n, compact.WIDTHS[a]) if a in compact.WIDTHS else (n,) for names in compact.ARCHIVES.values() for a in names}
    return {f: archive(**{a: changed.get(a, np.arange(np.prod(sizes[a]), dtype=float).reshape(sizes[a])) for a in names if changed.get(a, 1) is not None}) for f, names in compact.ARCHIVES.items()}


def arrays_of(spark, cars: dict[str, dict[str, bytes]]):
    rows = [(f"root/{c}/{f}", bytearray(b)) for c, files in cars.items() for f, b in files.items()]
    return compact.read_arrays(spark.createDataFrame(rows, "path string, content binary"))


def test_a_car_of_three_archives(spark):
    bad = car(lap_numbers=np.arange(3.0), positions=np.full((4, 3), np.nan), pit_status=None)
    a = arrays_of(spark, {"good": car(), "bad": bad, "text": car(lap_distances=np.array(["a", "b"]))})
    got = {r.car_path: (r.samples, r.problems) for r in compact.car_problems(a).collect()}
    assert got["root/good"] == (4, [])
    assert got["root/bad"] == (4, ["lap_data.npz:pit_status:missing", "motion_data.npz:positions:not finite", "motion and lap lengths differ"])
    assert got["root/text"][1] == ["lap_data.npz:lap_distances:not a numeric array"]


def test_objects_are_never_unpickled_and_broken_files_are_rows(spark):
    files = [("a", bytearray(archive(o=np.array([{}], dtype=object), n=np.arange(2)))), ("b", bytearray(b"junk")), ("c", None), ("d", bytearray())]
    got = {(r.path, r.name): r.problem for r in compact.read_arrays(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got[("a", "o")] == "not a numeric array" and got[("a", "n")] is None
    assert all(got[(p, None)].startswith("unreadable") for p in "bcd")


def test_array_rows_take_places_of_wide_arrays(spark):
    a = arrays_of(spark, {"c": {"motion_data.npz": archive(positions=np.arange(6.0).reshape(2, 3), t=np.array([7.0]), none=np.zeros((0, 3)))}})
    got = compact.array_rows(a, {"y": ("positions", 1), "t": ("t", 0), "gone": ("absent", 0)}).orderBy("sample").collect()
    assert [(r.sample, r.y, r.t, r.gone) for r in got] == [(0, 1.0, 7.0, None), (1, 4.0, None, None)]
    assert compact.array_rows(a, {"y": ("none", 1)}).count() == 0


def test_archives_on_disk(spark, tmp_path):
    for f, b in car(3).items():
        (tmp_path / "car_1").mkdir(exist_ok=True)
        (tmp_path / "car_1" / f).write_bytes(b)
    a = compact.read_arrays(compact.binary_files(spark, str(tmp_path), "*.npz"))
    assert [(r.samples, r.problems) for r in compact.car_problems(a).collect()] == [(3, [])]


def test_cloud_on_disk(spark, tmp_path):
    (tmp_path / "outer.pcd").write_text(CLOUD)
    clouds = maps.read_clouds(maps.text_files(spark, str(tmp_path), "*.pcd"))
    got = maps.cloud_points(clouds).orderBy("point").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(1, 2, 3), (5, 6, -7)]
    assert clouds.first().fields == ["x", "y", "z", "w"] and maps.require_clean(clouds).count() == 1


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (("DATA ascii", "DATA binary"), "not ascii"), (("VERSION 0.7", "VERSION 0.6"), "version"), (("WIDTH 2\n", ""), "missing headers"), (("WIDTH 2", "WIDTH 2\nWIDTH 2"), "repeated header"), (("FIELDS x y z", "FIELDS x y q"), "no x, y, z"),
        (("z w", "z z"), "repeated field"), (("TYPE F F F F", "TYPE F F F U"), "type"), (("SIZE 4 4 4 4", "SIZE 4 4 4"), "size"), (("COUNT 1 1 1 1", "COUNT 1 1 1 2"), "count"), (("HEIGHT 1", "HEIGHT 2"), "dimensions"), (("WIDTH 2", "WIDTH two"), "dimensions"),
        (("5 6e0", "5"), "number of values"), (("6e0", "nan"), "not finite"), (("6e0", "six"), "not finite"), ((CLOUD, ""), "missing headers"),
    ],
)
def test_broken_clouds(spark, change, problem):
    d = maps.read_clouds(spark.createDataFrame([("p", CLOUD.replace(*change))], "path string, text string"))
    assert d.first().problem == problem


def test_metadata(spark):
    bad = [("null", None, "trackname")] + [(w, POSE.replace(*c), w) for w, c in {
        "unsafe token": ("clockwise: true", "clockwise: !!bool true"), "trackname": ("Some Track", "a/b"), "clockwise": ("true", "yes"), "frequency": ("20", "-20"), "timestep": ("timestep_history: 0.05\n", ""),
        "frequency and timestep disagree": ("0.05", "0.06"), "origin": ("- 2.5\n", ""), "quaternion": ("- 0\n- 1\n", "- 1\n"), "quaternion isn't a unit": ("- 0\n- 1\n", "- 1\n- 1\n"),
    }.items()]
    d = maps.read_metadata(spark.createDataFrame([("good", POSE), *((p, t) for p, t, _ in bad)], "path string, text string"))
    got = {r.path: r for r in d.collect()}
    good = got["good"]
    assert (good.problem, good.trackname, good.clockwise, good.frequency_hz, good.origin, good.quaternion) == (None, "Some Track", True, 20.0, [1.0, 2.5, -3.0], [0.0, 0.0, 0.0, 1.0])
    assert {p: got[p].problem for p, _, _ in bad} == {p: w for p, _, w in bad}
    with pytest.raises(PySparkException, match="clockwise"):
        maps.require_clean(d.where("path = 'clockwise'")).collect()


@pytest.mark.parametrize("kind", ["parquet", "csv", "jsonl"])
def test_published_tables_come_back_and_stay(spark, tmp_path, kind):
    path = str(tmp_path / f"t.{kind}")
    tables.publish(spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string"), path)
    with pytest.raises(DataValidationError):
        tables.publish(spark.range(1), path)
    assert [p.name for p in tmp_path.iterdir()] == [f"t.{kind}"]
    assert [r.s for r in tables.read_table(spark, path, columns=["s"], where="n > 1").collect()] == ["b"]


def test_unknown_tables_and_columns(spark, tmp_path):
    tables.publish(spark.range(2), str(tmp_path / "t.parquet"))
    with pytest.raises(DataValidationError):
        tables.read_table(spark, str(tmp_path / "t.parquet"), columns=["other"])
    with pytest.raises(DataValidationError):
        tables.read_table(spark, str(tmp_path / "t.feather"))


def test_natural_order(spark):
    names = ["car_10", "car_9", "zoo", "bus_1", "car_"]
    d = spark.createDataFrame([(n,) for n in names], "n string").orderBy(tables.natural_key(F.col("n")))
    assert [r.n for r in d.collect()] == ["bus_1", "car_9", "car_10", "car_", "zoo"]


def test_scratch_tables_can_be_cleared(spark):
    kept = scratch.stored(spark.range(3), "t")
    assert kept.count() == 3 and scratch.clear(spark) and not scratch.clear(spark)
    with pytest.raises(Exception):  # noqa: B017
        kept.count()
    assert scratch.stored(spark.range(2), "t").count() == 2
