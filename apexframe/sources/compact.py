"""Array archives (NPZ) of cars: reading, checking and writing them, one car at a time inside tasks.

A file is a row (path, content), as Spark's ``binaryFile`` source gives it, so archives may also lie in a table.
A car's session bounds the size of an archive; cars are spread over tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The archives of a car, their arrays, and the widths of the motion arrays.
SHARED = ["session_times", "frame_identifiers", "overall_frame_identifiers"]
WIDTHS = {"positions": 3, "quaternions": 4, "velocities": 3, "accelerations": 3}
LAP = ["lap_distances", "total_distances", "last_lap_times", "current_lap_times", "lap_numbers", "result_status", "driver_status", "pit_status", "pit_lane_timer_active"]
SESSION = ["track_ids", "game_modes", "session_types", "game_paused"]
ARCHIVES = {"motion_data.npz": [*SHARED, *WIDTHS], "lap_data.npz": [*SHARED, *LAP], "session_data.npz": [*SHARED, *SESSION]}

ARRAY_SCHEMA = "path string, name string, shape array<long>, values array<double>, problem string"


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files below a path whose name fits."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def _arrays(path: str, content: bytes | None) -> Iterator[tuple]:
    try:
        with np.load(io.BytesIO(content or b""), allow_pickle=False) as archive:
            for name in archive.files:
                try:
                    a = archive[name]
                    yield path, name, list(a.shape), a.astype(float).ravel(), None
                except ValueError:  # pickled objects and text
                    yield path, name, None, None, "not a numeric array"
    except Exception as e:  # noqa: BLE001  a file that is no archive is a row with its problem
        yield path, None, None, None, f"unreadable: {type(e).__name__}"


def read_arrays(files: DataFrame) -> DataFrame:
    """(path, name, shape, values, problem): each array of each archive, flattened by rows.

    Pickled objects are never loaded. A file that can't be read (null or empty ones too) gives one row with a null name and its problem.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(list(_arrays(path, content)), columns=["path", "name", "shape", "values", "problem"])

    return files.select("path", "content").mapInPandas(run, ARRAY_SCHEMA)


def _part(path: Column, back: int) -> Column:
    return F.element_at(F.split(path, "/"), -back)


def car_problems(arrays: DataFrame) -> DataFrame:
    """One row for each car's folder: its number of samples and, in order, everything wrong with its three archives (an empty list if nothing is)."""
    d = arrays.select(F.regexp_replace("path", "/[^/]*$", "").alias("car_path"), _part(F.col("path"), 1).alias("file"), "name", "shape", "values", "problem")
    rows, flat = F.element_at("shape", 1), F.size("shape") == 1
    motion = F.col("name").isin(*WIDTHS) & (F.col("file") == "motion_data.npz")
    width = F.element_at(F.create_map(*(F.lit(x) for kv in WIDTHS.items() for x in kv)), F.col("name"))
    lap, session = F.col("name").isin(*LAP) & (F.col("file") == "lap_data.npz"), F.col("file") == "session_data.npz"
    finite = F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    tell = lambda what: F.concat_ws(":", "file", "name", F.lit(what))
    wrong = (
        F.when(F.col("problem").isNotNull(), F.concat_ws(":", "file", "name", "problem")).when(motion & ~((F.size("shape") == 2) & (F.try_element_at("shape", F.lit(2)) == width)), tell("shape"))
        .when(motion & ~finite, tell("not finite")).when((lap | (session & F.col("name").isin(*SHARED, *SESSION))) & ~flat, tell("not one-dimensional"))
    )
    seen = F.collect_set(F.concat_ws(":", "file", "name"))
    expected = F.array(*(F.lit(f"{f}:{a}") for f, names in ARCHIVES.items() for a in names))
    per = d.withColumn("wrong", wrong).groupBy("car_path").agg(
        F.sort_array(F.collect_list("wrong")).alias("w"), F.sort_array(F.array_except(expected, seen)).alias("absent"),
        F.min(F.when(motion | lap, rows)).alias("low"), F.max(F.when(motion | lap, rows)).alias("high"), F.min(F.when(session, rows)).alias("s_low"), F.max(F.when(session, rows)).alias("s_high"),
    )
    checks = [F.when(F.col("low") != F.col("high"), "motion and lap lengths differ"), F.when(F.col("high") == 0, "no samples"), F.when((F.col("s_low") != F.col("s_high")) | (F.col("s_high") == 0), "session lengths differ")]
    found = F.concat(F.transform("absent", lambda a: F.concat(a, F.lit(":missing"))), "w", F.array_compact(F.array(*checks)))
    return per.select("car_path", F.col("high").alias("samples"), found.alias("problems"))


def array_rows(arrays: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """A row for each sample: (path, sample, columns). A column takes its values from (array, place in the array's width).

    An array shorter than others of its file gives nulls, one that isn't there too.
    """
    names = sorted({a for a, _ in columns.values()})
    wide = arrays.where(F.col("name").isin(*names)).groupBy("path").agg(*(F.max_by(F.struct("shape", "values"), F.when(F.col("name") == n, F.lit(1))).alias(f"a_{i}") for i, n in enumerate(names)))
    sizes = [F.coalesce(F.element_at(f"a_{i}.shape", 1), F.lit(0)) for i in range(len(names))]
    length = F.greatest(*sizes, F.lit(0))
    d = wide.withColumn("sample", F.explode(F.when(length > 0, F.sequence(F.lit(0).cast("long"), length - 1))))

    def value(array: str, place: int) -> Column:
        a = f"a_{names.index(array)}"
        width = F.coalesce(F.try_element_at(f"{a}.shape", F.lit(2)), F.lit(1))
        return F.get(f"{a}.values", (F.col("sample") * width + place).cast("int"))

    return d.select("path", "sample", *(value(a, p).alias(c) for c, (a, p) in columns.items()))


def pack_arrays(rows: DataFrame, path: Column, order: str, arrays: list[str]) -> DataFrame:
    """(path, content): the rows of each path as one archive with an array for each column, in the given order. Nulls become NaN."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("_order"), io.BytesIO()
        np.savez(out, **{a: pdf[a].to_numpy(float) for a in arrays})
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [out.getvalue()]})

    d = rows.select(path.alias("path"), F.col(order).alias("_order"), *(F.col(a).cast("double").alias(a) for a in arrays))
    return d.groupBy("path").applyInPandas(pack, "path string, content binary")
