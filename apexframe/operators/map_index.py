"""Maps of many circuits: corridors from a manifest's files, and a grid index that finds a point's nearest sides without folding over all of them.

A side is entered in the cells around it, so a point needs its own cell alone: what isn't entered there is at least a cell away. A point whose nearest side
is farther than that goes on to cells of twice the width, until the bound holds. Whether a point lies in a ring needs the sides in its
row of cells only. Each lookup is an equi-join of points with one short array; no point is multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError
from apexframe.operators.geometry import _along, _gap
from apexframe.scratch import stored
from apexframe.sources.integrity import validate_manifest
from apexframe.sources.maps import cloud_points, read_clouds

RINGS = ("outer", "inner", "center")
#: Width of the finest cells in mean lengths of a circuit's sides.
CELL_SIDES = 2.0
#: Pieces of a side are at most that many cells long where they are entered.
PIECE_CELLS = 4.0
#: Doublings of the cells after which a map must have been found.
MOST_LEVELS = 60


def corridors(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(circuit, role, idx, ax, ay, bx, by, length, start): the rings of every circuit of a manifest, as outer, inner and center.

    ``manifest`` has circuit, role, path, bytes and sha256; a circuit needs two files of the role ``boundary`` and one of the role ``center``, other roles
    are left alone. ``files`` are (path, text). The larger boundary is the outer one. Files that are missing, listed twice or not what
    the manifest says, other numbers of them, clouds with a problem, rings of under three points, points repeated in a row, and boundaries of equal area are errors.
    """
    wanted = manifest.where(F.col("role").isin("boundary", "center"))
    found = files.join(wanted.select("path").distinct(), "path", "left_semi")
    content = found.select("path", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    if bad := validate_manifest(wanted, content).where("state != 'ok'").take(5):
        raise DataValidationError(f"map files: {[(r.path, r.state) for r in bad]}")
    roles = wanted.groupBy("circuit").agg(F.count_if(F.col("role") == "boundary").alias("boundaries"), F.count_if(F.col("role") == "center").alias("centers"))
    if bad := roles.where("boundaries != 2 or centers != 1").take(5):
        raise DataValidationError(f"a circuit needs two boundaries and a center: {[tuple(r) for r in bad]}")
    clouds = stored(read_clouds(found), "map-clouds")
    if bad := clouds.where("problem is not null").take(5):
        raise DataValidationError(f"map files: {[(r.path, r.problem) for r in bad]}")
    points = cloud_points(clouds).join(wanted.select("path", "circuit", "role"), "path")
    by_file = Window.partitionBy("circuit", "role", "path").orderBy("point")
    following = lambda c: F.coalesce(F.lead(c).over(by_file), F.first(c).over(by_file))
    sides = points.select("circuit", "role", "path", F.col("point").cast("int").alias("idx"), F.col("x").alias("ax"), F.col("y").alias("ay"), following("x").alias("bx"), following("y").alias("by"))
    sides = stored(sides.withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), "map-sides")
    rings = sides.groupBy("circuit", "role", "path").agg(F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))).alias("area"), F.count(F.lit(1)).alias("points"), F.min("length").alias("least"))
    if bad := rings.where("points < 3 or not least > 0").take(5):
        raise DataValidationError(f"not a ring: {[r.path for r in bad]}")
    pair = rings.where("role = 'boundary'").groupBy("circuit").agg(F.max("area").alias("most"), F.min("area").alias("less"), F.max_by("path", "area").alias("outer"))  # two rows a circuit
    if bad := pair.where("not most - less > 1e-9 * most").take(5):
        raise DataValidationError(f"boundaries of equal area: {[r.circuit for r in bad]}")
    name = F.when(F.col("role") == "center", "center").when(F.col("path") == F.col("outer"), "outer").otherwise("inner")
    upto = Window.partitionBy("circuit", "ring").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = sides.join(pair.select("circuit", "outer"), "circuit").withColumn("ring", name)
    return named.withColumn("start", F.sum("length").over(upto) - F.col("length")).select("circuit", F.col("ring").alias("role"), "idx", "ax", "ay", "bx", "by", "length", "start")


def _cell(value: Column, width: Column) -> Column:
    return F.floor(value / width).cast("long")


SIDE = ["idx", "ax", "ay", "bx", "by", "length", "start"]


def _entries(sides: DataFrame, level: int) -> DataFrame:
    """(circuit, cx, cy, outer, inner, center): the sides of each ring entered in a cell, which are all within a cell's width of it."""
    width = F.col("cell") * float(1 << level)
    d = sides.withColumn("width", width).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("length") / (F.col("width") * PIECE_CELLS))).cast("int"))
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    end = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("pieces")
    xs, ys = [end("ax", "bx", F.col("i") + k) for k in (0, 1)], [end("ay", "by", F.col("i") + k) for k in (0, 1)]
    span = lambda v: F.sequence(_cell(F.least(*v), F.col("width")) - 1, _cell(F.greatest(*v), F.col("width")) + 1)
    d = d.select("circuit", "role", *SIDE, F.explode(span(xs)).alias("cx"), span(ys).alias("ys")).select("circuit", "role", *SIDE, "cx", F.explode("ys").alias("cy"))
    each = [F.collect_set(F.when(F.col("role") == r, F.struct(*SIDE))).alias(f"__{r}") for r in RINGS]
    return d.groupBy("circuit", "cx", "cy").agg(*each)


def _nearest_here(ring: Column, x: Column, y: Column) -> Column:
    """(tie, idx, gap, u, side) of the nearest side of an array, null of an empty one; ties, to nine digits, go to the lower side."""
    return F.array_min(F.transform(ring, lambda s: F.struct(F.round(_gap(s, x, y), 9).alias("tie"), s.idx.alias("idx"), _gap(s, x, y).alias("gap"), _along(s, x, y).alias("u"), s.alias("side"))))


def nearest_sides(points: DataFrame, sides: DataFrame) -> DataFrame:
    """``points`` (circuit, id, x, y and others) with outer, inner and center: the nearest side of each ring of their own circuit.

    A level's points are those that no finer one could settle; each is one join, and the last points of a map's surroundings see as many sides as a whole ring has.
    """
    x, y, names = F.col("x"), F.col("y"), points.columns
    left = stored(points.join(sides.select("circuit", "cell").distinct(), "circuit"), "map-points")
    done: list[DataFrame] = []
    for level in range(MOST_LEVELS):
        width = F.col("cell") * float(1 << level)
        at = left.withColumns({"cx": _cell(x, width), "cy": _cell(y, width)}).join(_entries(sides, level), ["circuit", "cx", "cy"], "left")
        at = at.select(*names, "cell", *(_nearest_here(F.col(f"__{r}"), x, y).alias(r) for r in RINGS))
        settled = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"{r}.tie") < width * (1 - 1e-9) - 2e-9, F.lit(False)) for r in RINGS))
        at = stored(at.withColumn("settled", settled), "map-nearest")
        done.append(at.where("settled").select(*names, *RINGS))
        left = at.where("not settled").select(*names, "cell")
        if not left.take(1):
            return reduce(DataFrame.unionByName, done)
    raise DataValidationError("points that no map is near")


def inside_rings(points: DataFrame, sides: DataFrame) -> DataFrame:
    """``points`` with in_outer and in_inner: a ray to the right crosses the ring's sides in the point's row of cells an odd number of times."""
    rows = sides.where(F.col("role") != "center").withColumn("cy", F.explode(F.sequence(_cell(F.least("ay", "by"), F.col("cell")), _cell(F.greatest("ay", "by"), F.col("cell")))))
    both = RINGS[:2]
    rows = rows.groupBy("circuit", "cy").agg(*(F.collect_list(F.when(F.col("role") == r, F.struct("ax", "ay", "bx", "by"))).alias(f"__{r}") for r in both))
    x, y = F.col("x"), F.col("y")
    crosses = lambda s: ((s.ay > y) != (s.by > y)) & (x < s.ax + (y - s.ay) * F.try_divide(s.bx - s.ax, s.by - s.ay))
    odd = lambda ring: F.coalesce(F.size(F.filter(ring, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1, F.lit(False))
    d = points.join(sides.select("circuit", "cell").distinct(), "circuit").withColumn("cy", _cell(y, F.col("cell"))).join(rows, ["circuit", "cy"], "left")
    return d.select(*points.columns, *(odd(F.col(f"__{r}")).alias(f"in_{r}") for r in both))


def locate_on_maps(points: DataFrame, maps: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Where each (circuit, id, x, y) lies on its circuit's map (:func:`corridors`), as :func:`apexframe.operators.geometry.locate` says it.

    Points whose circuit has no map, and points with a null or non-finite coordinate, are an error.
    """
    x, y = F.col("x"), F.col("y")
    mean = maps.groupBy("circuit").agg((F.avg("length") * CELL_SIDES).alias("cell"), F.sum(F.when(F.col("role") == "center", F.col("length"))).alias("lap"))
    sides = stored(maps.join(mean, "circuit"), "map-index")
    if bad := points.select("circuit").distinct().join(mean, "circuit", "left_anti").take(5):
        raise DataValidationError(f"no map for {[r.circuit for r in bad]}")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    checked = F.when(finite(x) & finite(y), x).otherwise(F.raise_error(F.lit("a point isn't finite")).cast("double"))
    d = inside_rings(points.select("circuit", "id", checked.alias("x"), "y"), sides)
    d = nearest_sides(d, sides).join(mean.select("circuit", "lap"), "circuit")
    d = d.withColumn("nearest", F.least("outer.gap", "inner.gap")).withColumn("inside", (F.col("in_outer") & ~F.col("in_inner")) | (F.col("nearest") <= tolerance))
    c = F.col("center.side")
    cross = ((c.bx - c.ax) * (y - c.ay) - (c.by - c.ay) * (x - c.ax)) / c.length
    arc = c.start + F.col("center.u") * c.length
    return d.select(
        "circuit", "id", F.col("inside").alias("in_corridor"), F.col("in_inner").alias("in_hole"), F.when(F.col("outer.gap") <= F.col("inner.gap"), "outer").otherwise("inner").alias("nearest_boundary"),
        F.when(F.col("inside"), F.col("nearest")).otherwise(-F.col("nearest")).alias("clearance"), F.when(F.col("inside"), 0.0).otherwise(F.col("nearest")).alias("outside_depth"),
        F.when(cross > tolerance, "left").when(cross < -tolerance, "right").otherwise("center").alias("local_side"),
        F.col("center.idx").alias("centerline_segment"), arc.alias("arclength"), F.pmod(arc, F.col("lap")).alias("arclength_wrapped"),
    )
