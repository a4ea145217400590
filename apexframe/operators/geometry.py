"""Planar geometry of a closed corridor: rings as segment tables, membership, nearest segment, first exit.

A ring is a table of a map's segments (bounded by the map, not by the data). The map joins the points as one row of arrays,
and each point folds over its sides: no point is multiplied, and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ring_segments(spark: SparkSession, vertices: list[tuple[float, float]], role: str) -> DataFrame:
    """(role, idx, ax, ay, bx, by, length, start): the sides of a ring with their arc length."""
    rows = [(role, i, *map(float, vertices[i]), *map(float, vertices[(i + 1) % len(vertices)])) for i in range(len(vertices))]
    d = spark.createDataFrame(rows, "role string, idx int, ax double, ay double, bx double, by double")
    d = d.withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    w = Window.partitionBy("role").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("start", F.sum("length").over(w) - F.col("length"))


def square(half: float) -> list[tuple[float, float]]:
    return [(-half, -half), (half, -half), (half, half), (-half, half)]


def rings_of(points: DataFrame, key: str, order: str) -> DataFrame:
    """(key, ax, ay, bx, by): the sides of each group's closed ring, its points joined in ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    following = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    return points.select(key, F.col("x").alias("ax"), F.col("y").alias("ay"), following("x").alias("bx"), following("y").alias("by"))


def signed_area(segments: DataFrame, key: str = "role") -> DataFrame:
    """Shoelace area of each ring, positive if it runs against the clock."""
    return segments.groupBy(key).agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))


def corridor_roles(segments: DataFrame, key: str = "role") -> DataFrame:
    """(key, area, is_outer): of two boundary rings the one with the larger absolute area is the outer; two equal areas are an error."""
    area = signed_area(segments, key).withColumn("size", F.abs("area"))
    one = area.agg(F.count(F.lit(1)).alias("rings"), F.max("size").alias("most"), F.min("size").alias("least"))
    told = F.raise_error(F.lit("a corridor needs two rings of different area")).cast("boolean")
    good = (F.col("rings") == 2) & (F.col("most") - F.col("least") > 1e-9 * F.col("most"))
    return area.join(F.broadcast(one)).select(key, "area", F.when(~good, told).otherwise(F.col("size") == F.col("most")).alias("is_outer"))


def tangents(segments: DataFrame) -> DataFrame:
    """The sides with unit tangent, heading, and curvature: the turn to the next side over the mean of both lengths."""
    w = Window.partitionBy(*(c for c in ("circuit", "role") if c in segments.columns)).orderBy("idx")
    following = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    d = segments.withColumns({"tx": (F.col("bx") - F.col("ax")) / F.col("length"), "ty": (F.col("by") - F.col("ay")) / F.col("length")})
    d = d.withColumn("heading", F.atan2("ty", "tx"))
    turn = F.col("heading_next") - F.col("heading")
    return (
        d.withColumns({"heading_next": following("heading"), "length_next": following("length")})
        .withColumn("curvature", F.atan2(F.sin(turn), F.cos(turn)) / ((F.col("length") + F.col("length_next")) / 2))
        .drop("heading_next", "length_next")
    )


def _with_map(points: DataFrame, segments: DataFrame, *roles: str) -> DataFrame:
    """The rows with the map's sides as one array column for each role: the map is one row, so nothing is shuffled and no row multiplies.

    Segments with a circuit are a row for each circuit, and the points carry theirs; one without a map is an error.
    """
    side = F.struct("idx", "ax", "ay", "bx", "by", "length", "start", *(c for c in ("tx", "ty", "heading", "curvature") if c in segments.columns))
    sides = [F.array_sort(F.collect_list(F.when(F.col("role") == r, side))).alias(f"__{r}") for r in roles]
    if "circuit" not in segments.columns:
        return points.join(F.broadcast(segments.agg(*sides)))
    d = points.join(F.broadcast(segments.groupBy("circuit").agg(*sides)), "circuit", "left")
    told = F.raise_error(F.lit("a circuit has no map"))
    return d.withColumns({f"__{r}": F.coalesce(f"__{r}", told.cast(d.schema[f"__{r}"].dataType)) for r in roles})


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _along(s: Column, x: Column, y: Column) -> Column:
    """Place of the nearest point of side ``s``, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s.ax) * (s.bx - s.ax) + (y - s.ay) * (s.by - s.ay)) / (s.length * s.length)))


def _gap(s: Column, x: Column, y: Column) -> Column:
    u = _along(s, x, y)
    return F.hypot(x - s.ax - u * (s.bx - s.ax), y - s.ay - u * (s.by - s.ay))


def _inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right of (x, y) crosses the ring an odd number of times."""
    crosses = lambda s: ((s.ay > y) != (s.by > y)) & (x < s.ax + (y - s.ay) * F.try_divide(s.bx - s.ax, s.by - s.ay))
    return F.size(F.filter(ring, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1


def _covered(outer: Column, inner: Column, x: Column, y: Column, tolerance: float) -> Column:
    """In the outer ring and not in the hole, or on a boundary."""
    touches = lambda ring: F.exists(ring, lambda s: _gap(s, x, y) <= tolerance)
    return (_inside(outer, x, y) & ~_inside(inner, x, y)) | touches(outer) | touches(inner)


def _nearest(ring: Column, x: Column, y: Column) -> Column:
    """(gap, idx, place, side) of the nearest side; ties, to nine digits, go to the lower side."""
    return F.array_min(F.transform(ring, lambda s: F.struct(F.round(_gap(s, x, y), 9).alias("tie"), s.idx.alias("idx"), _gap(s, x, y).alias("gap"), _along(s, x, y).alias("u"), s.alias("side"))))


def locate(points: DataFrame, segments: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Where each (id, x, y) lies in a corridor of the roles outer, inner and center.

    Membership (boundaries count), the nearest boundary, clearance (negative outside), depth outside, and on the
    centre line the nearest side, arc length, wrapped arc length and the side of the line: left, right, or center within
    ``tolerance``. Points with a null or non-finite coordinate are an error. Repeated ids stay rows of their own.
    """
    x, y = F.col("x"), F.col("y")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    checked = F.when(finite(x) & finite(y), x).otherwise(F.raise_error(F.lit("a point isn't finite")).cast("double"))
    d = _with_map(points.withColumn("x", checked), segments, "outer", "inner", "center")
    d = d.select("id", "x", "y", *(_nearest(F.col(f"__{r}"), x, y).alias(r) for r in ("outer", "inner", "center")), _inside(F.col("__outer"), x, y).alias("in_outer"), _inside(F.col("__inner"), x, y).alias("in_hole"), F.aggregate("__center", F.lit(0.0), lambda n, s: n + s.length).alias("lap"))
    nearest = F.least("outer.gap", "inner.gap")
    d = d.withColumn("nearest", nearest).withColumn("inside", (F.col("in_outer") & ~F.col("in_hole")) | (F.col("nearest") <= tolerance))
    c = F.col("center.side")
    cross = ((c.bx - c.ax) * (y - c.ay) - (c.by - c.ay) * (x - c.ax)) / c.length
    arc = c.start + F.col("center.u") * c.length
    return d.select(
        "id", F.col("inside").alias("in_corridor"), "in_hole", F.when(F.col("outer.gap") <= F.col("inner.gap"), "outer").otherwise("inner").alias("nearest_boundary"),
        F.when(F.col("inside"), F.col("nearest")).otherwise(-F.col("nearest")).alias("clearance"), F.when(F.col("inside"), 0.0).otherwise(F.col("nearest")).alias("outside_depth"),
        F.when(cross > tolerance, "left").when(cross < -tolerance, "right").otherwise("center").alias("local_side"),
        F.col("center.idx").alias("centerline_segment"), arc.alias("arclength"), F.pmod(arc, F.col("lap")).alias("arclength_wrapped"),
    )


def sample_segment(points: DataFrame, segments: DataFrame, segment: Column) -> DataFrame:
    """Signed offset from, and heading and curvature of, the centre-line side that each (id, x, y) names (its line, not only its span); an unknown side is an error."""
    d = _with_map(points.withColumn("__segment", segment), tangents(segments.where(F.col("role") == "center")), "center")
    s = F.get(F.filter("__center", lambda v: v.idx == F.col("__segment")), F.lit(0))
    d = d.withColumn("__s", F.coalesce(s, F.raise_error(F.lit("no such side of the centre line")).cast(d.select(s.alias("s")).schema["s"].dataType)))
    s = F.col("__s")
    offset = s.tx * (F.col("y") - s.ay) - s.ty * (F.col("x") - s.ax)
    return d.select("id", s.idx.alias("segment"), offset.alias("offset"), s.heading.alias("heading"), s.curvature.alias("curvature"))


def track_features(points: DataFrame, centerline: DataFrame) -> DataFrame:
    """Nearest side of the centre line of each (id, x, y): signed offset, heading, curvature and arc length; ties go to the lower side."""
    d = _with_map(points, tangents(centerline), "center").withColumn("n", _nearest(F.col("__center"), F.col("x"), F.col("y")))
    s = F.col("n.side")
    offset = s.tx * (F.col("y") - s.ay) - s.ty * (F.col("x") - s.ax)
    return d.select("id", s.idx.alias("segment"), offset.alias("offset"), s.heading.alias("heading"), s.curvature.alias("curvature"), (s.start + F.col("n.u") * s.length).alias("arclength"))


def _hits(sides: Column, x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """Fractions of the move where it meets a side; where it runs along one, both ends of what they share."""
    rx, ry = x2 - x, y2 - y

    def of(s: Column) -> Column:
        sx, sy, qx, qy = s.bx - s.ax, s.by - s.ay, s.ax - x, s.ay - y
        cross = rx * sy - ry * sx
        t, u = F.try_divide(qx * sy - qy * sx, cross), F.try_divide(qx * ry - qy * rx, cross)
        meets = F.when((t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12), F.array(t))
        length = rx * rx + ry * ry
        t0, t1 = F.try_divide(qx * rx + qy * ry, length), F.try_divide((s.bx - x) * rx + (s.by - y) * ry, length)
        low, high = F.greatest(F.lit(0.0), F.least(t0, t1)), F.least(F.lit(1.0), F.greatest(t0, t1))
        shared = F.when((cross == 0) & (qx * ry - qy * rx == 0) & (low <= high), F.array(low, high))
        return F.coalesce(meets, shared, F.array().cast("array<double>"))

    return F.flatten(F.transform(sides, of))


def _beside(sides: Column, x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """Whether the move's box touches that of a side, with room to spare; a move that touches none meets none."""
    room = 1e-6 * (1 + F.greatest(F.abs(x), F.abs(y), F.abs(x2), F.abs(y2)))
    apart = lambda a, b, c, d: (F.greatest(a, b) + room < F.least(c, d)) | (F.greatest(c, d) + room < F.least(a, b))
    return F.exists(sides, lambda s: ~apart(x, x2, s.ax, s.bx) & ~apart(y, y2, s.ay, s.by))


def first_exit(moves: DataFrame, segments: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Where the moves (id, x, y, x2, y2) that start in the corridor and aren't wholly covered by it first meet its boundary: fraction and point.

    A move is covered if each of its pieces between boundary hits is; one that crosses the hole and comes back leaves. Moves without an
    exit are left out; a move of length zero has none.
    """
    x, y, x2, y2 = (F.col(c) for c in ("x", "y", "x2", "y2"))
    d = _with_map(moves, segments, "outer", "inner")
    d = d.where(_beside(F.col("__outer"), x, y, x2, y2) | _beside(F.col("__inner"), x, y, x2, y2))
    d = d.where(_covered(F.col("__outer"), F.col("__inner"), x, y, tolerance) & ((x != x2) | (y != y2)))
    hits = F.array_sort(F.array_distinct(F.transform(F.concat(_hits(F.col("__outer"), x, y, x2, y2), _hits(F.col("__inner"), x, y, x2, y2)), lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))))

    def outside(t: Column) -> Column:
        at = F.struct((x + t * (x2 - x)).alias("x"), (y + t * (y2 - y)).alias("y"))
        return _let(at, lambda p: ~_covered(F.col("__outer"), F.col("__inner"), p["x"], p["y"], tolerance))

    def leaves(h: Column) -> Column:
        cuts = F.array_sort(F.array_distinct(F.concat(h, F.array(F.lit(0.0), F.lit(1.0)))))
        middles = _let(cuts, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: (a + b) / 2))
        return F.when((F.size(h) > 0) & F.exists(middles, outside), F.element_at(h, 1))

    # Exploded, not filtered: a filter would go below the columns it reads, and the hits would be made again for each of their uses.
    d = d.select("id", "x", "y", "x2", "y2", F.explode(F.array_compact(F.transform(F.array(hits), leaves))).alias("t"))
    return d.select("id", F.col("t").alias("fraction"), (x + F.col("t") * (x2 - x)).alias("hit_x"), (y + F.col("t") * (y2 - y)).alias("hit_y"))


def rotation(q: list[Column]) -> list[list[Column]]:
    """Matrix of an active rotation by a quaternion (x, y, z, w)."""
    x, y, z, w = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def _dot(a: list, b: list):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def yaw_of(q: list[Column]) -> Column:
    """Planar yaw of a quaternion (x, y, z, w) of any length but zero, in (-pi, pi]."""
    x, y, z, w = q
    n = x * x + y * y + z * z + w * w
    usable = (n > 1e-24) & (n < float("inf"))
    return F.when(usable, F.atan2(2 * (w * z + x * y) / n, 1 - 2 * (y * y + z * z) / n)).otherwise(F.raise_error(F.lit("a quaternion has no direction")).cast("double"))


def map_kinematics(frames: DataFrame, origin: tuple[float, float, float], quaternion: tuple[float, float, float, float], keys: list[str], order: str) -> DataFrame:
    """Frames with world position p*, velocity v*, body acceleration a* and vehicle quaternion q* in the map's frame.

    With the map's rotation M and the vehicle's V: p' = (p - o) M, v' = v M, a' = (V a) M, and the forward axis (V e_x) M, whose
    yaw is unwrapped along each group's frames. Vehicle quaternions that aren't unit ones (within 1e-5) are an error.
    """
    m = rotation([F.lit(float(q)) for q in quaternion])
    to_map = lambda v: [_dot(v, [m[i][j] for i in range(3)]) for j in range(3)]
    q = [F.col(f"q{c}") for c in "xyzw"]
    norm = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    v = rotation(q)
    body = [F.col(f"a{c}") for c in "xyz"]
    forward = to_map([v[i][0] for i in range(3)])
    out = {
        **dict(zip(("map_x", "map_y", "map_z"), to_map([F.col(f"p{c}") - o for c, o in zip("xyz", origin, strict=True)]), strict=True)),
        **dict(zip(("map_vx", "map_vy", "map_vz"), to_map([F.col(f"v{c}") for c in "xyz"]), strict=True)),
        **dict(zip(("map_ax", "map_ay", "map_az"), to_map([_dot(v[i], body) for i in range(3)]), strict=True)),
        **dict(zip(("forward_x", "forward_y", "forward_z"), forward, strict=True)),
    }
    unit = F.abs(norm - 1) <= 1e-5 + 1e-5
    d = frames.withColumns(out).withColumn("forward_x", F.when(unit, F.col("forward_x")).otherwise(F.raise_error(F.lit("a vehicle quaternion isn't a unit")).cast("double")))
    w = Window.partitionBy(*keys).orderBy(order)
    d = d.withColumn("yaw", F.atan2("forward_y", "forward_x"))
    step = F.coalesce(F.col("yaw") - F.lag("yaw").over(w), F.lit(0.0))
    d = d.withColumn("__turns", F.when(step > math.pi, -1.0).when(step < -math.pi, 1.0).otherwise(0.0))
    d = d.withColumn("yaw", F.col("yaw") + 2 * math.pi * F.sum("__turns").over(w))
    return d.select(*keys, order, *out, "yaw")


def grid_acceleration(grid: DataFrame, keys: list[str], segment: str, order: str, time: str, velocity: list[str]) -> DataFrame:
    """The grid with each velocity's backward difference quotient inside its segment; null at a segment's start and where time doesn't rise."""
    w = Window.partitionBy(*keys, segment).orderBy(order)
    dt = F.col(time) - F.lag(time).over(w)
    return grid.withColumns({f"{v}_rate": F.when(dt > 0, (F.col(v) - F.lag(v).over(w)) / dt) for v in velocity})
