"""Balanced label propagation: linked documents move to one shard while shards stay even.

Documents of one link group (here: equal texts) that are in one shard are
interchangeable, so the state of the propagation is a table of cells
(group, shard, number of documents); it never holds pairs. A round joins the cells
with each group's most frequent shard, which asks for moves with gains. A table of
at most shards x shards x gain classes sums what is asked; quotas that keep
each shard's load under its capacity (swaps count) are solved on it, best gains
first, and each cell moves its admitted part. Unlinked documents fill what is left.

The propagation leaves each group a home, the shard with most of it. Groups then settle whole: a table of how many
groups of each size have each home says how many stay, how many move to another shard with room, and how many fit
nowhere. Only the last, and groups larger than a shard, are cut. Unlinked documents fill each shard to its exact size by
their rank, so sizes differ by one row at most. Ranks are prefix sums over bounded chunks, and huge groups are spread
over slices: no window holds more than a slice or a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.llm.common import lookup, small_frame, stored, uniform

#: Slices of a large group, and the group size from which a group is sliced in the final order.
SLICES = 1024
LARGE_GROUP = 1000
#: Load that a shard may reach during the propagation, as a multiple of the even one.
SLACK = 1.1
#: Rows that a chunk of the final order holds on average.
CHUNK_ROWS = 500_000


def _quotas(asked: dict[tuple[int, int, int], int], load: list[int], cap: int) -> dict[tuple[int, int, int], float]:
    """Shares of the asked moves (from, to, gain class) to admit so that no load exceeds ``cap``.

    All flows are scaled down until every shard's inflow fits its room and its outflow;
    within a flow the better gains go first.
    """
    shards = range(len(load))
    flow: dict[tuple[int, int], float] = {}
    for (a, b, _), n in asked.items():
        flow[a, b] = flow.get((a, b), 0) + n
    for _ in range(100):
        worst = 1.0
        for t in shards:
            into = sum(v for (_, b), v in flow.items() if b == t)
            out = sum(v for (a, _), v in flow.items() if a == t)
            room = max(0.0, cap - load[t] + out)
            if into > room + 1e-9:
                scale = room / into
                worst = min(worst, scale)
                flow = {k: v * scale if k[1] == t else v for k, v in flow.items()}
        if worst > 1 - 1e-6:
            break
    share = {}
    for a, b in flow:
        left = flow[a, b]
        for gain in sorted((g for x, y, g in asked if (x, y) == (a, b)), reverse=True):
            n = asked[a, b, gain]
            share[a, b, gain] = max(0.0, min(1.0, left / n))
            left -= n
    return share


def propagate(cells: DataFrame, shards: int, capacity: int, rounds: int = 12, settle: float = 0.001) -> DataFrame:
    """Rounds of balanced label propagation over cells (hub, shard, n); returns the cells it ends with."""
    spark = cells.sparkSession
    cells = stored(cells, "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    for step in range(rounds if total else 0):
        load = [0] * shards
        for row in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row for each shard
            load[row.shard] = row.n
        # Each group's shards, best first: by documents there, then by a hash that all its cells agree on.
        best = cells.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")), asc=False).alias("ranked"))
        # Even rounds swap with full shards too; odd ones gather in the best shard that has room, leaving full shards for it.
        full = F.array(*map(F.lit, [s for s in range(shards) if load[s] >= capacity] or [-1]))
        closed = lambda c: F.array_contains(full, c) & F.lit(step % 2 == 1)
        ranked = F.filter("ranked", lambda r: ~closed(r.shard) & ((r.n < int(capacity * 0.9)) | ~F.array_contains(full, r.shard)))
        joined = cells.join(best.select("hub", ranked.alias("ranked")), "hub").withColumn("goal", F.try_element_at("ranked", F.lit(1)))
        ahead = F.struct("goal.n", "goal.tie") > F.struct("n", F.xxhash64("hub", "shard"))
        leaves = closed(F.col("shard")) & (F.col("goal.n") >= F.col("n")) & (F.col("n") < int(capacity * 0.9))
        joined = joined.withColumn("wants", F.coalesce((F.col("goal.shard") != F.col("shard")) & (ahead | leaves), F.lit(False)))
        joined = joined.withColumn("gain", F.when(F.col("wants"), F.floor(F.log2(F.col("goal.n") - F.col("n") + 1))).cast("int"))
        joined = joined.select("hub", "shard", "n", F.when(F.col("wants"), F.col("goal.shard")).alias("to"), "gain")
        joined = stored(joined, "moves")
        asked = {(r.shard, r.to, r.gain): r.n for r in joined.where("to is not null").groupBy("shard", "to", "gain").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            if step % 2:
                break
            continue
        share = _quotas(asked, load, capacity)
        moved = sum(asked[k] * v for k, v in share.items())
        table = small_frame(spark, [{"shard": a, "to": b, "gain": g, "share": v} for (a, b, g), v in share.items() if v > 0], "shard int, `to` int, gain int, share double")
        part = joined.join(F.broadcast(table), ["shard", "to", "gain"], "left")  # at most shards^2 x 64 rows
        # The admitted part of a cell, rounded at random by a hash so that sums meet the quota.
        go = F.least("n", F.floor(F.coalesce("share", F.lit(0.0)) * F.col("n") + uniform(F.col("hub"), F.col("shard"), F.lit(step)))).cast("bigint")
        part = part.withColumn("go", F.when(F.col("to").isNull() | F.col("share").isNull(), F.lit(0)).when(F.col("share") >= 1, F.col("n")).otherwise(go))
        halves = F.array(F.struct("hub", "shard", (F.col("n") - F.col("go")).alias("n")), F.struct("hub", F.coalesce("to", "shard").alias("shard"), F.col("go").alias("n")))
        cells = part.select(F.explode(halves).alias("c")).select("c.*").where("n > 0").groupBy("hub", "shard").agg(F.sum("n").alias("n"))
        cells = stored(cells, "cells")
        if moved < settle * total and step % 2:
            break
    return cells


def settle(classes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Where the groups of each (home, size) go: a list of (shard, groups), the rest fit nowhere whole.

    Large groups first: as many as fit stay at home, then the others go where most room is. ``room`` is used up.
    """
    goes: dict[tuple[int, int], list[tuple[int, int]]] = {k: [] for k in classes}
    left = dict(classes)
    for (home, size), n in sorted(classes.items(), key=lambda x: (-x[0][1], x[0][0])):
        stay = min(n, room[home] // size)
        if stay:
            goes[home, size].append((home, stay))
            room[home] -= stay * size
            left[home, size] -= stay
    for home, size in sorted(left, key=lambda x: (-x[1], x[0])):
        for shard in sorted(range(len(room)), key=lambda s: (-room[s], s)):
            move = min(left[home, size], room[shard] // size)
            if not move:
                break  # the others have less room
            goes[home, size].append((shard, move))
            room[shard] -= move * size
            left[home, size] -= move
    return goes


def _ranked(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with their rank (from 0) among those of equal ``keys``, in an order by chunk, then ``order``; ``chunk`` takes a bounded number of values."""
    rows = rows.withColumn("__chunk", chunk)
    counts = rows.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy(*keys).orderBy("__chunk")) - F.col("m")
    base = counts.select(*keys, "__chunk", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order))
    return rows.join(base, [*keys, "__chunk"]).withColumn(name, F.col("__before") + within - 1).drop("__chunk", "__before")


def group_labels(groups: DataFrame, cells: DataFrame, sizes: list[int]) -> tuple[DataFrame, list[int]]:
    """((hub, copies, piece_rows, labels), the room that is left in each shard).

    A group no larger than a shard is one piece. A larger one is cut into pieces of a shard's rows and a rest, whose homes are its
    shards, best first. ``labels`` has the shard of each piece, -1 for one that fits nowhere whole.
    """
    shards, limit = len(sizes), max(1, min(s for s in sizes if s) if any(sizes) else 1)
    ranked = cells.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")), asc=False).alias("ranked"))  # at most `shards` entries
    homes = groups.join(ranked, "hub").withColumn("pieces", F.ceil(F.col("copies") / limit).cast("int"))
    one = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    pieces = homes.select("hub", "copies", "pieces", "ranked", one)
    size = F.when(F.col("piece") < F.col("pieces") - 1, F.lit(limit)).otherwise(F.col("copies") - F.col("piece") * limit)
    # Pieces beyond the shards that the group has go on with the next ones.
    home = F.pmod(F.get("ranked", F.pmod(F.col("piece"), F.size("ranked"))).shard + F.floor(F.col("piece") / F.size("ranked")), F.lit(shards))
    pieces = stored(pieces.select("hub", "copies", "piece", size.cast("bigint").alias("n"), home.cast("int").alias("home")), "shard-pieces")
    # One row for each home and size: at most shards x sqrt(2 x rows).
    classes = {(r.home, r.n): r.k for r in pieces.groupBy("home", "n").agg(F.count(F.lit(1)).alias("k")).collect()}
    room = list(sizes)
    goes = settle(classes, room)
    table, upto = [], 0
    for (home, size), moves in goes.items():
        upto = 0
        for shard, k in moves:
            table.append({"home": home, "n": size, "first": upto, "last": upto + k - 1, "label": shard})
            upto += k
    spans = small_frame(cells.sparkSession, table, "home int, n bigint, first bigint, last bigint, label int")
    spans = spans.groupBy("home", "n").agg(F.collect_list(F.struct("first", "last", "label")).alias("spans"))  # at most a shard each
    ranked = _ranked(pieces, ["home", "n"], F.pmod(F.xxhash64("hub", F.lit(3)), F.lit(SLICES)).cast("int"), ["hub", "piece"], "rank")
    label = F.get(F.filter("spans", lambda x: (x.first <= F.col("rank")) & (F.col("rank") <= x.last)), F.lit(0)).label
    placed = ranked.join(F.broadcast(spans), ["home", "n"], "left").select("hub", "copies", "piece", F.coalesce(label, F.lit(-1)).alias("label"))
    labels = placed.groupBy("hub", "copies").agg(F.array_sort(F.collect_list(F.struct("piece", "label"))).alias("labels"))
    return stored(labels.select("hub", "copies", F.lit(limit).cast("bigint").alias("piece_rows"), F.col("labels.label").alias("labels"), F.col("copies").alias("n")), "shard-groups"), room


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = 12) -> DataFrame:
    """Deal documents out to ``shards`` shards whose row counts differ by one at most; equal texts are linked.

    Returns id, size, text_crc32, law ("rows"), shard, slot (gapless from 0 in each shard), grown_shard (null).

    Edge cases: a null text has no bytes (size 8, crc32 of no bytes: 0), and null and
    empty texts link to nothing; null ids and repeated rows are rows like any other;
    with fewer rows than shards some shards stay empty; an empty table gives an empty
    result. Other columns are ignored. Which of several equal rows gets which slot is
    not defined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text, F.octet_length(text)).alias("hub"))
    rows = stored(rows, "shard-rows")
    total = rows.count()
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    groups = stored(rows.where("size > 8").groupBy("hub").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "shard-links")

    # A group starts spread evenly: document r of it in shard (hash + r) mod shards.
    start = groups.select("hub", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "copies")
    turn = F.pmod(F.col("shard") - F.pmod("hub", F.lit(shards)), F.lit(shards))
    start = start.select("hub", "shard", F.expr(f"copies div {shards}").alias("each"), (F.expr(f"copies % {shards}") > turn).cast("bigint").alias("more"))
    cells = start.select("hub", F.col("shard").cast("int").alias("shard"), (F.col("each") + F.col("more")).alias("n")).where("n > 0")
    cells = propagate(cells, shards, max(1, round(SLACK * total / shards)), rounds)
    labels, room = group_labels(groups, cells, sizes)

    # Empty texts have a hub too, but no group.
    known = lookup(rows, labels, "hub", "n", ["id"])
    slices = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SLICES)).cast("int")
    small = known.where("copies is null or size(labels) = 1").withColumn("piece", F.lit(0).cast("bigint"))
    wide = _ranked(known.where("size(labels) > 1"), ["hub"], slices, ["id"], "rank").withColumn("piece", F.expr("rank div piece_rows")).drop("rank")
    label = F.coalesce(F.get("labels", F.col("piece").cast("int")), F.lit(-1))
    linked = F.col("copies").isNotNull()
    large = F.coalesce(F.col("copies") >= LARGE_GROUP, F.lit(False))
    chunks = int(min(4096, max(32, total // CHUNK_ROWS // max(1, shards // 8))))
    own = F.when(linked, F.col("hub")).otherwise(F.xxhash64("id", "hub", F.lit(11)))
    keyed = small.unionByName(wide).select(
        "id", "size", "crc", "hub", label.alias("label"), F.when(large, 0).when(linked, 1).otherwise(2).alias("class"),
        F.when(large, F.pmod("hub", F.lit(64))).otherwise(F.pmod(own, F.lit(chunks))).cast("int").alias("c1"), F.when(large, F.pmod(slices, F.lit(64))).otherwise(0).alias("c2"),
    )
    keyed = stored(keyed, "shard-labels")
    # What has no shard yet fills the shards up in one order, groups that had to be cut before single documents.
    order = ["class", "c1", "c2"]
    open_rows = keyed.where("label < 0")
    upto_room = [sum(room[: s + 1]) for s in range(shards)]

    def numbered(d: DataFrame, keys: list[str]) -> DataFrame:
        """``d`` with ``at``, its place from 0 by ``keys`` and the order above; the table of counts is bounded (keys x classes x chunks)."""
        sums = d.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("m"))
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select(*keys, *order, F.coalesce(F.sum("m").over(w), F.lit(0)).alias("base"))
        return d.join(base, [*keys, *order]).withColumn("at", F.col("base") + F.row_number().over(Window.partitionBy(*keys, *order).orderBy("hub", "id")) - 1).drop("base")

    fill = F.lit(shards - 1)
    for s in reversed(range(shards)):
        fill = F.when(F.col("at") < upto_room[s], s).otherwise(fill)
    filled = numbered(open_rows, []).withColumn("label", fill.cast("int")).drop("at")
    final = numbered(keyed.where("label >= 0").unionByName(filled), ["label"])
    return final.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("label").alias("shard"), F.col("at").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_groups(sharded: DataFrame, group: Column) -> DataFrame:
    """One row: groups of more than one row, how many of them lie in several shards, and the links cut (shards of a group but one, summed)."""
    per = sharded.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("k")).where("n > 1")
    return per.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("k") > 1).alias("cut"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("links"))
