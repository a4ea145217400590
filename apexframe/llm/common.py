"""Helpers that the corpus operators share: the shared folder, written tables, bounded filters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.ranks import positions
from apexframe.scratch import scratch_path, stored

__all__ = ["positions", "scratch_path", "stored"]

#: Bits of one bitmap row (4 KiB) and of a whole key filter (8 MiB at most, whatever the input).
ROW_BITS = 32_768
FILTER_BITS = 1 << 26
#: Rows of a table that may be broadcast, and the most keys that count as hot.
BROADCAST_ROWS = 200_000
HOT_KEYS = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are cores; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A bounded list of the driver as a DataFrame, without Python on the executors."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; ASCII texts take the byte-wise path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def _filter_bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """Bitmaps of hashed keys: at most FILTER_BITS / ROW_BITS rows of 4 KiB, so fit to broadcast at any input size.

    A filter that gets full lets more rows through; it never loses one.
    """
    bit = _filter_bit(F.col(key))
    return (
        keys.select(F.expr(f"{ROW_BITS}").alias("w"), bit.alias("bit"))
        .select(F.expr("bit div w").alias("__row"), F.expr("cast(bit % w as int)").alias("pos"))
        .groupBy("__row")
        .agg(F.bitmap_construct_agg("pos").alias("__bits"))
    )


def passing(df: DataFrame, key: str, filtered: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter (see :func:`key_filter`)."""
    names = df.columns
    bit = _filter_bit(F.col(key))
    tested = df.withColumn("__bit", bit).withColumn("__row", F.expr(f"__bit div {ROW_BITS}")).join(F.broadcast(filtered), "__row")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast(__bit % {ROW_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return tested.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0).select(*names)


def flagged(df: DataFrame, key: str, filtered: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column: false means that the key is surely not in the filter."""
    names = df.columns
    bit = _filter_bit(F.col(key))
    tested = df.withColumn("__bit", bit).withColumn("__row", F.expr(f"__bit div {ROW_BITS}")).join(F.broadcast(filtered), "__row", "left")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast(__bit % {ROW_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return tested.select(*names, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0, F.lit(False)).alias(name))


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text (null counts as empty): the identity of a distinct text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def packed_rows(df: DataFrame, **extra: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside computed columns, so that no name of its own can clash; ``select("row.*")`` undoes it."""
    row = F.struct(*(F.col(f"`{n}`") for n in df.columns)).alias("row")
    return df.select(row, *(c.alias(n) for n, c in extra.items()))


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, by: list[str], whole: bool = False) -> DataFrame:
    """Left join of ``rows`` with a written table of unique keys, whose column ``count`` says how many of the rows have the key.

    A table of at most BROADCAST_ROWS (counted here) is broadcast: the rows stay where they are. Of a larger one, rows that a bitmap
    rules out stay too; keys with over a HOT_KEYS-th of the counted rows, so HOT_KEYS of them at most, are broadcast with a
    number of parts, and their rows meet the table in parts, by a hash of the columns ``by``. ``whole`` says that the table has the key of every
    row, so that no bitmap is made.
    """
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(count).alias("rows"), F.max(count).alias("most")).first()
    if size.n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(count)), key, "left")
    most = max(100_000, (size.rows or 0) // HOT_KEYS)
    if whole and (size.most or 0) <= most:
        return rows.join(table.drop(count), key, "left")
    marked = flagged(rows, key, key_filter(table, key), "__maybe")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in (key, count)]
    alone = marked.where(~F.col("__maybe") | F.col(key).isNull()).select(*rows.columns, *none)
    hot = table.where(F.col(count) > most).select(key, F.ceil(F.col(count) / most).cast("int").alias("__parts"))
    salted = marked.where(F.col("__maybe") & F.col(key).isNotNull()).drop("__maybe").join(F.broadcast(hot), key, "left")
    salted = salted.withColumn("__part", F.pmod(F.xxhash64(*by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copies = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(count) / most)).cast("int") - 1))).drop(count)
    return alone.unionByName(salted.join(copies, [key, "__part"], "left").drop("__part"))


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, members): each distinct text once as (uid, id, text) with the smallest id that has it, and (uid, id) of all rows.

    Both are written to the shared folder. Only rows whose text may recur are shuffled with
    their text; a group of copies of any size is found by a combined aggregate. The id is null only
    where all copies have none.
    """
    rows = docs.select(text_key(F.col(text_col)).alias("uid"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    members = stored(rows.select("uid", "id"), "members")
    groups = stored(members.groupBy("uid").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("copied", F.lit(True)), "copies")
    marked = flagged(rows, "uid", key_filter(groups, "uid"), "maybe")
    single = marked.where(~F.col("maybe")).select("uid", "id", "text")
    shared = lookup(marked.where("maybe").drop("maybe"), groups, "uid", "n", ["id"])
    # Rows that repeat both id and text are one text as well; a text without copies has no first id.
    chosen = shared.where("not copied or copied is null or id <=> first").groupBy("uid", "id", "text").agg(F.count(F.lit(1)).alias("n")).select("uid", "id", "text")
    return stored(single.unionByName(chosen), "distinct-texts"), members


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for edges (a, b): alternating large-star and small-star joins; root is the smallest node.

    Raises if the rounds don't suffice (they grow with the logarithm of the longest path). A node of any degree is joined in parts (:func:`lookup`).
    What a round makes is written as tables and read again, each once: a checkpoint keeps the size estimates and constraints of the plan that it
    cuts, and these multiply over the joins of the rounds until planning stalls.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "pairs")
    signature = lambda p: tuple(p.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = signature(pairs)

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        if 2 * state[0] <= BROADCAST_ROWS:
            return rows.join(F.broadcast(least.drop("n")), "a")  # two nodes an edge at most
        return lookup(rows, least, "a", "n", ["b"], whole=True)

    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = stored(with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = with_least(large, low).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "pairs")
        before, state = state, signature(pairs)
        if state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"connected components did not settle in {most_rounds} rounds")
