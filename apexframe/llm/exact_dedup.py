"""Exact duplicate removal over a log-structured merge index of text digests.

The rows are dealt to memtables by a hash. Each memtable is flushed as a run of level 0: one row for each
digest (identifier and count), sorted by digest, with a bitmap filter of its digests. Whenever a level has two runs they
are merged into one of the next level: a digest that the other run's filter rules out is carried over as it is; only digests
that may be in both are probed, by grouping them, and there the smallest identifier (in the order asked for) stays. Most digests
are therefore never shuffled again. At the end all runs are merged into one.

Digests that more than one row has are hits;
every hit is verified on bytes, by grouping the hits' rows on (digest, text), which
is combined before the shuffle, so that a huge group of copies never meets in one task. Hits' texts are found again by a cheap
hash, so a text is digested once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.llm.common import flagged, key_filter, lookup, lower_az, passing, scratch_path, stored

#: Memtables that the rows are dealt to; each becomes a run.
MEMTABLES = 4


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


@dataclass
class Run:
    """A sorted run in the folder and the filter of its digests."""

    level: int
    path: str
    filter_path: str


class MergeIndex:
    """Digest index in a folder: ``flush`` adds a run and merges levels, ``compact`` leaves one run, ``current`` reads it.

    Rows are (digest, keep_id, n). ``keep`` says which identifier a merge keeps: "smallest" or "largest".
    """

    SCHEMA = "digest string, keep_id bigint, n bigint"
    FILTER = "__row bigint, __bits binary"

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest"):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
        self.spark, self.path, self.keep = spark, path, keep
        self.runs: list[Run] = []
        self.written = 0

    def _best(self, column: str) -> Column:
        return (F.min if self.keep == "smallest" else F.max)(column)

    def _write(self, rows: DataFrame, level: int, filters: DataFrame | None = None) -> Run:
        """Store rows of distinct digests as one run; its filter is built from it, or given."""
        path = f"{self.path}/level{level}/run-{self.written}"
        run = Run(level, path, f"{path}-filter")
        self.written += 1
        rows.select("digest", "keep_id", "n").sortWithinPartitions("digest").write.option("compression", "zstd").parquet(path)
        (key_filter(self._rows(run), "digest") if filters is None else filters).coalesce(1).write.parquet(run.filter_path)
        return run

    def _rows(self, run: Run) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(run.path)

    def _filter(self, run: Run) -> DataFrame:
        return self.spark.read.schema(self.FILTER).parquet(run.filter_path)

    def flush(self, rows: DataFrame) -> None:
        """Add one memtable of (digest, id) rows, then merge while a level has two runs."""
        grouped = rows.groupBy("digest").agg(self._best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        self.runs.append(self._write(grouped, 0))
        while len(self.runs) > 1 and self.runs[-1].level == self.runs[-2].level:
            self._merge_last()

    def _merge_last(self) -> None:
        new, old = self.runs.pop(), self.runs.pop()
        asked = [flagged(self._rows(run), "digest", self._filter(other), "maybe") for run, other in ((old, new), (new, old))]
        both = asked[0].unionByName(asked[1])
        alone = both.where(~F.col("maybe")).select("digest", "keep_id", "n")
        met = both.where("maybe").groupBy("digest").agg(self._best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        bits = self._filter(old).unionByName(self._filter(new)).groupBy("__row").agg(F.bitmap_or_agg("__bits").alias("__bits"))
        self.runs.append(self._write(alone.unionByName(met), max(old.level, new.level) + 1, bits))

    def compact(self) -> None:
        """Merge all runs into one, the newest first."""
        while len(self.runs) > 1:
            self._merge_last()

    def current(self) -> DataFrame:
        """(digest, keep_id, n) of everything flushed; call ``compact`` first."""
        return self._rows(self.runs[0])

    def find(self, digests: DataFrame) -> DataFrame:
        """Rows of the index for a table of digests: what a run's filter rules out is never looked for in it."""
        found = None
        for run in self.runs:
            asked = passing(digests.select("digest").distinct(), "digest", self._filter(run))
            here = self._rows(run).join(asked, "digest")
            found = here if found is None else found.unionByName(here)
        return found.groupBy("digest").agg(self._best("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = lower_az,
    digest: Callable[[Column], Column] = sha256_hex,
    memtables: int = MEMTABLES,
) -> DataFrame:
    """Classes of texts that are equal after ``normalise``.

    Returns, for each row of ``docs``: id, keep_id, group_size, kept, digest.

    Edge cases: a null text counts as the empty text; empty texts are equal to each
    other. A null id is never chosen while the class has another; a class of null ids
    has keep_id null and keeps them all. Rows that repeat both id and text can't be
    told apart: they count in group_size, and those with the kept id are all marked.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    rows = rows.select("id", "body", F.xxhash64("body").alias("probe"))
    memtable = F.pmod(F.xxhash64("id", "probe"), F.lit(memtables)).cast("int")
    path = scratch_path(spark, "merge-index")
    rows.select("id", digest(F.col("body")).alias("digest"), "probe", memtable.alias("memtable")).write.partitionBy("memtable").option("compression", "zstd").parquet(f"{path}/rows")
    dealt = spark.read.schema("id bigint, digest string, probe bigint, memtable int").parquet(f"{path}/rows")
    index = MergeIndex(spark, path, keep)
    for k in range(memtables):
        index.flush(dealt.where(F.col("memtable") == k))
    index.compact()
    hits = stored(index.current().where("n > 1").withColumn("rows", F.col("n")), "digest-hits")

    # Byte verification of the hits: copies collapse before the shuffle, and only texts with a hit's probe are digested again.
    probes = key_filter(passing(dealt, "digest", key_filter(hits, "digest")), "probe")
    best = F.min("id") if keep == "smallest" else F.max("id")
    bodies = passing(rows, "probe", probes).groupBy("body").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("n")).select(digest(F.col("body")).alias("digest"), "body", "keep_id", "n")
    bodies = bodies.join(hits.select("digest"), "digest", "left_semi")
    unequal = bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest").checkpoint()

    found = lookup(dealt.select("id", "digest"), hits, "digest", "rows", ["id"])
    if not unequal.isEmpty():
        # Equal digests of different texts: these rows are classed by their bytes instead.
        clashing = rows.select("id", "body", digest(F.col("body")).alias("digest")).join(unequal, "digest", "left_semi")
        by_bytes = clashing.groupBy("digest", "body").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("n"))
        found = found.join(unequal, "digest", "left_anti").unionByName(clashing.join(by_bytes, ["digest", "body"]).select("digest", "id", "keep_id", "n"))
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), "digest")
