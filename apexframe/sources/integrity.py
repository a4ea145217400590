"""Content identity: manifests against files, and hashes of tables that don't depend on row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a path; only digests leave the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def validate_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each manifest row with what is wrong with it: missing, duplicate, size, digest, or ok."""
    n = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("listed"))
    found = files.select("path", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    j = manifest.join(n, "path").join(found, "path", "left")
    state = F.when(F.col("listed") > 1, "duplicate").when(F.col("found_bytes").isNull(), "missing").when(F.col("found_bytes") != F.col("bytes"), "size").when(F.col("found_sha256") != F.col("sha256"), "digest").otherwise("ok")
    return j.select("path", state.alias("state"))


def _json_text(text: Column) -> Column:
    """A JSON string in printable ASCII: other characters as \\uXXXX, those beyond the basic plane as two."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def of(c: Column) -> Column:
        n = F.ascii(c)
        plain = F.when((n >= 32) & (n <= 126), c).when(n < 65536, code(n))
        out = plain.otherwise(F.concat(code(F.floor((n - 65536) / 1024) + 55296), code((n - 65536) % 1024 + 56320)))
        for k, v in short.items():
            out = F.when(c == k, F.lit(v)).otherwise(out)
        return out

    return F.concat(F.lit('"'), F.array_join(F.transform(F.split(text, ""), of), ""), F.lit('"'))


def source_provenance(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_session_id, revision, source_unit_sha256) of each unit's manifest rows.

    The session is ``dataset@revision:circuit_directory``; a unit whose rows differ in one of these is an error. The digest is that of the
    sorted JSON list of [upstream_path, filename, bytes, sha256], in ASCII and without spaces. A unit has a few files.
    """
    same = ["dataset", "revision", "circuit_directory"]
    record = F.struct("upstream_path", "filename", F.col("bytes").cast("long").alias("bytes"), "sha256")
    d = manifest.groupBy(*keys).agg(*(F.min(c).alias(c) for c in same), *(F.max(c).alias(f"_{c}") for c in same), F.count_if(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in same))).alias("nulls"), F.array_sort(F.collect_list(record)).alias("records"))
    whole = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in same)) & (F.col("nulls") == 0)
    line = lambda r: F.concat(F.lit("["), _json_text(r["upstream_path"]), F.lit(","), _json_text(r["filename"]), F.lit(","), r["bytes"].cast("string"), F.lit(","), _json_text(r["sha256"]), F.lit("]"))
    text = F.concat(F.lit("["), F.array_join(F.transform("records", line), ","), F.lit("]"))
    session = F.when(whole, F.concat("dataset", F.lit("@"), "revision", F.lit(":"), "circuit_directory")).otherwise(F.raise_error(F.lit("a unit's provenance is inconsistent")).cast("string"))
    return d.select(*keys, session.alias("source_session_id"), "revision", F.sha2(text.cast("binary"), 256).alias("source_unit_sha256"))


def unit_digests(rows: DataFrame, keys: list[str], record: list[str]) -> DataFrame:
    """An identity of each unit's rows that doesn't depend on their order: how many, and the 256-bit digests summed in four lanes of 64 bits.

    Each field stands with its length before it, and a null is "-", so no two records read alike. Sums are
    exact (decimal), combined before the shuffle; the unit's digest is the SHA-256 of its count and lanes.
    """
    text = lambda c: F.col(c).cast("string")
    field = lambda c: F.when(text(c).isNull(), "-").otherwise(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)))
    digest = F.sha2(F.concat(*map(field, record)), 256)
    lane = lambda i: F.conv(F.substring("digest", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(lane(i)).alias(f"lane_{i}") for i in range(4)]
    d = rows.select(*keys, digest.alias("digest")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    return d.select(*keys, "n_rows", F.sha2(F.concat_ws("|", "n_rows", *(F.col(f"lane_{i}").cast("string") for i in range(4))), 256).alias("digest"))
