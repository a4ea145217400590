"""Tables by file name, and results that appear whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.contracts import DataValidationError, require_columns


def read_table(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A Parquet, CSV, JSON or JSON lines table, told by its extension; the columns and the filter reach the scan.

    Without a schema a CSV table's types are inferred, which reads it twice.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        d = spark.read.parquet(path)
    elif kind == "csv":
        d = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    elif kind in ("json", "jsonl"):
        d = spark.read.json(path, schema=schema, multiLine=kind == "json")
    else:
        raise DataValidationError(f"unknown kind of table: {path}")
    if columns is not None:
        require_columns(d, columns)
    d = d if where is None else d.where(where)
    return d if columns is None else d.select(*columns)


def publish(rows: DataFrame, path: str) -> None:
    """Writes a table beside its place and renames it there once it is whole; a table that is there already stays and is an error.

    The extension tells the format: zstd Parquet, CSV with a header, or JSON lines.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise DataValidationError(f"already published: {path}")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = rows.write.mode("errorifexists")
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(staging)
    elif kind == "csv":
        writer.option("header", "true").csv(staging)
    elif kind in ("json", "jsonl"):
        writer.json(staging)
    else:
        raise DataValidationError(f"unknown kind of table: {path}")
    # A rename onto a folder that has appeared since would move into it, so look again.
    if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
        raise DataValidationError(f"already published: {path}")


def significant(value: Column, digits: int = 9) -> Column:
    """A number as text with that many significant digits, shortest form: fixed from 0.0001 on while the whole part fits, else with an exponent.

    Null and NaN are null, zero keeps its sign. Halves are rounded up in the number's shortest decimal form.
    """
    v = value.cast("double")
    parts = F.split(F.format_string(f"%.{digits - 1}e", F.abs(v)), "e")
    number, e = F.replace(parts[0], F.lit("."), F.lit("")), parts[1].cast("int")
    cut = lambda s: F.regexp_replace(s, "0+$", "")
    after = lambda whole, rest: F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))
    large = after(number.substr(F.lit(1), e + 1), cut(number.substr(e + 2, F.lit(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), cut(number))
    power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    scientific = F.concat(after(number.substr(F.lit(1), F.lit(1)), cut(number.substr(F.lit(2), F.lit(digits)))), power)
    size = F.when(v == 0, "0").when(F.abs(v) == float("inf"), "inf").when((e >= 0) & (e < digits), large).when((e < 0) & (e >= -4), small).otherwise(scientific)
    sign = F.when((v < 0) | F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(v.isNotNull() & ~F.isnan(v), F.concat(sign, size))


def significant_columns(rows: DataFrame, digits: int = 9) -> DataFrame:
    """``rows`` for a CSV sink: floating-point columns as text of :func:`significant`."""
    return rows.select(*(significant(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in rows.schema))


def natural_key(name: Column) -> Column:
    """Sorts ``car_9`` before ``car_10``: the text before the last number, the number, then the name."""
    number = F.regexp_extract(name, r"_(\d+)$", 1)
    prefix = F.when(number != "", F.regexp_replace(name, r"_\d+$", "")).otherwise(name)
    return F.struct(prefix.alias("prefix"), F.when(number != "", number.cast("decimal(38,0)")).alias("number"), name.alias("name"))
