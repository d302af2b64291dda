"""Readers and writers of documents: JSON lines in, JSON lines or Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trendloom.schemas import CLEAN, RAW

CORRUPT = "_corrupt_record"


def _json_options(mode: str, schema: StructType) -> tuple[dict, StructType]:
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    if mode == "PERMISSIVE":
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType(), True)])
    return {"mode": mode, "columnNameOfCorruptRecord": CORRUPT}, schema


def read_raw(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """One JSON object per line; missing keys come out null.

    A malformed line ends the read, or lands in ``_corrupt_record`` when
    ``mode`` is PERMISSIVE.  Blank lines are skipped.
    """
    options, schema = _json_options(mode, RAW)
    return spark.read.schema(schema).options(**options).json(path)


def parse_raw(lines: DataFrame, column: str, mode: str = "FAILFAST", *others: str) -> DataFrame:
    """The same for lines that are already in a string column; ``others`` are columns to keep."""
    options, schema = _json_options(mode, RAW)
    return lines.select(F.from_json(column, schema, options).alias("o"), *others).select("o.*", *others)


def write_clean(docs: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written out."""
    docs.select(*CLEAN.names).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_clean(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Documents as ``write_clean`` leaves them.

    With ``partitions`` they are dealt out to so many tasks: for a few files that cannot
    be split, or that hold very unequal amounts of text.
    """
    docs = spark.read.schema(CLEAN).option("mode", "FAILFAST").json(path)
    return docs if partitions is None else docs.repartition(partitions)
