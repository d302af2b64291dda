"""Malformed JSON lines set aside with the file that they came from, in the pass that reads the good ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trendloom.schemas import RAW
from trendloom.sources.documents import CORRUPT, parse_raw

KIND, GOOD, BAD = "kind", "documents", "malformed"


def _split(lines: DataFrame) -> DataFrame:
    """The documents' columns, the file, the line if it is malformed, and its kind; blank lines go."""
    kept = lines.filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = parse_raw(kept, "value", "PERMISSIVE", "file")
    bad = F.col(CORRUPT).isNotNull()
    kind = F.when(bad, BAD).otherwise(GOOD)
    return parsed.select(*RAW.names, "file", F.col(CORRUPT).alias("line"), kind.alias(KIND))


def split_raw(spark: SparkSession, path: str, target: str) -> None:
    """Write the documents and the malformed lines of ``path`` below ``target``, in one pass."""
    _split(spark.read.text(path)).write.partitionBy(KIND).mode("overwrite").parquet(target)


def split_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int | None = None
) -> StreamingQuery:
    """The same for files that arrive in ``source``; every file counts once."""
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    writer = _split(reader.text(source)).writeStream.partitionBy(KIND).format("parquet")
    return writer.option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()


def _read(spark: SparkSession, target: str, kind: str) -> DataFrame:
    schema = f"{', '.join(f'{name} string' for name in RAW.names)}, file string, line string, {KIND} string"
    return spark.read.schema(schema).parquet(target).filter(F.col(KIND) == kind)


def read_good(spark: SparkSession, target: str) -> DataFrame:
    """The documents, as ``read_raw`` gives them."""
    return _read(spark, target, GOOD).select(*RAW.names)


def read_malformed(spark: SparkSession, target: str) -> DataFrame:
    """(file, line)."""
    return _read(spark, target, BAD).select("file", "line")
