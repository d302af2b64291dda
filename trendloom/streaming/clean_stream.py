"""The cleaner on a stream of JSON-line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trendloom.functions.cleaning import clean_documents
from trendloom.schemas import CLEAN, RAW


def read_raw_stream(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None
) -> DataFrame:
    """New files of a folder, one JSON object per line; a malformed line ends the stream."""
    reader = spark.readStream.schema(RAW).option("mode", "FAILFAST")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def clean_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    on_error: str = "raise",
    files_per_trigger: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Clean what arrives in ``source`` and append it to ``target`` as JSON lines.

    The same column expressions as the batch cleaner; no state is kept, and the
    checkpoint makes every input file count exactly once.  Without ``interval``
    the query processes what is there and stops.
    """
    cleaned = clean_documents(read_raw_stream(spark, source, files_per_trigger), on_error)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        cleaned.select(*CLEAN.names)
        .writeStream.format("json")
        .option("ignoreNullFields", "false")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )
