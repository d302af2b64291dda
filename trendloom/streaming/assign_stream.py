"""Stored models applied to new documents, in one go or as they arrive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trendloom.functions.vectors import normalize_rows
from trendloom.operators import block_svd, clustering, kmeans, svd, tfidf
from trendloom.schemas import CLEAN
from trendloom.sources import models


@dataclass
class Models:
    """Vocabulary, factors and centres of a run."""

    tfidf: tfidf.TfidfModel
    factors: svd.SvdModel | block_svd.BlockModel
    centers: DataFrame
    whiten: bool = True


def load_models(spark: SparkSession, out: str, whiten: bool = True) -> Models:
    """The models that a run has stored under ``out``."""
    center = kmeans.centers_frame(spark, models.load_kmeans(spark, f"{out}/kmeans"))
    return Models(models.load_tfidf(spark, f"{out}/tfidf"), models.load_svd(spark, f"{out}/svd"), center, whiten)


def assign_documents(docs: DataFrame, stored: Models, id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, cluster, distance) of documents that the models have not seen.

    The vocabulary is joined, the factors and centres go along; nothing is fitted.  A
    document without any known term is a zero vector, and nearest to the centre of the
    least length.
    """
    rows = stored.tfidf.transform(docs, id_column, text)
    if stored.whiten:
        placed = svd.whitened(rows, id_column, stored.factors)
    else:
        placed = stored.factors.project(rows, id_column)
    near = clustering.assign_nearest(normalize_rows(placed, "embedding"), "embedding", stored.centers)
    return near.select(id_column, "cluster", "distance")


def assign_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    stored: Models,
    files_per_trigger: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Assign the clean documents that arrive in ``source``, as the cleaner's stream writes them.

    A batch goes to its own folder, which is written over if the batch has to be
    repeated, so every document counts once.  Without ``interval`` the query processes
    what is there and stops.
    """
    reader = spark.readStream.schema(CLEAN).option("mode", "FAILFAST")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def write(batch: DataFrame, number: int) -> None:
        assign_documents(batch, stored).write.mode("overwrite").parquet(f"{target}/batch={number}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = reader.json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def read_assigned(spark: SparkSession, target: str) -> DataFrame:
    """(id, cluster, distance) of all batches so far."""
    return spark.read.parquet(target).drop("batch")
