"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app_name: str = "trendloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and ANSI errors on.

    Partition counts are left to the cluster's own settings: adaptive execution
    merges small shuffle partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, visible to every executor.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="trendloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_RUN: ContextVar[str] = ContextVar("run", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table inside the shared folder."""
    return f"{shared_folder(spark)}/trendloom/{_RUN.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_of_run(spark: SparkSession):
    """Intermediate tables made inside go to a folder of their own, which goes at the end.

    Results must be written elsewhere before that.
    """
    run = f"run-{uuid.uuid4().hex}/"
    before = _RUN.set(run)
    try:
        yield
    finally:
        _RUN.reset(before)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/trendloom/{run}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet and continue from the written table.

    Used where several jobs read the same result.  The table outlives lost
    executors, and each reader prunes the columns it needs.  ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with short_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_shuffles(spark: SparkSession):
    """Shuffle files of what is written inside go as soon as it is written.

    Otherwise they stay until the driver happens to collect its garbage, and those of
    many steps lie on the disk at once.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Arrow batches of at most that size for what runs inside.

    Each task keeps about four times a batch outside the heap, and as much in Python,
    which for rows of megabytes is more than what the task works on.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if "/trendloom/" in folder:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
