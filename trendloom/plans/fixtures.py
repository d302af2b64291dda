"""Derived views over the given tables that stand in for the pipeline's own tables.

Plain SQL understood by Spark and DuckDB alike; ``~`` stands for a backslash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators.clustering import centroids

CORPUS = """
SELECT concat('d', lpad(cast(doc_id AS varchar(20)), 8, '0')) AS id, doc_id, text, lang,
  CASE WHEN doc_id % 97 = 0 THEN NULL ELSE cast(2015 + doc_id % 8 AS int) END AS update_year,
  cast((CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END) * 3
    + doc_id % 3 AS int) AS cluster,
  CASE WHEN doc_id % 50 = 0 THEN NULL ELSE concat(
    CASE cast(substr(source, 4) AS int) % 6 WHEN 0 THEN 'cs.LG' WHEN 1 THEN 'cs.CL'
      WHEN 2 THEN 'math.CO' WHEN 3 THEN 'quant-ph' WHEN 4 THEN 'cond-mat.mes-hall'
      ELSE 'cs.CE' END,
    CASE WHEN doc_id % 2 = 0 THEN concat(' ', CASE lang WHEN 'en' THEN 'stat.ML'
      WHEN 'fr' THEN 'hep-th' ELSE 'q-bio.BM' END) ELSE '' END,
    CASE WHEN doc_id % 11 = 0 THEN ', zz.QQ' ELSE '' END) END AS categories
FROM {documents}
"""

LATEX = """
SELECT cast(p_partkey AS varchar(20)) AS id,
  replace(concat('  On ~alpha_{', cast(p_size AS varchar(20)), '} of ', p_name, ' '),
    '~', chr(92)) AS title,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE replace(concat(p_name, CASE p_partkey % 8
    WHEN 0 THEN ' with $x ~geq 1$ and ~mathbb{R}^n' WHEN 1 THEN ' ~left( x ~right) ~cdots'
    WHEN 2 THEN ' 3 ~times 10^{(-22)} g' WHEN 3 THEN ' ~[ x + y ~] end'
    WHEN 4 THEN ' ~(a+b~) and ~(f(x)~)' WHEN 5 THEN ' $~mathrm_x$ vs ~mathrm_x'
    WHEN 6 THEN ' cost $5 and $6 now' ELSE ' A ~simeq B ~mapsto C' END), '~', chr(92))
    END AS abstract,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat(cast(2010 + p_partkey % 12 AS varchar(20)),
    '-', cast(1 + p_partkey % 12 AS varchar(20)), '-05') END AS update_date
FROM {part}
"""

# Of the rows above, some without any.
CATEGORIES = """CASE WHEN cast(id AS int) % 7 = 0 THEN NULL ELSE concat('cs.LG math.', id) END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def dealt_out(df: DataFrame) -> DataFrame:
    """The same rows; those of fewer files than there are cores are dealt out to all cores.

    A file with one row group is read by one task, however large it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    view = f"trendloom_{name}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return spark.sql(sql.replace("{" + name + "}", view))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with years, clusters and category codes derived from their columns."""
    return _view(spark, sf_dir, CORPUS, "documents")


def latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw metadata with eight shapes of LaTeX in it."""
    return _view(spark, sf_dir, LATEX, "part")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a given cluster each."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("cluster"), F.col("embedding").cast("array<double>")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """41 topic vectors: the means of all vectors, dealt out by id."""
    dealt = embeddings(spark, sf_dir).withColumn("cand", (F.col("vec_id") % 41).cast("int"))
    return centroids(dealt, "embedding", "cand").select(
        F.col("cluster").alias("cand_id"),
        F.concat(F.lit("topic "), F.col("cluster").cast("string")).alias("name"),
        F.col("center").alias("embedding"),
    )


def oracle_view(sql: str) -> str:
    for name in ("documents", "part"):
        sql = sql.replace("{" + name + "}", name)
    return sql.strip()
