"""Documents with everything that goes wrong: nulls, empty, long and repeated rows, other columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row int, size double"
LONG = "lorem ipsum dolor sit amet " * 20_000

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 10, "x", 1, 0.5),
    (2, "the  quick\tbrown fox jumps over the lazy dog near the old river bank today", "en", "b", 10, None, None, None),
    (3, None, "en", "a", None, "y", 2, 1.0),
    (4, "", None, None, 0, None, None, None),
    (5, " \n\t ", "de", "b", 4, None, 3, None),
    (6, LONG, None, None, len(LONG), "z", None, 2.0),
    (None, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", None, 1, None, None, None),
    (None, None, None, None, None, None, None, None),
    (7, "¿Qué? ½ 123 #*$%&|<>", "es", "c", 3, "x", 1, 0.0),
    (7, "¿Qué? ½ 123 #*$%&|<>", "es", "c", 3, "x", 1, 0.0),
    (7, "another text of the same id", "en", "c", 3, "x", 1, 0.0),
    (8, "x", "fr", "a", 1, None, None, None),
    (9, "a\x00b \U0001f600 é é", "fr", "a", 1, None, None, None),
]


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_text(spark, texts, **columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows.withColumns({name: F.lit(value) for name, value in columns.items()})


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
