"""Declared schemas of the tables that travel between the steps."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# One JSON object per line.  Ids look numeric but are text; keys that a line
# lacks come out null.
RAW = StructType(
    [
        StructField(name, StringType(), True)
        for name in ("id", "title", "abstract", "categories", "update_date")
    ]
)

CLEAN = StructType(
    [
        StructField("id", StringType(), True),
        StructField("categories", StringType(), True),
        StructField("text", StringType(), True),
        StructField("update_year", IntegerType(), True),
    ]
)

EMBEDDING = StructType(
    [
        StructField("id", StringType(), True),
        StructField("embedding", ArrayType(FloatType()), True),
    ]
)

CATEGORY_COUNTS = StructType(
    [
        StructField("cluster", IntegerType(), True),
        StructField("codes", StringType(), True),
        StructField("n", LongType(), True),
        StructField("cluster_total", LongType(), True),
        StructField("share", DoubleType(), True),
    ]
)
