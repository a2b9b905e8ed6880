"""Reading organisations' catalogue extracts: one CSV file each, columns by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("cpse", "material_code", "description", "uom", "category_hint", "hsn_code", "last_rate_inr")
SUFFIX = "_materials.csv"


def files(spark: SparkSession, folder: str) -> list[str]:
    """The extracts of a folder, in the order of their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*{SUFFIX}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def read_extracts(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id, file_id, file_name and the catalogue's text columns of all extracts; columns that a file lacks are null.

    Headers are met in any order and case.  The organisation is the column's, else the first part of the file's name.
    Every cell is text, quotes inside quotes are doubled, a record may hold line breaks.  An empty folder gives no rows.
    """
    parts = []
    for k, name in enumerate(files(spark, folder)):
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(name)
        raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
        own = F.upper(F.split_part(F.lit(name.rsplit("/", 1)[-1]), F.lit("_"), F.lit(1)))
        text = [F.col(c).cast("string").alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]
        row = raw.select(F.lit(k).cast("long").alias("file_id"), F.lit(name.rsplit("/", 1)[-1]).alias("file_name"), *text, F.monotonically_increasing_id().alias("line"))
        parts.append(row.withColumn("cpse", F.coalesce(F.nullif(F.trim("cpse"), F.lit("")), own)))
    if not parts:
        return spark.createDataFrame([], "rec_id long, file_id long, file_name string, " + ", ".join(f"{c} string" for c in COLUMNS))
    # a file's lines number up to 2**33 in each of its splits
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select((F.col("file_id") * F.lit(1 << 43) + F.col("line")).alias("rec_id"), "file_id", "file_name", *COLUMNS)
