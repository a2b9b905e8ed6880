"""Profiles of extracts before they are taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.rules import UPLOAD_ROWS

_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _text(c: str):
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def validate(df: DataFrame, by: str) -> DataFrame:
    """Rows, blank and repeated codes of each extract, and whether it is accepted."""
    k = df.groupBy(by, F.upper(_text("material_code")).alias("c")).agg(F.count("*").alias("n"))
    blank = F.coalesce(F.sum(F.when(F.col("c") == "", F.col("n"))), F.lit(0)).alias("blank_codes")
    repeated = F.coalesce(F.sum(F.when(F.col("c") != "", F.col("n") - 1)), F.lit(0)).alias("repeated_codes")
    s = k.groupBy(by).agg(F.sum("n").alias("n_rows"), blank, repeated)
    return s.withColumn("accepted", (F.col("n_rows") <= UPLOAD_ROWS) & (F.col("blank_codes") == 0) & (F.col("repeated_codes") == 0))


def profile(df: DataFrame, by: str) -> DataFrame:
    x = df.select(by, _text("material_code").alias("c"), _text("description").alias("s"), _text("uom").alias("u"), _text("last_rate_inr").alias("r"))
    size = F.length("s")
    main = x.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("c") == "").alias("blank_code"), F.count_if(F.col("s") == "").alias("blank_description"), F.count_if(F.col("u") == "").alias("blank_uom"),
        F.min(size).cast("long").alias("shortest"), F.percentile(size, 0.5).alias("middle"), F.max(size).cast("long").alias("longest"), F.count_if(size < 8).alias("short"),
        F.count_if((F.col("r") != "") & ~F.regexp_replace("r", ",", "").rlike(_NUMBER)).alias("bad_rates"))
    codes = x.filter("c <> ''").groupBy(by, F.upper("c").alias("c")).agg(F.count("*").alias("n")).groupBy(by).agg(F.sum(F.col("n") - 1).alias("repeated_codes"))
    rows = x.groupBy(by, "c", "s", "u", "r").agg(F.count("*").alias("n")).groupBy(by).agg(F.sum(F.col("n") - 1).alias("repeated_rows"))
    return main.join(codes, by, "left").join(rows, by, "left").withColumn("repeated_codes", F.coalesce("repeated_codes", F.lit(0)))


def verdict(p: DataFrame, by: str) -> DataFrame:
    """blocked, warnings or ready, and the first three problems."""
    names = {"blank_code": "blank codes", "blank_description": "blank descriptions", "repeated_codes": "repeated codes", "repeated_rows": "repeated rows", "blank_uom": "blank units", "short": "short descriptions", "bad_rates": "bad rates"}
    stop = F.col("blank_code") + F.col("blank_description") + F.col("repeated_codes") > 0
    warn = F.col("blank_uom") + F.col("short") + F.col("bad_rates") + F.col("repeated_rows") > 0
    problems = F.array_compact(F.array(*[F.when(F.col(c) > 0, n) for c, n in names.items()]))
    return p.select(by, F.when(stop, "blocked").when(warn, "warnings").otherwise("ready").alias("verdict"), F.array_join(F.slice(problems, 1, 3), ", ").alias("problems"))


def top_values(df: DataFrame, by: str, column: str, k: int) -> DataFrame:
    n = df.groupBy(by, F.upper(_text(column)).alias("u")).agg(F.count("*").alias("n"))
    w = W.partitionBy(by)
    o = n.withColumn("i", F.row_number().over(w.orderBy(F.desc("n"), "u"))).withColumn("kinds", F.count("*").over(w))
    return o.filter(F.col("i") <= k).select(by, "u", "n", F.greatest(F.col("kinds") - k, F.lit(0)).alias("more"))
