"""Merging the members of an item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, value, n): the most frequent value; of equally frequent ones the first met in `order`."""
    k = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = k.groupBy(*by).agg(F.max_by(F.struct(F.col(value).alias("value"), "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select(*by, "b.value", "b.n")


def merged_values(df: DataFrame, by: str, keys: list[str], order: str, union: tuple[str, ...] = ()) -> DataFrame:
    """(by, k, value): per attribute the majority of its values, of those in `union` all of them, sorted."""
    one = [df.select(by, F.lit(k).alias("k"), F.col(f"a_{k}").alias("v"), order) for k in keys]
    long = reduce(DataFrame.unionByName, one) if len(one) == 1 else df.select(by, order, F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a_{k}").alias("v")) for k in keys])))
    long = long.filter("v is not null")
    best = majority(long.filter(~F.col("k").isin(*union)) if union else long, [by, "k"], "v", order).select(by, "k", "value")
    if union:
        each = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("v", ",")))))
        best = best.unionByName(long.filter(F.col("k").isin(*union)).groupBy(by, "k").agg(F.array_join(each, ",").alias("value")))
    return best


def merge_attributes(df: DataFrame, by: str, keys: list[str], order: str, union: tuple[str, ...] = ()) -> DataFrame:
    """(by, attrs): the merged values as `key=value` sorted by key."""
    best = merged_values(df, by, keys, order, union)
    kv = F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: F.concat(x["k"], F.lit("="), x["value"]))
    return best.groupBy(by).agg(F.array_join(kv, ";").alias("attrs"))
