"""Percentiles of very large numeric columns, exact or with a stated bound, and combinable.

Method: radix selection.  A double becomes a 64-bit integer of the same order: its bits,
with all but the sign flipped for negative numbers.  A histogram of the highest 16 bits per
group, counted on the map side, tells which digit holds each target rank; only the values with
that digit go on to the next 16 bits, and so on.  A digit that holds a single value
gives it at once; four passes give every value exactly.

A state is the histogram of the leading 24 bits per group (sign, exponent, 12 bits of the
fraction).  States of files or days combine by adding counts.  A percentile is read from a
state by the same selection over its bins; it is the lower edge of its bin and errs
by at most 2**-12 (0.0245 %) of the value, towards zero.

Percentiles are nearest-rank: the ceil(q * n)-th smallest value (at least the first).
Defined cases: values that are null, NaN or not plain numbers do not count; a group without
a number has no row; null is a group of its own; -0.0 counts as 0.0; an empty input gives
an empty result; other columns are ignored.

A group with a third of all rows is no trouble: its rows become at most 2**16 bins on the
map side, no row holds more than the bins of one digit, and values travel only where a pass follows them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import Store

QUANTILES = (0.5, 0.9, 0.95, 0.99)
STATE_BITS = 24
RELATIVE_ERROR = 2.0**-12
DIGIT = 16


@F.pandas_udf(T.LongType())
def ordered_key(x: pd.Series) -> pd.Series:
    """The order-preserving integer of each double."""
    bits = (x.to_numpy(np.float64, na_value=np.nan) + 0.0).view(np.int64)
    out = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return pd.Series(out).where(x.notna(), None).astype("Int64")


@F.pandas_udf(T.DoubleType())
def key_value(k: pd.Series) -> pd.Series:
    """The double that an order-preserving integer stands for."""
    key = k.to_numpy(np.int64)
    return pd.Series(np.where(key < 0, key ^ np.int64(0x7FFFFFFFFFFFFFFF), key).view(np.float64))


def plain_number(c: Column) -> Column:
    """A double where the text, without outer spaces, is a plain number; else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[0-9][0-9,]*(\.[0-9]+)?$"), F.regexp_replace(t, ",", "").cast("double"))


def keys(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(g, key, n): the order-preserving integer of each value, of weight one; no shuffle."""
    v = df.select(F.struct(*group).alias("g"), F.col(value).cast("double").alias("__v")).filter("__v is not null and not isnan(__v)")
    return v.select("g", ordered_key("__v").alias("key"), F.lit(1).cast("long").alias("n"))


def _walk(rank: Column) -> Column:
    """The bin of `bins` that holds a rank, and how many stand below it."""
    start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    return F.aggregate(
        "bins",
        start,
        lambda s, b: F.when(s["d"].isNotNull(), s)
        .when(s["below"] + b["n"] >= rank, F.struct(s["below"].alias("below"), b["d"].alias("d"), b["lo"].alias("lo"), b["hi"].alias("hi")))
        .otherwise(F.struct((s["below"] + b["n"]).alias("below"), s["d"].alias("d"), s["lo"].alias("lo"), s["hi"].alias("hi"))),
    )


def _select(leaves: DataFrame, quantiles: Sequence[float], store: Store, bits: int = 64) -> DataFrame:
    """(g, total, q, key): the key at each target rank of each group, of weighted keys (g, key, n)."""
    found: list[DataFrame] = []
    active, rest = None, leaves.withColumn("prefix", F.lit(0).cast("long"))
    for shift in range(bits - DIGIT, -DIGIT, -DIGIT):
        shift = max(shift, 0)
        digit = F.expr(f"shiftright(key, {shift})")
        bins = rest.groupBy("g", "prefix", digit.alias("d")).agg(F.sum("n").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        # at most 2**16 bins of a (group, prefix)
        edges = bins.groupBy("g", "prefix").agg(F.sort_array(F.collect_list(F.struct("d", "n", "lo", "hi"))).alias("bins"), F.sum("n").alias("total"))
        if active is None:
            goal = [F.struct(F.lit(i).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total"))).cast("long").alias("rank")) for i, q in enumerate(quantiles)]
            at = edges.withColumn("ranks", F.array(*goal))
        else:
            ranks = active.groupBy("g", "prefix", F.col("total").alias("of")).agg(F.collect_list(F.struct("q", "rank")).alias("ranks"))
            at = edges.drop("total").join(ranks, ["g", "prefix"]).withColumnRenamed("of", "total")
        hits = at.select("g", "total", F.explode(F.transform("ranks", lambda r: F.struct(r["q"].alias("q"), r["rank"].alias("rank"), _walk(r["rank"]).alias("w")))).alias("h"))
        hits = store.keep(hits.select("g", "total", "h.q", (F.col("h.rank") - F.col("h.w.below")).alias("rank"), F.col("h.w.d").alias("prefix"), F.col("h.w.lo").alias("lo"), F.col("h.w.hi").alias("hi")))
        found.append(hits.filter("lo = hi").select("g", "total", "q", F.col("lo").alias("key")))
        active = hits.filter("lo <> hi").select("g", "total", "q", "rank", "prefix")
        if not shift or active.isEmpty():
            break
        rest = leaves.withColumn("prefix", digit).join(active.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _wide(found: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(group, n, q0, q1, ...) from (g, total, q, v)."""
    cols = [F.max(F.when(F.col("q") == i, F.col("v"))).alias(f"q{i}") for i in range(len(quantiles))]
    return found.groupBy("g").agg(F.max("total").alias("n"), *cols).select("g.*", "n", *(f"q{i}" for i in range(len(quantiles))))


def radix_select(df: DataFrame, group: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(group, n, q0, q1, ...): exact percentiles of each group."""
    store = Store(df.sparkSession)
    # groups may be null: a struct keeps null a key of its own in joins
    leaves = store.keep(keys(df, list(group), value))
    found = _select(leaves, quantiles, store)
    return _wide(found.select("g", "total", "q", key_value("key").alias("v")), quantiles)


def state(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, bin, n): the combinable histogram of leading bits, counted on the map side."""
    bins = keys(df, list(group), value).groupBy("g", F.expr(f"shiftright(key, {64 - STATE_BITS})").alias("bin")).agg(F.sum("n").alias("n"))
    return bins.select("g.*", "bin", "n")


def combine(states: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds the states of files, days or partitions up to one state per group."""
    return states.groupBy(*group, "bin").agg(F.sum("n").alias("n"))


def from_state(states: DataFrame, group: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(group, n, q0, q1, ...): percentiles from a state, each at most RELATIVE_ERROR of itself too near zero."""
    store = Store(states.sparkSession)
    bins = store.keep(states.select(F.struct(*group).alias("g"), F.col("bin").alias("key"), "n"))
    found = _select(bins, quantiles, store, STATE_BITS)
    # of a negative bin the edge nearer zero is the upper one
    low = F.expr(f"shiftleft(key, {64 - STATE_BITS})")
    edge = F.when(F.col("key") < 0, low + F.lit((1 << (64 - STATE_BITS)) - 1)).otherwise(low)
    return _wide(found.select("g", "total", "q", key_value(edge).alias("v")), quantiles)


def rate_percentiles(materials: DataFrame) -> DataFrame:
    """(category_hint, n, p50, p90, p95, p99) of the plain numbers in last_rate_inr, exact."""
    df = materials.select("category_hint", plain_number(F.col("last_rate_inr")).alias("v"))
    return radix_select(df, ["category_hint"], "v").toDF("category_hint", "n", "p50", "p90", "p95", "p99")


def rate_states(materials: DataFrame) -> DataFrame:
    """(category_hint, file_id, bin, n): one combinable state per file."""
    df = materials.select("category_hint", "file_id", plain_number(F.col("last_rate_inr")).alias("v"))
    return state(df, ["category_hint", "file_id"], "v")


def combined_percentiles(states: DataFrame) -> DataFrame:
    """(category_hint, n, p50, p90, p95, p99) read from the states of all files."""
    return from_state(combine(states, ["category_hint"]), ["category_hint"]).toDF("category_hint", "n", "p50", "p90", "p95", "p99")
