"""Mixing sources to target weights, with capped repeats.

Method: Poisson replication.  The wanted total, unless one is asked for, is all there is of the
sources with a target.  A source's target repetition rate is its share of the total over what it has.
A hash of seed and id gives each record a uniform number; the inverse of a Poisson distribution at that
number, cut at the source's cap, is how often it is taken.  The mean of the distribution is the one
whose cut draws have the rate as their expectation, found from the distribution alone, so
the records are read once.  Copies are then shuffled globally by another hash.

A source that cannot give its share within its cap gives every record as often as the cap allows, the
others what they were to give; the shortfall is reported.  What is given differs from what is
expected by chance only, by about the root of the sum of the squared sizes.

Defined cases: sources without records, and those without target, share or repeats, give nothing,
and the other shares are scaled to sum to one; null sources have no target; records of
size zero or null are left out; ties and repeated rows draw by their ids; an empty input gives an
empty result; the reached shares are reported for every target and every source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.session import Store

SEED = 17


def draws(u: np.ndarray, mean: float, cap: int) -> np.ndarray:
    """min(inverse Poisson(mean) at u, cap); an infinite mean gives the cap."""
    if math.isinf(mean):
        return np.full(len(u), cap, np.int64)
    n = np.zeros(len(u), np.int64)
    p = total = math.exp(-mean)
    for k in range(1, cap + 1):
        n += u >= total
        p *= mean / k
        total += p
    return n


def expected(mean: float, cap: int) -> float:
    """The expectation of min(Poisson(mean), cap)."""
    p = below = math.exp(-mean)
    out = 1 - below
    for k in range(1, cap):
        p *= mean / k
        below += p
        out += 1 - below
    return out


def mean_for(rate: float, cap: int) -> float:
    """The mean whose draws, cut at the cap, have the rate as their expectation; infinite from the cap on."""
    if rate >= cap:
        return math.inf
    low, high = 0.0, 1.0
    while expected(high, cap) < rate:
        if high > 700:  # beyond, exp(-mean) is no normal number; the draws are the cap but for parts in a million
            return math.inf
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid, cap) < rate else (low, mid)
    return (low + high) / 2


def _uniform(ids: str = "doc_id"):
    """53 bits of a hash as a number in [0, 1)."""
    return F.expr(f"shiftrightunsigned(xxhash64({SEED}, {ids}), 11)").cast("double") / float(1 << 53)


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> dict[str, tuple[float, int, float]]:
    """source -> (Poisson mean, cap, wanted tokens).  Only per-source sums reach the driver; the target list is bounded."""
    want = {r.source: (r.target_share, r.max_repeats) for r in targets.limit(10_001).collect() if r.source is not None and r.target_share and r.target_share > 0 and r.max_repeats and r.max_repeats > 0}
    if len(want) > 10_000:
        raise ValueError("too many sources")
    have = {r.source: r.size for r in sized.filter(F.col("source").isin(*want)).groupBy("source").agg(F.sum("tokens").alias("size")).collect()} if want else {}
    want = {s: w for s, w in want.items() if have.get(s)}
    if not want:
        return {}
    share = sum(w[0] for w in want.values())
    total = sum(have[s] for s in want) if total is None else total
    goal = {s: total * w / share for s, (w, _) in want.items()}
    return {s: (mean_for(goal[s] / have[s], cap), cap, goal[s]) for s, (_, cap) in want.items()}


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, copy, order_key) of every copy taken, in shuffled order."""
    sized = sized.filter("tokens > 0")
    return _taken(sized, plan(sized, targets, total))


def _taken(sized: DataFrame, means: dict[str, tuple[float, int, float]]) -> DataFrame:
    schema = "doc_id long, source string, tokens int, copy int"

    def take(batches):
        for b in batches:
            parts = []
            for source, g in b.groupby("source"):
                if source in means:
                    mean, cap, _ = means[source]
                    n = draws(g["u"].to_numpy(), mean, cap)
                    r = g.loc[g.index.repeat(n), ["doc_id", "source", "tokens"]]
                    parts.append(r.assign(copy=r.groupby(level=0).cumcount() + 1))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["doc_id", "source", "tokens", "copy"])

    taken = sized.select("doc_id", "source", "tokens", _uniform().alias("u")).mapInPandas(take, schema)
    keyed = taken.withColumn("order_key", F.xxhash64(F.lit(SEED + 1), "doc_id", "copy"))
    return keyed.repartitionByRange("order_key").sortWithinPartitions("order_key")


def sized_documents(docs: DataFrame, store: Store, vocabulary: str) -> DataFrame:
    return store.keep(tokens.token_counts(docs, ["doc_id", "source"], vocabulary=vocabulary))


def mixed_documents(docs: DataFrame, targets: DataFrame, vocabulary: str = tokens.VOCABULARY, total: int | None = None) -> DataFrame:
    return mix(sized_documents(docs, Store(docs.sparkSession), vocabulary), targets, total)


def reached_shares(docs: DataFrame, targets: DataFrame, vocabulary: str = tokens.VOCABULARY, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, wanted, taken_records, taken, shortfall, reached_share, most_repeats).

    wanted: tokens its share of the total comes to; shortfall: what its cap keeps it from giving.
    """
    store = Store(docs.sparkSession)
    sized = sized_documents(docs, store, vocabulary).filter("tokens > 0")
    means = plan(sized, targets, total)
    got = _taken(sized, means).groupBy("source").agg(F.count("*").alias("taken_records"), F.sum("tokens").alias("taken"), F.max("copy").alias("most_repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    asked = docs.sparkSession.createDataFrame([(s, round(goal)) for s, (_, _, goal) in means.items()], "source string, wanted long")
    out = have.join(targets.select("source", "target_share", "max_repeats"), "source", "full").join(got, "source", "left").join(asked, "source", "left")
    out = out.fillna({"available": 0, "taken_records": 0, "taken": 0, "most_repeats": 0, "wanted": 0})
    whole = got.agg(F.sum("taken").alias("whole"))
    out = out.join(F.broadcast(whole), how="inner")  # one row
    short = F.greatest(F.lit(0).cast("long"), F.col("wanted") - F.coalesce(F.col("max_repeats") * F.col("available"), F.lit(0)))
    return out.select("source", "target_share", "max_repeats", "available", "wanted", "taken_records", "taken", short.alias("shortfall"), F.round(F.coalesce(F.col("taken") / F.col("whole"), F.lit(0.0)), 6).alias("reached_share"), "most_repeats")
