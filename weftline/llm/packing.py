"""Filling containers of fixed capacity with items, no item split unless it exceeds the capacity.

Method: bound-certified repacking.  Items are spread by hash over partitions of bounded size and
packed there by best-fit decreasing.  Dual feasible functions give a lower bound of the
containers each partition needs; where it equals the number used, the packing is certified
optimal.  Partitions with a gap give up their containers that have room, certified ones only
their emptiest (the bound is rounded up, which can leave one container's room); these are
mixed with those of other partitions by hash, and repacked by best-fit decreasing; a pool
keeps what it had unless it gains.  This repeats until nothing is given up, or no
exchange saves a container.

An item over the capacity fills containers of its own with full pieces; the rest is an item.

Defined cases: an item of size zero goes where the first container has room; a null size counts
as zero; repeated items are items each; an empty input gives an empty result;
no container is ever over its capacity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.session import Store

#: Items that one task packs at a time.
PART_ITEMS = 20_000
#: A container with at most this share of room left is not given up; 0: only full ones are not.
NEARLY_FULL = 0.0
#: Tasks of a packing stage; parts beyond share tasks, one after the other.
MOST_TASKS = 20_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """(container of each item, containers)."""
    where = [0] * len(sizes)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a container has room r
    used = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fit = some >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                some ^= 1 << r
        else:
            r, b, used = capacity, used, used + 1
        r -= s
        rooms[r].append(b)
        some |= 1 << r
        where[i] = b
    return where, used


def lower_bound(sizes, capacity: int, counts=None) -> int:
    """The best of the bounds by dual feasible functions: identity, thresholds, and rounding to k parts."""
    s = np.asarray(sizes, np.int64)
    n = np.ones(len(s), np.int64) if counts is None else np.asarray(counts, np.int64)
    keep = s > 0
    s, n = s[keep], n[keep]
    if not len(s):
        return 0
    best = -(-int((s * n).sum()) // capacity)
    hist = np.bincount(s, weights=n, minlength=capacity + 1).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(hist)])  # items smaller than x
    mass = np.concatenate([[0], np.cumsum(hist * np.arange(capacity + 1))])
    # items over C - a count as whole containers, those under a as nothing
    a = np.unique(s[2 * s <= capacity])
    a = np.concatenate([[0], a])
    half = capacity // 2
    whole = upto[capacity + 1] - upto[capacity - a + 1]
    middle = upto[capacity - a + 1] - upto[half + 1]
    middle_mass = mass[capacity - a + 1] - mass[half + 1]
    small_mass = mass[half + 1] - mass[a]
    spare = middle * capacity - middle_mass
    best = max(best, int((whole + middle + np.maximum(0, -(-(small_mass - spare) // capacity))).max()))
    for k in range(1, 21):
        x = (k + 1) * s
        # u(x) = x where (k+1)x/C is whole, else floor((k+1)x/C)/k, all over k*C
        u = np.where(x % capacity == 0, s * k, (x // capacity) * capacity)
        best = max(best, -(-int((u * n).sum()) // (k * capacity)))
    return best


_OUT = "pack_name string, capacity int, doc_id long, piece int, tokens int, pack_id string, gap int, open boolean"


def _pack(pdf: pd.DataFrame, label: str, nearly_full: float) -> pd.DataFrame:
    """Packs one partition; says which containers may be given up."""
    capacity, part = int(pdf["capacity"].iloc[0]), int(pdf["part"].iloc[0])
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
    sizes = pdf["tokens"].tolist()
    where, used = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if "pack_id" in pdf and pdf["pack_id"].nunique() <= used:
        ids, used = pdf["pack_id"].tolist(), pdf["pack_id"].nunique()
    else:
        ids = [f"{capacity}-{label}-{part}-{b}" for b in where]
    fill = pd.Series(sizes).groupby(pd.Series(ids)).transform("sum").to_numpy()
    gap = used - max(bound, 1)
    out = pdf[["pack_name", "capacity", "doc_id", "piece", "tokens"]].reset_index(drop=True)
    # rounding up leaves even a certified part room in one container: it gives up the emptiest
    return out.assign(pack_id=ids, gap=gap, open=(fill < capacity * (1 - nearly_full)) & ((gap > 0) | (np.array(ids) == ids[int(fill.argmin())])))


def _packed(items: DataFrame, parts: int, packs: int, label: str, nearly_full: float) -> DataFrame:
    """Each part packed.  The number of tasks is given, since packing is slow for the bytes it reads."""
    keys = ["pack_name", "capacity", "part"]
    spread = items.repartition(max(1, min(parts * packs, MOST_TASKS)), *keys)
    return spread.groupBy(*keys).applyInPandas(lambda pdf: _pack(pdf, label, nearly_full), _OUT)


def pack(items: DataFrame, packs: list[tuple[str, int]], store: Store, part_items: int = PART_ITEMS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """(pack_name, capacity, doc_id, piece, tokens, pack_id) from (doc_id, tokens), for each (name, capacity)."""
    if not packs:
        return items.sparkSession.createDataFrame([], "pack_name string, capacity int, doc_id long, piece int, tokens int, pack_id string")
    sizes = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity")) for n, c in packs])
    base = items.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("size"), F.explode(sizes).alias("p")).select("doc_id", "size", "p.*")
    whole = (F.col("size") / F.col("capacity")).cast("int")
    cut = base.filter(F.col("size") > F.col("capacity")).withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1)))
    full = cut.select("pack_name", "capacity", "doc_id", "piece", F.col("capacity").alias("tokens"), F.concat_ws("-", "capacity", F.lit("full"), "doc_id", "piece").alias("pack_id"))
    over = F.col("size") > F.col("capacity")
    rest = base.select("pack_name", "capacity", "doc_id", F.when(over, whole).otherwise(0).alias("piece"), F.when(over, F.col("size") % F.col("capacity")).otherwise(F.col("size")).alias("tokens"))
    rest = store.keep(rest.filter("piece = 0 or tokens > 0"))
    # every capacity has about as many items
    parts = max(1, -(-rest.count() // (part_items * len(packs))))
    spread = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    now = store.keep(_packed(spread, parts, len(packs), "0", nearly_full))
    store.drop(rest)
    settled, k = None, 0
    while True:
        done = now.filter("not open").drop("gap", "open")
        settled = done if settled is None else settled.unionByName(done)
        open_ = now.filter("open").drop("gap", "open")
        left, before = open_.agg(F.count("*"), F.count_distinct("pack_id")).first()
        if not left:
            return settled.unionByName(full)
        k += 1
        pools = max(1, -(-left // (part_items * len(packs))))
        mixed = open_.withColumn("part", F.pmod(F.xxhash64(F.lit(k), "pack_id"), F.lit(pools)).cast("int"))
        new = store.keep(_packed(mixed, pools, len(packs), str(k), nearly_full))
        if new.agg(F.count_distinct("pack_id")).first()[0] >= before:
            return settled.unionByName(open_).unionByName(full)
        now = new


def capacities(packs: DataFrame) -> list[tuple[str, int]]:
    """The capacities; a list of a few rows, and checked to be one."""
    rows = packs.select("pack_name", "capacity_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("too many capacities")
    return sorted((r.pack_name, r.capacity_tokens) for r in rows if r.pack_name is not None and r.capacity_tokens and r.capacity_tokens > 0)


def packed_documents(docs: DataFrame, packs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    store = Store(docs.sparkSession)
    sized = store.keep(tokens.token_counts(docs, ["doc_id"], vocabulary=vocabulary))
    return pack(sized, capacities(packs), store)


def packing_report(docs: DataFrame, packs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(pack_name, packs, tokens, fill, lower_bound): the bound is of all items together, from the histogram of sizes."""
    names = capacities(packs)
    placed = packed_documents(docs, packs, vocabulary)
    store = Store(docs.sparkSession)
    placed = store.keep(placed)
    used = placed.groupBy("pack_name", "capacity").agg(F.count_distinct("pack_id").alias("packs"), F.sum("tokens").cast("long").alias("tokens"))
    hist = placed.groupBy("pack_name", "capacity", "tokens").agg(F.count("*").alias("n"))

    def bound(pdf):
        c = int(pdf["capacity"].iloc[0])
        return pd.DataFrame([(pdf["pack_name"].iloc[0], lower_bound(pdf["tokens"], c, pdf["n"]))], columns=["pack_name", "lower_bound"])

    # at most one row for each possible size
    low = hist.groupBy("pack_name").applyInPandas(bound, "pack_name string, lower_bound long")
    out = used.join(low, "pack_name").withColumn("fill", F.round(F.col("tokens") / (F.col("packs") * F.col("capacity")), 6))
    return out.select("pack_name", "capacity", "packs", "tokens", "fill", "lower_bound") if names else out.limit(0).select("pack_name", "capacity", "packs", "tokens", "fill", "lower_bound")
