"""Best representative of each duplicate group, field by field.

Method: skyline selection.  A record dominates another of its group if it is at least as good in
completeness (letters and digits of its description), recency and trust, and better in one.
The undominated records form the first layer, those that only it dominates the next, and
so on.  A lexicographic policy for each field picks the best record of a layer that can supply it; a
field that no record of the layer can supply is filled from the next layers.  Layers are taken off
while a field is open, or while a record below is as good as the one picked in what the
field goes by (a record dominated for want of trust may still have the same completeness, and a
file more trusted than the one picked may stand below a record without unit).

A layer is found by sort and sweep: records in falling order of completeness, a staircase of recency
and trust of those before.  Before that, records alike in everything but time and id are
reduced to the best of them by a map-side aggregate; the earlier of two such records can be no
field's best.  What is left of a group is bounded by the distinct (completeness, trust,
usable fields), however many records the group has.

Defined cases: a blank code is no listing; a null trust is the lowest, a null time the
oldest; ties go to the latest, then to the smallest id; a field nobody can supply gives 0; groups of
one record are left out; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OLDEST = -(2**62)
LEAST_TRUST = -(2**31)
#: What a record can supply, as bits.
DESC, UOM, RATE = 1, 2, 4


def skyline(rows: list[tuple[int, int, int]]) -> list[int]:
    """Positions of the rows (completeness, recency, trust) that no other dominates; equal rows do not dominate each other."""
    order = sorted(range(len(rows)), key=lambda i: rows[i], reverse=True)
    top: list[int] = []
    steps: list[tuple[int, int]] = []  # recency rising, trust falling: the staircase of the rows so far
    last = None
    for i in order:
        row = rows[i]
        if row == last:
            top.append(i)
            continue
        at, trust = row[1], row[2]
        k = bisect_left(steps, (at, trust))
        # steps from k on are as recent or more; the first of them has the greatest trust
        if k < len(steps) and steps[k][1] >= trust:
            continue
        while k and steps[k - 1][1] <= trust:
            k -= 1
            del steps[k]
        insort(steps, (at, trust))
        top.append(i)
        last = row
    return top


#: For each field its bit, the dimension it goes by, and the policy: a row (fill, at, trust, -id) as a key.
POLICY = (
    (DESC, 0, lambda r: (r[0], r[1], r[3])),
    (UOM, 2, lambda r: (r[2], r[1], r[3])),
    (RATE, 1, lambda r: (r[1], r[3])),
)


def resolve(rows: list[tuple[int, int, int, int, int]]) -> tuple[list[int], list[int], int]:
    """(id for each field or 0, layer it came from or 0, layers taken off) of rows (fill, at, trust, -id, bits)."""
    best: list[tuple | None] = [None, None, None]
    layer_of = [0, 0, 0]
    layer = 0
    while rows:
        layer += 1
        top = set(skyline([r[:3] for r in rows]))
        for f, (bit, _, key) in enumerate(POLICY):
            usable = [rows[i] for i in top if rows[i][4] & bit]
            if usable:
                pick = max(usable, key=key)
                if best[f] is None or key(pick) > key(best[f]):
                    best[f], layer_of[f] = pick, layer
        rows = [r for i, r in enumerate(rows) if i not in top]
        if not any(b is None or any(r[dim] >= b[dim] for r in rows) for b, (_, dim, _) in zip(best, POLICY)):
            break
    return [-b[3] if b else 0 for b in best], layer_of, layer


_FIELDS = ("desc", "uom", "rate")
_OUT = T.StructType([*(T.StructField(f"{f}_rec", T.LongType()) for f in _FIELDS), *(T.StructField(f"{f}_layer", T.IntegerType()) for f in _FIELDS), T.StructField("layers", T.IntegerType())])


@F.pandas_udf(_OUT)
def _resolve(fill: pd.Series, at: pd.Series, trust: pd.Series, rid: pd.Series, bits: pd.Series) -> pd.DataFrame:
    out = []
    for group in zip(fill, at, trust, rid, bits):
        ids, layer_of, layers = resolve(list(zip(*(np.asarray(c).tolist() for c in group))))
        out.append((*ids, *layer_of, layers))
    return pd.DataFrame(out, columns=_OUT.names)


def survivors(records: DataFrame, group: list[str]) -> DataFrame:
    """(group, desc_rec, uom_rec, rate_rec, desc_layer, uom_layer, rate_layer, layers).

    records: group, rec_id long, fill int (0: no description), trust int, has_uom boolean,
    has_rate boolean, at long (microseconds).
    """
    bits = F.when(F.col("fill") > 0, DESC).otherwise(0) + F.when(F.col("has_uom"), UOM).otherwise(0) + F.when(F.col("has_rate"), RATE).otherwise(0)
    r = records.select(*group, "rec_id", F.col("fill").cast("long").alias("__fill"), F.coalesce("trust", F.lit(LEAST_TRUST)).cast("long").alias("__trust"), bits.alias("__bits"), F.coalesce("at", F.lit(OLDEST)).alias("__at"))
    # the best of those alike: the latest, then the smallest id
    top = r.groupBy(*group, "__fill", "__trust", "__bits").agg(F.count("*").alias("__n"), F.max(F.struct("__at", (-F.col("rec_id")).alias("id"))).alias("__b"))
    row = F.struct("__fill", F.col("__b.__at").alias("at"), "__trust", F.col("__b.id").alias("id"), "__bits")
    g = top.groupBy(*group).agg(F.sum("__n").alias("__n"), F.collect_list(row).alias("__rows")).filter("__n > 1")
    got = _resolve("__rows.__fill", "__rows.at", "__rows.__trust", "__rows.id", "__rows.__bits")
    return g.select(*group, got.alias("__got")).select(*group, "__got.*")


def listing_records(materials: DataFrame, files: DataFrame) -> DataFrame:
    """The records of the catalogue as `survivors` takes them, by listing."""
    code = F.upper(F.trim("material_code"))
    rate = F.trim("last_rate_inr")
    plain = F.coalesce(rate.rlike(r"^[0-9][0-9,]*(\.[0-9]+)?$") & rate.rlike("[1-9]"), F.lit(False))
    m = materials.select(
        "cpse", code.alias("material_code"), "rec_id", "file_id",
        F.length(F.regexp_replace(F.coalesce("description", F.lit("")), r"[^\p{L}\p{Nd}]", "")).alias("letters"),
        (F.trim(F.coalesce("description", F.lit(""))) != "").alias("some"),
        (F.trim(F.coalesce("uom", F.lit(""))) != "").alias("has_uom"),
        plain.alias("has_rate"),
        F.unix_micros(F.col("extracted_at").cast("timestamp")).alias("at"),
    ).filter("material_code <> ''")
    # a description without letter or digit is still one: it comes after all others
    m = m.withColumn("fill", F.when(F.col("some"), F.col("letters") + 1).otherwise(0))
    return m.join(files.select("file_id", "trust"), "file_id", "left")


def surviving_listings(materials: DataFrame, files: DataFrame) -> DataFrame:
    """(cpse, material_code, desc_rec, uom_rec, rate_rec) of the listings with two or more records."""
    return survivors(listing_records(materials, files), ["cpse", "material_code"]).select("cpse", "material_code", "desc_rec", "uom_rec", "rate_rec")


def survivor_layers(materials: DataFrame, files: DataFrame) -> DataFrame:
    """(desc_layer, uom_layer, rate_layer, layers, listings): how many listings took each field from which layer."""
    s = survivors(listing_records(materials, files), ["cpse", "material_code"])
    return s.groupBy("desc_layer", "uom_layer", "rate_layer", "layers").agg(F.count("*").alias("listings"))
