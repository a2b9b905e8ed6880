"""Verdicts on pairs: veto, review, match or no match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import harmonise as h
from weftline.functions.dialect import DUCK, SPARK, Dialect
from weftline.functions.rules import GOOD_SCORE, GOOD_SIM, HIGH_SIM, SHARED_SIM, WEIGHT_ATTR, WEIGHT_SIM, WEIGHT_TEXT
from weftline.operators import enrich as en
from weftline.operators.similarity import token_sort_ratio


def sides(pairs: DataFrame) -> DataFrame:
    """Both descriptions of each pair typed and read: x_* and y_*.  Each distinct description is read once."""
    df = pairs.withColumns({"xd": F.coalesce("a_desc", F.lit("")), "yd": F.coalesce("b_desc", F.lit(""))})
    read = en.readings(df.select(F.explode(F.array("xd", "yd")).alias("description")))
    for s in "xy":
        names = {"description": f"{s}d", "t": f"{s}t", "fine": f"{s}f", "category": f"{s}c", **{f"a_{k}": f"{s}_{k}" for k in en.KEYS}}
        df = df.join(read.select(*(F.col(c).alias(n) for c, n in names.items())), f"{s}d")
    return df


def sides_sql() -> str:
    one = "p0 AS (SELECT *, coalesce(a_desc, '') AS xd, coalesce(b_desc, '') AS yd FROM match_pairs)"
    k = "p0"
    for s in "xy":
        one += f""", {s}1 AS MATERIALIZED (SELECT *, {h.normal_steps(DUCK, f'lower({s}d)')} AS {s}t FROM {k}), {s}2 AS MATERIALIZED (SELECT *, {h.fine_type(DUCK, f'{s}t')} AS {s}f FROM {s}1),
{s}3 AS MATERIALIZED ({en.attributes_sql(f'{s}2', f'{s}t', f'{s}f', f'{s}_')}), {s}4 AS MATERIALIZED (SELECT *, {h.category(DUCK, f'{s}f')} AS {s}c FROM {s}3)"""
        k = f"{s}4"
    return one + f", p AS MATERIALIZED (SELECT * FROM {k})"


def agree(d: Dialect, k: str) -> str:
    """Do the values agree?  Of sizes one side's may hold the other's."""
    x, y = f"x_{k}", f"y_{k}"
    if k != "inch":
        return f"{x} = {y}"
    if d.spark:
        a, b = f"split({x}, ',')", f"split({y}, ',')"
        return f"(size(array_except({a}, {b})) = 0 OR size(array_except({b}, {a})) = 0)"
    a, b = f"string_split({x}, ',')", f"string_split({y}, ',')"
    return f"(list_has_all({b}, {a}) OR list_has_all({a}, {b}))"


def conflicts(d: Dialect) -> str:
    """Sorted names of what contradicts, joined by ','."""
    names = sorted([*en.KEYS, "type", "category"])
    parts = []
    for k in names:
        if k == "type":
            parts.append("CASE WHEN xf <> yf AND xf <> 'unknown' AND yf <> 'unknown' THEN 'type' END")
        elif k == "category":
            parts.append("CASE WHEN xc <> yc THEN 'category' END")
        else:
            parts.append(f"CASE WHEN NOT {agree(d, k)} THEN '{k}' END")
    return f"concat_ws(',', {', '.join(parts)})"


def shared(d: Dialect) -> str:
    return "(" + " + ".join(f"CASE WHEN x_{k} IS NOT NULL AND y_{k} IS NOT NULL THEN 1 ELSE 0 END" for k in en.KEYS) + ")"


def known(d: Dialect) -> str:
    return "(" + " + ".join(f"CASE WHEN x_{k} IS NOT NULL OR y_{k} IS NOT NULL THEN 1 ELSE 0 END" for k in en.KEYS) + ")"


def overlap(d: Dialect) -> str:
    return f"(CASE WHEN {known(d)} = 0 THEN 0.0 ELSE {shared(d)} / cast({known(d)} AS DOUBLE) END)"


def incomplete(d: Dialect) -> str:
    return f"(NOT {h.complete(d, 'xf', en.col('x_'))} OR NOT {h.complete(d, 'yf', en.col('y_'))})"


def agreeing(d: Dialect) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {agree(d, k)} THEN '{k}=' || x_{k} END" for k in en.KEYS) + ")"


def differences(d: Dialect) -> str:
    """key:equal, key:differ or key:missing of every attribute that either side has."""
    parts = [f"CASE WHEN x_{k} IS NULL AND y_{k} IS NULL THEN NULL WHEN x_{k} IS NULL OR y_{k} IS NULL THEN '{k}:missing' WHEN {agree(d, k)} THEN '{k}:equal' ELSE '{k}:differ' END" for k in en.KEYS]
    return f"concat_ws(';', {', '.join(parts)})"


def verdicts(pairs: DataFrame) -> DataFrame:
    """pair_id, verdict, reason, confidence; pairs are `sides` with sim."""
    df = pairs.withColumns({"s": F.coalesce("sim", F.lit(0.0)), "frac": F.expr(overlap(SPARK)), "n": F.expr(shared(SPARK)), "why": F.expr(conflicts(SPARK)), "gaps": F.expr(incomplete(SPARK)), "tsr": token_sort_ratio("xt", "yt")})
    df = df.withColumn("score", WEIGHT_SIM * F.col("s") + WEIGHT_ATTR * F.col("frac") + WEIGHT_TEXT * F.col("tsr") / 100)
    good = (F.col("score") >= GOOD_SCORE) & (F.col("s") >= GOOD_SIM)
    reason = (
        F.when(F.col("why") != "", F.concat(F.lit("veto:"), "why")).when(F.col("gaps"), "review:insufficient-attributes").when(F.col("s") >= HIGH_SIM, "match:high-sim")
        .when(good, "match").when((F.col("s") >= SHARED_SIM) & (F.col("n") > 0), "match:sim+attr").otherwise(F.format_string("no-match:score=%.2f", F.round("score", 2)))
    )
    df = df.withColumn("reason2", reason)
    confidence = F.when(F.col("reason2").rlike("^(veto|review)"), F.col("s")).otherwise(F.col("score"))
    return df.select("pair_id", F.split_part("reason2", F.lit(":"), F.lit(1)).alias("verdict"), F.col("reason2").alias("reason"), F.round(confidence, 4).alias("confidence"))
