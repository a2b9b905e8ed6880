"""Records of the catalogue with normalised text, type, attributes, identity and code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import harmonise as h
from weftline.functions.dialect import DUCK, SPARK, Dialect
from weftline.functions.rules import LABELS

KEYS = sorted([*LABELS, "coil"])


def col(prefix: str = "a_"):
    return lambda k: f"{prefix}{k}"


def ingest(materials: DataFrame) -> DataFrame:
    """Rows with a code and a description, missing text as ''; organisation and code in upper case."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("material_code", "description", "uom", "category_hint", "hsn_code", "last_rate_inr")}
    rows = materials.withColumns(text).filter("material_code <> '' and description <> ''")
    return rows.select("rec_id", "file_id", F.upper(F.trim("cpse")).alias("org"), F.upper(F.trim("material_code")).alias("code"), "description", "uom", "category_hint", F.col("last_rate_inr").alias("rate"))


def with_attributes(df: DataFrame, text: str = "t", fine: str = "fine", prefix: str = "a_") -> DataFrame:
    return df.select("*", *(F.expr(e).alias(f"{prefix}{k}") for k, e in h.attributes(SPARK, text, fine).items()))


def typed(df: DataFrame, description: str, text: str = "t", fine: str = "fine") -> DataFrame:
    df = df.withColumn(text, F.expr(h.normal_steps(SPARK, f"lower({description})")))
    return df.withColumn(fine, F.expr(h.fine_type(SPARK, text)))


def readings(texts: DataFrame, description: str = "description") -> DataFrame:
    """(description, t, fine, category, a_*) of each distinct description.

    Descriptions are repeated, and a hundred patterns a text are heavy work on little data: each is read
    once, in as many tasks as a shuffle has, which the engine does not coalesce.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = texts.select(description).repartition(parts, description).distinct()
    return with_attributes(typed(each, description)).withColumn("category", F.expr(h.category(SPARK, "fine")))


#: The code of a record that is not known well enough to be merged: its listing's own.
PROVISIONAL = "concat('PROVISIONAL-', substr(upper(replace(fine, ' ', '')), 1, 14), '-', org, '-', code)"


def enrich(materials: DataFrame) -> DataFrame:
    """The whole chain: one projection after the other, each rule evaluated once a description.

    issued: the code of the record's canonical form; nmc: that, or a provisional one where the record is incomplete.
    """
    rows = ingest(materials)
    df = rows.join(readings(rows), "description")
    df = df.withColumns({"unit": F.expr(h.uom(SPARK, "uom")), "price": F.expr(h.rate(SPARK, "rate"))})
    df = df.withColumns({"complete": F.expr(h.complete(SPARK, "fine", col())), "canon": F.expr(h.canonical(SPARK, "fine", "unit", col()))})
    df = df.withColumn("issued", F.expr(h.code(SPARK, "canon")))
    return df.withColumn("nmc", F.expr(f"CASE WHEN complete THEN issued ELSE {PROVISIONAL} END"))


def attributes_sql(source: str, text: str = "t", fine: str = "fine", prefix: str = "a_") -> str:
    return f"SELECT *, {', '.join(f'{e} AS {prefix}{k}' for k, e in h.attributes(DUCK, text, fine).items())} FROM {source}"


def chain_sql() -> str:
    """The same chain as common table expressions; `e` is the last."""
    d: Dialect = DUCK
    return f"""
r AS (SELECT rec_id, file_id, upper(trim(cpse)) AS org, upper(trim(material_code)) AS code, description, coalesce(uom, '') AS uom,
  coalesce(category_hint, '') AS category_hint, coalesce(last_rate_inr, '') AS rate FROM iocl_materials WHERE material_code <> '' AND description <> ''),
n AS MATERIALIZED (SELECT *, {h.normal_steps(d, 'lower(description)')} AS t FROM r),
y AS MATERIALIZED (SELECT *, {h.fine_type(d, 't')} AS fine FROM n),
a AS MATERIALIZED ({attributes_sql('y')}),
u AS MATERIALIZED (SELECT *, {h.category(d, 'fine')} AS category, {h.uom(d, 'uom')} AS unit, {h.rate(d, 'rate')} AS price FROM a),
c AS MATERIALIZED (SELECT *, {h.complete(d, 'fine', col())} AS complete, {h.canonical(d, 'fine', 'unit', col())} AS canon FROM u),
i AS MATERIALIZED (SELECT *, {h.code(d, 'canon')} AS issued FROM c),
e AS MATERIALIZED (SELECT *, CASE WHEN complete THEN issued ELSE {PROVISIONAL} END AS nmc FROM i)"""
