"""From extracts to the registry: ingest, enrich, candidates, verdicts, groups, masters, reviews, and the five outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import chain
from weftline.operators import enrich as en
from weftline.session import Store
from weftline.sources import sinks
from weftline.sources.extracts import read_extracts


@dataclass
class Registry:
    """The outputs, as tables; `report` counts them."""

    master: DataFrame
    mapping: DataFrame
    review: DataFrame
    audit: DataFrame
    rejected: DataFrame

    def report(self) -> dict[str, int]:
        return {name: table.count() for name, table in vars(self).items()}


OUTPUTS = {
    "master": ["nmc", "standard", "category", "fine", "unit", "orgs", "members", "avg_price", "low", "high", "confidence", "status"],
    "mapping": ["nmc", "cpse", "material_code", "description", "uom"],
    "review": ["cpse", "material_code", "description", "candidates", "suggested_nmc"],
    "audit": ["nmc", "action", "members", "confidence"],
    "rejected": ["a_cpse", "a_code", "a_desc", "b_cpse", "b_code", "b_desc", "confidence", "reason"],
}


def harmonise(materials: DataFrame, candidates: int = 3) -> Registry:
    """The registry of catalogue records (rec_id, file_id, cpse, material_code, description, uom, category_hint, hsn_code, last_rate_inr).

    Complete records are grouped by accepted links; incomplete ones stay alone and come up for review with their
    best candidates and the code of the best.  Equal texts are compared once: links are between representatives of texts.
    """
    store = Store(materials.sparkSession)
    rows = store.keep(en.enrich(materials))
    grouped = store.keep(chain.clusters(rows, store))
    master = store.keep(chain.masters(rows, grouped))
    coded = store.keep(rows.join(grouped.select("rec_id", "cluster"), "rec_id").join(master.select("cluster", "nmc").withColumnRenamed("nmc", "code_of"), "cluster"))
    mapping = coded.select(F.col("code_of").alias("nmc"), F.col("org").alias("cpse"), F.col("code").alias("material_code"), "description", "uom")

    # verdicts between texts of one category; each text by its first record
    reps = store.keep(chain.representatives(rows))
    verdict = store.keep(chain.verdicts(reps, "category", store).filter("p < q"))
    first = coded.join(reps.select(F.col("rep").alias("rec_id")), "rec_id", "left_semi").select("rec_id", "org", "code", "description", "complete", "code_of")

    def side(prefix: str, key: str) -> DataFrame:
        return first.select(F.col("rec_id").alias(key), *(F.col(c).alias(f"{prefix}_{n}") for c, n in (("org", "cpse"), ("code", "code"), ("description", "desc"), ("complete", "complete"), ("code_of", "nmc"))))

    pairs = verdict.join(side("a", "p"), "p").join(side("b", "q"), "q")
    rejected = pairs.filter("verdict = 'veto'").select(*OUTPUTS["rejected"])
    asked = pairs.filter("verdict = 'review'")
    # from the incomplete side to the other, of two incomplete ones from both
    a_to_b = asked.filter("not a_complete").select(F.col("p").alias("rec_id"), "a_cpse", "a_code", "a_desc", F.col("b_cpse").alias("c_cpse"), F.col("b_code").alias("c_code"), F.col("b_nmc").alias("c_nmc"), "confidence")
    b_to_a = asked.filter("not b_complete").select(F.col("q").alias("rec_id"), F.col("b_cpse"), F.col("b_code"), F.col("b_desc"), F.col("a_cpse").alias("c_cpse"), F.col("a_code").alias("c_code"), F.col("a_nmc").alias("c_nmc"), "confidence")
    both = a_to_b.toDF("rec_id", "cpse", "material_code", "description", "c_cpse", "c_code", "c_nmc", "sim").unionByName(b_to_a.toDF("rec_id", "cpse", "material_code", "description", "c_cpse", "c_code", "c_nmc", "sim"))
    # a rank limit is pushed below the shuffle
    best = both.withColumn("i", F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("sim"), "c_cpse", "c_code"))).filter(F.col("i") <= candidates)
    said = F.format_string("%s/%s (sim %.2f)", "c_cpse", "c_code", "sim")
    review = best.groupBy("rec_id", "cpse", "material_code", "description").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", said.alias("s")))), lambda x: x["s"]), " || ").alias("candidates"), F.min_by("c_nmc", "i").alias("suggested_nmc")
    ).drop("rec_id")
    audit = master.select("nmc", F.when(F.col("members") > 1, "CLUSTER_CREATED").otherwise("RECORD_ISSUED").alias("action"), "members", "confidence")
    return Registry(master.select(*OUTPUTS["master"]), mapping, review, audit, rejected)


def run(spark: SparkSession, extracts: str, out: str) -> Registry:
    """Reads the extracts of a folder, and writes the five outputs as guarded CSV."""
    registry = harmonise(read_extracts(spark, extracts))
    for name, columns in OUTPUTS.items():
        sinks.write_csv(getattr(registry, name), f"{out.rstrip('/')}/{name}", columns)
    return registry
