"""The queries of this package: name -> (session, data folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import canonical, consolidate, garbled, mixture, packing, percentiles, resolve, survivor
from weftline.sources.tables import table as t


def p2_found(spark, d):
    return resolve.same_products(t(spark, d, "iocl_materials"), t(spark, d, "uom_list"))


def p2_groups(spark, d):
    return resolve.product_groups(t(spark, d, "iocl_materials"), t(spark, d, "uom_list"))


def p3_found(spark, d):
    return canonical.canonical_values(t(spark, d, "iocl_materials"), t(spark, d, "uom_list"), t(spark, d, "category_list"))


def p4_found(spark, d):
    return consolidate.listing_groups(t(spark, d, "match_pairs"), t(spark, d, "iocl_materials"))


def p5_percentiles(spark, d):
    return percentiles.rate_percentiles(t(spark, d, "iocl_materials"))


def p5_states(spark, d):
    return percentiles.rate_states(t(spark, d, "iocl_materials"))


def p5_combined(spark, d):
    """Percentiles from the combined states; each value is at most 2**-12 of itself too small."""
    got = percentiles.combined_percentiles(percentiles.rate_states(t(spark, d, "iocl_materials")))
    return got.withColumn("relative_error_bound", F.lit(percentiles.RELATIVE_ERROR))


def p6_found(spark, d):
    return survivor.surviving_listings(t(spark, d, "iocl_materials"), t(spark, d, "extract_files"))


def p6_layers(spark, d):
    """How many listings took each field from which layer of dominance."""
    return survivor.survivor_layers(t(spark, d, "iocl_materials"), t(spark, d, "extract_files"))


def p8_packed(spark, d):
    """Every piece of every document in a container, for each capacity."""
    placed = packing.packed_documents(t(spark, d, "documents"), t(spark, d, "pack_sizes"))
    return placed.select("pack_name", "pack_id", "doc_id", "piece", "tokens")


def p8_report(spark, d):
    return packing.packing_report(t(spark, d, "documents"), t(spark, d, "pack_sizes"))


def p9_mixture(spark, d):
    return mixture.mixed_documents(t(spark, d, "documents"), t(spark, d, "source_targets"))


def p9_shares(spark, d):
    return mixture.reached_shares(t(spark, d, "documents"), t(spark, d, "source_targets"))


def p10_found(spark, d):
    return garbled.garbled_documents(t(spark, d, "documents"))


def p5_file_percentiles(spark, d):
    """(category_hint, file_id, n, p50, p90, p95, p99) of each file's own plain rates, exact."""
    m = t(spark, d, "iocl_materials")
    v = m.select("category_hint", "file_id", percentiles.plain_number(F.col("last_rate_inr")).alias("v"))
    return percentiles.radix_select(v, ["category_hint", "file_id"], "v").toDF("category_hint", "file_id", "n", "p50", "p90", "p95", "p99")


QUERIES = {
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_file_percentiles": p5_file_percentiles,
    "p5_percentiles": p5_percentiles,
    "p5_states": p5_states,
    "p5_combined": p5_combined,
    "p6_found": p6_found,
    "p6_layers": p6_layers,
    "p8_packed": p8_packed,
    "p8_report": p8_report,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}
