"""The core's queries: name -> (session, data folder) -> DataFrame."""

from __future__ import annotations

from weftline.operators import rejects, units
from weftline.plans import catalogue_queries, match_queries
from weftline.sources.tables import table as t


def p1_found(spark, d):
    return rejects.rejected_rows(t(spark, d, "raw_lines"))


def p1_valid(spark, d):
    return rejects.valid_rows(t(spark, d, "raw_lines"))


def p7_found(spark, d):
    return units.contents(t(spark, d, "iocl_materials"), t(spark, d, "uom_list"))


def p7_scales(spark, d):
    """What each unit spelling was found to mean, and how."""
    return units.scale_report(t(spark, d, "iocl_materials"), t(spark, d, "uom_list"))


QUERIES = {"p1_found": p1_found, "p1_valid": p1_valid, "p7_found": p7_found, "p7_scales": p7_scales, **catalogue_queries.QUERIES, **match_queries.QUERIES}
