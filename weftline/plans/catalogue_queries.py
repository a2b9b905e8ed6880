"""Queries of the harmonisation pipeline over the catalogue tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import harmonise as h
from weftline.functions.dialect import DUCK, SPARK
from weftline.functions.rules import UPLOAD_ROWS
from weftline.operators import enrich as en
from weftline.operators import quality
from weftline.session import Store
from weftline.sources.tables import table as t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
E = f"WITH {en.chain_sql()}\n"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_KEPT: dict = {}


def enriched(spark, d):
    """The enriched records, written once for a session and folder and then read by column."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _KEPT:
        _KEPT[key] = Store(spark).keep(en.enrich(t(spark, d, "iocl_materials")))
    return _KEPT[key]


# --- sources -----------------------------------------------------------------


@query("SELECT file_id, coalesce(nullif(trim(cpse), ''), upper(split_part(file_name, '_', 1))) AS org, upper(split_part(file_name, '_', 1)) AS by_name FROM extract_files")
def src_default_label(spark, d):
    """The organisation of a file: its own column, else the first part of the file's name."""
    by_name = F.upper(F.split_part("file_name", F.lit("_"), F.lit(1)))
    return t(spark, d, "extract_files").select("file_id", F.coalesce(F.nullif(F.trim("cpse"), F.lit("")), by_name).alias("org"), by_name.alias("by_name"))


@query("""SELECT file_id, count(*) FILTER (material_code <> '' AND description <> '') AS kept,
  count(*) FILTER (coalesce(material_code, '') = '' OR coalesce(description, '') = '') AS skipped FROM iocl_materials GROUP BY file_id""")
def ingest_report(spark, d):
    ok = (F.coalesce("material_code", F.lit("")) != "") & (F.coalesce("description", F.lit("")) != "")
    return t(spark, d, "iocl_materials").groupBy("file_id").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


@query(E + "SELECT rec_id, org, code, description, uom, category_hint, rate FROM r")
def ingest_defaults(spark, d):
    return en.ingest(t(spark, d, "iocl_materials")).drop("file_id")


@query("""WITH v AS (SELECT 'c' AS k, cpse, material_code, description, uom FROM iocl_materials),
x AS (SELECT line_id FROM raw_lines)
SELECT source, count(*) AS n, count(category_hint) AS hints, count(rec_id) AS ids FROM (
  SELECT 'catalogue' AS source, rec_id, category_hint FROM iocl_materials UNION ALL BY NAME SELECT 'pairs' AS source, pair_id FROM match_pairs) GROUP BY source""".replace("WITH v AS (SELECT 'c' AS k, cpse, material_code, description, uom FROM iocl_materials),\nx AS (SELECT line_id FROM raw_lines)\n", ""))
def src_union_by_name(spark, d):
    """Extracts whose columns differ in order and number, united by name."""
    a = t(spark, d, "iocl_materials").select(F.lit("catalogue").alias("source"), "rec_id", "category_hint")
    b = t(spark, d, "match_pairs").select("pair_id", F.lit("pairs").alias("source"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.count("category_hint").alias("hints"), F.count("rec_id").alias("ids"))


@query(f"""WITH k AS (SELECT cpse, upper(trim(coalesce(material_code, ''))) AS c, count(*) AS n FROM iocl_materials GROUP BY ALL)
SELECT cpse, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (c = ''), 0)::BIGINT AS blank_codes, coalesce(sum(n - 1) FILTER (c <> ''), 0)::BIGINT AS repeated_codes,
  sum(n) <= {UPLOAD_ROWS} AND coalesce(sum(n) FILTER (c = ''), 0) = 0 AND coalesce(sum(n - 1) FILTER (c <> ''), 0) = 0 AS accepted FROM k GROUP BY cpse""")
def upload_validation(spark, d):
    return quality.validate(t(spark, d, "iocl_materials"), "cpse")


@query("""SELECT decision_id, decided_at, upper(trim(decision)) AS decision, cpse, upper(trim(material_code)) AS material_code FROM review_decisions
  WHERE trim(coalesce(material_code, '')) <> '' AND trim(coalesce(decision, '')) <> ''""")
def decisions_scan(spark, d):
    x = t(spark, d, "review_decisions").filter("trim(material_code) <> '' and trim(decision) <> ''")
    return x.select("decision_id", "decided_at", F.upper(F.trim("decision")).alias("decision"), "cpse", F.upper(F.trim("material_code")).alias("material_code"))


@query(r"""SELECT line_id, CASE WHEN regexp_matches(raw_line, '^[=+\-@\t\r]') THEN '''' || raw_line ELSE raw_line END AS guarded FROM raw_lines""")
def formula_guard(spark, d):
    from weftline.sources.sinks import guard

    return guard(t(spark, d, "raw_lines").select("line_id", F.col("raw_line").alias("guarded")))


# --- text ----------------------------------------------------------------------


@query(E + "SELECT rec_id, t FROM n")
def normalize_text(spark, d):
    return enriched(spark, d).select("rec_id", "t")


@query(f"SELECT rec_id, {h.uom(DUCK, 'uom')} AS unit FROM iocl_materials")
def normalize_uom(spark, d):
    return t(spark, d, "iocl_materials").select("rec_id", F.expr(h.uom(SPARK, "uom")).alias("unit"))


@query(f"SELECT rec_id, {h.rate(DUCK, 'last_rate_inr')} AS price FROM iocl_materials")
def parse_rate(spark, d):
    return t(spark, d, "iocl_materials").select("rec_id", F.expr(h.rate(SPARK, "last_rate_inr")).alias("price"))


@query(f"SELECT rec_id, round({h.rate(DUCK, 'last_rate_inr')}, 2) AS price FROM iocl_materials")
def price_columns(spark, d):
    return t(spark, d, "iocl_materials").select("rec_id", F.round(F.expr(h.rate(SPARK, "last_rate_inr")), 2).alias("price"))


_CAND = r"^([^/]+)/(.+?) \(sim ([0-9.]+)\): ?(.*)$"


@query(rf"""WITH f AS (SELECT a_cpse AS k, pair_id, b_cpse || '/' || coalesce(b_code, '?') || ' (sim ' || printf('%.2f', round(coalesce(sim, 0), 2)) || '): ' || coalesce(replace(b_desc, ' || ', ' '), '') AS c FROM match_pairs WHERE b_cpse IS NOT NULL AND b_code <> '')
SELECT pair_id, regexp_extract(c, '{_CAND}', 1, 's') AS org, regexp_extract(c, '{_CAND}', 2, 's') AS code, TRY_CAST(regexp_extract(c, '{_CAND}', 3, 's') AS DOUBLE) AS sim FROM f""")
def parse_candidates(spark, d):
    """Candidates written as `ORG/CODE (sim 0.00): text`, and read back."""
    p = t(spark, d, "match_pairs").filter("b_cpse is not null and b_code <> ''")
    text = F.coalesce(F.regexp_replace("b_desc", r" \|\| ", " "), F.lit(""))
    c = F.concat("b_cpse", F.lit("/"), F.coalesce("b_code", F.lit("?")), F.lit(" (sim "), F.format_string("%.2f", F.round(F.coalesce("sim", F.lit(0.0)), 2)), F.lit("): "), text)
    got = [F.regexp_extract(c, "(?s)" + _CAND, i) for i in (1, 2, 3)]
    return p.select("pair_id", got[0].alias("org"), got[1].alias("code"), got[2].try_cast("double").alias("sim"))


# --- types, attributes, identity --------------------------------------------------


@query(E + "SELECT rec_id, fine, category FROM u")
def classify_type(spark, d):
    return enriched(spark, d).select("rec_id", "fine", "category")


@query(E + f"SELECT rec_id, {h.pairs_text(DUCK, {k: f'a_{k}' for k in en.KEYS})} AS attrs FROM a")
def extract_attrs(spark, d):
    return enriched(spark, d).select("rec_id", F.expr(h.pairs_text(SPARK, {k: f"a_{k}" for k in en.KEYS})).alias("attrs"))


@query(E + "SELECT rec_id, complete FROM c")
def record_complete(spark, d):
    return enriched(spark, d).select("rec_id", "complete")


@query(E + f"SELECT rec_id, {h.missing(DUCK, 'fine', en.col())} AS missing FROM a")
def missing_identity(spark, d):
    return enriched(spark, d).select("rec_id", F.expr(h.missing(SPARK, "fine", en.col())).alias("missing"))


# --- profile -------------------------------------------------------------------------


@query(r"""WITH x AS (SELECT cpse, trim(coalesce(material_code, '')) AS c, trim(coalesce(description, '')) AS s, trim(coalesce(uom, '')) AS u, coalesce(trim(last_rate_inr), '') AS r FROM iocl_materials),
k AS (SELECT cpse, count(*) - count(DISTINCT upper(c)) AS repeated_codes FROM x WHERE c <> '' GROUP BY cpse),
o AS (SELECT cpse, count(*) - count(DISTINCT (c, s, u, r)) AS repeated_rows FROM x GROUP BY cpse)
SELECT cpse, count(*) AS n_rows, count(*) FILTER (c = '') AS blank_code, count(*) FILTER (s = '') AS blank_description, count(*) FILTER (u = '') AS blank_uom,
  coalesce(any_value(repeated_codes), 0) AS repeated_codes, any_value(repeated_rows) AS repeated_rows, min(length(s)) AS shortest, quantile_cont(length(s), 0.5) AS middle, max(length(s)) AS longest,
  count(*) FILTER (length(s) < 8) AS short, count(*) FILTER (r <> '' AND NOT regexp_matches(replace(r, ',', ''), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')) AS bad_rates
FROM x LEFT JOIN k USING (cpse) LEFT JOIN o USING (cpse) GROUP BY cpse""")
def preflight_stats(spark, d):
    return quality.profile(t(spark, d, "iocl_materials"), "cpse")


@query("""WITH k AS (SELECT cpse, upper(trim(coalesce(uom, ''))) AS u, count(*) AS n FROM iocl_materials GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY cpse ORDER BY n DESC, u) AS i, count(*) OVER (PARTITION BY cpse) AS kinds FROM k)
SELECT cpse, u, n, greatest(kinds - 5, 0) AS more FROM o WHERE i <= 5""")
def uom_inventory(spark, d):
    return quality.top_values(t(spark, d, "iocl_materials"), "cpse", "uom", 5)


@query(ORACLE["preflight_stats"].join(["SELECT cpse, CASE WHEN blank_code + blank_description + repeated_codes > 0 THEN 'blocked' WHEN blank_uom + short + bad_rates + repeated_rows > 0 THEN 'warnings' ELSE 'ready' END AS verdict, array_to_string(list_filter([CASE WHEN blank_code > 0 THEN 'blank codes' END, CASE WHEN blank_description > 0 THEN 'blank descriptions' END, CASE WHEN repeated_codes > 0 THEN 'repeated codes' END, CASE WHEN repeated_rows > 0 THEN 'repeated rows' END, CASE WHEN blank_uom > 0 THEN 'blank units' END, CASE WHEN short > 0 THEN 'short descriptions' END, CASE WHEN bad_rates > 0 THEN 'bad rates' END], lambda v: v IS NOT NULL)[1:3], ', ') AS problems FROM (", ")"]))
def preflight_verdict(spark, d):
    return quality.verdict(quality.profile(t(spark, d, "iocl_materials"), "cpse"), "cpse")


# --- standard forms and codes ------------------------------------------------------------


@query(E + f"SELECT rec_id, {h.shown(DUCK, 'inch', 'a_inch')} AS inch, {h.shown(DUCK, 'std', 'a_std')} AS std, {h.shown(DUCK, 'material', 'a_material')} AS material FROM a")
def format_value(spark, d):
    return enriched(spark, d).select("rec_id", *(F.expr(h.shown(SPARK, k, f"a_{k}")).alias(k) for k in ("inch", "std", "material")))


@query(E + f"SELECT rec_id, {h.description(DUCK, 'fine', 'unit', en.col())} AS standard FROM c")
def std_description(spark, d):
    return enriched(spark, d).select("rec_id", F.expr(h.description(SPARK, "fine", "unit", en.col())).alias("standard"))


@query(E + "SELECT rec_id, canon, issued AS nmc FROM e")
def issue_code(spark, d):
    return enriched(spark, d).select("rec_id", "canon", F.col("issued").alias("nmc"))


@query(E + """, f AS (SELECT DISTINCT issued, canon FROM e),
s AS (SELECT x.issued, x.canon, (SELECT count(*) FROM f y WHERE y.issued = x.issued AND y.canon < x.canon) AS lesser FROM f x)
SELECT canon, CASE WHEN lesser = 0 THEN issued ELSE issued || '-' || lesser END AS nmc, lesser + 1 AS place FROM s""")
def code_collision(spark, d):
    """A code for each canonical form; forms that share a hash are told apart by their place among them, so that no code is given twice."""
    forms = enriched(spark, d).select("issued", "canon").distinct()
    s = forms.withColumn("place", F.row_number().over(W.partitionBy("issued").orderBy("canon")).cast("long"))  # the forms of one hash: a handful
    return s.select("canon", F.when(F.col("place") == 1, F.col("issued")).otherwise(F.concat_ws("-", "issued", F.col("place") - 1)).alias("nmc"), "place")


_FORM = h.canonical(DUCK, "fine", "unit", lambda k: "cast(NULL AS VARCHAR)" if k == "std" else f"a_{k}")


@query(E + f""", o AS (SELECT issued FROM e WHERE complete GROUP BY issued HAVING count(*) = 1),
f AS (SELECT rec_id, fine, org, code, issued, concat_ws('|', {_FORM}, a_coil) AS form FROM e WHERE complete AND issued IN (SELECT issued FROM o)),
w AS (SELECT form, count(*) AS twins FROM f GROUP BY form)
SELECT rec_id, twins, CASE WHEN twins > 1 THEN {en.PROVISIONAL} ELSE issued END AS nmc FROM f JOIN w USING (form)""")
def twin_detection(spark, d):
    """Of the complete records that are alone in their group: how many have the same form but for standards, and the code that they get for it."""
    e = enriched(spark, d).filter("complete")
    alone = e.groupBy("issued").agg(F.count("*").alias("n")).filter("n = 1").select("issued")
    form = h.canonical(SPARK, "fine", "unit", lambda k: "cast(NULL AS STRING)" if k == "std" else f"a_{k}")
    f = e.join(alone, "issued", "left_semi").withColumn("form", F.concat_ws("|", F.expr(form), "a_coil"))
    twins = f.groupBy("form").agg(F.count("*").alias("twins"))
    return f.join(twins, "form").select("rec_id", "twins", F.when(F.col("twins") > 1, F.expr(en.PROVISIONAL)).otherwise(F.col("issued")).alias("nmc"))


# --- the registry: one master row for each canonical form ----------------------------------

_MASTER = """, m AS MATERIALIZED (SELECT nmc, min(canon) AS canon, min(category) AS category, count(DISTINCT org || '|' || code) AS codes, count(*) AS members, count(DISTINCT org) AS n_orgs,
  string_agg(DISTINCT org, ',' ORDER BY org) AS orgs, round(avg(price), 6) AS avg_price, min(price) AS low, max(price) AS high, bool_and(complete) AS settled FROM e GROUP BY nmc)
"""


def master(spark, d):
    return enriched(spark, d).groupBy("nmc").agg(
        F.min("canon").alias("canon"), F.min("category").alias("category"), F.count_distinct(F.concat("org", F.lit("|"), "code")).alias("codes"), F.count("*").alias("members"),
        F.count_distinct("org").alias("n_orgs"), F.array_join(F.array_sort(F.collect_set("org")), ",").alias("orgs"), F.round(F.avg("price"), 6).alias("avg_price"),
        F.min("price").alias("low"), F.max("price").alias("high"), F.bool_and("complete").alias("settled"))


@query(E + _MASTER + "SELECT nmc, canon, category, codes, members, orgs, low, high, settled FROM m")
def master_build(spark, d):
    return master(spark, d).select("nmc", "canon", "category", "codes", "members", "orgs", "low", "high", "settled")


@query(E + "SELECT nmc, org, code, description, uom, rec_id FROM e")
def mapping_build(spark, d):
    return enriched(spark, d).select("nmc", "org", "code", "description", "uom", "rec_id")


@query(E + _MASTER + "SELECT nmc, CASE WHEN members > 1 THEN 'CLUSTER_CREATED' ELSE 'RECORD_ISSUED' END AS action, members, settled AS auto FROM m")
def audit_clusters(spark, d):
    return master(spark, d).select("nmc", F.when(F.col("members") > 1, "CLUSTER_CREATED").otherwise("RECORD_ISSUED").alias("action"), "members", F.col("settled").alias("auto"))


@query(E + _MASTER + "SELECT nmc, avg_price, low, high FROM m")
def price_band(spark, d):
    return master(spark, d).select("nmc", "avg_price", "low", "high")


@query(E + _MASTER + "SELECT nmc, orgs, n_orgs FROM m")
def orgs_sharing(spark, d):
    return master(spark, d).select("nmc", "orgs", "n_orgs")


@query(E + _MASTER + "SELECT nmc, codes, n_orgs FROM m WHERE codes > 1 AND n_orgs > 1")
def shared_materials(spark, d):
    return master(spark, d).filter("codes > 1 and n_orgs > 1").select("nmc", "codes", "n_orgs")


_SPREAD = ", p AS (SELECT *, CASE WHEN high > 0 AND low > 0 THEN (high - low) / high END AS spread FROM m)\n"


def spreads(spark, d):
    return master(spark, d).withColumn("spread", F.when((F.col("high") > 0) & (F.col("low") > 0), (F.col("high") - F.col("low")) / F.col("high")))


@query(E + _MASTER + _SPREAD + "SELECT nmc, round(spread, 6) AS spread FROM p")
def price_spread(spark, d):
    return spreads(spark, d).select("nmc", F.round("spread", 6).alias("spread"))


@query(E + _MASTER + _SPREAD + "SELECT category, round(avg(spread), 6) AS spread, count(*) AS n FROM p WHERE codes > 1 AND n_orgs > 1 GROUP BY category")
def avg_price_spread(spark, d):
    return spreads(spark, d).filter("codes > 1 and n_orgs > 1").groupBy("category").agg(F.round(F.avg("spread"), 6).alias("spread"), F.count("*").alias("n"))


@query(E + _MASTER + _SPREAD + "SELECT nmc, round(spread, 6) AS spread FROM p WHERE spread IS NOT NULL ORDER BY p.spread DESC, nmc LIMIT 8")
def top_spreads(spark, d):
    return spreads(spark, d).filter("spread is not null").orderBy(F.desc("spread"), "nmc").limit(8).select("nmc", F.round("spread", 6).alias("spread"))


@query(E + _MASTER + _SPREAD + "SELECT nmc, category, round(spread, 6) AS spread FROM p WHERE category = 'valve' AND spread > 0 ORDER BY p.spread DESC, nmc LIMIT 5")
def spread_spotlight(spark, d):
    return spreads(spark, d).filter("category = 'valve' and spread > 0").orderBy(F.desc("spread"), "nmc").limit(5).select("nmc", "category", F.round("spread", 6).alias("spread"))


@query(E + "SELECT category, fine, count(*) AS n FROM e GROUP BY ALL")
def category_counts(spark, d):
    return enriched(spark, d).groupBy("category", "fine").agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN members = 1 AND settled THEN 'UNIQUE' WHEN members = 1 THEN 'PROVISIONAL' WHEN settled THEN 'AUTO_MATCHED' ELSE 'NEEDS_REVIEW' END"


@query(E + _MASTER + f"SELECT {_STATUS} AS status, count(*) AS n FROM m GROUP BY ALL")
def status_counts(spark, d):
    return master(spark, d).groupBy(F.expr(_STATUS).alias("status")).agg(F.count("*").alias("n"))


@query(E + _MASTER + """SELECT count(*) AS masters, sum(members)::BIGINT AS records, count(*) FILTER (codes > 1 AND n_orgs > 1) AS shared, count(*) FILTER (NOT settled) AS unsettled,
  (SELECT count(DISTINCT org) FROM e) AS organisations FROM m""")
def overview_kpis(spark, d):
    m = master(spark, d).agg(F.count("*").alias("masters"), F.sum("members").alias("records"), F.count_if((F.col("codes") > 1) & (F.col("n_orgs") > 1)).alias("shared"), F.count_if(~F.col("settled")).alias("unsettled"))
    o = en.ingest(t(spark, d, "iocl_materials")).agg(F.count_distinct("org").alias("organisations"))
    return m.crossJoin(o)  # one row by one row


@query(E + _MASTER + "SELECT category, count(*) AS total, count(*) FILTER (codes > 1 AND n_orgs > 1) AS shared, count(*) FILTER (members = 1) AS single, round(avg(codes) FILTER (codes > 1 AND n_orgs > 1), 4) AS codes_a_shared FROM m GROUP BY category")
def catalog_kpis(spark, d):
    s = (F.col("codes") > 1) & (F.col("n_orgs") > 1)
    return master(spark, d).groupBy("category").agg(F.count("*").alias("total"), F.count_if(s).alias("shared"), F.count_if(F.col("members") == 1).alias("single"), F.round(F.avg(F.when(s, F.col("codes"))), 4).alias("codes_a_shared"))


@query(E + """, k AS (SELECT nmc, uom, count(*) AS n, min(rec_id) AS first FROM e WHERE uom <> '' GROUP BY ALL)
SELECT nmc, uom AS value, n FROM k QUALIFY row_number() OVER (PARTITION BY nmc ORDER BY n DESC, first) = 1""")
def majority_value(spark, d):
    """The most frequent unit of each item; of equally frequent ones the first met."""
    from weftline.operators.registry import majority

    return majority(enriched(spark, d).filter("uom <> ''"), ["nmc"], "uom", "rec_id")


@query(None)
def merge_attrs(spark, d):
    """Of each item (cluster) every attribute's majority, and all its standards."""
    from weftline.operators.chain import merged
    from weftline.plans.match_queries import grouped

    return merged(enriched(spark, d), grouped(spark, d))


# --- views on the registry -------------------------------------------------------------------


@query(E + """, q AS (SELECT min(nmc) AS q FROM e), l AS (SELECT max(code) AS q FROM e)
SELECT 'code' AS found_by, nmc, org, code FROM e WHERE nmc = (SELECT q FROM q) UNION ALL
SELECT 'legacy', nmc, org, code FROM e WHERE code = (SELECT q FROM l) UNION ALL
SELECT 'prefix', nmc, org, code FROM e WHERE starts_with(nmc, 'NMC-VLV-GATE-0')""")
def code_lookup(spark, d):
    """The least code, the greatest legacy code, and a code prefix looked up."""
    e = enriched(spark, d).select("nmc", "org", "code")
    q = e.agg(F.min("nmc").alias("q"), F.max("code").alias("l"))
    ways = F.array(F.when(F.col("nmc") == F.col("q"), "code"), F.when(F.col("code") == F.col("l"), "legacy"), F.when(F.col("nmc").startswith("NMC-VLV-GATE-0"), "prefix"))
    hits = e.crossJoin(q).select(F.explode(F.array_compact(ways)).alias("found_by"), "nmc", "org", "code")  # q has one row
    return hits


@query(E + _MASTER + "SELECT nmc, canon FROM m WHERE contains(lower(canon), 'ss316') OR contains(lower(nmc), 'ss316')")
def catalog_search(spark, d):
    low = F.lower("canon").contains("ss316") | F.lower("nmc").contains("ss316")
    return master(spark, d).filter(low).select("nmc", "canon")


@query(E + _MASTER + _SPREAD + "SELECT nmc FROM p WHERE category IN ('valve', 'bearing') AND codes > 1 AND n_orgs > 1 AND spread <> 0")
def catalog_filter(spark, d):
    return spreads(spark, d).filter("category in ('valve', 'bearing') and codes > 1 and n_orgs > 1 and spread <> 0").select("nmc")


@query(E + _MASTER + "SELECT nmc AS Code, upper(substr(category, 1, 1)) || substr(category, 2) AS Category, CASE WHEN length(canon) > 60 THEN substr(canon, 1, 59) || '…' ELSE canon END AS Description, codes AS Legacy, round(low, 2) AS Low, round(high, 2) AS High FROM m")
def catalog_view(spark, d):
    cut = F.when(F.length("canon") > 60, F.concat(F.substring("canon", 1, 59), F.lit("…"))).otherwise(F.col("canon"))
    pretty = F.concat(F.upper(F.substring("category", 1, 1)), F.expr("substr(category, 2)"))
    return master(spark, d).select(F.col("nmc").alias("Code"), pretty.alias("Category"), cut.alias("Description"), F.col("codes").alias("Legacy"), F.round("low", 2).alias("Low"), F.round("high", 2).alias("High"))


@query(E + _MASTER + """SELECT 'shared' AS pick, nmc AS id FROM (SELECT nmc FROM m WHERE codes >= 3 AND n_orgs >= 2 ORDER BY nmc LIMIT 1)
UNION ALL SELECT 'review', min(pair_id)::VARCHAR FROM match_pairs WHERE starts_with(lower(trim(reason)), 'review') UNION ALL SELECT 'veto', min(pair_id)::VARCHAR FROM match_pairs WHERE starts_with(lower(trim(reason)), 'veto')""")
def quick_picks(spark, d):
    first = master(spark, d).filter("codes >= 3 and n_orgs >= 2").orderBy("nmc").limit(1).select(F.lit("shared").alias("pick"), F.col("nmc").alias("id"))
    p = t(spark, d, "match_pairs").withColumn("kind", F.lower(F.trim("reason")))
    for k in ("review", "veto"):
        first = first.unionByName(p.filter(F.col("kind").startswith(k)).agg(F.min("pair_id").cast("string").alias("id")).select(F.lit(k).alias("pick"), "id"))
    return first


@query(E + _MASTER + """SELECT 'duplicate codes' AS rule, (SELECT count(*) - count(DISTINCT nmc) FROM m) AS broken UNION ALL
SELECT 'unmapped records', (SELECT count(*) FROM r WHERE rec_id NOT IN (SELECT rec_id FROM e)) UNION ALL
SELECT 'member counts', (SELECT count(*) FROM m JOIN (SELECT nmc, count(*) AS k FROM e GROUP BY nmc) USING (nmc) WHERE k <> members)""")
def registry_integrity(spark, d):
    m, e = master(spark, d), enriched(spark, d)
    one = m.agg((F.count("*") - F.count_distinct("nmc")).alias("broken")).select(F.lit("duplicate codes").alias("rule"), "broken")
    two = en.ingest(t(spark, d, "iocl_materials")).join(e.select("rec_id"), "rec_id", "left_anti").agg(F.count("*").alias("broken")).select(F.lit("unmapped records").alias("rule"), "broken")
    counted = e.groupBy("nmc").agg(F.count("*").alias("k"))
    three = m.join(counted, "nmc").filter("k <> members").agg(F.count("*").alias("broken")).select(F.lit("member counts").alias("rule"), "broken")
    return one.unionByName(two).unionByName(three)


@query(E + _MASTER + """SELECT (SELECT count(*) FROM e LEFT JOIN (SELECT nmc FROM m WHERE settled) USING (nmc) WHERE e.nmc NOT IN (SELECT nmc FROM m WHERE settled)) AS orphan_mappings""".replace(" LEFT JOIN (SELECT nmc FROM m WHERE settled) USING (nmc)", ""))
def orphan_mappings(spark, d):
    """Mapping rows whose master is not among the settled ones."""
    return enriched(spark, d).select("nmc").join(master(spark, d).filter("settled").select("nmc"), "nmc", "left_anti").agg(F.count("*").alias("orphan_mappings"))


@query(E + _MASTER + "SELECT e.rec_id, m.nmc, m.members FROM e JOIN m USING (nmc)")
def mapping_master_join(spark, d):
    return enriched(spark, d).select("rec_id", "nmc").join(master(spark, d).select("nmc", "members"), "nmc")


@query(E + _MASTER + "SELECT org, code, max(rec_id) AS rec_id, max_by(nmc, rec_id) AS nmc FROM e GROUP BY ALL")
def record_to_code(spark, d):
    """Each listing's code; of repeated listings the last record counts."""
    return enriched(spark, d).groupBy("org", "code").agg(F.max("rec_id").alias("rec_id"), F.max_by("nmc", "rec_id").alias("nmc"))
