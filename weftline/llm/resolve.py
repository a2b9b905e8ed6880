"""Product listings describing the same item.

Method: generic merge resolution.  Each record starts as a profile: kind, type number, attributes,
amount, read by a technical grammar with a lexicon of words, kinds and their attributes that is learnt from the
records themselves (`functions.lexicon`); no item is known beforehand.  Two profiles match if no attribute of theirs
disagrees and the poorer one fits that richer profile only; matched profiles are merged, which
makes the poorer one richer.  Each round blocks the profiles that are still poor

* by listing (organisation and code): a shortened description takes what a fuller one says, several partial ones
  are put together, an amount that one of them states holds for all;
* across organisations by kind, type number and the attributes they know: a profile that knows half of its
  attributes or more takes the rest from the one richer profile, of whatever organisation, that has the same of them.

The richer profiles are reblocked, by the attributes gained, and rematched, until no
profile changes.  Records with equal whole profiles describe one product.

Only poor profiles travel: the whole ones meet them by aggregates of distinct profiles, in the blocks
where a poor one stands.

Defined cases: a record with nothing but a kind, a blank or a null description belongs to no
product; records without a code take part with what they state and what other organisations'
profiles give them; profiles that stay incomplete form no pair; extra columns are ignored; an empty
input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import units
from weftline.session import Store

PROFILE = ("kind", "type", "attrs", "amount")
#: A profile may be completed across organisations if it knows this share of its kind's attributes.
KNOWN = 0.5


def _parts(attrs: str):
    return F.filter(F.split(F.coalesce(attrs, F.lit("")), ";"), lambda x: x != "")


def _keys(attrs: str):
    return F.array_join(F.transform(_parts(attrs), lambda x: F.substring_index(x, "=", 1)), " ")


def _agrees(poor: str, rich: str):
    """Is each `k=v` of the poorer among the richer's, or the beginning of one?"""
    return F.forall(_parts(poor), lambda p: F.exists(_parts(rich), lambda r: r.startswith(p)))


def _within_listing(open_: DataFrame, full: DataFrame) -> DataFrame:
    """(rec_id, profile): poor profiles that exactly one whole profile of their listing fits."""
    # a listing's profiles that differ only in whether they state the amount are one
    blocks = full.groupBy("listing", "kind", "type", "attrs").agg(F.max("amount").alias("amount"), F.count_distinct("amount").alias("amounts")).filter("amounts < 2")
    b = blocks.select("listing", *(F.col(c).alias(f"r_{c}") for c in PROFILE))
    j = open_.filter("listing is not null").join(b, "listing").filter(
        (F.col("kind").isNull() | (F.col("kind") == F.col("r_kind")))
        & (F.col("type").isNull() | (F.col("type") == F.col("r_type")))
        & (F.col("kind").isNull() | _agrees("attrs", "r_attrs"))
        & (F.col("amount").isNull() | F.col("r_amount").isNull() | (F.col("amount") == F.col("r_amount")))
    )
    one = j.groupBy("rec_id").agg(F.count("*").alias("n"), *(F.first(f"r_{c}").alias(c) for c in PROFILE))
    return one.filter("n = 1").select("rec_id", *PROFILE)


def _put_together(open_: DataFrame) -> DataFrame:
    """(rec_id, profile): the poor profiles of a listing without contradiction, put together."""
    poor = open_.filter("listing is not null and kind is not null")
    kv = poor.select("listing", "kind", F.explode(_parts("attrs")).alias("kv")).select("listing", "kind", F.substring_index("kv", "=", 1).alias("k"), F.substring_index("kv", "=", -1).alias("v"))
    # a value cut short gives way to the longest that it begins
    best = kv.groupBy("listing", "kind", "k").agg(F.max_by("v", F.length("v")).alias("v"), F.collect_set("v").alias("vs"))
    best = best.withColumn("ok", F.forall("vs", lambda x: F.col("v").startswith(x)))
    merged = best.groupBy("listing", "kind").agg(F.min("ok").alias("ok"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "k", "v"))), ";").alias("attrs"))
    ids = poor.groupBy("listing").agg(F.count_distinct("kind").alias("kinds"), F.count_distinct("type").alias("types"), F.max("type").alias("type"), F.count_distinct("amount").alias("amounts"), F.max("amount").alias("amount"), F.count("*").alias("n"))
    ids = ids.filter("kinds = 1 and types < 2 and amounts < 2 and n > 1")
    got = merged.filter("ok").select("listing", "kind", "attrs").join(ids, "listing")
    return poor.select("rec_id", "listing").join(got, "listing").select("rec_id", *PROFILE)


def _across(open_: DataFrame, full: DataFrame) -> DataFrame:
    """(rec_id, profile): poor profiles that exactly one whole profile, of whatever organisation, fits by what they know."""
    poor = open_.filter("kind is not null and type is not null and known").withColumn("keys", _keys("attrs"))
    asked = poor.select("kind", "type", "keys", "attrs", F.col("amount").alias("a_amount")).distinct()
    # the whole profiles, seen by the attributes that some poor one of their kind and number knows
    seen = full.join(asked.select("kind", "type", "keys").distinct(), ["kind", "type"])
    seen = seen.select("kind", "type", "keys", F.col("attrs").alias("r_attrs"), "amount", F.array_join(F.filter(_parts("attrs"), lambda x: F.array_contains(F.split("keys", " "), F.substring_index(x, "=", 1))), ";").alias("attrs"))
    fits = asked.join(seen, ["kind", "type", "keys", "attrs"]).filter("a_amount is null or amount is null or a_amount = amount")
    fits = fits.groupBy("kind", "type", "keys", "attrs", "a_amount").agg(F.count_distinct("r_attrs").alias("n"), F.min("r_attrs").alias("r_attrs"), F.count_distinct("amount").alias("amounts"), F.min("amount").alias("r_amount"))
    fits = fits.filter("n = 1 and (amounts < 2 or a_amount is not null)").withColumn("got", F.coalesce("a_amount", "r_amount"))
    mine = poor.select("rec_id", "kind", "type", "keys", "attrs", F.coalesce("amount", F.lit("")).alias("a"))
    fits = fits.select("kind", "type", "keys", "attrs", F.coalesce("a_amount", F.lit("")).alias("a"), "r_attrs", "got")
    return mine.join(fits, ["kind", "type", "keys", "attrs", "a"]).select("rec_id", "kind", "type", F.col("r_attrs").alias("attrs"), F.col("got").alias("amount"))


def merge_profiles(materials: DataFrame, uoms: DataFrame, store: Store) -> DataFrame:
    """(rec_id, cpse, kind, type, attrs, amount, grown) of the records whose profile is whole once no profile changes any more."""
    read, lex = units.read_materials(materials, store)
    now = units.measured(read, units.learn_scales(units.statements(read), uoms, store)).withColumn("amount", F.nullif(F.concat_ws(" ", "quantity_kind", F.col("amount").cast("string")), F.lit("")))
    sold = F.col("content").isNotNull()
    now = now.filter("(kind is not null and parts > 0) or type is not null")
    now = store.keep(now.select("rec_id", "cpse", "listing", *PROFILE, sold.alias("sold"), "whole", (F.col("whole") & ~(sold & F.col("amount").isNull())).alias("done")))
    store.drop(read)
    # the kinds' attributes: as many rows as kinds, which the lexicon bounds
    kinds = now.sparkSession.createDataFrame([(k, " ".join(v), k in lex.content) for k, v in lex.own.items()], "kind string, own string, sells boolean")

    def judged(df: DataFrame) -> DataFrame:
        """With whole, done and known as the profile now is."""
        j = df.join(F.broadcast(kinds), "kind", "left")
        j = j.withColumn("whole", F.coalesce(F.when(F.col("own").isNull(), F.col("whole")).otherwise(F.col("type").isNotNull() & (_keys("attrs") == F.col("own"))), F.lit(False)))
        j = j.withColumn("sold", F.coalesce("sells", "sold"))
        known = F.col("own").isNotNull() & (F.size(_parts("attrs")) >= KNOWN * F.size(F.split("own", " ")))
        return j.withColumns({"done": F.col("whole") & ~(F.col("sold") & F.col("amount").isNull()), "known": known}).drop("own", "sells")

    settled = now.filter("done")
    open_ = store.keep(judged(now.filter("not done")).withColumn("grown", F.lit(False)))
    # whole profiles where a poor one may meet them: of its listing, or of its kind and number
    rich = now.filter("whole")
    near = store.keep(rich.join(open_.select("listing").filter("listing is not null").distinct(), "listing", "left_semi").select("listing", *PROFILE).distinct())
    alike = store.keep(rich.join(open_.filter("known and type is not null").select("kind", "type").distinct(), ["kind", "type"], "left_semi").select(*PROFILE).distinct())
    while True:
        grown = open_.filter("whole and grown")
        poor = open_.filter("not done")
        ways = (
            _within_listing(poor, near.unionByName(grown.filter("listing is not null").select("listing", *PROFILE))),
            _put_together(poor),
            _across(poor, alike.unionByName(grown.select(*PROFILE))),
        )
        # of what the three give a record, its own listing's whole profile comes first
        new = ways[0].withColumn("way", F.lit(0)).unionByName(ways[1].withColumn("way", F.lit(1))).unionByName(ways[2].withColumn("way", F.lit(2)))
        new = new.groupBy("rec_id").agg(F.min_by(F.struct(*PROFILE), "way").alias("p")).select("rec_id", "p.*")
        j = open_.join(new.select("rec_id", *(F.col(c).alias(f"n_{c}") for c in PROFILE), F.lit(True).alias("met")), "rec_id", "left")
        value = {c: F.coalesce(f"n_{c}", c) for c in PROFILE}
        changed = F.coalesce(F.col("met") & ~F.struct(*(v.alias(c) for c, v in value.items())).eqNullSafe(F.struct(*PROFILE)), F.lit(False))
        step = j.select("rec_id", "cpse", "listing", *(v.alias(c) for c, v in value.items()), "sold", "whole", (F.col("grown") | changed).alias("grown"), changed.alias("changed"))
        step, seen = store.measure(judged(step), changes=F.count_if("changed"))
        store.drop(open_)
        open_ = step.drop("changed")
        open_._weftline_path = step._weftline_path
        if not seen["changes"]:
            break
    out = settled.select("rec_id", "cpse", *PROFILE, F.lit(False).alias("grown")).unionByName(open_.filter("whole").select("rec_id", "cpse", *PROFILE, "grown"))
    return out


def _signed(p: DataFrame) -> DataFrame:
    return p.withColumn("sig", F.unhex(F.md5(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in PROFILE)))))


def same_products(materials: DataFrame, uoms: DataFrame) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b, of different cpse."""
    store = Store(materials.sparkSession)
    p = store.keep(_signed(merge_profiles(materials, uoms, store)).select("rec_id", "cpse", "sig"))
    a = p.select(F.col("rec_id").alias("rec_a"), F.col("cpse").alias("ca"), "sig")
    b = p.select(F.col("rec_id").alias("rec_b"), F.col("cpse").alias("cb"), "sig")
    return a.join(b, "sig").filter("rec_a < rec_b and ca <> cb").select("rec_a", "rec_b")


def product_groups(materials: DataFrame, uoms: DataFrame) -> DataFrame:
    """(rec_id, product, members, organisations, merged): each record of a known product, with its group's least rec_id.

    merged: the record's own words do not tell its product; a merge did.
    """
    store = Store(materials.sparkSession)
    p = store.keep(_signed(merge_profiles(materials, uoms, store)).select("rec_id", "cpse", "sig", "grown"))
    g = p.groupBy("sig").agg(F.min("rec_id").alias("product"), F.count("*").alias("members"), F.count_distinct("cpse").alias("organisations"))
    return p.join(g, "sig").select("rec_id", "product", "members", "organisations", F.col("grown").alias("merged"))
