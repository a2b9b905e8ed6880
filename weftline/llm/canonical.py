"""Mapping free-entered values to a canonical list.

Method: token-level repair.  The distinct values are cut into tokens; each distinct token is
joined to the tokens of the reference list by edit distance (one slip for four or five
characters, two from six on; a swap of neighbours is one slip), by way of the strings that
losing up to that many characters leaves, so no token meets the whole vocabulary.  The
corrected tokens are combined by soft TF-IDF, which ranks the complete entries; a value whose
best score is under the threshold is UNMATCHED.

Each code, name and alias of an entry is a label.  A label's spelling without spaces is a
token too, and so is a value's, which mends lost or moved spaces; a value cut short matches
the labels it begins.

Defined cases: blank values and values that literally are a code have no row; nulls have
none; ties go to the higher similarity, then to the smaller code; an empty list leaves every
value unmatched; repeated values are decided once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import Store

UNMATCHED = "UNMATCHED"
THRESHOLD = 0.6
#: Similarity of a value that is the beginning of a label.
CUT_SHORT = 0.9
LEAST_CUT = 4
#: Words that carry no meaning in such values.
IDLE = ("in", "per", "of", "and", "the", "for")
_DOTTED = re.compile(r"(?<![^\W_])(?:[^\W_]\.)+(?:[^\W_](?![^\W_]))?")


def slips(n: int) -> int:
    """How many slips a token of that length may hold."""
    return 0 if n < 4 else 1 if n < 6 else 2


def distance(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours counts as one."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


def tokens(value: str, amounts: bool) -> list[str]:
    """Lower-case tokens, the spelling without spaces last if there are several; amounts: leave numbers out."""
    v = value.strip().lower()
    v = _DOTTED.sub(lambda m: m[0].replace(".", ""), v)
    if amounts and (any(c.isalpha() for c in v)):
        v = re.sub(r"\d[\d,]*(?:\.\d+)?", " ", v)
    got = [t for t in re.findall(r"[^\W_]+", v) if t not in IDLE]
    return got


def _remains(t: str) -> set[str]:
    """The token, and what losing up to its allowed slips leaves of it."""
    out = {t}
    for k in range(1, slips(len(t)) + 1):
        for cut in combinations(range(len(t)), k):
            out.add("".join(c for i, c in enumerate(t) if i not in cut))
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for field, value, amounts in zip(b["field"], b["value"], b["amounts"]):
            # an alias such as M2 is itself, not an amount of M
            for n, mode in enumerate([False, True] if amounts else [False]):
                ts = tokens(value, mode)
                if n and ts == tokens(value, False):
                    continue
                rows += [(field, value, n, t, len(ts), False) for t in sorted(set(ts))]
                if ts:
                    rows.append((field, value, n, "".join(ts), 1, True))
        yield pd.DataFrame(rows, columns=["field", "value", "mode", "token", "of", "whole"])


def _variants(batches: Iterator[pd.DataFrame], longest: int) -> Iterator[pd.DataFrame]:
    """What each token leaves; one longer than any known word by more than two slips is near none of them."""
    for b in batches:
        rows = [(f, t, r) for f, t in zip(b["field"], b["token"]) if len(t) <= longest + 2 for r in _remains(t)]
        yield pd.DataFrame(rows, columns=["field", "token", "rest"])


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b)])


def labels(lists: DataFrame) -> DataFrame:
    """(field, code, label) from (field, code, name, aliases); a code or alias also with a plural s."""
    text = F.array_union(F.array("code", "name"), F.split(F.coalesce("aliases", F.lit("")), ";"))
    return lists.select("field", "code", F.explode(text).alias("label")).filter("trim(label) <> ''").distinct()


def repair(values: DataFrame, lists: DataFrame, store: Store, threshold: float = THRESHOLD) -> DataFrame:
    """(field, value, canonical) for distinct (field, value, amounts) against (field, code, name, aliases)."""
    entry = labels(lists)
    cut_schema = "field string, value string, mode int, token string, of int, whole boolean"
    named = store.keep(entry.select("field", F.col("label").alias("value"), F.lit(False).alias("amounts")).distinct().mapInPandas(_cut, cut_schema))
    owner = entry.withColumnRenamed("label", "value")
    words = named.filter("not whole")
    total = words.groupBy("field").agg(F.count_distinct("value").alias("labels"))
    idf = words.groupBy("field", "token").agg(F.count_distinct("value").alias("df")).join(total, "field").select("field", F.col("token").alias("word"), F.log(1 + F.col("labels") / F.col("df")).alias("w"))
    idf = store.keep(idf)
    cut = store.keep(values.mapInPandas(_cut, cut_schema))

    # 1. each distinct token meets the vocabulary where the two leave the same remains
    vocabulary = named.select("field", F.col("token").alias("word")).distinct()
    plural = vocabulary.select("field", "word", F.concat("word", F.lit("s")).alias("token"))
    known = vocabulary.select("field", "word", F.col("word").alias("token")).unionByName(plural)
    known_rest = known.mapInPandas(_variants_of_known, "field string, word string, token string, rest string")
    seen = cut.select("field", "token").distinct()
    longest = known.agg(F.max(F.length("token"))).first()[0] or 0
    seen_rest = seen.mapInPandas(lambda it: _variants(it, longest), "field string, token string, rest string")
    met = seen_rest.join(known_rest.withColumnRenamed("token", "spelt"), ["field", "rest"]).select("field", "token", "word", "spelt").distinct()
    near = met.withColumn("d", _distance("token", "spelt")).filter(F.col("d") <= F.when(F.length("token") < 4, 0).when(F.length("token") < 6, 1).otherwise(2))
    near = store.keep(near.groupBy("field", "token", "word").agg(F.max(1 - F.col("d") / F.greatest(F.length("token"), F.length("spelt"))).alias("sim")))

    # 2. soft TF-IDF over the corrected tokens
    top = idf.groupBy("field").agg(F.max("w").alias("top"))
    best_word = near.join(idf, ["field", "word"]).groupBy("field", "token").agg(F.max_by("w", "sim").alias("wt"))
    mine = cut.filter("not whole").join(top, "field").join(best_word, ["field", "token"], "left")
    # an unknown short token says little; a long one speaks against every entry
    mine = mine.select("field", "value", "mode", "token", F.coalesce("wt", F.when(F.length("token") <= 3, F.col("top") * 0.3).otherwise(F.col("top"))).alias("wt"))
    norm = mine.groupBy("field", "value", "mode").agg(F.sqrt(F.sum(F.col("wt") * F.col("wt"))).alias("nv"))
    label_words = words.select("field", F.col("value").alias("label"), F.col("token").alias("word")).join(idf, ["field", "word"])
    label_norm = label_words.groupBy("field", "label").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nl"))
    hit = mine.join(near, ["field", "token"]).join(label_words, ["field", "word"])
    # a label's word counts once, by the token closest to it
    hit = hit.groupBy("field", "value", "mode", "label", "word").agg(F.max(F.col("sim") * F.col("wt") * F.col("w")).alias("s"))
    soft = hit.groupBy("field", "value", "mode", "label").agg(F.sum("s").alias("s")).join(norm, ["field", "value", "mode"]).join(label_norm, ["field", "label"])
    soft = soft.select("field", "value", "mode", "label", (F.col("s") / (F.col("nv") * F.col("nl"))).alias("score"))

    # 3. the spelling without spaces, whole or cut short
    joined = named.filter("whole").select("field", F.col("token").alias("word"), F.col("value").alias("label"))
    mine_whole = cut.filter("whole").select("field", "value", "mode", "token")
    whole = mine_whole.join(near, ["field", "token"]).join(joined, ["field", "word"]).select("field", "value", "mode", "label", F.col("sim").alias("score"))
    starts = joined.filter(F.length("word") > LEAST_CUT).select("field", "label", F.explode(F.transform(F.sequence(F.lit(LEAST_CUT), F.length("word") - 1), lambda n: F.substring("word", F.lit(1), n))).alias("token"))
    short = mine_whole.join(starts, ["field", "token"]).select("field", "value", "mode", "label", F.lit(CUT_SHORT).alias("score"))

    scored = soft.unionByName(whole).unionByName(short).join(owner.withColumnRenamed("value", "label"), ["field", "label"])
    # as typed before without its amount, then by score, then by code
    best = scored.groupBy("field", "value").agg(F.min_by(F.struct("code", "score"), F.struct(-F.round("score", 9), "mode", "code")).alias("b"))
    all_ = values.select("field", "value").join(best, ["field", "value"], "left")
    return all_.select("field", "value", F.when(F.col("b.score") >= threshold, F.col("b.code")).otherwise(UNMATCHED).alias("canonical"))


def _variants_of_known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, w, t, r) for f, w, t in zip(b["field"], b["word"], b["token"]) for r in _remains(t)]
        yield pd.DataFrame(rows, columns=["field", "word", "token", "rest"])


def canonical_values(materials: DataFrame, uoms: DataFrame, categories: DataFrame) -> DataFrame:
    """(rec_id, field_name, canonical) of every non-blank uom and category_hint that is not literally a code."""
    store = Store(materials.sparkSession)
    u = uoms.select(F.lit("uom").alias("field"), F.col("uom_code").alias("code"), F.col("uom_name").alias("name"), "aliases")
    c = categories.select(F.lit("category_hint").alias("field"), F.col("category_code").alias("code"), F.col("category_name").alias("name"), "aliases")
    lists = u.unionByName(c)
    both = F.array(F.struct(F.lit("uom").alias("field"), F.col("uom").alias("value")), F.struct(F.lit("category_hint").alias("field"), F.col("category_hint").alias("value")))
    typed = materials.select("rec_id", F.inline(both)).filter("trim(value) <> ''")
    distinct = typed.select("field", "value").distinct()
    codes = lists.select("field", F.col("code").alias("value")).distinct()
    distinct = store.keep(distinct.join(codes, ["field", "value"], "left_anti").withColumn("amounts", F.col("field") == "uom"))
    found = store.keep(repair(distinct, lists, store))
    return typed.join(found, ["field", "value"]).select("rec_id", F.col("field").alias("field_name"), "canonical")
