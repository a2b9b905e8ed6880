"""Quantities recorded in different units: what one stock unit holds, in g, ml or mm.

Method: linkage and a source graph.  A source is an organisation's use of a unit spelling (as met in
descriptions and units of issue).  Records of the same entity (kind, type number and technical
attributes, amount aside) link the sources: where one source says 12 and another, whose scale is
known, says 144 g, the two are a point.  Through a source's points a line is laid, robustly: its
slope is the known conversion that most pairs of points lie on, its offset where that gathers which the line
leaves (as Theil and Sen, but by modes, since entities come in several amounts; the pairs are
counted by what each conversion leaves, not listed, so the work is in proportion to the points).  Points of a single
quantity have only ratios, and no offset.  The ratio is snapped to a known conversion; a source with an
offset measures something else (a gross weight, say) and gets no scale.  Sources resolved in
one round serve the next, so scales spread through the graph, until a round finds none, from the anchors: the codes,
names and aliases of the unit list.  All organisations' use of a spelling taken together is a source as well,
which serves those with too few points of their own.
A spelling without links takes the conversion its name is known for, or that of
the anchor it is a misspelling of; else its amounts are left out.

Defined cases: a record without amount, or whose unit measures no mass, volume or length, has
no row; null and blank texts state nothing; an amount without a unit takes the unit
of issue; with no amount in the description, one written into the unit of issue counts;
several packs count in total; zero amounts are left out; a null organisation is a source of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.lexicon import ANY, Lexicon
from weftline.operators import profiles
from weftline.session import Store

# --- fixed values: conversions to g, ml and mm ---
CODES = {
    "KG": ("mass", "1000"), "GM": ("mass", "1"), "MT": ("mass", "1000000"), "QTL": ("mass", "100000"), "LB": ("mass", "453.59237"),
    "LTR": ("volume", "1000"), "ML": ("volume", "1"), "GAL": ("volume", "3785.411784"), "CUM": ("volume", "1000000"),
    "MTR": ("length", "1000"), "KM": ("length", "1000000"), "CM": ("length", "10"), "FT": ("length", "304.8"), "YD": ("length", "914.4"),
}
#: Conversions that an estimated scale may be snapped to, besides those of the codes.
MORE = {"mass": ["28.349523125"], "volume": ["946.352946"], "length": ["1", "25.4"]}
#: What spellings outside the unit list are known for; used where nothing links them.
KNOWN = {
    "us qt": ("volume", "946.352946"), "us qts": ("volume", "946.352946"), "us quart": ("volume", "946.352946"), "us quarts": ("volume", "946.352946"),
    "quart": ("volume", "946.352946"), "quarts": ("volume", "946.352946"), "qt": ("volume", "946.352946"), "qts": ("volume", "946.352946"),
    "us gal": ("volume", "3785.411784"), "gals": ("volume", "3785.411784"), "cc": ("volume", "1"), "lit": ("volume", "1000"), "lt": ("volume", "1000"),
    "kl": ("volume", "1000000"), "kilolitre": ("volume", "1000000"), "kiloliter": ("volume", "1000000"), "cu m": ("volume", "1000000"), "cum": ("volume", "1000000"), "m³": ("volume", "1000000"),
    "oz": ("mass", "28.349523125"), "ounce": ("mass", "28.349523125"), "m ton": ("mass", "1000000"), "metric ton": ("mass", "1000000"), "gram": ("mass", "1"), "kilogram": ("mass", "1000"),
    "mm": ("length", "1"), "millimetre": ("length", "1"), "millimeter": ("length", "1"),
}
TOLERANCE = 0.002
#: A line is believed if this share of a source's points lies on it.
SUPPORT = 0.25
#: In how many pairs a point counts, so that a stray one among many that are alike tells no slope.
PAIRINGS = 2
#: Pairs of points from which on the slope between them is believed rather than the ratio.
LEAST_PAIRS = 3
#: Hubs closer than so many of the bins of what a line leaves tell no slope.
APART = 10
#: The source that stands for all organisations' use of a spelling.
EVERYONE = "*"
#: Accuracy of the medians: they are within one part in as many of the rank.
ACCURACY = 10_000


def anchors(uoms: DataFrame) -> DataFrame:
    """(unit, dim, scale): the spellings that the unit list itself gives, plurals too."""
    scale = reduce(lambda c, k: c.when(F.col("uom_code") == k, F.struct(F.lit(CODES[k][0]).alias("dim"), F.lit(CODES[k][1]).alias("scale"))), CODES, F)
    text = F.array_union(F.array("uom_code", "uom_name"), F.split(F.coalesce("aliases", F.lit("")), ";"))
    a = uoms.select(F.explode(text).alias("t"), scale.alias("s")).filter("s is not null and t <> ''")
    t = F.lower(F.trim("t"))
    return a.select(F.explode(F.array(t, F.concat(t, F.lit("s")), F.concat(F.lit("us "), t))).alias("unit"), "s.dim", "s.scale").dropDuplicates(["unit"])


def _near(spellings: DataFrame, known: DataFrame) -> DataFrame:
    """(unit, dim, scale) for spellings one or two slips from, or the beginning of, a known one.

    known comes from the unit list, whose size is checked before it is sent along.
    """
    table = known.limit(20_001).collect()
    if len(table) > 20_000:
        raise ValueError("the unit list is too long to be a unit list")
    table = [(r.unit, r.dim, r.scale) for r in table]

    def read(batches):
        for b in batches:
            rows = []
            for u in b["unit"]:
                t, best = "".join(sorted(u.split(" "))), None
                for v, dim, scale in table:
                    w = "".join(sorted(v.split(" ")))
                    most = 0 if len(t) < 4 else 1 if len(t) < 6 else 2
                    if abs(len(t) - len(w)) <= most and most:
                        d = _slips(t, w)
                        if d <= most and (best is None or (d, v) < best[0]):
                            best = ((d, v), dim, scale)
                    if len(t) >= 4 and w.startswith(t) and (best is None or (1.5, v) < best[0]):
                        best = ((1.5, v), dim, scale)
                if best:
                    rows.append((u, best[1], best[2]))
            yield pd.DataFrame(rows, columns=["unit", "dim", "scale"])

    return spellings.mapInPandas(read, "unit string, dim string, scale string")


def _slips(a: str, b: str) -> int:
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


def _halves(x, width):
    """The two bins of that width, which overlap by halves, that hold x: an even and an odd number."""
    return F.array(F.floor(x / width).cast("long") * 2, F.floor(x / width + 0.5).cast("long") * 2 - 1)


def _mode(values: DataFrame, by: list[str], x, width) -> DataFrame:
    """(by, mid, n): the mean of the fullest of the overlapping bins of that width, and what it holds; a row of values counts n times."""
    bins = values.withColumn("__x", x).withColumn("__b", F.explode(_halves(F.col("__x"), width)))
    full = bins.groupBy(*by, "__b").agg(F.sum("n").alias("n"), (F.sum(F.col("__x") * F.col("n")) / F.sum("n")).alias("mid"))
    return full.groupBy(*by).agg(F.max_by(F.struct("mid", "n"), F.struct("n", -F.abs("mid"))).alias("m")).select(*by, "m.mid", "m.n")


def _shifts(alike: DataFrame, by: list[str], table: list) -> DataFrame:
    """(by, scale): the conversion on whose line most pairs of points lie, whatever its offset, if LEAST_PAIRS do.

    Two points are on a line of slope c where hub - c q is the same, so the pairs need not be listed: each bin of that
    difference is counted, and of its points the most that are of one hub, which tell no slope.
    """
    width = F.greatest(F.col("mid") * TOLERANCE, F.lit(1e-6))
    each = alike.select(*by, "q", "hub", "n", "mid", F.explode(F.filter(F.array(*table), lambda c: c["dim"] == F.col("dim"))["scale"]).alias("scale"))
    each = each.withColumn("bin", F.explode(_halves(F.col("hub") - F.col("q") * F.col("scale").cast("double"), width)))
    each = each.withColumn("same", F.explode(_halves(F.col("hub"), width * APART)))
    held = each.groupBy(*by, "scale", "bin", "same").agg(F.sum("n").alias("m")).groupBy(*by, "scale", "bin")
    # a point is in one even bin
    held = held.agg(F.sum(F.when(F.pmod("same", F.lit(2)) == 0, F.col("m"))).alias("n"), F.max("m").alias("most"))
    pairs = held.withColumn("pairs", F.least("n", PAIRINGS * (F.col("n") - F.col("most")))).filter(F.col("pairs") >= LEAST_PAIRS)
    return pairs.groupBy(*by).agg(F.max_by("scale", F.struct("pairs", "n", "scale")).alias("scale"))


def _lines(points: DataFrame, table: list, store: Store) -> DataFrame:
    """(source, unit, dim, scale, votes, offset, mid, sloped, points) of the sources whose points (q, hub of dim) lie on a line that a conversion explains.

    Many an entity comes in several amounts, so half of the points and more may be beside the line: what is looked for is the conversion
    that most pairs of points lie on and the fullest bin of what the line leaves, not a median.  Every point counts, with all others of its source
    and dimension.  All are aggregates with partial sums, so a source with a third of all points is no trouble.
    """
    by = ["source", "unit", "dim"]
    size = points.groupBy(*by).agg(F.count("*").alias("points"), F.percentile_approx("hub", 0.5, ACCURACY).alias("mid"))
    # amounts are repeated: what follows takes equal points together
    alike = store.keep(points.groupBy(*by, "q", "hub").agg(F.count("*").alias("n")).join(size, by))
    ratios = _mode(alike, by, F.ln(F.col("hub") / F.col("q")), TOLERANCE).select(*by, F.exp("mid").alias("ratio"))
    fit = ratios.join(_shifts(alike, by, table), by, "left").withColumn("sloped", F.col("scale").isNotNull())
    # points of one amount have only ratios
    snapped = F.filter(F.array(*table), lambda c: (c["dim"] == F.col("dim")) & (F.abs(F.col("ratio") / c["scale"].cast("double") - 1) < TOLERANCE))
    snap = fit.withColumn("scale", F.coalesce("scale", F.get(snapped, F.lit(0))["scale"])).filter("scale is not null").select(*by, "scale", "sloped")
    # of the two, alike may be small as written and large as broadcast
    left = alike.join(snap.hint("merge"), by).withColumn("d", F.col("hub") - F.col("q") * F.col("scale").cast("double"))
    offset = _mode(left, by, F.col("d"), F.greatest(F.col("mid") * TOLERANCE, F.lit(1e-6))).select(*by, F.when(F.abs("mid") < 0.01, 0.0).otherwise(F.col("mid")).alias("offset"))
    lines = store.keep(snap.join(offset, by).join(size, by))
    d = F.col("hub") - F.col("q") * F.col("scale").cast("double")
    on = points.join(lines, by).filter(F.abs(d - F.col("offset")) <= TOLERANCE * F.abs("hub"))
    votes = on.groupBy(*by).agg(F.count_distinct("entity").alias("votes"), F.count("*").alias("on"))
    return lines.join(votes, by)


def learn_scales(stated: DataFrame, uoms: DataFrame, store: Store, least_votes: int = 2) -> DataFrame:
    """(source, unit, dim, scale string, how, votes, offset) of each source; dim and scale are null where none was found.

    stated: source, entity, want (dimension of the goods or null), unit, q double.
    """
    seen = store.keep(stated.filter("unit <> ''").groupBy(F.coalesce("source", F.lit("")).alias("source"), "entity", "want", "unit", "q").agg(F.count("*").alias("n")))
    known = anchors(uoms)
    table = [F.struct(F.lit(d).alias("dim"), F.lit(s).alias("scale")) for d in ("mass", "volume", "length") for s in dict.fromkeys([x[1] for x in CODES.values() if x[0] == d] + MORE[d])]
    cols = ["source", "unit", "dim", "scale", "how", "votes", "offset"]
    blank = [F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("offset")]
    all_ = seen.select("source", "unit").distinct().join(known, "unit", "left")
    # every source, with its scale once that is found; how: "" while it is open
    scales = store.keep(all_.select("source", "unit", "dim", "scale", F.when(F.col("dim").isNotNull(), "anchor").otherwise("").alias("how"), *blank))
    linked = seen.filter("entity is not null and q > 0")
    while True:
        j = linked.join(scales.select("source", "unit", "scale", F.col("dim").alias("d"), "how"), ["source", "unit"])
        # each entity's hub: its most frequent amount among the sources resolved so far
        # only of entities that some open source speaks of
        asked = j.filter("how = ''").select("entity").distinct()
        resolved = j.filter("scale is not null").join(asked, "entity", "left_semi").select("entity", F.col("d").alias("dim"), F.round(F.col("q") * F.col("scale").cast("double"), 3).alias("a"), "n")
        hub = resolved.groupBy("entity", "dim", "a").agg(F.sum("n").alias("n")).groupBy("entity", "dim").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("hub"))
        point = j.filter("how = ''").join(hub, "entity").filter("want is null or want = dim").select("source", "unit", "dim", "entity", "q", "hub")
        points, count = store.measure(point.withColumn("source", F.explode(F.array(F.col("source"), F.lit(EVERYONE)))), n=F.count("*"))
        if not count["n"]:
            break
        lines = store.keep(_lines(points, table, store).filter((F.col("votes") >= least_votes) & (F.col("on") >= SUPPORT * F.col("points"))))
        store.drop(points)
        shifted = F.col("sloped") & (F.abs("offset") >= TOLERANCE * F.abs("mid"))
        best = lines.groupBy("source", "unit").agg(F.max_by(F.struct("dim", "scale", "votes", "offset"), F.when(~shifted, F.struct("on", "dim"))).alias("b"), F.min(shifted).alias("refused"))
        own = best.filter(F.col("source") != EVERYONE).select("source", "unit", F.col("b").alias("own"), "refused")
        shared = best.filter((F.col("source") == EVERYONE) & ~F.col("refused")).select("unit", F.col("b").alias("shared"))
        j = scales.join(own, ["source", "unit"], "left").join(shared, "unit", "left")
        open_ = F.col("how") == ""
        # a source whose own points lie on a shifted line measures something else, whatever the spelling means elsewhere
        new = F.when(~open_, "").when(F.col("refused"), "refused: offset").when(F.col("own").isNotNull(), "linked").when(F.col("shared").isNotNull(), "spelling linked").otherwise("")
        value = F.when(F.col("new") == "linked", F.col("own")).when(F.col("new") == "spelling linked", F.col("shared"))
        step = j.withColumn("new", new).withColumn("v", value)
        step = step.select("source", "unit", *(F.coalesce(f"v.{c}", c).alias(c) for c in ("dim", "scale")), F.when(F.col("new") != "", F.col("new")).otherwise(F.col("how")).alias("how"), *(F.coalesce(f"v.{c}", c).alias(c) for c in ("votes", "offset")), (F.col("new") != "").alias("found"))
        step, count = store.measure(step, found=F.count_if("found"))
        store.drop(scales)
        scales = step.drop("found")
        scales._weftline_path = step._weftline_path
        if not count["found"]:
            break
    rest = scales.filter("how = ''").select("unit").distinct()
    named = stated.sparkSession.createDataFrame([(u, d, s) for u, (d, s) in KNOWN.items()], "unit string, dim string, scale string")
    by_name = rest.join(F.broadcast(named), "unit").withColumn("how", F.lit("name"))  # a fixed table
    # misspellings of a unit that measures something else must not be taken for a length, volume or mass
    others = uoms.filter(~F.col("uom_code").isin(*CODES)).select(F.explode(F.array_union(F.array("uom_code", "uom_name"), F.split(F.coalesce("aliases", F.lit("")), ";"))).alias("t")).filter("t <> ''")
    others = others.select(F.lower(F.trim("t")).alias("unit"), F.lit("none").alias("dim"), F.lit("0").alias("scale"))
    near = _near(rest.filter(~F.col("unit").isin(*KNOWN)), known.unionByName(others).unionByName(others.withColumn("unit", F.concat("unit", F.lit("s")))))
    guess = by_name.unionByName(near.filter("dim <> 'none'").withColumn("how", F.lit("spelling"))).select("unit", F.struct("dim", "scale", "how").alias("g"))
    out = scales.join(guess, "unit", "left").withColumn("g", F.when(F.col("how") == "", F.col("g")))
    return store.keep(out.select("source", "unit", F.coalesce("g.dim", "dim").alias("dim"), F.coalesce("g.scale", "scale").alias("scale"), F.coalesce("g.how", "how").alias("how"), "votes", "offset").select(*cols))


def entity():
    """What the records of one product share, amount aside; null where too little is known."""
    return F.when(F.col("whole") & F.col("type").isNotNull(), F.xxhash64("kind", "type", "attrs"))


def statements(read: DataFrame, source: str = "cpse") -> DataFrame:
    """(source, entity, want, unit, q) of the kept profiles that state an amount."""
    q = F.col("times").cast("double") * F.col("number").cast("double")
    return read.filter("number is not null and unit is not null").select(F.col(source).alias("source"), entity().alias("entity"), F.nullif("content", F.lit(ANY)).alias("want"), "unit", q.alias("q"))


def measured(read: DataFrame, scales: DataFrame, source: str = "cpse") -> DataFrame:
    """The profiles with quantity_kind and amount by the scales: long g, ml or mm, rounded half up; null where none is stated."""
    scales = scales.select(F.col("source").alias("__source"), F.col("unit").alias("__unit"), F.col("dim").alias("__dim"), F.col("scale").cast("decimal(18,9)").alias("__scale"))
    exact = F.expr("cast(times as decimal(9,0)) * cast(number as decimal(16,6))").cast("decimal(20,6)")
    amount = F.round(exact * F.col("__scale"), 0).cast("long")
    # a row for each source and spelling; the engine broadcasts it only if it measures small
    got = read.join(scales, (F.coalesce(source, F.lit("")) == F.col("__source")) & (F.col("unit") == F.col("__unit")), "left")
    fits = F.col("__dim").isNotNull() & (amount > 0) & (~F.col("stated") | F.col("content").isNull() | F.col("content").isin(ANY) | (F.col("content") == F.col("__dim")))
    return got.withColumns({"quantity_kind": F.when(fits, F.col("__dim")), "amount": F.when(fits, amount)}).drop("__source", "__unit", "__dim", "__scale")


def listing():
    """Key of a listing: organisation and code; null where either is blank."""
    return F.when((F.trim("material_code") != "") & F.col("cpse").isNotNull(), F.concat_ws("|", "cpse", F.upper(F.trim("material_code"))))


#: A record whose features state no amount has none.
AMOUNTS = "amounts <> '' or number is not null"


def read_materials(materials: DataFrame, store: Store, only: str | None = None) -> tuple[DataFrame, Lexicon]:
    """(rec_id, cpse, listing (64 bits of its key) and the profile of each record, kept; the lexicon)."""
    src = materials.select("rec_id", "cpse", F.when(listing().isNotNull(), F.xxhash64(listing())).alias("listing"), "description", "uom")
    return profiles.profiles(src, ["rec_id", "cpse", "listing"], store, "listing", only)


def contents(materials: DataFrame, uoms: DataFrame) -> DataFrame:
    """(rec_id, quantity_kind, amount) of the records that state what one stock unit holds."""
    store = Store(materials.sparkSession)
    read, _ = read_materials(materials, store, AMOUNTS)
    return measured(read.filter("number is not null"), learn_scales(statements(read), uoms, store)).filter("amount is not null").select("rec_id", "quantity_kind", "amount")


def scale_report(materials: DataFrame, uoms: DataFrame) -> DataFrame:
    """(source, unit, quantity_kind, scale, how, votes): what each organisation's unit spelling was found to mean."""
    store = Store(materials.sparkSession)
    scales = learn_scales(statements(read_materials(materials, store, AMOUNTS)[0]), uoms, store)
    return scales.select("source", "unit", F.col("dim").alias("quantity_kind"), F.col("scale").cast("double").alias("scale"), "how", "votes")
