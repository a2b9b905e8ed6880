"""Consolidating pairwise matches into groups.

Method: rake and compress.  In turn, the vertices of degree one are stripped, and chains of vertices
of degree two are compressed by list ranking (pointer doubling over half-edges), until
neither finds anything; since a compressed chain leaves its ends as the next leaves, a tail of any
length goes in a logarithmic number of turns.  The reduced core is solved by star contraction, then the
labels go back to the vertices taken away.  All tables hold pairs of 64-bit ids; nothing is
collected but counts.

Rings that hang on nothing stay in the core; the core solver is exact on any graph.

Defined cases: pairs with a null side and pairs of a node with itself tie nothing;
repeated and reversed pairs count once; an empty input gives an empty result; other columns
are ignored.  A node of very high degree is aggregated on the map side; in joins the few
nodes that hold a thousandth of all edges or more (so at most two thousand) are sent to
the edges instead of the edges to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import Store


def _both(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, by one pass over the table."""
    two = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.inline(two))


def _ids(nodes: DataFrame, seed: int):
    return nodes.select("node", F.xxhash64(F.lit(seed), "node").alias("id"))


#: A node with a share of this many-th of all edges or more is a hub.
HUBS = 1000


def _by_degree(rows: DataFrame, facts: DataFrame, edges: int) -> DataFrame:
    """rows joined to facts (u, m, n) by u; n: the rows of u.  Rows of hubs stay where they are."""
    hub = F.col("n") * HUBS >= max(edges, HUBS)
    # the degrees of a graph sum to twice its edges: at most 2 * HUBS hubs
    hubs = F.broadcast(facts.filter(hub).select("u", "m"))
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(facts.filter(~hub).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(rest)


def strip_leaves(edges: DataFrame, store: Store) -> tuple[DataFrame, DataFrame | None]:
    """(edges without those of the vertices of degree one, (u, parent) of the vertices taken away)."""
    degree = _both(edges).groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    leaves = degree.filter("n = 1").select("u", "v")
    other = leaves.select(F.col("u").alias("w"))
    # two leaves tied to each other: the greater one goes
    gone, seen = store.measure(leaves.join(other, F.col("v") == F.col("w"), "left").filter("w is null or u > v").select("u", F.col("v").alias("parent")), n=F.count("*"))
    if not seen["n"]:
        return edges, None
    cut = gone.select(F.least("u", "parent").alias("a"), F.greatest("u", "parent").alias("b"))
    rest = store.keep(edges.join(cut, ["a", "b"], "left_anti"))
    return rest, gone


def compress_chains(edges: DataFrame, store: Store) -> tuple[DataFrame, DataFrame | None]:
    """(edges with each chain of degree-two vertices made one edge, (v, parent) of the chains' inner vertices)."""
    both = _both(edges)
    degree = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    inner, seen = store.measure(degree.filter("n = 2").select(F.col("u").alias("v"), "lo", "hi"), n=F.count("*"))
    if not seen["n"]:
        return edges, None
    # half-edge (u, v) into an inner vertex v goes on to v's other neighbour
    nxt = F.when(F.col("u") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    step = store.keep(both.join(inner, "v").select("u", "v", F.col("v").alias("x"), nxt.alias("y")))
    ends = None  # half-edges whose chain's end is known
    open_before = None
    rank = step
    while True:
        # (u, v) reaches (x, y); if y is inner too, go on from there, at doubled speed
        onward = rank.select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        jumped, seen = store.measure(rank.join(onward, ["x", "y"], "left").select("u", "v", F.coalesce("x2", "x").alias("x"), F.coalesce("y2", "y").alias("y"), F.col("x2").isNotNull().alias("more")), waiting=F.count_if("more"))
        waiting = seen["waiting"]
        store.drop(rank)
        rank = jumped.drop("more")
        rank._weftline_path = jumped._weftline_path
        if waiting == 0 or waiting == open_before:
            ends = jumped.filter("not more") if waiting else jumped
            break
        open_before = waiting
    # what still waits runs round in a ring; it stays in the core
    done = ends.select("u", "v", "y")
    chained = done.groupBy("v").agg(F.min("y").alias("parent"), F.count("*").alias("n")).filter("n = 2").select(F.col("v").alias("u"), "parent")
    chained, seen = store.measure(chained, n=F.count("*"))
    if not seen["n"]:
        return edges, None
    names = chained.select(F.col("u").alias("c"))
    keep = edges.join(names, F.col("a") == F.col("c"), "left_anti").join(names, F.col("b") == F.col("c"), "left_anti")
    # from a vertex that is not in a chain, through one, to its end
    spans = done.join(names, F.col("v") == F.col("c"), "left_semi").join(names, F.col("u") == F.col("c"), "left_anti").filter("u <> y")
    spans = spans.select(F.least("u", "y").alias("a"), F.greatest("u", "y").alias("b"))
    reduced = store.keep(keep.select("a", "b").unionByName(spans).distinct())
    store.drop(rank)
    store.drop(inner)
    return reduced, chained


def reduce(edges: DataFrame, store: Store) -> tuple[DataFrame, list[DataFrame]]:
    """(core, tables (u, parent) of the vertices taken away): strips and compresses in turn until neither changes anything."""
    taken: list[DataFrame] = []
    while True:
        bare, leaves = strip_leaves(edges, store)
        core, chained = compress_chains(bare, store)
        new = [t for t in (leaves, chained) if t is not None]
        if not new:
            return core, taken
        taken += new
        for old in (edges, bare):
            if old is not core:
                store.drop(old)
        edges = core


def solve_core(edges: DataFrame, store: Store) -> DataFrame:
    """(v, label): the least id of each vertex's component, by alternating large and small stars."""
    mark = None
    now, size = edges, edges.count()
    while True:
        both = _both(now)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _by_degree(both.filter("v > u"), low, size).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now points from the greater end u to the lesser end v
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        linked = _by_degree(large, least, size)
        small = linked.filter("v <> m").select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
        new, seen = store.measure(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n=F.count("*"), sum=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        sign = (seen["n"], seen["sum"])
        if now is not edges:
            store.drop(now)
        now, size = new, sign[0]
        if sign == mark:
            break
        mark = sign
    return now.select(F.col("b").alias("v"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("v"), F.col("a").alias("label")).distinct())


def _root(parents: DataFrame, store: Store) -> DataFrame:
    """Follows (u, parent) to where no parent is known, by pointer doubling."""
    while True:
        up = parents.select(F.col("u").alias("p"), F.col("parent").alias("q"))
        new, seen = store.measure(parents.join(up, F.col("parent") == F.col("p"), "left").select("u", F.coalesce("q", "parent").alias("parent"), F.col("q").isNotNull().alias("moved")), moved=F.count_if("moved"))
        moved = seen["moved"]
        store.drop(parents)
        parents = new.drop("moved")
        parents._weftline_path = new._weftline_path
        if not moved:
            return parents


def consolidate(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group_id): each node that a pair ties to another, with the least node of all it is tied to."""
    store = Store(pairs.sparkSession)
    names = pairs.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).filter("x is not null and y is not null and x <> y")
    names = store.keep(names.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    nodes = names.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    seed = 42
    while True:  # ids stand for names, so two names must not share one
        ids = store.keep(_ids(nodes, seed))
        if ids.groupBy("id").count().filter("count > 1").isEmpty():
            break
        seed += 1
    edge = names.select(F.xxhash64(F.lit(seed), "x").alias("p"), F.xxhash64(F.lit(seed), "y").alias("q"))
    edges = store.keep(edge.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
    core, taken = reduce(edges, store)
    labels = solve_core(core, store)
    if taken:
        parents = taken[0]
        for t in taken[1:]:
            parents = parents.unionByName(t)
        roots = _root(store.keep(parents), store)
        # a root without label was left alone: it is its own
        found = roots.join(labels, F.col("parent") == F.col("v"), "left").select("u", F.coalesce("label", "parent").alias("label"), "parent", F.col("label").isNull().alias("alone"))
        alone = found.filter("alone").select(F.col("parent").alias("v"), F.col("parent").alias("label")).distinct()
        labels = labels.unionByName(found.select(F.col("u").alias("v"), "label")).unionByName(alone)
    named = store.keep(ids.join(labels, F.col("id") == F.col("v")).select("node", "label"))
    first = named.groupBy("label").agg(F.min("node").alias("group_id"))
    return named.join(first, "label").select("node", "group_id")


def accepted_pairs(pairs: DataFrame, materials: DataFrame) -> DataFrame:
    """(a, b): `cpse|material_code` of the accepted pairs whose sides both stand in the catalogue."""

    def key(cpse, code):
        c = F.upper(F.trim(F.col(code)))
        return F.when((c != "") & F.col(cpse).isNotNull(), F.concat(F.col(cpse), F.lit("|"), c))

    ok = pairs.filter(F.lower(F.trim(F.col("reason"))).startswith("match")).select(key("a_cpse", "a_code").alias("x"), key("b_cpse", "b_code").alias("y"))
    ok = ok.filter("x is not null and y is not null and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    # most listings of a large catalogue are in no pair: the catalogue is deduplicated, then probed once for each side
    known = materials.select(key("cpse", "material_code").alias("k")).filter("k is not null").distinct()
    return ok.join(known, F.col("a") == F.col("k"), "left_semi").join(known, F.col("b") == F.col("k"), "left_semi")


def listing_groups(pairs: DataFrame, materials: DataFrame) -> DataFrame:
    g = consolidate(accepted_pairs(pairs, materials), "a", "b")
    parts = F.split("node", r"\|", 2)
    return g.select(parts[0].alias("cpse"), parts[1].alias("material_code"), "group_id")
