"""Connected components and the repair of components that hold contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.rules import REPAIR_ROUNDS
from weftline.session import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, label): each node's least reachable node, by least labels and shortcuts until nothing changes."""
    both = store.keep(edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))).filter("u <> v").distinct())
    labels = store.keep(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("low"))
        hop = labels.select(F.col("node").alias("h"), F.col("label").alias("far"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "low").alias("low"))
        new = lower.join(hop, F.col("low") == F.col("h"), "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), "label")
        new = store.keep(new)
        changed = not new.filter("new <> label").isEmpty()
        store.drop(labels)
        labels = new.select("node", F.col("new").alias("label"))
        labels._weftline_path = new._weftline_path
        if not changed:
            return labels


def repair(edges: DataFrame, vetoes: DataFrame, store: Store, rounds: int = REPAIR_ROUNDS) -> DataFrame:
    """(node, label) after the weakest edge of each contradictory component is left out, round by round.

    edges: a, b, confidence, edge_id; vetoes: a, b that must not share a component.  Only the
    contradictory components are worked on again.
    """
    labels = components(edges.select("a", "b"), store)
    settled = None
    now = edges
    for _ in range(rounds):
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("p")), labels.select(F.col("node").alias("b"), F.col("label").alias("q"))
        bad = store.keep(vetoes.join(la, "a").join(lb, "b").filter("p = q").select(F.col("p").alias("label")).distinct())
        good = labels.join(bad, "label", "left_anti").select("node", "label")
        settled = good if settled is None else settled.unionByName(good)
        if bad.isEmpty():
            return settled
        inside = now.join(la, "a").join(bad.withColumnRenamed("label", "p"), "p", "left_semi")
        weakest = inside.groupBy("p").agg(F.min_by("edge_id", F.struct("confidence", "edge_id")).alias("edge_id"))
        now = store.keep(inside.join(weakest.select("edge_id"), "edge_id", "left_anti").select(*edges.columns))
        nodes = labels.join(bad, "label", "left_semi").select("node")
        again = components(now.select("a", "b"), store)
        # a node without edges left is alone
        labels = store.keep(nodes.join(again, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    return settled.unionByName(labels)
