"""The chained run over enriched records: block, candidates, verdicts, groups with repair.

Equal texts are read alike, so each is compared once: `rep` is the least rec_id of a text, `times` its records.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import harmonise as h
from weftline.functions.dialect import SPARK
from weftline.functions.rules import FLOOR, GOOD_SCORE, GOOD_SIM, HIGH_SIM, IDENTITY, LABELS, REPAIR_ROUNDS, SHARED_SIM, WEIGHT_ATTR, WEIGHT_SIM, WEIGHT_TEXT
from weftline.operators import enrich as en
from weftline.operators import graph
from weftline.operators import matching as mt
from weftline.operators import registry
from weftline.operators.similarity import _dense, _rounded, _weights, by_token, compared, frequencies, grams, indel_ratios, near, read_tile, text_weights
from weftline.session import Store

#: Texts of a block that are compared at once.
TILE = 1024
#: Texts of a block that are sent once for each as many others of it; two groups of them are judged in one task.
GROUP = 65536
#: Records of a block up to which one task groups the whole of it.
WHOLE = 8192
_SAID = [f"a_{k}" for k in en.KEYS]


def representatives(rows: DataFrame) -> DataFrame:
    """(rep, times, t, fine, category, complete, a_*) of each text."""
    same = ["fine", "category", "complete", *(f"a_{k}" for k in en.KEYS)]
    return rows.groupBy("t").agg(F.min("rec_id").alias("rep"), F.count("*").alias("times"), *(F.first(c).alias(c) for c in same))


def identity_block():
    """Only complete records of one type match, and but for sizes their identity attributes are equal: a block that loses no match."""
    block = F.lit(None).cast("string")
    for kind, keys in IDENTITY.items():
        block = F.when(F.col("fine") == kind, F.concat_ws("|", "fine", *(f"a_{k}" for k in keys if k != "inch"))).otherwise(block)
    return F.when(F.col("complete"), block)


def vectors(reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, grams, ws): TF-IDF of the wanted texts, its idf over all records."""
    word = F.filter(F.split(F.trim(F.regexp_replace(F.lower("t"), r"\s+", " ")), " "), lambda w: w != "")
    padded = F.transform(word, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of = lambda w: F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.length(w))), lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))))
    # counted without a shuffle of every text's grams
    df = reps.select("times", F.explode(F.array_distinct(F.flatten(F.transform(padded, of)))).alias("gram")).groupBy("gram").agg(F.sum("times").alias("df"))
    total = reps.agg(F.sum("times").alias("total"))
    w = grams(wanted, "rep", "t").join(df, "gram").crossJoin(total)  # total has one row
    w = w.select("rep", "gram", ((1 + F.log("n")) * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)).alias("w"))
    return w.groupBy("rep").agg(F.collect_list("gram").alias("grams"), F.collect_list("w").alias("ws"))


def _tile(floor: float):
    def matrix(part: pd.DataFrame, at: dict) -> np.ndarray:
        m = np.zeros((len(part), len(at)), dtype=np.float64)
        for i, (g, w) in enumerate(zip(part["grams"], part["ws"])):
            w = np.asarray(w, dtype=np.float64)
            m[i, [at[x] for x in g]] = w / np.sqrt((w * w).sum())
        return m

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        at: dict = {}
        for g in pdf["grams"]:
            for x in g:
                at.setdefault(x, len(at))
        x = pdf[pdf["chunk"] == low]
        y = x if low == high else pdf[pdf["chunk"] == high]
        p, q = x["rep"].to_numpy(), y["rep"].to_numpy()
        s = matrix(x, at) @ matrix(y, at).T
        i, j = np.nonzero(s >= floor)
        keep = p[i] < q[j] if low == high else np.ones(len(i), dtype=bool)
        i, j = i[keep], j[keep]
        return pd.DataFrame({"p": np.minimum(p[i], q[j]), "q": np.maximum(p[i], q[j]), "sim": s[i, j]})

    return run


def candidates(reps: DataFrame, block: str, store: Store, floor: float = FLOOR) -> DataFrame:
    """(p, q, sim), p <= q: the pairs of each block's texts from the floor on, and each repeated text with itself."""
    wanted = reps.filter(F.col(block).isNotNull() & (F.trim("t") != ""))
    v = store.keep(vectors(reps, wanted).join(wanted.select("rep", F.col(block).alias("block")), "rep"))
    tiles = v.groupBy("block").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    v = v.join(tiles, "block").withColumn("chunk", F.pmod(F.xxhash64("rep"), "tiles"))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    v = v.select("block", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "rep", "grams", "ws")
    got = v.groupBy("block", "low", "high").applyInPandas(_tile(floor), "p long, q long, sim double")
    return got.unionByName(wanted.filter("times > 1").select(F.col("rep").alias("p"), F.col("rep").alias("q"), F.lit(1.0).alias("sim")))


def both_sides(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs p, q with both texts' readings, as `matching` names them."""
    for end, s in (("p", "x"), ("q", "y")):
        names = {"t": f"{s}t", "fine": f"{s}f", "category": f"{s}c", "times": f"{s}n", **{f"a_{k}": f"{s}_{k}" for k in en.KEYS}}
        pairs = pairs.join(reps.select(F.col("rep").alias(end), *(F.col(c).alias(n) for c, n in names.items())), end)
    return pairs


def verdicts(reps: DataFrame, block: str, store: Store, matches_only: bool = False) -> DataFrame:
    """(p, q, pairs, verdict, reason, confidence) of all candidates; `pairs` is how many pairs of records share the verdict."""
    if not matches_only:
        return judged(reps, block)
    # written before it is filtered: the planner can't cope with so long a condition over renamed columns
    df = store.keep(both_sides(candidates(reps, block, store), reps))
    df = store.keep(df.filter(F.expr(mt.conflicts(SPARK)) == ""))  # what is vetoed needs no score
    many = F.when(F.col("p") == F.col("q"), (F.col("xn") * (F.col("xn") - 1) / 2).cast("long")).otherwise(F.col("xn") * F.col("yn"))
    df = mt.verdicts(df.withColumn("pair_id", F.struct("p", "q", many.alias("pairs"))))
    return df.select("pair_id.*", "verdict", "reason", "confidence")


class _Sides:
    """What some texts say, in numbers, ready to be judged as `matching.verdicts` does."""

    NAMES = sorted([*en.KEYS, "type", "category"])

    def __init__(self, t: pa.Table):
        self.codes: dict[str, np.ndarray] = {}
        for name in self.NAMES:
            c = t["fine" if name == "type" else name if name == "category" else f"a_{name}"].to_pylist()
            places = {v: n for n, v in enumerate(dict.fromkeys(v for v in c if v is not None and not (name == "type" and v == "unknown")))}
            if places:
                self.codes[name] = np.array([places.get(v, -1) for v in c], dtype=np.int32)
            if name == "inch":
                self.sizes, self.fit = [frozenset(v.split(",")) for v in places], {}
        self.orders = [by_token(x) for x in t["t"].to_pylist()]
        self.complete = t["complete"].to_numpy(zero_copy_only=False).astype(bool)

    def _apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Do sizes contradict?  Of two one may hold the other."""
        pair, at = np.unique(x.astype(np.int64) * len(self.sizes) + y, return_inverse=True)
        out = []
        for k in pair.tolist():
            if k not in self.fit:
                a, b = self.sizes[k // len(self.sizes)], self.sizes[k % len(self.sizes)]
                self.fit[k] = not (a <= b or b <= a)
            out.append(self.fit[k])
        return np.array(out, dtype=bool)[at]

    def judge(self, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(verdict, reason, confidence) of the pairs i[k], j[k] of similarity s[k]."""
        differ, shared, known = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int16), np.zeros(len(i), dtype=np.int16)
        for name, codes in self.codes.items():
            x, y = codes[i], codes[j]
            both = (x >= 0) & (y >= 0)
            apart = both & (x != y)
            if name == "inch" and apart.any():
                k = np.flatnonzero(apart)
                apart[k] = self._apart(x[k], y[k])
            differ |= apart.astype(np.int64) << self.NAMES.index(name)
            if name not in ("type", "category"):
                shared += both
                known += (x >= 0) | (y >= 0)
        veto = differ > 0
        scored = np.flatnonzero(~veto & self.complete[i] & self.complete[j])
        score = np.zeros(len(i))
        texts, at = np.unique(np.concatenate([i[scored], j[scored]]), return_inverse=True)
        ratio = indel_ratios([self.orders[n] for n in texts], at[: len(scored)], at[len(scored) :]) if len(scored) else np.empty(0)
        score[scored] = WEIGHT_SIM * s[scored] + WEIGHT_ATTR * (shared[scored] / np.maximum(known[scored], 1)) + WEIGHT_TEXT * ratio / 100
        # a reason's number: 0 review, 1 to 3 ways to match, else no match by its score, or a veto by what differs
        shown = _rounded(score[scored], 2)
        high, good = s[scored] >= HIGH_SIM, (score[scored] >= GOOD_SCORE) & (s[scored] >= GOOD_SIM)
        way = np.select([high, good, (s[scored] >= SHARED_SIM) & (shared[scored] > 0)], [1, 2, 3], 4 + np.rint(shown * 100).astype(np.int64))
        number = np.zeros(len(i), dtype=np.int64)
        number[scored] = way
        number[veto] = -differ[veto]
        each, at = np.unique(number, return_inverse=True)
        reasons = [self._reason(n) for n in each.tolist()]
        sure = s.copy()
        sure[scored] = score[scored]
        return pa.array([r.split(":")[0] for r in reasons]).take(pa.array(at)), pa.array(reasons).take(pa.array(at)), _rounded(sure)

    def _reason(self, n: int) -> str:
        if n < 0:
            return "veto:" + ",".join(name for k, name in enumerate(self.NAMES) if -n >> k & 1)
        return ("review:insufficient-attributes", "match:high-sim", "match", "match:sim+attr")[n] if n < 4 else f"no-match:score={(n - 4) / 100:.2f}"


def _judged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, q, pairs, verdict, reason, confidence) of two groups of texts, or of one, some pairs at a time."""
    tile, x, y = read_tile(key, batches)
    t = tile.slice(0, len(tile) - tile["id"].null_count)
    if not len(t):
        return
    weights = text_weights(t, tile)
    said, rep, times = _Sides(t), t["id"].to_numpy(), t["times"].to_numpy()

    def batch(i, j, s, pairs):
        verdict, reason, sure = said.judge(i, j, s)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j])), pa.array(pairs), verdict, reason, pa.array(sure)], ["p", "q", "pairs", "verdict", "reason", "confidence"])

    if y is None:  # each repeated text with itself
        i = np.flatnonzero(times > 1)
        if len(i):
            yield batch(i, i, np.ones(len(i)), times[i] * (times[i] - 1) // 2)
    for i, j, s in near(weights, x, y, FLOOR):
        yield batch(i, j, s, times[i] * times[j])


def judged(reps: DataFrame, block: str) -> DataFrame:
    """`verdicts` of a block's texts, judged where they are compared: no candidate is written or sent, only the texts are."""
    rows = reps.filter(F.col(block).isNotNull() & (F.trim("t") != "")).select(F.col(block).alias("block"), F.col("rep").alias("id"), "t", "times", "complete", "fine", "category", *_SAID)
    total = reps.agg(F.sum("times").alias("total"))
    return compared(rows, frequencies(reps, "times"), total, GROUP).applyInArrow(_judged, "p long, q long, pairs long, verdict string, reason string, confidence double")


def contradicted(held: DataFrame) -> DataFrame:
    """(label) of the groups (label, fine, category, a_*) that hold a contradiction of `matching.conflicts`, found without listing pairs.

    Two members differ in an attribute if its least and its greatest value do; of sizes one's may hold the other's.
    """
    named = F.when(F.col("fine") != "unknown", F.col("fine"))
    two = [F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in (named, F.col("category"), *(F.col(f"a_{k}") for k in en.KEYS if k != "inch"))]
    g = held.groupBy("label").agg(reduce(lambda x, y: x | y, two).alias("differ"), F.collect_set("a_inch").alias("sizes"))
    beyond = lambda x, y: F.size(F.array_except(F.split(x, ","), F.split(y, ","))) > 0
    apart = F.exists("sizes", lambda x: F.exists("sizes", lambda y: beyond(x, y) & beyond(y, x)))
    return g.filter(F.col("differ") | apart).select("label")


def _contradict(said: list[dict]) -> bool:
    """`contradicted` for the values of one group's members."""
    for k in said[0]:
        values = {x[k] for x in said if x[k] is not None and not (k == "fine" and x[k] == "unknown")}
        if k != "a_inch" and len(values) > 1:
            return True
        if k == "a_inch" and len(values) > 1:
            sizes = [frozenset(v.split(",")) for v in values]
            if any(not (x <= y or y <= x) for x in sizes for y in sizes):
                return True
    return False


def _split(said: dict, edges: list[tuple]) -> dict:
    """{node: label} of one group after `graph.repair`'s rounds; said: what each node's text says, edges: (confidence, edge_id, a, b)."""
    settled, open_ = [], [(list(said), sorted(edges))]
    for _ in range(REPAIR_ROUNDS):
        now = []
        for nodes, es in open_:
            if not _contradict([said[n] for n in nodes]):
                settled.append(nodes)
                continue
            up, left = {n: n for n in nodes}, len(nodes)

            def find(x):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for _, _, x, y in es[1:]:
                p, q = find(x), find(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    left -= 1
                    if left == 1:
                        break
            if left == 1:
                now.append((nodes, es[1:]))
                continue
            parts: dict = {}
            for n in nodes:
                parts.setdefault(find(n), ([], []))[0].append(n)
            for e in es[1:]:
                parts[find(e[2])][1].append(e)
            now += parts.values()
        open_ = now
    return {n: min(nodes) for nodes in (*settled, *(nodes for nodes, _ in open_)) for n in nodes}


def _mend(members: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """(node, label) of one contradictory group, split."""
    columns = [c for c in members.columns if c not in ("node", "label")]
    said = {n: dict(zip(columns, (None if pd.isna(v) else v for v in values))) for n, *values in members[["node", *columns]].itertuples(index=False)}
    rows = _split(said, list(edges[["confidence", "edge_id", "a", "b"]].itertuples(index=False, name=None)))
    return pd.DataFrame(rows.items(), columns=["node", "label"])


def repaired(labels: DataFrame, links: DataFrame, reps: DataFrame, store: Store) -> DataFrame:
    """(node, label): groups joined by links (a, b, confidence, edge_id), the weakest links of contradictory ones left out as by `graph.repair`.

    Only contradictory groups are worked on, each whole in one task, all rounds at once.
    """
    held = store.keep(labels.join(reps.select(F.col("rep").alias("node"), "fine", "category", *(f"a_{k}" for k in en.KEYS)), "node"))
    bad = store.keep(contradicted(held))
    inside = links.join(labels.select(F.col("node").alias("a"), "label"), "a").join(bad, "label", "left_semi").select("label", "a", "b", "confidence", "edge_id")
    mended = held.join(bad, "label", "left_semi").groupBy("label").cogroup(inside.groupBy("label")).applyInPandas(_mend, "node long, label long")
    return labels.join(bad, "label", "left_anti").select("node", "label").unionByName(mended)


class _Read:
    """The attributes (in the order of KEYS) of some texts, ready to be compared with each other."""

    def __init__(self, said: list[tuple]):
        self.codes: dict[str, np.ndarray] = {}
        self.fits = None
        for k, values in zip(en.KEYS, zip(*said)):
            places: dict = {v: n for n, v in enumerate(dict.fromkeys(v for v in values if v is not None))}
            if places:
                self.codes[k] = np.array([-1 if v is None else places[v] for v in values])
                if k == "inch":
                    sizes = [frozenset(v.split(",")) for v in places]
                    self.fits = np.array([[x <= y or y <= x for y in sizes] for x in sizes])

    def compared(self, i, j) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without contradiction, attributes both have, attributes either has; i and j as numpy broadcasts them."""
        shape = np.broadcast_shapes(np.shape(i), np.shape(j))
        fit, shared, known = np.ones(shape, dtype=bool), np.zeros(shape, dtype=np.int16), np.zeros(shape, dtype=np.int16)
        for k, codes in self.codes.items():
            x, y = codes[i], codes[j]
            both = (x >= 0) & (y >= 0)
            fit &= ~both | (self.fits[x, y] if k == "inch" else x == y)
            shared += both
            known += (x >= 0) | (y >= 0)
        return fit, shared, known


def _matches(texts: list[str], said: list[tuple], df: dict[str, int], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score), i < j: the complete texts of one type that match by `matching.verdicts`."""
    rows, width = _weights(texts, df, total)
    read, orders = _Read(said), [by_token(t) for t in texts]
    got = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    for low in range(0, len(texts), TILE // 4):
        x = np.arange(low, min(low + TILE // 4, len(texts)))
        left = _dense([rows[n] for n in x], width)
        for first in range(low, len(texts), TILE):
            y = np.arange(first, min(first + TILE, len(texts)))
            fit = read.compared(x[:, None], y[None, :])[0] & (x[:, None] < y[None, :])
            y, fit = y[fit.any(0)], fit[:, fit.any(0)]
            if not len(y):
                continue
            s = left @ _dense([rows[n] for n in y], width).T
            # every way to match asks for as much
            i, j = np.nonzero(fit & (s >= max(FLOOR, min(GOOD_SIM, HIGH_SIM, SHARED_SIM))))
            s, i, j = s[i, j], x[i], y[j]
            _, shared, known = read.compared(i, j)
            score = WEIGHT_SIM * s + WEIGHT_ATTR * np.where(known == 0, 0.0, shared / np.maximum(known, 1))
            sure = (s >= HIGH_SIM) | ((s >= SHARED_SIM) & (shared > 0))
            able = sure | (score + WEIGHT_TEXT * 1.001 >= GOOD_SCORE)
            i, j, s, score, sure = i[able], j[able], s[able], score[able], sure[able]
            score = score + WEIGHT_TEXT * indel_ratios(orders, i, j) / 100
            ok = sure | ((score >= GOOD_SCORE) & (s >= GOOD_SIM))
            got.append((i[ok], j[ok], score[ok]))
    return tuple(np.concatenate(c) for c in zip(*got))


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _grouped(key: tuple, records: pa.Table, counted: pa.Table) -> pa.Table:
    """(rec_id, cluster, confidence) of one whole block: matches, groups and their repair."""
    ids, texts = records["rec_id"].to_pylist(), records["t"].to_pylist()
    rep_of, times, values = {}, Counter(texts), {}
    for r, t, v in zip(ids, texts, records["said"].to_pylist()):
        rep_of[t] = min(r, rep_of.get(t, r))
        values[t] = tuple(v)
    each = sorted(rep_of, key=lambda t: (tuple(v or "" for v in values[t]), rep_of[t]))  # like attributes together
    df = dict(zip(counted["gram"].to_pylist(), counted["df"].to_pylist()))
    total = counted["total"][0].as_py() if len(counted) else 0
    i, j, score = _matches(each, [values[t] for t in each], df, total)
    # from here on nodes are in the order of rep
    rep = np.array([rep_of[t] for t in each], dtype=np.int64)
    order = np.argsort(rep)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    rep, each, i, j, sure = rep[order], [each[n] for n in order], place[i], place[j], _rounded(score)
    i, j = np.minimum(i, j), np.maximum(i, j)
    label = _joined(len(rep), i, j)
    groups: dict[int, list[int]] = {}
    for n, g in enumerate(label.tolist()):
        groups.setdefault(g, []).append(n)
    for g, members in groups.items():
        said = {n: values[each[n]] for n in members}
        if len(differ := set(said.values())) > 1 and _contradict([dict(zip(_SAID, v)) for v in differ]):
            edges = [(c, f"{rep[a]}|{rep[b]}", a, b) for c, a, b in zip(*(x[label[i] == g].tolist() for x in (sure, i, j)))]
            for n, least in _split({n: dict(zip(_SAID, v)) for n, v in said.items()}, edges).items():
                label[n] = least
    weakest = np.full(len(rep), np.inf)
    kept = label[i] == label[j]
    np.minimum.at(weakest, label[i[kept]], sure[kept])
    np.minimum.at(weakest, label[[times[t] > 1 for t in each]], 1.0)  # a repeated text matches itself
    of = {t: label[n] for n, t in enumerate(each)}
    at = np.array([of[t] for t in texts], dtype=np.int64)
    return pa.table({"rec_id": pa.array(ids, pa.int64()), "cluster": pa.array(rep[at]), "confidence": pa.array(weakest[at], mask=weakest[at] == np.inf)})


def clusters(rows: DataFrame, store: Store) -> DataFrame:
    """(rec_id, cluster, confidence): matches joined into groups, the weakest links of contradictory ones left out.

    `cluster` is the least rec_id; confidence is the weakest accepted link, null for a record alone.  Records whose
    text is incomplete are never merged, however alike.  A match stays within its block, and so does all that follows
    from it: each block is grouped in one task, but those of more than WHOLE records in tiles of many tasks.
    """
    rec = store.keep(rows.filter("complete").withColumn("block", identity_block()).select("block", "rec_id", "t", *_SAID))
    hot = store.keep(rec.groupBy("block").count().filter(F.col("count") > WHOLE).select("block"))
    some = not hot.isEmpty()
    small = rec.join(hot, "block", "left_anti") if some else rec
    word = small.select(F.col("block").alias("of"), F.explode(F.array_distinct(F.split("t", " "))).alias("w")).filter("w <> ''").distinct().withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    gram = F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.length("w"))), lambda n: F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring("w", i, n))))
    total = rows.agg(F.count("*").alias("total"))
    counted = word.select("of", F.explode(gram).alias("gram")).distinct().join(frequencies(rows), "gram").crossJoin(F.broadcast(total))  # one row
    read = small.select("block", "rec_id", "t", F.array(*_SAID).alias("said"))
    got = read.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(_grouped, "rec_id long, cluster long, confidence double")
    if some:
        got = got.unionByName(_hot_clusters(rows, rec.join(hot, "block", "left_semi"), store))
    return got.unionByName(rows.filter("not complete").select("rec_id", F.col("rec_id").alias("cluster"), F.lit(None).cast("double").alias("confidence")))


def _hot_clusters(rows: DataFrame, hot: DataFrame, store: Store) -> DataFrame:
    """(rec_id, cluster, confidence) of the records of large blocks, compared in tiles of many tasks; idf over all rows."""
    blocks = hot.select("t", "block").distinct()
    reps = store.keep(representatives(rows).join(blocks, "t", "left"))
    match = verdicts(reps, "block", store, True).filter("verdict = 'match'")
    match = store.keep(match.select(F.col("p").alias("a"), F.col("q").alias("b"), "confidence", F.concat_ws("|", "p", "q").alias("edge_id")))
    links = match.filter("a < b")
    first = graph.components(links.select("a", "b"), store)
    labels = store.keep(repaired(first, links, reps, store))
    whole = reps.filter("block is not null").select("t", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("t", "rep", F.coalesce("label", "rep").alias("cluster"))
    ends = match.join(whole.select(F.col("rep").alias("a"), "cluster"), "a").join(whole.select(F.col("rep").alias("b"), F.col("cluster").alias("other")), "b")
    weakest = ends.filter("cluster = other").groupBy("cluster").agg(F.min("confidence").alias("confidence"))
    return hot.select("rec_id", "t").join(whole.select("t", "cluster"), "t").join(weakest, "cluster", "left").select("rec_id", "cluster", "confidence")


@F.udf(T.ArrayType(T.StringType()))
def _issued(nmc: str, canons: list[str]) -> list[str]:
    """A code for each of the groups that would share it: the first keeps it, the others extend it until it is free."""
    taken, n = [nmc], 0
    while len(taken) < len(canons):
        n += 1
        more = hashlib.sha1(f"{n}|{canons[len(taken)]}".encode()).hexdigest()[: 2 if n < 1000 else 8].upper()
        if nmc + more not in taken:
            taken.append(nmc + more)
    return taken


#: A record's own standards as merged ones are written.
_STD = "array_join(array_sort(array_distinct(split(a_std, ','))), ',')"


def masters(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row for each cluster of `clusters`: its merged attributes in the canonical form, code, holders, prices and status.

    Records alone whose forms are equal but for `std` can't be told apart: they get provisional codes.
    An incomplete record is always a cluster of its own: what is said of it needs no join.
    """
    e = rows.filter("complete").join(grouped, "rec_id")
    kept = registry.merged_values(e, "cluster", en.KEYS, "rec_id", ("std",))
    attrs = kept.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m"))
    unit = registry.majority(e, ["cluster"], "unit", "rec_id").select("cluster", F.col("value").alias("unit"))
    m = e.groupBy("cluster").agg(
        F.min_by("fine", "rec_id").alias("fine"), F.min_by("category", "rec_id").alias("category"), F.count("*").alias("members"), F.count_distinct("org").alias("n_orgs"),
        F.array_join(F.array_sort(F.collect_set("org")), ",").alias("orgs"), F.round(F.avg("price"), 6).alias("avg_price"), F.min("price").alias("low"), F.max("price").alias("high"),
        F.bool_and("complete").alias("settled"), F.first("confidence").alias("confidence"), F.min_by(F.concat("org", F.lit("-"), "code"), "rec_id").alias("listing"))
    m = m.join(attrs, "cluster", "left").join(unit, "cluster", "left").select("*", *(F.col("m")[k].alias(f"a_{k}") for k in en.KEYS)).drop("m")
    m = m.withColumn("canon", F.expr(h.canonical(SPARK, "fine", "unit", en.col())))
    own = {"members": F.lit(1).cast("long"), "n_orgs": F.when(F.col("org").isNull(), 0).otherwise(1).cast("long"), "orgs": F.coalesce("org", F.lit("")), "avg_price": F.round("price", 6), "low": F.col("price"), "high": F.col("price"), "settled": F.lit(False), "confidence": F.lit(None).cast("double"), "listing": F.concat("org", F.lit("-"), "code"), "a_std": F.expr(_STD)}
    m = m.unionByName(rows.filter("not complete").select(F.col("rec_id").alias("cluster"), "fine", "category", *(c.alias(n) for n, c in own.items()), "unit", *(k for k in _SAID if k != "a_std"), "canon"))
    # std is the last part of the canonical form
    form = f"CASE WHEN a_std IS NULL THEN canon ELSE left(canon, length(canon) - length('|{LABELS['std']}=' || {h.shown(SPARK, 'std', 'a_std')})) END"
    m = m.withColumns({"form": F.concat_ws("|", F.expr(form), "a_coil"), "nmc": F.expr(h.code(SPARK, "canon")), "standard": F.expr(h.description(SPARK, "fine", "unit", en.col()))}).drop(*_SAID)
    m = Store(rows.sparkSession).keep(m)
    alone = m.filter("members = 1").groupBy("form").agg(F.count("*").alias("twins")).filter("twins > 1")
    # told apart on few columns
    said = m.select("cluster", "members", "form", "nmc", "canon").join(alone, "form", "left").withColumn("twin", (F.col("members") == 1) & F.col("twins").isNotNull())
    issued = said.filter("not twin").groupBy("nmc").agg(F.array_sort(F.collect_list(F.struct((F.col("members") == 1).alias("single"), "cluster", "canon"))).alias("g"))
    # groups of several come before records alone
    codes = F.when(F.size("g") == 1, F.array("nmc")).otherwise(_issued("nmc", F.col("g.canon")))
    issued = issued.select(F.explode(F.arrays_zip(F.col("g.cluster").alias("cluster"), codes.alias("code")))).select("col.cluster", "col.code")
    m = m.join(issued, "cluster", "left")
    twin = F.col("code").isNull()  # all others have a code
    given = F.concat(F.lit("PROVISIONAL-"), F.substring(F.regexp_replace(F.upper("fine"), " ", "-"), 1, 14), F.lit("-"), "listing")
    status = F.when(twin, "PROVISIONAL").when(~F.col("settled"), "NEEDS_REVIEW").when(F.col("members") > 1, "AUTO_MATCHED").otherwise("UNIQUE")
    sure = F.when(F.col("members") == 1, F.when(twin, 0.5).otherwise(1.0)).otherwise(F.coalesce("confidence", F.lit(0.5)))
    return m.select("cluster", F.coalesce("code", given).alias("nmc"), "canon", "standard", "category", "fine", "unit", "members", "n_orgs", "orgs", "avg_price", "low", "high", sure.alias("confidence"), status.alias("status"))


def merged(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """(g, attrs) of each cluster of `clusters` that has attributes: their majority, and all standards; of an incomplete record its own."""
    e = rows.filter("complete").join(grouped, "rec_id").withColumn("g", F.col("cluster").cast("string"))
    several = registry.merge_attributes(e, "g", en.KEYS, "rec_id", ("std",))
    own = F.expr(h.pairs_text(SPARK, {k: _STD if k == "std" else f"a_{k}" for k in en.KEYS}))
    return several.unionByName(rows.filter("not complete").select(F.col("rec_id").cast("string").alias("g"), own.alias("attrs")).filter("attrs <> ''"))
