import itertools
import math
import random

import pytest

import __spark_entry__ as entry
from weftline.operators import enrich, graph, matching, similarity
from weftline.session import Store

NORMAL = {
    "Hex Bolt – M16 X 60 – Gr.8.8 – Zn": "hex bolt m16x60 grade 8.8 zinc plated",
    "GATE VALVE 2\" CL 150 C.S. FLG": "gate valve 2 inch class 150 caststeel. flanged",
    "3Cx2.5 SQMM PVC": "3c x 2.5 sqmm sqmm pvc",  # both cable rules apply, one after the other
    "black oxide": "black oxide oxide",
    "1/2\" elbow": "1/2 inch elbow",
    "grade 8.8": "grade 8.8",
}


@pytest.mark.parametrize("raw", NORMAL)
def test_normal_text(spark, raw):
    df = enrich.typed(spark.createDataFrame([(raw,)], "description string"), "description")
    assert df.first().t == NORMAL[raw]


def test_attributes_and_identity(spark):
    rows = [(1, 1, "IOCL", "a1", "GATE VALVE 2\" CL 150 CAST STEEL FLANGED", "Nos.", None, None, "1,250.50"), (2, 1, "IOCL", "a2", "deep groove ball bearing 6205 2rs", "EA", None, None, "N/A"), (3, 1, "IOCL", "", "x", "", None, None, None), (4, 1, "IOCL", "a4", None, "", None, None, None)]
    m = spark.createDataFrame(rows, "rec_id long, file_id long, cpse string, material_code string, description string, uom string, category_hint string, hsn_code string, last_rate_inr string")
    got = {r.rec_id: r for r in enrich.enrich(m).collect()}
    assert set(got) == {1, 2}
    v, b = got[1], got[2]
    assert (v.fine, v.category, v.a_inch, v.a_class, v.a_material, v.a_end, v.unit, v.price, v.complete) == ("gate valve", "valve", "2.0", "150", "caststeel", "FLG", "NOS", 1250.5, True)
    assert (b.fine, b.a_designation, b.a_seal, b.price, b.complete) == ("ball bearing", "6205", "2rs", None, True)
    assert v.canon == "VLV-GATE|NOS|SIZE=2.0IN|MAT=CAST STEEL|CLS=150|END=FLG" and v.nmc.startswith("NMC-VLV-GATE-")


def test_indel_ratio_against_brute_force():
    def lcs(a, b):
        last = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(last[j] + 1 if x == y else max(last[j + 1], now[-1]))
            last = now
        return last[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(90))) for _ in range(2))
        want = 100.0 if not a and not b else 200 * lcs(a, b) / (len(a) + len(b))
        assert similarity.indel_ratio(a, b) == pytest.approx(want if a and b or not (a or b) else 0.0)


def test_verdicts(spark):
    rows = [
        (1, 'gate valve 2" cl 150 ss316', 'gate valve 2" cl 300 ss316', 0.99),
        (2, "gate valve cl 150", 'gate valve 2" cl 150 ss316', 0.99),
        (3, 'gate valve 2" cl 150 ss316', 'valve gate valve 2" class 150 ss 316', 0.90),
        (4, 'gate valve 2" cl 150 ss316', None, None),
    ]
    p = spark.createDataFrame(rows, "pair_id long, a_desc string, b_desc string, sim double")
    got = {r.pair_id: r.reason for r in matching.verdicts(matching.sides(p)).collect()}
    assert got == {1: "veto:class", 2: "review:insufficient-attributes", 3: "match:high-sim", 4: "veto:category"}


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def test_components_and_repair(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(22)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a string, b string"), Store(spark)).collect()}
    assert got == union_find(edges)
    chain = [("a", "b", 0.9, 1), ("b", "c", 0.6, 2), ("c", "d", 0.9, 3)]
    got = graph.repair(spark.createDataFrame(chain, "a string, b string, confidence double, edge_id long"), spark.createDataFrame([("a", "d")], "a string, b string"), Store(spark))
    assert {r.node: r.label for r in got.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_tfidf_has_unit_length_and_cosine(spark):
    df = spark.createDataFrame([(1, "hex bolt", "k"), (2, "hex bolt", "k"), (3, "gear oil", "k"), (4, None, "k"), (5, "", "k")], "id long, t string, block string")
    w = similarity.tfidf(df, "id", "t")
    sums = {r.id: r.s for r in w.groupBy("id").agg({"w": "sum"}).withColumnRenamed("sum(w)", "s").collect()}
    assert set(sums) == {1, 2, 3}
    pairs = {(r.a, r.b): r.sim for r in similarity.cosine_pairs(w, df, "id", "block", 0.4).collect()}
    assert list(pairs) == [(1, 2)] and pairs[1, 2] == pytest.approx(1.0)


def test_tfidf_reads_each_text_once(spark, monkeypatch):
    """A thousand keys of two texts: two texts are cut up; a key of two rows counts as one text, and one without weight in the sums is left out."""
    read, grams = [], similarity.grams
    monkeypatch.setattr(similarity, "grams", lambda df, *a: (read.append(df.count()), grams(df, *a))[1])
    rows = [(i, "hex bolt" if i % 2 else "gear oil") for i in range(1000)]
    w = similarity.tfidf(spark.createDataFrame([*rows, (1000, "hex bolt"), (1000, "nut")], "id long, t string"), "id", "t").collect()
    assert read == [3]
    assert len({r.id for r in w}) == 1001 and sum(r.w**2 for r in w) == pytest.approx(1001)
    one = {r.gram: r.w for r in w if r.id == 1000}
    assert one[" nu"] / one["hex"] == pytest.approx((math.log(1003 / 2) + 1) / (math.log(1003 / 502) + 1))


def test_every_name_has_a_callable_and_sql_names_exist():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["nmc", "codes", "n_orgs"]


def test_profile_and_guard(spark, folder):
    from weftline.sources.sinks import guard

    got = guard(spark.createDataFrame([("=1+1", 5), ("ok", -5), (None, 0)], "s string, n int")).collect()
    assert [(r.s, r.n) for r in got] == [("'=1+1", 5), ("ok", -5), (None, 0)]
    q = entry.queries()
    for name in itertools.islice(("preflight_verdict", "upload_validation"), 2):
        assert q[name](spark, folder).count() > 0
