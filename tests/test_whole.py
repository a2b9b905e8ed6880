"""Queries do the whole job: against SQL of the tests' own, without the cuts that the code once had."""

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import match_queries as mq


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for name in ("part", "embeddings"):
        c.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return c


def rows(spark, folder, name):
    return sorted(tuple(r) for r in entry.queries()[name](spark, folder).collect())


def test_tfidf_pairs_of_the_whole_category(spark, folder, con):
    want = con.execute("WITH " + mq._GRAMS + """, b AS (SELECT p_partkey, p_brand || '/' || p_type AS k FROM part)
    SELECT x.p_partkey AS a, y.p_partkey AS b, round(sum(x.w * y.w), 4) AS sim FROM v x JOIN b bx USING (p_partkey) JOIN b byy ON byy.k = bx.k AND byy.p_partkey > bx.p_partkey
    JOIN v y ON y.p_partkey = byy.p_partkey AND y.gram = x.gram GROUP BY ALL HAVING sum(x.w * y.w) >= 0.4""").fetchall()
    sizes = dict(con.execute("SELECT p_partkey, p_size FROM part").fetchall())
    assert any(sizes[a] % 10 != sizes[b] % 10 for a, b, _ in want)
    assert rows(spark, folder, "tfidf_cosine_pairs") == sorted(want)


def test_blocks_are_counted_from_their_sizes(spark, tmp_path):
    """A block of 200,000 parts has 2e10 pairs: only what is counted without listing them ends. Null brands are a block as in SQL."""
    c = duckdb.connect()
    c.execute(f"copy (select range as p_partkey, 'hot bolt' as p_name, CASE WHEN range % 1000 > 0 THEN 'B' || (range % 1000 // 998) END as p_brand, 'T' as p_type from range(200000)) to '{tmp_path}/part.parquet'")
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = c.execute(mq.ORACLE["block_pairs"]).fetchall()
    assert len(want) == 3
    key = lambda r: str(r[0])
    assert sorted((tuple(r) for r in entry.queries()["block_pairs"](spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)


def test_neighbours_up_to_the_full_bound(spark):
    folder = "/root/testdata/sf0.1"  # the labels of the smaller folders hold fewer vectors than TOP_K
    c = duckdb.connect()
    want = c.execute(f"""WITH s AS (SELECT x.vec_id AS a, y.vec_id AS b, round({mq._DOT}, 9) AS s FROM '{folder}/embeddings.parquet' x JOIN '{folder}/embeddings.parquet' y ON x.label = y.label),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM s) SELECT a, b, place FROM k WHERE place <= 128 AND a < b""").fetchall()
    assert max(p for _, _, p in want) == 128
    assert rows(spark, folder, "knn_topk") == sorted(want)


def test_catalogue_is_matched_and_grouped(spark, folder):
    """Clusters by the narrow block equal union-find over the verdicts of whole categories, and hold no contradiction."""
    from weftline.operators import chain
    from weftline.plans.catalogue_queries import enriched
    from weftline.session import Store

    q = entry.queries()
    e = enriched(spark, folder)
    verdicts = q["catalogue_verdicts"](spark, folder).collect()
    assert {v.verdict for v in verdicts} >= {"veto", "review", "match"}
    store = Store(spark)
    reps = store.keep(chain.representatives(e).withColumn("block", chain.identity_block()))
    narrow = chain.verdicts(reps, "block", store, True).filter("verdict = 'match'").collect()
    assert {(v.p, v.q, v.confidence) for v in narrow} == {(v.p, v.q, v.confidence) for v in verdicts if v.verdict == "match"}
    got = {r.rec_id: r.cluster for r in q["catalogue_clusters"](spark, folder).collect()}
    assert len(got) == e.count()
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for v in verdicts:
        if v.verdict == "match":
            a, b = find(v.p), find(v.q)
            up[max(a, b)] = min(a, b)
    text = {r.rec_id: (r.t, r.complete) for r in e.select("rec_id", "t", "complete").collect()}
    rep = {r.t: r.rep for r in reps.select("t", "rep").collect()}
    coarse = {i: find(rep[t]) if c else i for i, (t, c) in text.items()}
    assert all(coarse[i] == coarse[g] for i, g in got.items())  # repair only splits
    assert len(set(got.values())) < len(got)
    m = {r.cluster: r for r in q["catalogue_masters"](spark, folder).collect()}
    assert set(m) == set(got.values()) and sum(r.members for r in m.values()) == len(got)
    assert len({r.nmc for r in m.values() if r.status != "PROVISIONAL"}) == sum(r.status != "PROVISIONAL" for r in m.values())


def test_records_that_differ_in_an_attribute_are_grouped(spark):
    from weftline.operators import chain, enrich
    from weftline.session import Store

    texts = ['gate valve 2" cl 150 ss316 flanged', 'gate valve 2" cl 150 ss316', 'gate valve 2" cl 300 ss316', "gate valve cl 150 ss316", "gate valve cl 150 ss316"]
    raw = [(i, 1, o, f"c{i}", t, "NOS", None, None, None) for i, (t, o) in enumerate(zip(texts, "ABABC"))]
    m = spark.createDataFrame(raw, "rec_id long, file_id long, cpse string, material_code string, description string, uom string, category_hint string, hsn_code string, last_rate_inr string")
    e = enrich.enrich(m)
    c = chain.clusters(e, Store(spark))
    assert {r.rec_id: r.cluster for r in c.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    got = {r.cluster: r for r in chain.masters(e, c).collect()}
    assert got[0].orgs == "A,B" and "END=FLG" in got[0].canon and got[0].status == "AUTO_MATCHED"
    assert got[2].status == "UNIQUE" and got[3].status == got[4].status == "PROVISIONAL" and got[3].nmc != got[4].nmc


def test_a_large_group_is_repaired_without_listing_its_pairs(spark):
    """A star of 30,000 agreeing texts (4.5e8 pairs) ends; groups that contradict are split as `graph.repair` splits them."""
    import random

    from pyspark.sql import functions as F

    from weftline.operators import chain, graph, matching
    from weftline.operators.enrich import KEYS
    from weftline.functions.dialect import SPARK
    from weftline.session import Store

    rnd, store = random.Random(5), Store(spark)
    texts = [(n, rnd.choice(["valve", "valve", "unknown"]), rnd.choice([None, "2", "2", "2,3", "3"]), rnd.choice([None, "150", "150", "150", "300"])) for n in range(60)]
    edges = sorted({tuple(sorted(rnd.sample(range(k, k + 10), 2))) for k in range(0, 60, 10) for _ in range(14)})
    big = [(n, "valve", "2", "150") for n in range(100, 30_100)]
    blank = {f"a_{k}": F.lit(None).cast("string") for k in KEYS}
    of = lambda rows: spark.createDataFrame(rows, "rep long, fine string, inch string, cl string").withColumns({"t": F.lit("x"), "times": F.lit(1), "category": F.lit("c"), **blank, "a_inch": F.col("inch"), "a_coil": F.col("cl")})
    link = lambda es: spark.createDataFrame([(a, b, rnd.randrange(5) / 5, f"{a}|{b}") for a, b in es], "a long, b long, confidence double, edge_id string")
    reps, links = of(texts + big), store.keep(link([*edges, *((100, n) for n in range(101, 30_100))]))
    got = {r.node: r.label for r in chain.repaired(graph.components(links.select("a", "b"), store), links, reps, store).collect()}
    assert all(got.pop(n) == 100 for n in range(100, 30_100))
    few = links.filter("a < 100")
    pairs = of(texts).select(F.col("rep").alias("p")).crossJoin(of(texts).select(F.col("rep").alias("q"))).filter("p < q")
    vetoes = store.keep(chain.both_sides(pairs, of(texts))).filter(F.expr(matching.conflicts(SPARK)) != "").select(F.col("p").alias("a"), F.col("q").alias("b"))
    assert got == {r.node: r.label for r in graph.repair(few, store.keep(vetoes), store).collect()}
    assert len(set(got.values())) > 6


def test_every_attribute_of_every_item_is_merged(spark, folder):
    from collections import Counter, defaultdict

    from weftline.operators.enrich import KEYS
    from weftline.plans.catalogue_queries import enriched

    q = entry.queries()
    cluster = {r.rec_id: r.cluster for r in q["catalogue_clusters"](spark, folder).collect()}
    seen = defaultdict(lambda: defaultdict(list))
    for r in sorted(enriched(spark, folder).collect(), key=lambda r: r.rec_id):
        for k in KEYS:
            if r[f"a_{k}"] is not None:
                seen[str(cluster[r.rec_id])][k].append(r[f"a_{k}"])
    want = {}
    for g, a in seen.items():
        best = {k: ",".join(sorted({x for v in vs for x in v.split(",")})) if k == "std" else Counter(vs).most_common(1)[0][0] for k, vs in a.items()}
        want[g] = ";".join(f"{k}={best[k]}" for k in sorted(best))
    got = dict(rows(spark, folder, "merge_attrs"))
    assert got == want


def _materials(spark, texts):
    raw = [(i, 1, "AB"[i % 2], f"c{i}", t, "NOS", None, None, "5") for i, t in enumerate(texts)]
    return spark.createDataFrame(raw, "rec_id long, file_id long, cpse string, material_code string, description string, uom string, category_hint string, hsn_code string, last_rate_inr string")


def test_a_block_is_grouped_in_one_task_or_in_tiles_alike(spark, folder, monkeypatch):
    """Groups of whole blocks equal those of tiles, and take few jobs, whose plans the driver holds."""
    from weftline.operators import chain
    from weftline.plans.catalogue_queries import enriched
    from weftline.session import Store

    e = enriched(spark, folder)
    spark.sparkContext.setJobGroup("clusters", "")
    want = sorted(tuple(r) for r in chain.masters(e, chain.clusters(e, Store(spark))).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("clusters"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 40
    monkeypatch.setattr(chain, "WHOLE", 2)
    assert sorted(tuple(r) for r in chain.masters(e, chain.clusters(e, Store(spark))).collect()) == want


def test_ratios_of_many_pairs_equal_those_of_one():
    import random

    import numpy as np

    from weftline.operators.similarity import indel_ratio, indel_ratios

    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcde ø") for _ in range(n)) for n in (0, 0, 1, 5, 63, 64, 65, 70, 127, 128, 129, 150, 200)]
    i, j = np.array([(a, b) for a in range(13) for b in range(13)]).T
    assert indel_ratios(texts, i, j, 50).tolist() == [indel_ratio(texts[a], texts[b]) for a, b in zip(i, j)]


def test_attributes_of_a_large_item_are_merged_in_time(spark):
    """A block of 3,000 texts has 4.5 million pairs without contradiction: compared one by one they take minutes. An incomplete record keeps its own."""
    import time

    from weftline.operators import chain, enrich
    from weftline.session import Store

    store = Store(spark)
    texts = [*(f"hex nut m33 grade 8 zinc plated din 934 lot a{n:04d}b" for n in range(3000)), "gasket iso 5678 din 1234 flanged", "nothing known"]
    e = store.keep(enrich.enrich(_materials(spark, texts)))
    began = time.time()
    got = dict(tuple(r) for r in chain.merged(e, store.keep(chain.clusters(e, store))).collect())
    assert time.time() - began < 60
    assert got.pop("3000") == "end=FLG;std=din 1234,iso 5678" and "3001" not in got
    assert set(got.values()) == {"finish=ZN;grade=8;material=ZN;std=din 934;thread=M33"}


def test_verdicts_are_judged_where_texts_are_compared(spark, folder, monkeypatch):
    """No candidate is written before it is judged, in whole categories or in groups of them; each verdict is that of `matching.verdicts`."""
    from pyspark.sql import functions as F

    from weftline.operators import chain, matching
    from weftline.plans.catalogue_queries import enriched
    from weftline.session import Store

    store = Store(spark)
    reps = store.keep(chain.representatives(enriched(spark, folder)))
    pairs = store.keep(chain.both_sides(chain.candidates(reps, "category", store), reps))
    many = F.when(F.col("p") == F.col("q"), F.expr("xn * (xn - 1) div 2")).otherwise(F.col("xn") * F.col("yn"))
    judged = matching.verdicts(pairs.withColumn("pair_id", F.struct("p", "q", many.alias("pairs"))))
    want = sorted(tuple(r) for r in judged.select("pair_id.*", "verdict", "reason", "confidence").collect())
    assert len(want) > reps.count() and {"match:high-sim", "review:insufficient-attributes"} <= {r[4] for r in want}
    kept, keep = [], Store.keep
    monkeypatch.setattr(Store, "keep", lambda self, df: (kept.append(keep(self, df)), kept[-1])[1])
    assert sorted(tuple(r) for r in chain.verdicts(reps, "category", store).collect()) == want
    monkeypatch.setattr(chain, "GROUP", 40)
    assert sorted(tuple(r) for r in chain.verdicts(reps, "category", store).collect()) == want
    assert all(df.count() <= reps.count() for df in kept)


def test_text_pairs_of_odd_parts(spark, tmp_path, monkeypatch):
    """Parts without brand, type or name have no pair but count in the idf, as in SQL; large categories are listed in groups alike."""
    from weftline.operators import similarity

    c = duckdb.connect()
    c.execute(f"""copy (select range as p_partkey, CASE WHEN range % 7 > 0 THEN 'hot galvanised steel bolt ' || ['red', 'blue', 'gilded copper anodised', 'dim'][1 + range % 4] END as p_name,
    CASE WHEN range % 5 > 0 THEN 'B' END as p_brand, CASE WHEN range % 3 > 0 THEN 'T' || (range % 2) END as p_type from range(200)) to '{tmp_path}/part.parquet'""")
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = sorted(c.execute(mq.ORACLE["tfidf_cosine_pairs"]).fetchall())
    assert len(want) > 1000
    assert rows(spark, str(tmp_path), "tfidf_cosine_pairs") == want
    monkeypatch.setattr(similarity, "RECORDS", 30)
    monkeypatch.setattr(similarity, "LISTED", 7)
    assert rows(spark, str(tmp_path), "tfidf_cosine_pairs") == want


def test_text_pairs_where_splits_have_no_rows(spark, tmp_path):
    """A row group is read in one split; the other splits of its file have no text, nor has an empty table."""
    c = duckdb.connect()
    for n in (300, 0):
        folder = tmp_path / str(n)
        folder.mkdir()
        c.execute(f"copy (select range as p_partkey, 'hot bolt ' || (range % 3) as p_name, 'B' as p_brand, 'T' || (range % 2) as p_type from range({n})) to '{folder}/part.parquet'")
        c.execute(f"create or replace view part as select * from '{folder}/part.parquet'")
        want = sorted(c.execute(mq.ORACLE["tfidf_cosine_pairs"]).fetchall())
        splits = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "0"}
        for k, v in splits.items():
            spark.conf.set(k, v)
        try:
            assert spark.read.parquet(f"{folder}/part.parquet").rdd.getNumPartitions() > 1 or not n
            assert rows(spark, str(folder), "tfidf_cosine_pairs") == want
        finally:
            for k in splits:
                spark.conf.unset(k)


def test_text_pairs_keep_the_keys_type_and_tell_texts_apart(spark, tmp_path):
    """Keys of 32 bits come out as such; a text with a NUL at its end is another text, as in SQL."""
    c = duckdb.connect()
    c.execute(f"copy (select range::int as p_partkey, ['hot bolt', 'hot bolt' || chr(0), 'hot nut'][1 + range % 3] as p_name, 'B' as p_brand, 'T' as p_type from range(12)) to '{tmp_path}/part.parquet'")
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = sorted(c.execute(mq.ORACLE["tfidf_cosine_pairs"]).fetchall())
    assert dict(entry.queries()["tfidf_cosine_pairs"](spark, str(tmp_path)).dtypes)["a"] == "int"
    assert len({s for _, _, s in want}) > 1  # all alike if the NUL is lost
    assert rows(spark, str(tmp_path), "tfidf_cosine_pairs") == want
