import pytest

from weftline.functions import lexicon
from weftline.functions.catalogue import Parser, Speller, unit_of_issue, within_one
from weftline.operators import units
from weftline.session import Store

UOMS = [("KG", "Kilograms", "KGS;KGM;Kilo", "mass"), ("LTR", "Litres", "L;LTRS;Liter", "volume"), ("GAL", "US gallons", "Gallon", "volume"), ("MTR", "Metres", "Meter;M", "length"), ("NOS", "Numbers", "EA;N", "count"), ("LB", "Pounds", "LBS", "mass")]


def uoms(spark):
    return spark.createDataFrame([(*u, "clash") for u in UOMS], "uom_code string, uom_name string, aliases string, quantity_kind string, unit string")


def materials(spark, rows):
    schema = "rec_id long, description string, uom string, kind string, amount int, cpse string, material_code string"
    return spark.createDataFrame([(i, d, u, "x", 1, None if i % 5 == 4 else "ABC"[i % 3], f"c{i}") for i, (d, u) in enumerate(rows)], schema)


def contents(spark, rows):
    return {r.rec_id: (r.quantity_kind, r.amount) for r in units.contents(materials(spark, rows), uoms(spark)).collect()}


def test_contents(spark):
    rows = [
        ("gear oil - VG 46 - pail of 5.0 US gal - type 12345", "NOS"),
        ("gear oil - VG 46 - 12345 - pack 20 l", "NOS"),
        ("gear oil - VG 46 - can 1 - 12345", "gallons"),
        ("thread sealant; shade grey; 4 x 0.5 US qt; drg 12345", None),
        ("descaling powder, purity 95%, drg 21111", "LBS35"),
        ("hex bolt, m6x20, grade 8.8, zinc plated, 12345", "NOS"),
        (None, None),
        ("", ""),
        ("thread sealant; shade grey; 1/2 litres; drg 12345", "NOS"),
        ("power cable - 3c x 2.5 sqmm - PVC - 1100 V - 10 nos x 3000mm - 12345", "COIL"),
        ("x" * 150_000, "KG"),
        ("powder, descaling; purity 90%; net 0 kg; 12345", "NOS"),
    ]
    got = contents(spark, rows)
    assert got == {0: ("volume", 18927), 1: ("volume", 20000), 2: ("volume", 3785), 3: ("volume", 1893), 4: ("mass", 15876), 8: ("volume", 500), 9: ("length", 30000)}


def test_content_of_goods_named_like_pieces(spark):
    rows = [("pump coolant concentrate; net 5 kg", "NOS"), ("valve cleaner spray; can of 0.4 litre", "NOS"), ("bolt, hex head 8.8 m8 x 4 cm 88618", "NOS")]
    assert contents(spark, rows) == {0: ("mass", 5000), 1: ("volume", 400)}


def powders(k, *said):
    """Records of one product, told by its purity and number."""
    return [(f"descaling powder; purity {k % 97}%; drg {12000 + k}; {x}", u) for x, u in said]


CHAIN = ["kg", "zorka", "blint", "quivv", "mekko", "fludd", "garnz", "wuppo"]


@pytest.fixture(scope="module")
def learnt(spark):
    """(rows, contents, what each spelling was found to mean) of a corpus with spellings that no list knows."""
    chain = [r for i in range(7) for k in range(4) for r in powders(10 * i + k, (f"pack {k + 2}", CHAIN[i]), (f"pack {k + 2}", CHAIN[i + 1]))]
    # "grossk" weighs the drum of two kilograms too
    gross = [r for k in range(24) for r in powders(100 + k, (f"net {k + 2} kg", "NOS"), (f"pack {k + 4}", "grossk"))]
    # half of the entities come in a second amount
    other = [r for k in range(20) for r in powders(200 + k, (f"net {3 * k + 2} kg", "NOS"), (f"pack {(3 * k + 2) if k % 2 else 7 * k + 5}", "zork"))]
    rows = chain + gross + other
    store = Store(spark)
    read, _ = units.read_materials(materials(spark, rows), store)
    scales = units.learn_scales(units.statements(read), uoms(spark), store)
    got = {r.rec_id: (r.quantity_kind, r.amount) for r in units.measured(read, scales).filter("amount is not null").collect()}
    return rows, got, {r.unit: r for r in scales.collect()}


def test_scales_spread_along_a_chain_of_any_length(learnt):
    rows, got, scales = learnt
    assert {got[i] for i in range(56)} == {("mass", 1000 * k) for k in range(2, 6)}
    assert all(scales[u].how.endswith("linked") and scales[u].scale == "1000" for u in CHAIN[1:])


def test_a_source_with_an_offset_gets_no_scale(learnt):
    rows, got, scales = learnt
    assert [i for i in range(56, 104) if i in got] == list(range(56, 104, 2))
    assert scales["grossk"].how == "refused: offset" and scales["grossk"].scale is None


def test_another_amount_of_the_same_goods_does_not_mislead(learnt):
    assert learnt[2]["zork"].scale == "1000"


def test_every_pair_of_points_tells_the_slope(spark):
    """Of twenty sources with five points each, all on a shifted line, none is missed by how its points happen to be paired."""
    sources = [f"S{i:02d}" for i in range(20)]
    said = [(s, 10 * i + k, "mass", u, float(q)) for i, s in enumerate(sources) for k, x in enumerate((2, 3, 5, 7, 11)) for u, q in (("kg", x + 2), ("grossk", x))]
    stated = spark.createDataFrame(said, "source string, entity long, want string, unit string, q double")
    got = {(r.source, r.unit): (r.how, r.scale) for r in units.learn_scales(stated, uoms(spark), Store(spark)).collect()}
    assert got == {(s, u): v for s in sources for u, v in (("kg", ("anchor", "1000")), ("grossk", ("refused: offset", None)))}


def test_empty(spark):
    assert contents(spark, []) == {}


COUNTS = {"valve": 900, "ball": 300, "socket": 300, "weld": 400, "stainless": 100, "motor": 200, "wire": 500, "with": 80}


def test_features():
    p = Parser(COUNTS)
    a = p.features("BALL VALEV / NPS 1-1/2 / CL 800 / S.S. 316 / SOCKET SELD / TYPE 63/O88")
    b = p.features("valve ball type dn40 #800 aisi 316 skt weld uo-63 088")
    assert a[1] == b[1] == {"bore": "40", "rating": "800", "ends": "es", "material": "x6"} and a[2] == b[2] == ["63088"]
    assert a[0] == {"ball", "valve"}
    one, two = p.features("Induction motor - 10 HP - 4P - B3 - 0.415 kV - 12345"), p.features("motor, induction; 7.5kW; poles 4; foot mounted; 415 volts; drg 12 345")
    assert one[1] == two[1] and one[2] == two[2] == ["12345"]
    assert p.features("hex bolt, ref PO 36123, m8 x 10 cm, pc 8.8, zp, 24246")[2] == ["24246"]
    assert p.features("paint; colour: white; moc: s.s. 304")[0] == {"paint"}
    assert p.features("belt; make Zork")[0] == {"belt"}
    assert p.features(None) == (set(), {}, [], [], [])


def test_speller():
    s = Speller(COUNTS)
    assert [s.word(w) for w in ("vavle", "valves", "stainles", "wie", "motr", "zebra", "x" * 500)] == ["valve", "valve", "stainless", "wire", "motor", "zebra", "x" * 500]
    assert Speller({"coil": 30, "soil": 25}).word("coil") == "coil"


def test_kinds_are_put_together_by_votes():
    votes = {("a", "a"): 50, ("b", "b"): 50, ("a", "b"): 30, ("c", "c"): 160, ("b", "c"): 2, ("d", "d"): 10, ("a", "d"): 4, ("c", "d"): 4}
    kinds = lexicon.linked_names(votes)
    assert kinds["a"] == kinds["b"] != kinds["c"]
    assert kinds["d"] in (kinds["a"], kinds["c"])  # a name used of both ties them to nothing


def test_idle_words_stand_beside_everything():
    words = {"valve": 400, "nut": 300, "super": 100, "item": 1000}
    attributes = {"bore": 400, "thread": 300, "grade": 300, "rating": 400, "ends": 400, "material": 400}
    beside = {(w, a): n for w, own, n in (("valve", ("bore", "rating", "ends", "material"), 400), ("nut", ("thread", "grade"), 300)) for a in own}
    beside |= {("super", a): n // 10 for a, n in attributes.items()} | {("item", a): n for a, n in attributes.items()}
    assert lexicon.idle_words(words, beside, attributes, 1000) == {"super"}


def test_unit_of_issue():
    assert unit_of_issue("LTR-0.1") == ("0.1", "ltr")
    assert unit_of_issue("24.0 FT") == ("24", "ft")
    assert unit_of_issue("K.G.S.") == (None, "kgs")
    assert unit_of_issue("???") == (None, "")
    assert unit_of_issue(None) == (None, "")


def test_within_one():
    assert within_one("valve", "vavle") and within_one("valve", "vlve") and within_one("valve", "valvee") and within_one("valve", "velve")
    assert not within_one("valve", "vlavee")


def test_a_listing_of_many_names_votes(spark):
    """Twelve names of one listing vote for all their pairs, as its two do for theirs."""
    from weftline.operators import profiles

    order = [f"n{i:02d}" for i in range(12)]
    rows = [(1, n) for n in order] + [(2, "n00"), (2, "n01"), (2, "n01"), (3, "n05"), (4, "unknown"), (None, "n00"), (None, "n01")]
    table = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, i int")
    read = spark.createDataFrame(rows, "listing long, words string")
    got = profiles._votes(read, read["words"], "listing", table, order)
    want = {(a, b): 1 for a in order for b in order if a < b} | {("n01", "n01"): 1}
    want["n00", "n01"] = 2
    assert got == want
