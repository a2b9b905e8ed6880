import csv

from weftline.plans import pipeline
from weftline.sources import sinks
from weftline.sources.extracts import read_extracts

NORTH = """material_code,description,uom,last_rate_inr
N-1,"Gate valve 2"" class 800 SS316 socket weld",NOS,"1,250.50"
N-2,"Gate valve 2"" class 300 SS316 socket weld",NOS,900
N-3,valve,NOS,
N-4,,NOS,5
"""
SOUTH = """UOM ,Description,MATERIAL_CODE,extra,cpse
EA,"Gate valve 2 inch class 800 SS 316 socket weld",S-1,x,SOUTHERN
EA,"=Gate valve
2 inch class 300 SS 316 socket weld",S-2,y,
"""


def extracts(folder):
    for name, text in (("north_materials.csv", NORTH), ("south_materials.csv", SOUTH), ("other.csv", "a,b\n1,2\n")):
        (folder / name).write_text(text)
    return str(folder)


def test_extracts_are_read_by_name(spark, tmp_path):
    rows = {(r.cpse, r.material_code): r for r in read_extracts(spark, extracts(tmp_path)).collect()}
    assert set(rows) == {("NORTH", "N-1"), ("NORTH", "N-2"), ("NORTH", "N-3"), ("NORTH", "N-4"), ("SOUTHERN", "S-1"), ("SOUTH", "S-2")}
    assert rows["NORTH", "N-1"].description == 'Gate valve 2" class 800 SS316 socket weld' and rows["NORTH", "N-1"].last_rate_inr == "1,250.50"
    assert rows["SOUTHERN", "S-1"].uom == "EA" and rows["SOUTHERN", "S-1"].last_rate_inr is None and "\n" in rows["SOUTH", "S-2"].description
    assert len({r.rec_id for r in rows.values()}) == 6
    (tmp_path / "none").mkdir()
    assert read_extracts(spark, str(tmp_path / "none")).count() == 0


def test_from_extracts_to_outputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    registry = pipeline.run(spark, extracts(tmp_path / "in"), str(tmp_path / "out"))
    code = {(r.cpse, r.material_code): r.nmc for r in registry.mapping.collect()}
    assert len(code) == 5  # the record without description is left out
    assert code["NORTH", "N-1"] == code["SOUTHERN", "S-1"] != code["NORTH", "N-2"] == code["SOUTH", "S-2"]
    masters = {r.nmc: r for r in registry.master.collect()}
    assert set(masters) == set(code.values()) and len(masters) == registry.master.count()
    assert masters[code["NORTH", "N-1"]].orgs == "NORTH,SOUTHERN" and masters[code["NORTH", "N-3"]].status != "AUTO_MATCHED"
    assert {(r.a_code, r.b_code) for r in registry.rejected.collect()} >= {("N-1", "N-2")}
    assert sum(registry.report().values()) > 0
    written = {}
    for name, columns in pipeline.OUTPUTS.items():
        lines = [line for p in (tmp_path / "out" / name).glob("*.csv") for line in csv.reader(p.open())]
        written[name] = lines
        assert not lines or lines[0] == columns
    assert any(cell.startswith("'=Gate") for line in written["mapping"] for cell in line)


def test_decisions_are_appended(spark, tmp_path):
    one = spark.createDataFrame([("A", "1", "APPROVED")], "cpse string, material_code string, decision string")
    sinks.append_decisions(one, str(tmp_path / "log"))
    sinks.append_decisions(one.replace("APPROVED", "REJECTED", "decision"), str(tmp_path / "log"))
    assert {r.decision for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {"APPROVED", "REJECTED"}
